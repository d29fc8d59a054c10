"""Exact ids of a public tokenizer, with the encodings of recurring words kept.

word_bpe_49k cuts a text into runs of letters, single digits and runs of other
signs, drops white space and encodes each piece for itself. So the ids of a
text are those of its pieces, one after the other; a piece's ids are computed
by the library once and kept in a table of bounded size. This holds for texts
of Latin letters, where lower case and composition are a matter of single
characters; any other text goes to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

#: Pieces in each of a worker's two generations: what a full generation saw and the one before it are kept.
KEPT = 150_000
#: Pieces encoded in one call of the library.
LOT = 512
#: The characters up to U+024F of a general category: what \\p{L} and \\p{N} mean for Latin texts.
_LETTERS, _NUMBERS = ("".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
#: How the tokenizer cuts a text (fixed by its file), for such texts.
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
#: A character for which the rule above isn't relied on.
OTHER = re.compile("[^\t-\r\x20-\x7e\xa1-įı-ɏ]")
SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>", re.I)
#: A piece this long is encoded but not kept.
LONG = 64


class PieceEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        """ids of different pieces, parted by spaces, LOT at a call; a piece ends where an id ends a word."""
        out: dict[str, bytes] = {}
        for low in range(0, len(pieces), LOT):
            lot = pieces[low : low + LOT]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(lot)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(lot) or ends[-1] != len(ids):
                out.update((p, self.whole(p).tobytes()) for p in lot)
                continue
            raw, at = ids.tobytes(), (ends * 4).tolist()
            out.update((p, raw[x:y]) for p, x, y in zip(lot, [0, *at], at))
        return out

    def ids(self, text: str | None) -> np.ndarray:
        """All ids of the text, as little-endian unsigned 32-bit numbers."""
        return np.frombuffer(self.raw([text])[0], dtype="<u4")

    def raw(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; the pieces unknown so far are encoded in one call."""
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        for k, text in enumerate(texts):
            if not text:
                continue
            if OTHER.search(text) or SPECIAL.search(text):
                out[k] = self.whole(text).tobytes()
            else:
                cut.append((k, PIECE.findall(text.lower())))
        known, older = self.known, self.older
        missing = set().union(*(pieces for _, pieces in cut)).difference(known)
        new = [p for p in missing if p not in older]
        known.update((p, older[p]) for p in missing.difference(new))
        if new:
            known.update(self._encode(new))
        get = known.__getitem__
        for k, pieces in cut:
            out[k] = b"".join(map(get, pieces))
        for p in new:
            if len(p) > LONG:
                del known[p]
        if len(known) > KEPT:
            self.known, self.older = {}, known
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
