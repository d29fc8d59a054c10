"""Words, shingles and their 64-bit hashes for whole batches of texts, in numpy.

A word's hash is a polynomial over its bytes with random coefficients modulo
2^64, mixed; it is computed by prefix sums over slices of SLICE bytes, so
that a text of any length takes bounded memory beyond its own. A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
U = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
_BYTE[65:91] = _BYTE[97:123]
_R = 0x9E3779B97F4A7C1B  # 3 modulo 8: powers differ in their low bits
_RINV = pow(_R, -1, 1 << 64)
_FACTORS = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=U)
    out[1:] = U(base)
    return np.cumprod(out, dtype=U)


_POW: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, 2 * SLICE)
        _POW[:] = [_powers(_R, size), _powers(_RINV, size)]
        if size > 8 * SLICE:  # a single huge word: not kept
            out = _POW[0], _POW[1]
            _POW.clear()
            return out
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and len + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, (offsets - offsets[0] if len(offsets) else np.zeros(1, dtype=np.int64))


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a text's bounds end a word. blank: by byte, what parts words."""
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    ink = ~blank[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | first[1:])) + 1
    return starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=U)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(starts):
            base = starts[k]
            j = max(k + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
            span = int(ends[j - 1] - base)
            power, inverse = _tables(span)
            sums = np.zeros(span + 1, dtype=U)
            np.cumsum(_BYTE[data[base : base + span]] * power[:span], dtype=U, out=sums[1:])
            s, e = starts[k:j] - base, ends[k:j] - base
            out[k:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U) * U(0x9E3779B97F4A7C15))
            k = j
    return out


def shingle_hashes(words: np.ndarray, doc: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each k-word shingle in order; texts with fewer words give their whole sequence as one."""
    with np.errstate(over="ignore"):
        n = len(words)
        if n >= k:
            m = n - k + 1
            whole = doc[:m] == doc[k - 1 :]
            h = np.zeros(m, dtype=U)
            for i in range(k):
                h += words[i : i + m] * _FACTORS[i % 5] + U(i // 5)
            long_h, long_doc = mix(h[whole]), doc[:m][whole]
        else:
            long_h, long_doc = np.empty(0, dtype=U), np.empty(0, dtype=doc.dtype)
        if not n:
            return long_h, long_doc
        ids, first, size = np.unique(doc, return_index=True, return_counts=True)
        short = size < k
        if not short.any():
            return long_h, long_doc
        hs, ds = [], []
        for d, f, c in zip(ids[short], first[short], size[short], strict=True):
            x = U(0)
            for i in range(c):
                x = x + words[f + i] * _FACTORS[i]
            hs.append(mix(np.array([x + U(int(c) * 0x5851F42D4C957F2D % (1 << 64))], dtype=U))[0])
            ds.append(d)
        return np.concatenate([long_h, np.array(hs, dtype=U)]), np.concatenate([long_doc, np.array(ds, dtype=doc.dtype)])


def shingle_sets(column: pa.Array, k: int = 5):
    """Yields (row, sorted distinct shingle hashes) for each text with a word."""
    data, offsets = text_buffers(column)
    row, n = 0, len(column)
    while row < n:
        # slices of whole texts of about 4 MB
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + (1 << 22), side="right")) - 1)
        part, off = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        starts, ends = word_spans(part, off)
        doc = np.searchsorted(off, starts, side="right") - 1
        h, d = shingle_hashes(word_hashes(part, starts, ends), doc, k)
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
        cuts = np.flatnonzero(np.diff(d)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(d)]]), strict=True):
            if hi > lo:
                yield row + int(d[lo]), np.unique(h[lo:hi])
        row = end
