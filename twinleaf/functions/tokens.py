"""Tokens, normalised tokens and fingerprints of source texts.

Tokens, hashes and counts are JVM expressions. The numbering of identifiers
needs each one's first place among those before it: as windows that is three
shuffles of all tokens. normalise() is therefore an Arrow function, without a shuffle: a batch's
tokens are coded as one flat array, each different one is judged once, and
the numbers come from sorted codes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .keywords import KEYWORDS

_WIDE_BLANKS = r"\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Strings, comments, numbers, names, then any other visible character. Unrolled and possessive: no recursion on long literals.
TOKEN = (
    r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"' r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'" r"|`[^`\\]*+(?:\\.[^`\\]*+)*+`"
    r"|//[^\n]*+|/\*.*?\*/|[0-9]++(?:\.[0-9]++)?+|[a-zA-Z_$][a-zA-Z0-9_$]*+|[^\s" + _WIDE_BLANKS + "]"
)


def tokens(text: Column) -> Column:
    """The raw tokens of a text, comments included; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def fingerprint(token_array: Column) -> Column:
    """SHA-256, in hex, of the tokens joined by a bar."""
    return F.sha2(F.array_join(token_array, "|"), 256)


def n_lines(text: Column) -> Column:
    """Line feeds of a text, plus one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def normalised(raw: list[str], language: str | None) -> list[str]:
    """Names become ID_k by first place, literals LIT_k in turn, comments go; all else stays."""
    words = KEYWORDS.get(language or "", frozenset())
    ids: dict[str, int] = {}
    literals = 0
    out = []
    for t in raw:
        if t.startswith("//") or (t.startswith("/*") and t.endswith("*/")):
            continue
        c = t[0]
        if (c.isalpha() or c == "_") and t not in words:
            out.append(f"ID_{ids.setdefault(t, len(ids))}")
        elif c in "\"'`0123456789":
            out.append(f"LIT_{literals}")
            literals += 1
        else:
            out.append(t)
    return out


def normalised_batch(raw: pa.Array, language: pa.Array) -> pa.Array:
    """normalised() of a whole batch: raw (list of strings), language (string)."""
    raw = pc.fill_null(raw, []) if raw.null_count else raw
    sizes = np.diff(raw.offsets.to_numpy())
    coded = raw.flatten().dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if not len(code):
        return raw
    row = np.repeat(np.arange(len(sizes)), sizes)
    comment = np.array([t.startswith("//") or (t.startswith("/*") and t.endswith("*/")) for t in words])
    name = np.array([t[0].isalpha() or t[0] == "_" for t in words])
    literal = np.array([t[0] in "\"'`0123456789" for t in words])
    kinds = language.dictionary_encode()
    kept_as_is = np.array([[t in KEYWORDS.get(x or "", ()) for t in words] for x in [*kinds.dictionary.to_pylist(), None]])
    lang = kinds.indices.fill_null(len(kinds.dictionary)).to_numpy()[row]
    keep = ~comment[code]
    code, row, lang = code[keep], row[keep], lang[keep]
    is_id = name[code] & ~kept_as_is[lang, code]
    is_literal = literal[code] & ~is_id
    n = len(words)
    out = code.astype(np.int64)
    # names: the order of first places within a row
    key, first, back = np.unique(row[is_id].astype(np.int64) * n + code[is_id], return_index=True, return_inverse=True)
    place = np.empty(len(key), dtype=np.int64)
    place[np.argsort(first, kind="stable")] = np.arange(len(key))
    owner = key // n if n else key
    before = np.searchsorted(owner, owner, side="left")
    ids = (place - before)[back]
    # literals: their own order within a row
    owner = row[is_literal]
    literals = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
    most_ids, most_literals = (int(x.max()) + 1 if len(x) else 0 for x in (ids, literals))
    out[is_id] = n + ids
    out[is_literal] = n + most_ids + literals
    labels = pa.array([*words, *(f"ID_{k}" for k in range(most_ids)), *(f"LIT_{k}" for k in range(most_literals))], pa.string())
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), labels.take(pa.array(out)))


@F.arrow_udf(ArrayType(StringType()))
def normalise(raw: pa.Array, language: pa.Array) -> pa.Array:
    return normalised_batch(raw, language)


def with_tokens(fragments: DataFrame, structural: bool = True) -> DataFrame:
    """fragments with tokens, token_count, raw_hash and, if structural, normalized_hash."""
    out = fragments.withColumn("tokens", tokens(F.col("source_text")))
    if structural:
        out = out.withColumn("normalized_tokens", normalise("tokens", "language")).withColumn("normalized_hash", fingerprint(F.col("normalized_tokens")))
    return out.withColumns({"token_count": F.size("tokens"), "raw_hash": fingerprint(F.col("tokens"))})
