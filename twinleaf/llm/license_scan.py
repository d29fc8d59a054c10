"""Licence scan: winnowed fingerprints pick candidates, banded alignment confirms them.

Schleimer, Wilkerson and Aiken, "Winnowing" (2003): of each WINDOW
consecutive hashes of GRAM words the smallest is kept, for templates and texts alike, so that
every shared run of WINDOW + GRAM - 1 words shares a kept hash. An inverted
index of the templates' hashes (bounded by the templates; broadcast with the
task) gives candidate places, which are chained across insertions and deletions. There a banded alignment of the words finds the
longest common subsequence within BAND words of the diagonal, and reports the
share of the template that it covers and the span in the text.

A template of at most LINE words has too few to spare: it counts only word for word. Of templates that match
overlapping words the one wins that fits best: most matched words, less those of the template and of the span that
aren't. So a licence isn't reported as another one that holds most of its words, nor a notice as a line of it.

Templates are a parameter, a table of names and texts of any length; those of license_texts are what stands for it.

Edge cases: null or empty texts give no row, nor do texts without a match of
at least LEAST_COVER. Every occurrence is a row of its own; repeated rows repeat
their rows. Of equally good overlapping matches the first by name stays. Words are runs of ASCII letters and digits and of all non-ASCII bytes; case and
punctuation play no part. Other columns, whatever their names, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .shingles import U, shingle_hashes, text_buffers, word_hashes, word_spans
from .tables import small_batches, table

GRAM, WINDOW, BAND = 3, 2, 8
LEAST_COVER = 0.8
#: Templates of up to so many words match word for word only.
LINE = 20
_PARTS = np.ones(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _PARTS[_lo:_hi] = False
RESULT = "doc_id long, license string, matched_words long, template_words long, coverage double, start_char long, end_char long"


def winnow(h: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places in h that winnowing keeps: the smallest of each window of a text, and of texts shorter than a window."""
    n = len(h)
    if not n:
        return np.empty(0, dtype=np.int64)
    keep = np.zeros(n, dtype=bool)
    if n >= window:
        views = np.lib.stride_tricks.sliding_window_view(h, window)
        whole = doc[: n - window + 1] == doc[window - 1 :]
        keep[(np.argmin(views, axis=1) + np.arange(len(views)))[whole]] = True
    ids, first, size = np.unique(doc, return_index=True, return_counts=True)
    for f, c in zip(first[size < window], size[size < window], strict=True):
        keep[f + int(np.argmin(h[f : f + c]))] = True
    return np.flatnonzero(keep)


def fingerprints(column: pa.Array):
    """(word hashes, starts, ends, text offsets, first word of each text, kept grams' hashes and first words)."""
    data, offsets = text_buffers(column)
    starts, ends = word_spans(data, offsets, _PARTS)
    words = word_hashes(data, starts, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n = len(words)
    whole = np.flatnonzero(doc[: max(0, n - GRAM + 1)] == doc[GRAM - 1 :]) if n >= GRAM else np.empty(0, dtype=np.int64)
    grams, owner = shingle_hashes(words, doc, GRAM)
    grams, owner = grams[: len(whole)], owner[: len(whole)]  # texts of fewer words have no gram
    kept = winnow(grams, owner)
    return data, offsets, starts, ends, words, doc, grams[kept], whole[kept]


class TemplateIndex:
    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        _, _, _, _, words, doc, h, at = fingerprints(pa.array(list(templates.values()), pa.string()))
        first = np.searchsorted(doc, np.arange(len(self.names) + 1))
        self.words = [words[first[k] : first[k + 1]] for k in range(len(self.names))]
        order = np.argsort(h, kind="stable")
        self.hashes, self.template = h[order], doc[at][order]
        self.place = (at - first[doc[at]])[order]


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(words matched, first and last matched word of text) of the longest common subsequence near text[i + shift] = template[i].

    Scores and the ends of the best path are carried row by row over 2 * band + 1 diagonals.
    """
    width = 2 * band + 1
    score = np.zeros(width, dtype=np.int64)
    start = np.full(width, -1, dtype=np.int64)
    last = np.full(width, -1, dtype=np.int64)
    for i in range(len(template)):
        j = np.arange(i + shift - band, i + shift + band + 1)
        inside = (j >= 0) & (j < len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[j[inside]] == template[i]
        # diagonal step; a template word skipped comes from the next diagonal of the row above
        take = score + same
        s_take = np.where(same & (start < 0), j, start)
        l_take = np.where(same, j, last)
        up = np.append(score[1:], -1)
        better = up > take
        score2 = np.where(better, up, take)
        start2 = np.where(better, np.append(start[1:], -1), s_take)
        last2 = np.where(better, np.append(last[1:], -1), l_take)
        for k in range(1, width):  # a text word skipped
            if score2[k - 1] > score2[k]:
                score2[k], start2[k], last2[k] = score2[k - 1], start2[k - 1], last2[k - 1]
        score, start, last = score2, start2, last2
    best = int(np.argmax(score))
    return int(score[best]), int(start[best]), int(last[best])


def chains(p: np.ndarray, q: np.ndarray, size: int, band: int) -> list[np.ndarray]:
    """Hits (text word p, template word q) as chains that rise in both, best first, none within the span of another.

    The shift p - q may change by the template's size from hit to hit, in short templates only by the band.
    """
    order = np.lexsort((q, p))
    p, q = p[order], q[order]
    reach = size if size > 3 * BAND else band
    score, back = np.ones(len(p)), np.full(len(p), -1)
    low = np.searchsorted(p, p - size - reach)
    for i in range(1, len(p)):
        j = np.arange(low[i], i)
        jump = np.abs((p[i] - q[i]) - (p[j] - q[j]))
        ok = (p[j] < p[i]) & (q[j] < q[i]) & (jump <= reach)
        if ok.any():
            gain = np.where(ok, score[j] - 0.001 * jump, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > 0:
                score[i], back[i] = 1 + gain[k], j[k]
    used = np.zeros(len(p), dtype=bool)
    out = []
    for i in np.argsort(-score, kind="stable"):
        chain = []
        while i >= 0 and not used[i]:
            chain.append(i)
            i = back[i]
        if chain:
            used[np.searchsorted(p, p[chain[-1]]) : np.searchsorted(p, p[chain[0]], side="right")] = True
            out.append(order[chain[::-1]])
    return out


def winners(rows: list[tuple]) -> list[tuple]:
    """Rows of one text (RESULT, then the words of the span) without those that overlap a better one."""
    out: list[tuple] = []
    for r in sorted(rows, key=lambda r: (r[3] + r[7] - 3 * r[2], r[1], r[5])):
        if not any(o[5] < r[6] and r[5] < o[6] for o in out):
            out.append(r)
    return [r[:7] for r in sorted(out, key=lambda r: r[5])]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least_cover: float = LEAST_COVER) -> DataFrame:
    """docs (doc_id, text) as RESULT rows, one per occurrence of a template."""
    templates = TEMPLATES if templates is None else templates

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates)
        names = ["doc_id", "license", "matched_words", "template_words", "coverage", "start_char", "end_char"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        for b in batches:
            rows: list[tuple] = []
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                data, offsets, starts, ends, words, doc, h, at = fingerprints(part.column(1))
                if not len(h) or not len(index.hashes):
                    continue
                lo, hi = np.searchsorted(index.hashes, h, side="left"), np.searchsorted(index.hashes, h, side="right")
                hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for k in np.flatnonzero(hi > lo):
                    d = int(doc[at[k]])
                    for e in range(lo[k], hi[k]):
                        hits.setdefault((d, int(index.template[e])), []).append((int(at[k]), int(index.place[e])))
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                own: dict[int, list[tuple]] = {}
                for (d, t), pairs in hits.items():
                    text = words[first[d] : first[d + 1]]
                    template = index.words[t]
                    done = -1
                    # a short template's band must not reach its next occurrence
                    band = min(BAND, max(1, len(template) // 3))
                    p, q = np.array(pairs).T
                    p = p - int(first[d])
                    for chain in sorted(chains(p, q, len(template), band), key=lambda c: p[c[0]]):
                        shifts = p[chain] - q[chain]
                        least, most = int(shifts.min()), int(shifts.max())
                        # one shift is the median over hits; more are all within the band
                        shift, wide = (int(np.median(shifts)), band) if most - least <= band else ((least + most) // 2, (most - least + 1) // 2 + band)
                        base = max(0, shift - wide, done + 1)
                        window = text[base : shift + len(template) + wide + 1]
                        n, s, e = align(template, window, shift - base, wide)
                        if n < least_cover * len(template) or len(template) <= LINE and not (n == len(template) == e - s + 1):
                            continue
                        done = e + base
                        a, z = starts[first[d] + s + base], ends[first[d] + done]
                        begin = int(offsets[d])
                        before = len(data[begin:a].tobytes().decode("utf-8", "replace"))
                        inside = len(data[a:z].tobytes().decode("utf-8", "replace"))
                        own.setdefault(d, []).append((part.column(0)[d].as_py(), index.names[t], n, len(template), n / len(template), before, before + inside, e - s + 1))
                for found_in in own.values():
                    rows += winners(found_in)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(7)], names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, RESULT)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
