"""Language identification by words first, with a back-off to character n-grams.

A known word scores its log frequency in each language. An unseen word is
scored by its character 4-grams; if no language knows any of these, by its
3-grams, then 2-grams, then single letters. A text's score is the sum over all of
its words; the softmax of the scores over the root of the number of words gives a
confidence from 0 to 1. A word is a run of letters, in lower case.

The model is fitted on SAMPLE_DOCS different labelled documents at most (those with the
smallest hashes), one row of each, and keeps the MOST_WORDS most frequent (word, language)
pairs: both bounds are parameters, and so the broadcast model, two sorted lists of strings
with a matrix each, has a bounded size. Every text is scored whole.

Edge cases: a null text, or one without a letter, is `und` with score 0. With no labelled
rows, or an empty table, every text is `und` with score 0. Ties go to the language first in order.
Rows are scored one by one: repeated ids and other columns play no part. In training repeated rows
count once, and of an id with several texts the one with the least hash; rows without an id are told apart by their texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .tables import fresh_name, small_batches, table

SAMPLE_DOCS = 4000
MOST_WORDS = 120_000
LONGEST_GRAM = 4
UNKNOWN = "und"
#: Below this confidence the pipeline's stage rejects a document.
LEAST_SCORE = 0.5
#: Bytes of text that are taken apart at once; one text alone may be longer.
SLICE = 1 << 20


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in order, first word of each text and the end)."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), r"[^\p{L}]+")
    flat = parts.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    offsets = parts.offsets.to_numpy()
    return flat.filter(keep), before[offsets - offsets[0]]


def slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about SLICE bytes."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(size, size[row] + SLICE, side="right")) - 1)
        yield row, column.slice(row, end - row)
        row = end


@dataclass
class BackoffModel:
    """Log frequencies by word and by n-gram: a list of strings and a matrix with a row for each."""

    langs: list[str]
    words: pa.Array
    word_logs: np.ndarray
    grams: pa.Array
    gram_logs: np.ndarray

    @classmethod
    def fit(cls, counted: list[tuple[str, str, int]]) -> BackoffModel:
        """counted: (lang, word, count)."""
        langs = sorted({lang for lang, _, _ in counted})
        at = {lang: k for k, lang in enumerate(langs)}
        seen: dict[str, np.ndarray] = {}
        pieces: list[Counter] = [Counter() for _ in langs]
        for lang, word, n in counted:
            seen.setdefault(word, np.zeros(len(langs)))[at[lang]] += n
            for k in range(1, LONGEST_GRAM + 1):
                for g in grams(word, k):
                    pieces[at[lang]][g] += n
        words, every = sorted(seen), sorted(set().union(*pieces))
        counts = np.array([seen[w] for w in words]).reshape(len(words), len(langs))
        by_size = np.array([[sum(c for g, c in p.items() if len(g) == k) + 1 for p in pieces] for k in range(1, LONGEST_GRAM + 1)], dtype=float)
        n = np.array([[p[g] for p in pieces] for g in every], dtype=float).reshape(len(every), len(langs))
        size = np.array([len(g) for g in every], dtype=np.intp) - 1
        return cls(langs, pa.array(words, pa.large_string()), np.log((counts + 0.5) / (counts.sum(axis=0) + 1)), pa.array(every, pa.large_string()), np.log((n + 0.5) / by_size[size]) if every else n)

    def unseen(self, words: list[str]) -> np.ndarray:
        """Rows of words that the list lacks: the mean over the longest n-grams of which any is known."""
        out = np.zeros((len(words), len(self.langs)))
        rest = np.arange(len(words))
        for n in range(LONGEST_GRAM, 0, -1):
            cut = [grams(words[k], n) for k in rest]
            owner = np.repeat(np.arange(len(rest)), [len(x) for x in cut])
            place = pc.index_in(pa.array([g for x in cut for g in x], pa.large_string()), self.grams)
            known = pc.is_valid(place).to_numpy(zero_copy_only=False)
            place, owner = place.drop_null().to_numpy(), owner[known]
            total = np.zeros((len(rest), len(self.langs)))
            np.add.at(total, owner, self.gram_logs[place])
            times = np.bincount(owner, minlength=len(rest))
            found = times > 0
            out[rest[found]] = total[found] / times[found, None]
            rest = rest[~found]
            if not len(rest):
                break
        return out

    def vectors(self, words: pa.Array) -> np.ndarray:
        """A row of log frequencies for each of different words."""
        place = pc.index_in(words, self.words)
        known = pc.is_valid(place).to_numpy(zero_copy_only=False)
        out = np.empty((len(words), len(self.langs)))
        out[known] = self.word_logs[place.drop_null().to_numpy()]
        if not known.all():
            out[~known] = self.unseen(words.filter(pa.array(~known)).to_pylist())
        return out

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages, number of words): sums over all words."""
        words, cut = words_of(texts)
        n = np.diff(cut)
        out = np.zeros((len(texts), len(self.langs)))
        if len(words) and self.langs:
            coded = words.dictionary_encode()
            each = self.vectors(coded.dictionary)[coded.indices.to_numpy()]
            some = n > 0
            out[some] = np.add.reduceat(each, cut[:-1][some], axis=0)
        return out, n

    def predict_all(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        names, confidence = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for low, part in slices(texts):
            s, n = self.scores(part)
            told = np.flatnonzero((n > 0) & bool(self.langs))
            if not len(told):
                continue
            s = s[told] / np.sqrt(n[told])[:, None]
            e = np.exp(s - s.max(axis=1, keepdims=True))
            best = np.argmax(s, axis=1)
            confidence[low + told] = e[np.arange(len(told)), best] / e.sum(axis=1)
            for k, b in zip(told.tolist(), best.tolist(), strict=True):
                names[low + k] = self.langs[b]
        return names, confidence

    def predict(self, text: str | None) -> tuple[str, float]:
        names, confidence = self.predict_all(pa.array([text], pa.string()))
        return names[0], float(confidence[0])


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of docs (lang, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, part in slices(b.column(1)):
                words, cut = words_of(part)
                lang = b.column(0).slice(low, len(part)).take(pa.array(np.repeat(np.arange(len(part)), np.diff(cut))))
                n = pa.table([lang, words.cast(pa.string())], names=["lang", "word"]).group_by(["lang", "word"]).aggregate([([], "count_all")])
                yield from n.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).combine_chunks().to_batches()

    return docs.select("lang", "text").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def sample(labelled: DataFrame, docs: int) -> DataFrame:
    """(lang, text) of at most docs different documents, those with the least hashes of their ids, one row each.

    A hash below a bound lets through about twice as many ids as wanted, whatever their number; the
    bound rises until enough are found or all have passed. So no table of ids is gathered.
    """
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rows = labelled.where("lang is not null and text is not null").withColumn("k", F.shiftrightunsigned(key, 1))
    n = max(1, rows.select(F.approx_count_distinct("doc_id")).first()[0])
    small_batches(labelled.sparkSession)
    least = F.min(F.struct(F.xxhash64("text", "lang").alias("h"), "lang", "text")).alias("row")
    bound = min(1.0, 2 * docs / n)
    while True:
        passed = rows.where(F.col("k") <= F.lit(min((1 << 63) - 1, int(bound * (1 << 63)))))
        if bound >= 1 or passed.select("k").distinct().limit(docs).count() >= docs:
            return passed.groupBy("k").agg(least).orderBy("k").limit(docs).select("row.lang", "row.text")
        bound = min(1.0, bound * 16)


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, most_words: int = MOST_WORDS) -> BackoffModel:
    """labelled: (doc_id, text, lang). The bounds are those of the sample and of the model."""
    top = word_counts(sample(labelled, sample_docs)).orderBy(F.desc("n"), "lang", "word").limit(most_words)
    return BackoffModel.fit([(r.lang, r.word, r.n) for r in top.collect()])


def identify(docs: DataFrame, model: BackoffModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (underscores before a name that docs has)."""
    lang, score = fresh_name(docs, "lang_pred"), fresh_name(docs, "score")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # in Arrow, so that other columns pass as they are, whatever their types
    schema = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    at = docs.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, confidence = shared.value.predict_all(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(confidence)], names=[*b.schema.names, lang, score])

    return docs.mapInArrow(predict, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on_own(docs: DataFrame) -> BackoffModel:
    """The model of docs' labelled rows outside the held-out third."""
    return train(docs.where(~held_out()).select("doc_id", "text", "lang"))


def language_filter(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is told with confidence, with docs' own columns."""
    model = train_on_own(docs)
    lang, score = fresh_name(docs, "lang_pred"), fresh_name(docs, "score")
    return identify(docs, model).where((F.col(lang) != UNKNOWN) & (F.col(score) >= least_score)).drop(lang, score)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_on_own(docs.select("doc_id", "text", "lang"))
    # lang and source never reach the prediction
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
