"""Delta-maintained token counts by source, language and tokenizer version.

A rollup is a folder of signed, additive deltas. A
batch holds inserts (+), deletes (-) and revised counts (the old row with -,
the new one with +), summed by key. Its rows are written to a folder of their own; the batch is
committed by a marker file with its name, made so that it fails where there is one: of two
writers of a batch, or a writer and its replay, one is counted, and the other's rows go. Totals are
the sum over the committed batches. compact() writes the sum of all batches so far and a marker that lists them:
from then on totals read that sum and the batches after it, and the names stay known, so that replays of old batches
are still ignored.

Edge cases: null texts count 0 tokens, null sources and languages are keys of
their own. Repeated rows count as often as they stand. A delete of what was
never inserted gives negative totals, which show the fault. Empty batches commit without rows.
Columns other than those named, whatever their names, are ignored. A marker that a dying writer left empty commits nothing and holds its name until abandon().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import work_dir
from .tables import WORD, small_batches, table
from .tokens import encoder, public_path

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens", "n_chars")
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"
#: Versions counted by the registered query.
WORDS_V1, BPE_V1 = "words@1", "word_bpe_49k@1"


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs' (source, lang, n_chars, words, ids) in one pass over the texts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path).raw
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            ids = [len(x) // 4 for low in range(0, len(texts), 128) for x in encode(texts[low : low + 128])]
            yield pd.DataFrame({"source": b["source"], "lang": b["lang"], "n_chars": b["n_chars_"], "words": b["words_"], "ids": pd.Series(ids, index=b.index, dtype="int64")})

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text",
        F.char_length(text).cast("long").alias("n_chars_"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words_"),
    ).mapInPandas(counted, "source string, lang string, n_chars long, words long, ids long")


def deltas(docs: DataFrame, sign: int = 1, tokenizer_path: str | None = None, versions: tuple[str, ...] = (WORDS_V1, BPE_V1)) -> DataFrame:
    """Signed counts of docs by key, for the tokenizer versions named; words alone need no Python."""
    if BPE_V1 in versions:
        counted = count_tokens(docs, tokenizer_path or public_path("word_bpe_49k.json"))
    else:
        text = F.coalesce(F.col("text"), F.lit(""))
        counted = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.char_length(text).cast("long").alias("n_chars"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words"))
        counted = counted.withColumn("ids", F.lit(0).cast("long"))
    each = F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), F.col({WORDS_V1: "words", BPE_V1: "ids"}[v]).alias("n_tokens")) for v in versions])
    # partial sums before the versions are spread: a hot source is added up where it is read
    return (
        counted.groupBy("source", "lang")
        .agg(F.sum("words").alias("words"), F.sum("ids").alias("ids"), F.sum("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("n_docs"))
        .select("source", "lang", "n_docs", "n_chars", F.explode(each).alias("v"))
        .select("source", "lang", "v.tokenizer_version", (F.lit(sign) * F.col("n_docs")).alias("n_docs"), (F.lit(sign) * F.col("v.n_tokens")).alias("n_tokens"), (F.lit(sign) * F.col("n_chars")).alias("n_chars"))
    )


class DeltaRollup:
    """path/data/<id>: rows; path/commits/<batch>: a marker that holds the id of its data; path/compacted/<n>: one that holds an id and the batches it sums."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self.at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _read(self, marker: str) -> list[str]:
        """The lines of a marker, none if it is empty or missing."""
        at = self.at(f"{self.path}/{marker}")
        if not self.fs.exists(at):
            return []
        stream = self.fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode().split("\n")[:-1]
        finally:
            stream.close()

    def _mark(self, marker: str, lines: list[str]) -> bool:
        """Makes the marker; False if there is one."""
        try:
            stream = self.fs.create(self.at(f"{self.path}/{marker}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        stream.write(bytearray(("\n".join(lines) + "\n").encode()))
        stream.close()
        return True

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS]).write.parquet(f"{self.path}/data/{name}")
        return name

    def _drop(self, name: str) -> None:
        self.fs.delete(self.at(f"{self.path}/data/{name}"), True)

    def committed(self) -> list[str]:
        return [b for b in self._names("commits") if self._read(f"commits/{b}")]

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Whether the batch was committed; False if it had been before."""
        if self.fs.exists(self.at(f"{self.path}/commits/{batch_id}")):
            return False
        data = self._write(rows)
        if self._mark(f"commits/{batch_id}", [data]):
            return True
        self._drop(data)
        return False

    def abandon(self, batch_id: str) -> bool:
        """Frees the name of a batch whose writer died between making its marker and filling it."""
        if self._read(f"commits/{batch_id}"):
            return False
        return bool(self.fs.delete(self.at(f"{self.path}/commits/{batch_id}"), False))

    def _parts(self) -> tuple[list[str], list[str], int]:
        """(ids of the data that make up the totals, all batches in them, number of the last compaction)."""
        number, head, batches = 0, [], []
        for name in self._names("compacted"):
            if lines := self._read(f"compacted/{name}"):
                number, head, batches = int(name), lines[:1], lines[1:]
        held = set(batches)
        late = {b: x[0] for b in self._names("commits") if b not in held and (x := self._read(f"commits/{b}"))}
        return head + list(late.values()), batches + list(late), number

    def _sum(self, ids: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/data/{x}" for x in ids]) if ids else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])

    def compact(self) -> bool:
        """Sums all batches so far into one; False if another compaction came first. Old data stays for those who read it."""
        ids, batches, number = self._parts()
        data = self._write(self._sum(ids))
        if self._mark(f"compacted/{number + 1:010d}", [data, *batches]):
            return True
        self._drop(data)
        return False

    def totals(self) -> DataFrame:
        return self._sum(self._parts()[0]).where(" or ".join(f"{c} <> 0" for c in SUMS))


#: Of the history that the registered queries make: documents whose first text is a draft, and that are recorded under a wrong source first.
DRAFTS, MISPLACED = "pmod(doc_id, 20) = 3", "pmod(doc_id, 20) = 7"


def history(docs: DataFrame, rollup: DeltaRollup, versions: tuple[str, ...]) -> DataFrame:
    """Totals of docs (doc_id, source, lang, text) after a load, a revision, a delete, replays of each and a compaction between."""
    count = lambda rows, sign=1: deltas(rows.select("source", "lang", "text"), sign, versions=versions)
    draft = F.coalesce(F.expr(DRAFTS), F.lit(False))
    wrong = docs.where(MISPLACED).withColumn("source", F.lit("unsorted"))
    drafts = docs.where(DRAFTS).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" draft")))
    load = count(docs.where(~draft).unionByName(drafts).unionByName(wrong))
    rollup.commit("1-load", load)
    rollup.commit("1-load", load)
    rollup.commit("2-revise", count(drafts, -1).unionByName(count(docs.where(DRAFTS))))
    rollup.compact()
    rollup.commit("3-delete", count(wrong, -1))
    for batch in ("1-load", "2-revise", "3-delete"):
        rollup.commit(batch, load)
    return rollup.totals()


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents, reached by a history of inserts, revisions, deletes and replays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return history(docs, DeltaRollup(spark, f"{work_dir(spark)}/rollup-{uuid.uuid4().hex}"), (WORDS_V1, BPE_V1))


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for words alone, which SQL can count."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return history(docs, DeltaRollup(spark, f"{work_dir(spark)}/rollup-{uuid.uuid4().hex}"), (WORDS_V1,))


WORDS_SQL = r"""
SELECT source, lang, 'words@1' AS tokenizer_version, count(*)::BIGINT AS n_docs,
       sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens, sum(length(coalesce(text, '')))::BIGINT AS n_chars
FROM documents GROUP BY source, lang
"""
