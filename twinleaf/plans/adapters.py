"""Fragments from tables of texts: documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import n_lines


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fragments(rows: DataFrame, ord_column, path, language, kind: str, text) -> DataFrame:
    return rows.select(
        ord_column.cast("long").alias("ord"), F.concat(F.lit(f"{kind}-"), ord_column.cast("string")).alias("fragment_id"), path.alias("file_path"),
        language.alias("language"), F.lit(kind).alias("fragment_type"), F.lit(1).alias("start_line"), n_lines(text).alias("end_line"), text.alias("source_text"),
    )


def document_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document, in a folder per source."""
    return _fragments(read(spark, sf_dir, "documents"), F.col("doc_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.col("lang"), "file", F.coalesce("text", F.lit("")))


def document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file per document, and as a function within all its lines but the last."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    whole = _fragments(rows, F.col("doc_id") * 2, F.col("path"), F.lit("Python"), "file", F.col("text"))
    inner = rows.where(F.col("text").contains("\n")).withColumn("text", F.regexp_replace("text", r"\n[^\n]*\z", ""))
    return whole.unionByName(_fragments(inner, F.col("doc_id") * 2 + 1, F.col("path"), F.lit("Python"), "function", F.col("text")))


def page_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JavaScript file per page: markup full of quotes, slashes and comments."""
    return _fragments(read(spark, sf_dir, "pages"), F.col("page_id"), F.col("url"), F.lit("JavaScript"), "file", F.coalesce("html", F.lit("")))


#: Turns of a conversation at most, so that its fragments have numbers of their own.
TURNS = 1 << 20
#: Turns whose lines are added up in one task.
STRETCH = 1024


def conversation_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per conversation, and its turns as functions within.

    A turn's lines follow those before it: sums over stretches of turns first, so that no task adds up a whole hot conversation.
    """
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("lines", n_lines(F.col("text"))).withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    so_far = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.groupBy("conv_id", "stretch").agg(F.sum("lines").alias("n")).select("conv_id", "stretch", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "stretch").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.withColumn("end", F.sum("lines").over(within)).join(sums, ["conv_id", "stretch"]).withColumn("end_line", (F.col("before") + F.col("end")).cast("int"))
    first = F.col("conv_id") * TURNS
    number = F.when(F.col("turn").between(0, TURNS - 2), first + F.col("turn") + 1).otherwise(F.raise_error(F.lit("a conversation has too many turns")).cast("long"))
    inner = placed.select(
        number.alias("ord"), F.col("conv_id").cast("string").alias("file_path"), F.lit("function").alias("fragment_type"),
        (F.col("end_line") - F.col("lines") + 1).alias("start_line"), "end_line", F.col("text").alias("source_text"),
    )
    # a file is one row: its text is gathered, as any file's is
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text")).select(
        first.alias("ord"), F.col("conv_id").cast("string").alias("file_path"), F.lit("file").alias("fragment_type"),
        F.lit(1).alias("start_line"), n_lines(F.col("text")).alias("end_line"), F.col("text").alias("source_text"),
    )
    both = inner.unionByName(whole)
    return both.select("ord", F.concat_ws("-", "fragment_type", F.col("ord").cast("string")).alias("fragment_id"), "file_path", F.lit("Python").alias("language"), "fragment_type", "start_line", "end_line", "source_text")
