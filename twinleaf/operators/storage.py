"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session: spark.checkpoint.dir.

    Only a session on one machine that names none (tests, a laptop) uses a temporary folder;
    on a cluster each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"twinleaf-{os.getuid()}")
    return named.rstrip("/")


#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: For tables of hashes that come again: a dictionary of up to 16 MB for a column keeps them small.
HASHES = {"compression": "zstd", "parquet.dictionary.page.size": str(1 << 24)}


def materialize(df: DataFrame, name: str, by: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df as Parquet under work_dir and reads it back.

    The files survive lost executors and end the lineage; each call writes to
    a path of its own, so that a rerun never reads another run's rows. by: a column whose values get folders of their own; options: the writer's.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned_up(spark):
        df.write.options(**(options or {})).partitionBy(*([by] if by else [])).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._twinleaf_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Deletes the files behind a materialize()d frame that is read no more."""
    path = getattr(df, "_twinleaf_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
