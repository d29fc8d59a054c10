"""Running counts of equal fingerprints over a stream of fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import fingerprint, tokens


def growing_groups(fragments: DataFrame) -> DataFrame:
    """(raw_hash, members, first_ord) of a stream of fragments (ord, source_text), for output mode update or complete.

    The state is one row per hash; a group is one whose members are two or more.
    """
    hashed = fragments.select("ord", fingerprint(tokens(F.col("source_text"))).alias("raw_hash"))
    return hashed.groupBy("raw_hash").agg(F.count(F.lit(1)).alias("members"), F.min("ord").alias("first_ord"))
