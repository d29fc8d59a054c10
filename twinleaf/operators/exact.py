"""Groups of equal fingerprints (clone types 1 and 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equal_groups(fragments: DataFrame, hash_column: str, clone_type: int) -> DataFrame:
    """(group_id, clone_type, representative_hash, ord): members of hashes that two fragments or more share.

    Counts come from a partial aggregate; members are found by a semi join, never gathered in a list,
    so that a hash of any number of copies stays spread.
    """
    rows = fragments.where(F.col(hash_column).isNotNull()).select("ord", F.col(hash_column).alias("representative_hash"))
    shared = rows.groupBy("representative_hash").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("representative_hash")
    return rows.join(shared, "representative_hash", "left_semi").select(F.concat(F.lit(f"t{clone_type}-"), "representative_hash").alias("group_id"), F.lit(clone_type).alias("clone_type"), "representative_hash", "ord")


def unassigned(fragments: DataFrame, members: DataFrame) -> DataFrame:
    """The fragments that no group of members holds."""
    return fragments.join(members.select("ord"), "ord", "left_anti")
