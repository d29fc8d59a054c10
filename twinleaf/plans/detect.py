"""Detection: exact, structural and similar groups of fragments."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import with_tokens
from ..operators.exact import equal_groups, unassigned
from ..operators.groups import similar_groups
from ..operators.similarity import OWN, similar_pairs, with_sets
from ..operators.storage import HASHES, materialize, release

MEMBERS = "group_id string, clone_type int, representative_hash string, similarity_score double, ord long"


@dataclass
class Detection:
    """members: one row per group and fragment, with the group's own values."""

    members: DataFrame

    @property
    def groups(self) -> DataFrame:
        return self.members.groupBy("group_id", "clone_type", "representative_hash", "similarity_score").agg(F.count(F.lit(1)).alias("n_members"))

    def counts(self) -> DataFrame:
        """One row: type1_groups, type2_groups, type3_groups."""
        each = self.members.select("group_id", "clone_type").distinct()
        return each.agg(*[F.count(F.when(F.col("clone_type") == t, 1)).alias(f"type{t}_groups") for t in (1, 2, 3)])


def detect(fragments: DataFrame, types: Collection[int] = (1, 2, 3), threshold: float = 0.8) -> Detection:
    """fragments: ord, file_path, language, start_line, end_line, source_text. A skipped type assigns nothing.

    A fragment of a type-1 group is in no type-2 group, and one of these in no type-3 group.
    """
    spark = fragments.sparkSession
    hashed = with_tokens(fragments, structural=2 in types)
    if 3 in types:
        hashed = with_sets(hashed)
    columns = ["ord", "file_path", "start_line", "end_line", "token_count", "raw_hash", *(["normalized_hash"] if 2 in types else []), *(["items", *OWN] if 3 in types else [])]
    whole = materialize(hashed.select(*columns), "fragments", options=HASHES)
    rows, held = whole.drop("items"), [whole]
    out = spark.createDataFrame([], MEMBERS)
    for kind, column in ((1, "raw_hash"), (2, "normalized_hash")):
        if kind in types:
            found = materialize(equal_groups(rows, column, kind), f"type{kind}")
            held.append(found)
            out = out.unionByName(found.withColumn("similarity_score", F.lit(None).cast("double")))
            rows = unassigned(rows, found)
    if 3 in types:
        rows = materialize(rows, "candidates")
        pairs = materialize(similar_pairs(rows, threshold, whole), "pairs")
        release(held.pop(0))
        out = out.unionByName(similar_groups(pairs, rows).withColumn("representative_hash", F.lit(None).cast("string")))
        held += [rows, pairs]
    members = materialize(out, "members")
    for used in held:
        release(used)
    return Detection(members)
