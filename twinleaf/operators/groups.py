"""From similar pairs to groups: components, container pruning, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .similarity import nested


def without_containers(members: DataFrame, fragments: DataFrame) -> DataFrame:
    """members (group_id, ord) without those that hold another member of their group.

    Of two nested members the longer goes; of equally long ones, the earlier.
    Every original member counts as a witness, also one that goes itself.
    """
    rows = members.join(fragments.select("ord", "file_path", "start_line", "end_line"), "ord").withColumn("span", F.col("end_line") - F.col("start_line"))
    outer, inner = rows.alias("x"), rows.alias("y")
    drops = (F.col("x.span") > F.col("y.span")) | ((F.col("x.span") == F.col("y.span")) & (F.col("x.ord") < F.col("y.ord")))
    kept = outer.join(inner, (F.col("x.group_id") == F.col("y.group_id")) & (F.col("x.file_path") == F.col("y.file_path")) & (F.col("x.ord") != F.col("y.ord")) & nested("x", "y") & drops, "left_anti")
    return kept.select("group_id", "ord")


def similar_groups(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(group_id, clone_type, similarity_score, ord) of pairs (a, b, score).

    The score is the least among the pairs whose two members survive, null if none does.
    """
    found = connected_components(pairs, "a", "b")
    members = found.select(F.concat(F.lit("t3-"), F.col("component").cast("string")).alias("group_id"), F.col("node").alias("ord"))
    kept = without_containers(members, fragments)
    sizes = kept.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("group_id")
    kept = kept.join(sizes, "group_id", "left_semi")
    scores = (
        pairs.join(kept.select(F.col("ord").alias("a"), "group_id"), "a")
        .join(kept.select(F.col("ord").alias("b")), "b", "left_semi")
        .groupBy("group_id").agg(F.min("score").alias("similarity_score"))
    )
    return kept.join(scores, "group_id", "left").select("group_id", F.lit(3).alias("clone_type"), "similarity_score", "ord")
