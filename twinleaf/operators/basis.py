"""Restriction of groups to those that touch a reference set of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches_suffix(path: Column, target: str) -> Column:
    """Whether the path ends in the target's segments, letter case aside."""
    parts = [p for p in target.replace("\\", "/").split("/") if p not in ("", ".")]
    segments = F.filter(F.split(F.lower(path), "/"), lambda s: s != "")
    tail = F.when(F.size(segments) >= len(parts), F.slice(segments, F.greatest(F.size(segments) - len(parts) + 1, F.lit(1)), len(parts)))
    return F.coalesce(tail == F.array(*[F.lit(p.lower()) for p in parts]), F.lit(False)) if parts else F.lit(True)


def is_basis(path: Column, files: list[str], directories: list[str], suffixes: list[str]) -> Column:
    """Absolute files by equality, directories by containment, relative targets by their last segments."""
    out = path.isin(files) if files else F.lit(False)
    for d in directories:
        out = out | path.startswith(d.rstrip("/") + "/")
    for s in suffixes:
        out = out | matches_suffix(path, s)
    return out


def with_basis(fragments: DataFrame, files: list[str], directories: list[str], suffixes: list[str]) -> DataFrame:
    """fragments (file_path, ...) with is_basis, for any number of targets: a path's own name, folders and endings are joined with them.

    Folder and file targets are paths; endings are joined without letter case. Without targets nothing is in the basis.
    """
    spark = fragments.sparkSession
    parts = lambda p: "/".join(x for x in p.replace("\\", "/").lower().split("/") if x not in ("", "."))
    if any(not parts(x) for x in suffixes):
        return fragments.withColumn("is_basis", F.lit(True))
    targets = [("f", x) for x in files] + [("d", x.rstrip("/")) for x in directories] + [("s", parts(x)) for x in suffixes]
    wanted = spark.createDataFrame(sorted(set(targets)), "kind string, target string")
    paths = fragments.select("file_path").distinct()
    segments = F.filter(F.split(F.lower("file_path"), "/"), lambda x: x != "")
    at = F.split("file_path", "/")
    endings = F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))), lambda k: F.struct(F.lit("s").alias("kind"), F.array_join(F.slice(segments, -k, k), "/").alias("target")))
    folders = F.when(F.size(at) > 1, F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda k: F.struct(F.lit("d").alias("kind"), F.array_join(F.slice(at, F.lit(1), k), "/").alias("target")))).otherwise(
        F.array().cast("array<struct<kind:string,target:string>>")
    )
    own = F.array(F.struct(F.lit("f").alias("kind"), F.col("file_path").alias("target")))
    hit = paths.select("file_path", F.explode(F.concat(own, folders, F.when(F.size(segments) > 0, endings).otherwise(F.array().cast("array<struct<kind:string,target:string>>")))).alias("t")).select("file_path", "t.*")
    hit = hit.join(wanted, ["kind", "target"], "left_semi").select("file_path").distinct().withColumn("is_basis", F.lit(True))
    return fragments.join(hit, "file_path", "left").withColumn("is_basis", F.coalesce("is_basis", F.lit(False)))


def basis_groups(members: DataFrame) -> DataFrame:
    """(group_id, clone_type, basis_internal) of members (group_id, clone_type, is_basis): groups with a basis member."""
    return (
        members.groupBy("group_id", "clone_type")
        .agg(F.bool_or("is_basis").alias("touches"), F.bool_and("is_basis").alias("basis_internal"))
        .where("touches").drop("touches")
    )


def basis_counts(groups: DataFrame) -> DataFrame:
    """One row: basis_type1_groups, basis_type2_groups, basis_type3_groups."""
    return groups.agg(*[F.count(F.when(F.col("clone_type") == t, 1)).alias(f"basis_type{t}_groups") for t in (1, 2, 3)])
