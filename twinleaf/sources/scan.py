"""Scanning trees of source files.

Folders are listed level by level, each level in one distributed pass, and what is excluded is not entered. The
kept paths are ranked without their contents; then the files are read where they are needed, and one that can't be read is marked and
left out, as is a folder that can't be listed. Spark's own file readers aren't used, as they pass over
names that start with an underscore or a dot, such as __init__.py.
"""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keywords import LANGUAGES
from ..operators.storage import materialize

LOG = logging.getLogger(__name__)
FILES = "file_ord long, path string, language string, content binary"
#: Files that one task reads, about, and bytes of them that it hands on at once.
PER_TASK, LOT = 200, 8 << 20
#: Folder names below a root that are never entered (fixed values).
EXCLUDED = (
    ".git", ".svn", ".hg", ".venv", "venv", "env", ".env", "__pycache__", "node_modules", "build", "dist", "target", "out", ".tox", ".pytest_cache", "htmlcov",
    ".mypy_cache", ".ruff_cache",
)


def extension(path: Column) -> Column:
    """The last suffix, lower case, of a path's name; a dot that starts the name starts no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    """The language by extension, null if none is known."""
    out = F.lit(None).cast("string")
    for language in dict.fromkeys(LANGUAGES.values()):
        out = F.when(extension(path).isin([e for e, x in LANGUAGES.items() if x == language]), F.lit(language)).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """A Java regular expression for a shell pattern; `*` crosses folders."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", k + (pattern[k : k + 1] in "!^") + 1)) > 0:
            body = pattern[k:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            k = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def glob_matches(path: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


class IgnoreRules:
    """Rules of a gitignore file, applied to paths below an anchor: the last rule that matches decides."""

    def __init__(self, lines: Sequence[str], anchor: str) -> None:
        self.anchor = anchor.rstrip("/")
        self.rules: list[tuple[str, bool, bool]] = []  # regex, negated, folders only
        for line in lines:
            line = line.rstrip("\n").rstrip()
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line
            line = line[1:] if line[:2] in ("\\!", "\\#") else line
            folder = line.endswith("/")
            line = line.rstrip("/")
            rooted = "/" in line
            self.rules.append((self._regex(line.lstrip("/"), rooted), negated, folder))

    @staticmethod
    def _regex(pattern: str, rooted: bool) -> str:
        out, k = "" if rooted else "(?:.*/)?", 0
        while k < len(pattern):
            if pattern.startswith("**/", k):
                out, k = out + "(?:.*/)?", k + 3
            elif pattern.startswith("/**", k) and k + 3 == len(pattern):
                out, k = out + "/.+", k + 3
            elif pattern[k] == "*":
                while pattern[k : k + 1] == "*":
                    k += 1
                out += "[^/]*"
            elif pattern[k] == "?":
                out, k = out + "[^/]", k + 1
            elif pattern[k] == "[" and (end := pattern.find("]", k + 2)) > 0:
                body = pattern[k + 1 : end]
                out, k = out + f"[{'^' + body[1:] if body[0] == '!' else body}]", end + 1
            else:
                out, k = out + re.escape(pattern[k]), k + 1
        return f"^{out}$"

    def _decides(self, relative: Column, is_folder: bool) -> Column:
        out = F.lit(False)
        for regex, negated, folder in self.rules:
            if is_folder or not folder:
                out = F.when(relative.rlike(regex), F.lit(not negated)).otherwise(out)
        return out

    def ignores(self, path: Column, folder: bool = False) -> Column:
        """Whether the file, or folder, or a folder above it, below the anchor, is ignored."""
        relative = F.substring(path, len(self.anchor) + 2, 1_000_000)
        parts = F.split(relative, "/")
        above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
        return path.startswith(self.anchor + "/") & (self._decides(relative, folder) | F.exists(above, lambda p: self._decides(p, True)))


def is_local(path: str) -> bool:
    return "://" not in path


def resolve(root: str) -> str:
    """The path with links followed, where it is local; the URI elsewhere."""
    if root.startswith("file:"):
        root = urlparse(root).path
    return os.path.realpath(root) if is_local(root) else root.rstrip("/")


def kind_of(path: str) -> str | None:
    """file, folder or None."""
    if is_local(path):
        return "folder" if os.path.isdir(path) else "file" if os.path.isfile(path) else None
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    kind = system.get_file_info(at).type
    return {fs.FileType.Directory: "folder", fs.FileType.File: "file"}.get(kind)


def children(folder: str) -> list[tuple[str, str, bool]]:
    """(path, path with links followed, whether it is a folder) of what a folder holds."""
    if is_local(folder):
        with os.scandir(folder) as found:
            return [(e.path, os.path.realpath(e.path), e.is_dir()) for e in found if e.is_dir() or e.is_file()]
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(folder)
    named = ((f"{folder}/{x.base_name}", x.type) for x in system.get_file_info(fs.FileSelector(at)))
    return [(p, p, t == fs.FileType.Directory) for p, t in named]


def content_of(path: str) -> bytes:
    if is_local(path):
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        return f.read()


LEVEL = "root int, base string, path string, real string, folder boolean, error string"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LEVEL rows of the folders (root, base, path)."""
    names, types = [c.split(" ")[0] for c in LEVEL.split(", ")], [pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    for b in batches:
        for root, base, folder in zip(*(c.to_pylist() for c in b.columns), strict=True):
            try:
                rows = [(root, base, p, real, below, None) for p, real, below in children(folder)]
            except OSError as e:
                rows = [(root, base, folder, folder, True, str(e))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(6)], names=names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_ord, path, language) with the files' contents, null where one can't be read."""
    for b in batches:
        low, held, lot = 0, 0, []
        for k, path in enumerate(b.column(1).to_pylist()):
            try:
                lot.append(content_of(path))
            except OSError as e:
                LOG.warning("can't read %s: %s", path, e)
                lot.append(None)
            held += len(lot[-1] or b"")
            if held >= LOT or k == b.num_rows - 1:
                yield pa.RecordBatch.from_arrays([*(c.slice(low, len(lot)) for c in b.columns), pa.array(lot, pa.binary())], names=["file_ord", "path", "language", "content"])
                low, held, lot = k + 1, 0, []


def files_below(spark: SparkSession, folders: list[tuple[int, str]], exclude: Sequence[str], ignore: IgnoreRules | None) -> DataFrame | None:
    """(root, path) of the files of known languages in the folders (root, path) and below."""
    if not folders:
        return None
    front = spark.createDataFrame([(k, p, p) for k, p in folders], "root int, base string, path string")
    seen = front.select("root", F.col("path").alias("real"))
    out = None
    while True:
        level = materialize(front.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(_list, LEVEL), "level")
        for row in level.where("error is not null").toLocalIterator():
            LOG.warning("left out %s: %s", row.path, row.error)
        hit = glob_matches(F.col("path"), exclude)
        there = level.where(F.col("error").isNull() & ~hit)
        kept = there.where(~F.col("folder") & language_of(F.col("path")).isNotNull())
        kept = (kept if ignore is None else kept.where(~ignore.ignores(F.col("path")))).select("root", F.col("real").alias("path"))
        out = kept if out is None else out.unionByName(kept)
        name = F.element_at(F.split("path", "/"), -1)
        below = there.where(F.col("folder") & ~name.isin(*EXCLUDED))
        below = below if ignore is None else below.where(~ignore.ignores(F.col("path"), True))
        # a link to a folder that was entered is not entered again
        fresh = materialize(below.join(seen, ["root", "real"], "left_anti").dropDuplicates(["root", "real"]), "folders")
        if fresh.isEmpty():
            return out
        front, seen = fresh.select("root", "base", "path"), seen.unionByName(fresh.select("root", "real"))


def ranked(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with a dense number from 0 in the given order: partitions of a range, each after the counts of those before it."""
    laid = rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()).withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND((1 << 33) - 1)})
    laid = materialize(laid, "ranked")
    counts = laid.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = counts.alias("x").join(counts.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy(F.col("x.part").alias("part")).agg(F.coalesce(F.sum("y.c"), F.lit(0)).alias("before"))
    return laid.join(F.broadcast(before), "part").withColumn(name, F.col("before") + F.col("row")).drop("at", "part", "row", "before")  # a row per partition


def scan(spark: SparkSession, roots: Sequence[str], exclude: Sequence[str] = (), ignore: IgnoreRules | None = None) -> DataFrame:
    """(file_ord, path, language, content) of the roots' files of known languages, each once; content is null where a file can't be read.

    Roots are files or folders; others are left out. Local ones must be seen by all executors, others are URIs that pyarrow can open.
    Excluded folder names, shell patterns and
    ignore rules count below each root, patterns and rules also for the roots that are files. The order is by
    root, then by the parts of the path; file_ord counts from 0. A folder that can't be listed is left out with a warning.
    """
    resolved = [(k, r, kind_of(r)) for k, r in enumerate(map(resolve, roots))]
    found = files_below(spark, [(k, r) for k, r, kind in resolved if kind == "folder"], exclude, ignore)
    single = [(k, r) for k, r, kind in resolved if kind == "file"]
    if single:
        path = F.col("path")
        own = spark.createDataFrame(single, "root int, path string").where(language_of(path).isNotNull() & ~glob_matches(path, exclude))
        # a file that is named first and ignored is left out for all roots
        own = own.withColumn("out", F.lit(False) if ignore is None else ignore.ignores(path))
        found = own if found is None else found.withColumn("out", F.lit(False)).unionByName(own)
    if found is None:
        return spark.createDataFrame([], FILES)
    if "out" not in found.columns:
        found = found.withColumn("out", F.lit(False))
    once = found.groupBy("path").agg(F.min(F.struct("root", "out")).alias("first")).where("not first.out").select("path", F.col("first.root").alias("root"))
    numbered = materialize(ranked(once, "file_ord", F.col("root"), F.split("path", "/")).select("file_ord", "path", language_of(F.col("path")).alias("language")), "paths")
    tasks = max(spark.sparkContext.defaultParallelism, numbered.count() // PER_TASK)
    return materialize(numbered.repartition(tasks, "file_ord").mapInArrow(_read, FILES), "files")


def target_list(lines: Sequence[str]) -> list[str]:
    """Paths of a list file: one per line, blank lines and comments left out."""
    out = [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]
    if not out:
        raise ValueError("the list names no path")
    return out
