"""Source files made from the rows of documents: code of six languages, whose fragments follow from a rule."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import work_dir
from .adapters import read

#: By doc_id modulo 7: extension, language, and the code around doc_id % 13 body lines: a text before and after the number, the body line, the rest.
KINDS = (
    (".py", "Python", "import os\n\nclass C", ":\n    def m(self, a):\n", "        a = a + 1\n", "        return a\n"),
    (".js", "JavaScript", "function f", "(a) {\n", "  a = a + 1;\n", "  return a;\n}\nclass K {\n  m() { return 1; }\n}\n"),
    (".TS", "TypeScript", "function f", "(a: number): number {\n", "  a = a + 1;\n", "  return a;\n}\nclass K {\n  m() { return 1; }\n}\n"),
    (".java", "Java", "public class A", " {\n  int f(int a) {\n", "    a = a + 1;\n", "    return a;\n  }\n}\n"),
    (".go", "Go", "package p\n\nfunc f", "(a int) int {\n", "\ta = a + 1\n", "\treturn a\n}\n\ntype T struct {\n\tx int\n}\n"),
    (".gs", "Gosu", "class G", " {\n  function f(a : int) : int {\n", "    a = a + 1\n", "    return a\n  }\n}\n"),
    (".md", None, "# note ", "\n", "text\n", "end\n"),
)
#: Folders by doc_id modulo 6.
FOLDERS = ("pkg", "node_modules", "gen", "_Sub", ".hidden", "build")


def chosen(values: list[str | None], by: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in enumerate(values):
        out = F.when(by == k, F.lit(v)).otherwise(out)
    return out


def code(doc_id: Column) -> Column:
    kind = F.pmod(doc_id, F.lit(7))
    part = lambda k: chosen([x[k] for x in KINDS], kind)
    return F.concat(part(2), doc_id.cast("string"), part(3), F.repeat(part(4), F.pmod(doc_id, F.lit(13)).cast("int")), part(5))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_ord, path, language, content): a file of code for each document, but those of no known language."""
    doc, kind = F.col("doc_id"), F.pmod(F.col("doc_id"), F.lit(7))
    rows = read(spark, sf_dir, "documents").select(
        doc.alias("file_ord"), F.concat(F.lit("/repo/f"), doc.cast("string"), chosen([x[0] for x in KINDS], kind)).alias("path"), chosen([x[1] for x in KINDS], kind).alias("language"),
        F.encode(code(doc), "UTF-8").alias("content"),
    )
    return rows.where("language is not null")


def write_files(rows: DataFrame) -> int:
    """Writes rows (path, text) as local files in a folder that all executors share; returns their number."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w", encoding="utf-8", newline="") as f:
                    f.write(text)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.select("path", "text").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def code_tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each document, in a folder per source and one below: returns its path."""
    shared = work_dir(spark).removeprefix("file:")
    if "://" in shared:
        raise RuntimeError("files are made in a shared local folder only")
    root = os.path.realpath(f"/{shared.lstrip('/')}/tree-{uuid.uuid4().hex}")
    doc = F.col("doc_id")
    name = F.concat(doc.cast("string"), chosen([x[0] for x in KINDS], F.pmod(doc, F.lit(7))))
    path = F.concat_ws("/", F.lit(root), F.coalesce("source", F.lit("none")), chosen(list(FOLDERS), F.pmod(doc, F.lit(6))), name)
    write_files(read(spark, sf_dir, "documents").select(path.alias("path"), code(doc).alias("text")))
    return root


def _sql(values: list[str | None], by: str) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
    return "CASE " + by + " " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in enumerate(values)) + " END"


def code_sql(doc_id: str = "doc_id") -> str:
    part = lambda k: _sql([x[k] for x in KINDS], f"{doc_id} % 7")
    return f"({part(2)} || {doc_id} || {part(3)} || repeat({part(4)}, ({doc_id} % 13)::INTEGER) || {part(5)})"


def extension_sql(doc_id: str = "doc_id") -> str:
    return _sql([x[0] for x in KINDS], f"{doc_id} % 7")


def language_sql(doc_id: str = "doc_id") -> str:
    return _sql([x[1] for x in KINDS], f"{doc_id} % 7")


def folder_sql(doc_id: str = "doc_id") -> str:
    return _sql(list(FOLDERS), f"{doc_id} % 6")


#: Lines of the fragments by doc_id % 7, with k = doc_id % 13: (function from, to, class from, to, file to).
LINES = (("4", "k + 5", "3", "k + 5", "k + 6"), ("1", "k + 3", "k + 4", "k + 6", "k + 7"), ("1", "k + 3", "k + 4", "k + 6", "k + 7"), ("2", "k + 4", "1", "k + 5", "k + 6"),
         ("3", "k + 5", "k + 7", "k + 9", "k + 10"), ("2", "k + 4", "1", "k + 5", "k + 6"))


def fragments_sql() -> str:
    """CTEs that end in fragments (doc_id, language, fragment_type, start_line, end_line, source_text) of all files."""
    line = lambda n: "CASE kind " + " ".join(f"WHEN {k} THEN {x[n]}" for k, x in enumerate(LINES)) + " END"
    text = "trim(array_to_string(list_slice(lines, {0}, {1}), chr(10)), ' ' || chr(9))"
    return f"""src AS (SELECT doc_id, doc_id % 7 AS kind, doc_id % 13 AS k, {language_sql()} AS language, {code_sql()} AS text FROM documents WHERE doc_id % 7 < 6),
    cut AS (SELECT *, string_split(text, chr(10)) AS lines, ({line(0)})::INTEGER AS f0, ({line(1)})::INTEGER AS f1, ({line(2)})::INTEGER AS c0, ({line(3)})::INTEGER AS c1, ({line(4)})::INTEGER AS e1 FROM src),
    fragments AS (
      SELECT doc_id, language, 'function' AS fragment_type, f0 AS start_line, f1 AS end_line, {text.format('f0', 'f1')} AS source_text FROM cut
      UNION ALL SELECT doc_id, language, 'class', c0, c1, {text.format('c0', 'c1')} FROM cut
      UNION ALL SELECT doc_id, language, 'file', 1, e1, text FROM cut
    )"""
