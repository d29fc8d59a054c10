"""Function, class and file fragments of source files.

Python is parsed with the standard library, and by indentation where that
fails. Languages with braces are read by a scanner that blanks strings and
comments, finds heads by pattern and their ends by matching braces; it goes on
past errors. What it captures: functions (also nested ones), methods and
constructors as the language has them, classes, and the file itself. A file
fragment runs from the first visible character to the end of the file, so that
a final line feed counts as one more line.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import normalise, tokens

SCHEMA = (
    "file_ord long, place int, fragment_id string, file_path string, language string, fragment_type string, start_line int, end_line int, source_text string, error string"
)
#: Fragments of a file at most.
PLACES = 1 << 20
_QUIET = re.compile(r"\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)")
_NAME = r"[A-Za-z_$][\w$]*"
_RESERVED = frozenset("if for while switch catch return new throw else do try synchronized using foreach unless eval super this".split())
_CLASS = {
    "JavaScript": re.compile(rf"(?<![\w$.=(,:?]\s)(?<![\w$.])(?:abstract\s+)?class\s+{_NAME}[^{{;]*\{{"),
    "Java": re.compile(rf"(?:(?:@{_NAME}(?:\([^)]*\))?|public|protected|private|static|final|abstract|sealed|strictfp)\s+)*\bclass\s+{_NAME}[^{{;]*\{{"),
    "Gosu": re.compile(rf"(?:(?:public|protected|private|internal|static|final|abstract)\s+)*\bclass\s+{_NAME}[^{{;]*\{{"),
    "Go": re.compile(r"^[ \t]*type\b", re.M),
}
_CLASS["TypeScript"] = _CLASS["JavaScript"]


def quiet(text: str) -> str:
    """The text with strings and comments blanked, at the same length."""
    return _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(text: str, at: int, pair: str = "{}") -> int:
    """The place after the bracket that closes the one at `at`; the end if none does."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.end()
    return len(text.rstrip())


def _after_parameters(q: str, at: int) -> int:
    """The place of the body's brace after a head whose parameters open at `at`; -1 if there is none."""
    end = closing(q, at, "()")
    m = re.compile(r"[^{};=]*\{").match(q, end)
    return m.end() - 1 if m else -1


def _arrows(q: str) -> Iterator[tuple[int, int]]:
    for m in re.finditer(r"=>", q):
        left = q[: m.start()].rstrip()
        if left.endswith(")"):
            depth, k = 0, len(left) - 1
            while k >= 0:
                depth += (left[k] == ")") - (left[k] == "(")
                if not depth:
                    break
                k -= 1
            start = k
        elif head := re.search(rf"{_NAME}$", left):
            start = head.start()
        else:
            continue
        if head := re.search(r"\basync\s*$", q[:start]):
            start = head.start()
        body = re.compile(r"\s*").match(q, m.end()).end()
        if q[body : body + 1] == "{":
            yield start, closing(q, body)
            continue
        depth, k = 0, body
        while k < len(q):
            c = q[k]
            if c in ")]}" and not depth or c in ",;" and not depth:
                break
            depth += (c in "([{") - (c in ")]}")
            if c == "\n" and not depth and not re.match(r"\s*[.?:+\-*/&|]", q[k:]):
                break
            k += 1
        yield start, len(q[:k].rstrip())


def _functions(language: str, q: str) -> Iterator[tuple[int, int]]:
    if language in ("JavaScript", "TypeScript"):
        for m in re.finditer(rf"(?:\basync\s+)?\bfunction\b(?!\s*\*)\s*(?:{_NAME})?\s*(?:<[^>(]*>)?\s*\(", q):
            body = _after_parameters(q, m.end() - 1)
            if body >= 0:
                yield m.start(), closing(q, body)
        yield from _arrows(q)
    elif language == "Go":
        for m in re.finditer(rf"^func\s*(?:\([^)]*\)\s*)?{_NAME}\s*(?:\[[^\]]*\])?\s*\(", q, re.M):
            body = _after_parameters(q, m.end() - 1)
            if body >= 0:
                yield m.start(), closing(q, body)
    else:
        head = rf"(?:(?:@{_NAME}(?:\([^)]*\))?|public|protected|private|internal|static|final|abstract|override|synchronized|native|default|strictfp)\s+)*"
        kind = rf"(?:function\s+|construct\s*(?=\())(?:{_NAME})?" if language == "Gosu" else rf"(?:<[^>]*>\s*)?(?:[\w$.<>\[\],?]+\s+)?(?P<name>{_NAME})"
        for m in re.finditer(rf"(?<![\w$.@]){head}{kind}\s*\(", q):
            if language == "Java" and (m["name"] in _RESERVED or re.match(r"(?:new|return|else|throw|case|assert|instanceof)\b", m[0]) or re.search(r"(?:\bnew|[.=(,])\s*$", q[: m.start()])):
                continue
            end = closing(q, m.end() - 1, "()")
            body = re.compile(r"\s*(?:throws\s+[\w$.,\s]+)?\{" if language == "Java" else r"\s*(?::\s*[\w$.<>\[\], ]+)?\s*\{").match(q, end)
            if body:
                yield m.start(), closing(q, body.end() - 1)


def _classes(language: str, q: str) -> Iterator[tuple[int, int]]:
    for m in _CLASS[language].finditer(q):
        if language != "Go":
            yield m.start() + len(m[0]) - len(m[0].lstrip()), closing(q, m.end() - 1)
            continue
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        group = re.compile(r"\s*\(").match(q, m.end())
        if group:
            yield at, closing(q, group.end() - 1, "()")
            continue
        k = m.end()
        while k < len(q) and q[k] != "\n":
            k = closing(q, k) if q[k] == "{" else k + 1
        yield at, len(q[:k].rstrip())


def _indented(text: str) -> Iterator[tuple[str, int, int]]:
    """Python by indentation: for texts that don't parse."""
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    for k, line in enumerate(lines):
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\b", line)
        if not m:
            continue
        last = k
        for j in range(k + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]):
                    break
                last = j
        yield ("function" if m[2] == "def" else "class"), starts[k] + len(m[1]), starts[last] + len(lines[last].rstrip())


def _python(text: str) -> Iterator[tuple[str, int, int]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield from _indented(text)
        return
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    place = lambda line, byte: starts[line - 1] + len(lines[line - 1].encode()[:byte].decode(errors="ignore"))
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            yield ("class" if isinstance(node, ast.ClassDef) else "function"), place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)


def extract(content: bytes, language: str, min_lines: int = 10, code_blocks_only: bool = False) -> list[tuple[str, int, int, str]]:
    """(type, start line, end line, text): functions, classes, file; each of min_lines lines at least."""
    text = content.decode("utf-8", "replace").replace("\r\n", "\n") if language == "Python" else content.decode("utf-8", "replace")
    if language == "Python":
        found = list(_python(text))
    elif language in _CLASS:
        q = quiet(text)
        found = [("function", a, b) for a, b in sorted(set(_functions(language, q)))] + [("class", a, b) for a, b in _classes(language, q)]
    else:
        return []
    if not code_blocks_only and text.strip():
        found.append(("file", len(text) - len(text.lstrip()), len(text)))
    rank = {"function": 0, "class": 1, "file": 2}
    out = []
    for kind, a, b in sorted(found, key=lambda x: (rank[x[0]], x[1], -x[2])):
        first = text.count("\n", 0, a) + 1
        last = text.count("\n", 0, b) + 1
        if last - first + 1 >= min_lines:
            out.append((kind, first, last, text[a:b]))
    return out


def fragments_of(files: DataFrame, min_lines: int = 10, code_blocks_only: bool = False) -> DataFrame:
    """files (file_ord, path, language, content) as SCHEMA with ord; a file that can't be read, or has no content, gives one row with its error.

    ord is the file's dense number above the fragment's place in it (of PLACES at most), so that the order needs no global sort.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for f in b.itertuples():
                try:
                    if f.content is None:
                        raise OSError("the file can't be read")
                    for k, (kind, first, last, text) in enumerate(extract(bytes(f.content), f.language, min_lines, code_blocks_only)):
                        rows.append((f.file_ord, k, f"{f.file_ord}-{k}", f.path, f.language, kind, first, last, text, None))
                except Exception as e:  # one broken file must not end the run; it is reported
                    rows.append((f.file_ord, 0, f"{f.file_ord}-error", f.path, f.language, "error", 0, 0, "", repr(e)))
            yield pd.DataFrame(rows, columns=columns)

    rows = files.select("file_ord", "path", "language", "content").mapInPandas(cut, SCHEMA)
    too_many = F.raise_error(F.lit("a file has too many fragments")).cast("long")
    return rows.withColumn("ord", F.when(F.col("place") < PLACES, F.col("file_ord") * PLACES + F.col("place")).otherwise(too_many))


def node_text(content: Column, start: Column, end: Column) -> Column:
    """The text of a node from its byte range; bytes that are no UTF-8 become replacement characters."""
    return F.decode(F.substring(content, start + 1, end - start), "UTF-8")


def extract_tokens(nodes: DataFrame) -> DataFrame:
    """nodes (content, start_byte, end_byte, ...) with the raw tokens of each node's text."""
    return nodes.withColumn("tokens", tokens(node_text(F.col("content"), F.col("start_byte"), F.col("end_byte"))))


def extract_and_normalise(nodes: DataFrame) -> DataFrame:
    """nodes (content, start_byte, end_byte, language, ...) with raw and normalised tokens."""
    return extract_tokens(nodes).withColumn("normalized_tokens", normalise("tokens", "language"))


def large_enough(fragments: DataFrame, min_lines: int) -> DataFrame:
    """The fragments of at least min_lines lines."""
    return fragments.where(F.col("end_line") - F.col("start_line") + 1 >= min_lines)
