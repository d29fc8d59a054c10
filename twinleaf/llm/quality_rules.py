"""Quality rules as a short-circuit cascade, in DataFrame expressions alone.

Every rule is a Boolean column that is true for a text to reject. The cascade
measures on a sample, drawn at random from a few files and written once, what each rule costs and rejects, orders the rules by
rejection per cost and folds them into one CASE expression, which Spark stops
evaluating at the first rule that rejects. The order decides the time alone:
a text is kept if no rule rejects it, whatever the order.

Edge cases: a null text is a text without words; without words every count is
0 and the base rule rejects (n_words < 50). Repeated rows and repeated ids are
judged one by one. Columns of the input stay as they are; a clash of names
with a feature is resolved by underscores before the feature's name.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import materialize
from .tables import WORD, fresh_name, table

#: Characters that stand for markup, tables and code (fixed by the contract).
SYMBOLS = "[#*$%&|<>]"
#: Rows of the sample on which costs and rejections are measured, about, and files that it is drawn from, about.
SAMPLE_ROWS, SAMPLE_FILES = 1000, 8
#: Runs of which the fastest counts.
RUNS = 3


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda binds it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    return (F.char_length(plain) - F.char_length(F.regexp_replace(plain, SYMBOLS, ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text holds twice or more.

    The windows' 64-bit hashes are sorted with their places, equal neighbours
    are the repeated ones, and the union of the intervals [p, p + 2] is summed.
    """
    def windows(w: Column) -> Column:
        return F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def places(r: Column) -> Column:
        same = lambda x, k: F.get(r, k)["h"] == x["h"]
        return F.sort_array(F.transform(F.filter(r, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(w: Column) -> Column:
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(let(F.sort_array(windows(w)), places), covered))

    return let(words, counted)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def seconds(sample: DataFrame, rejects: Column) -> tuple[int, float]:
    """(rows rejected, least time of RUNS) of one rule over the whole sample."""
    least, rejected = float("inf"), 0
    for _ in range(RUNS):
        began = time.perf_counter()
        rejected = sample.where(F.coalesce(rejects, F.lit(False))).count()
        least = min(least, time.perf_counter() - began)
    return rejected, least


def order_by_rejection_per_cost(sample: DataFrame, rules: list[Rule], text: str = "text") -> tuple[list[Rule], list[dict]]:
    """The rules in cascade order and what was measured.

    Each rule runs over the whole sample; its cost is the time taken beyond that of a rule that only
    reads the texts, its yield the rows that it rejects. Ties and an empty sample keep the order given.
    """
    _, idle = seconds(sample, F.length(text) < 0)
    measured = []
    for rule in rules:
        rejected, took = seconds(sample, rule.rejects)
        measured.append({"rule": rule.name, "rejected": rejected, "seconds": max(took - idle, 1e-3)})
    rank = sorted(range(len(rules)), key=lambda k: -measured[k]["rejected"] / measured[k]["seconds"])
    return [rules[k] for k in rank], measured


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return verdict


def features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the base counts, and the columns' names by feature."""
    name = {k: fresh_name(docs, k) for k in ("words", "lines", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    t = F.col(text)
    out = docs.withColumns({name["words"]: words_of(t), name["lines"]: worded_lines(t)})
    w, lines = F.col(name["words"]), F.col(name["lines"])
    out = out.withColumns(
        {
            name["n_words"]: F.size(w).cast("long"),
            name["word_chars"]: word_chars(w),
            name["n_symbols"]: n_symbols(t),
            name["n_lines"]: F.size(lines).cast("long"),
            name["n_dup_lines"]: n_dup_lines(lines),
            name["n_repeat_words"]: n_repeat_words(w),
        }
    ).drop(name["words"], name["lines"])
    return out, {k: v for k, v in name.items() if k not in ("words", "lines")}


def base_failed(f: dict[str, str]) -> Column:
    return (F.col(f["n_words"]) < 50) | (100 * F.col(f["n_repeat_words"]) > 50 * F.col(f["n_words"]))


def standard_rules(f: dict[str, str]) -> list[Rule]:
    """Published heuristics for web text: lengths of words, symbols, repeated lines."""
    n = F.col(f["n_words"])
    return [
        Rule("too_few_words", n < 50),
        Rule("repeated_windows", 100 * F.col(f["n_repeat_words"]) > 50 * n),
        Rule("symbols", 10 * F.col(f["n_symbols"]) > n),
        Rule("repeated_lines", 10 * F.col(f["n_dup_lines"]) > 3 * F.col(f["n_lines"])),
        Rule("short_words", F.col(f["word_chars"]) < 2 * n),
        Rule("long_words", F.col(f["word_chars"]) > 20 * n),
    ]


def lazy_rules(text: str = "text") -> list[Rule]:
    """The same rules over the text itself: a feature is computed only if its rule is reached."""
    t = F.col(text)
    by_words = lambda test: let(words_of(t), test)
    return [
        Rule("too_few_words", by_words(lambda w: F.size(w) < 50)),
        Rule("repeated_windows", by_words(lambda w: 100 * n_repeat_words(w) > 50 * F.size(w))),
        Rule("symbols", by_words(lambda w: 10 * n_symbols(t) > F.size(w))),
        Rule("repeated_lines", let(worded_lines(t), lambda x: 10 * n_dup_lines(x) > 3 * F.size(x))),
        Rule("short_words", by_words(lambda w: word_chars(w) < 2 * F.size(w))),
        Rule("long_words", by_words(lambda w: word_chars(w) > 20 * F.size(w))),
    ]


def sample_of(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, files: int = SAMPLE_FILES) -> DataFrame:
    """About rows random rows of about files of the files that docs reads, written: it serves the order of the rules alone.

    Files are left out as they are listed, so that the others aren't opened; a frame that isn't read from files is sampled as a whole.
    """
    every = len(docs.inputFiles())
    chosen = docs
    if every > 2 * files and "_metadata" not in docs.columns:
        for k in range(5):  # a hash may pick none
            few = docs.where(F.pmod(F.xxhash64(F.col("_metadata.file_path"), F.lit(k)), F.lit(-(-every // files))) == 0)
            if not few.select(text).isEmpty():
                chosen = few
                break
    n = chosen.count()
    return materialize(chosen.select(text).sample(min(1.0, rows / max(1, n)), seed=8).repartition(1), "quality-sample")


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with docs' own columns."""
    rules, _ = order_by_rejection_per_cost(sample_of(docs, text), lazy_rules(text), text)
    return docs.where(cascade(rules).isNull())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules, _ = order_by_rejection_per_cost(sample_of(docs), lazy_rules())
    counted, f = features(docs)
    known = {r.name: r for r in standard_rules(f)}
    failed = base_failed(f)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        cascade([known[r.name] for r in rules]).isNull().alias("kept"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM d)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid
), f AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN cov USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM f
"""
