"""Mixing sources to target weights by pivotal dependent rounding, DataFrame functions alone.

A source that is to give target words out of size words gives each document a
copy count of target / size on average. The whole part is fixed; the fractions
are rounded by pivotal sampling: two open fractions p and q of documents with
a and b words meet, and a random transfer that keeps a * p + b * q makes one
of them integral, with the expectation of both unchanged. So the words taken
from a source differ from its target by less than the words of one document.

The pairs meet in a reduction tree: documents are dealt by a hash to blocks of
about BLOCK, a block folds its fractions one after the other and hands on the
one residual, and the residuals of all blocks are folded likewise, until each
source has one, which goes to its nearer side. A source of any size is thus spread
over many tasks, and no task holds more than a few blocks' worth of numbers.

Edge cases: a null text has size 0 and takes 0; a null source is a source of
its own, last in order; a source without words has target 0. Repeated rows are
documents of their own. Coins are hashes of the ids, so that reruns agree. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import materialize
from .tables import WORD, fresh_name, table

BLOCK = 256
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Fractions this near to 0 or 1 are integral: what floating point leaves over.
EPS = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources (one row each) with rank from 0 by code point, null last, without a one-task sort.

    A range partitioning sorts them; each partition's place is the sum of the counts before it.
    """
    laid = materialize(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()).withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND((1 << 33) - 1)}),
        "mix-sources",
    )
    counts = laid.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = counts.alias("x").join(counts.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy(F.col("x.part").alias("part")).agg(F.coalesce(F.sum("y.c"), F.lit(0)).alias("before"))
    return laid.join(F.broadcast(before), "part").select("source", "source_size", "n_docs", (F.col("before") + F.col("row")).alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target): shares by weight, none above most times its size.

    Each round is one aggregate: what the sources at their limit leave is shared
    by weight among the others, until none of these is above its limit.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = materialize(ranked(sources).withColumn("weight", weight).withColumn("limit", most * F.col("source_size")), "mix-ranked")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        # a source is at its limit if the level of this or an earlier round puts it above
        at_limit = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("limit")
        row = s.agg(F.sum(F.when(at_limit, F.col("limit"))), F.sum(F.when(~at_limit, F.col("weight"))), F.count(F.when(at_limit, 1))).first()
        full, free, n = row[0] or 0, row[1] or 0, row[2]
        if n == capped or not free:
            break
        capped = n
        level = (total - full) / free
    share = F.lit(0.0) if level is None else F.least(F.col("weight") * F.lit(float(level)), F.col("limit").cast("double"))
    return s.select("source", "source_size", "n_docs", share.cast("double").alias("target"))


def _coin(item: Column, other: Column, salt: int) -> Column:
    """Uniform in [0, 1), the same in every run."""
    h = F.xxhash64(item["id"], item["size"], item["dup"], other["id"], other["size"], other["dup"], F.lit(salt))
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def _fold(items: Column, salt: int) -> Column:
    """Folds a block's items (id, size, dup, base, p) by pivotal steps.

    The state is the open item and the decided ones. A step moves size * p
    between the open item and the next, up or down, each with the chance that keeps the
    expectations, as far as the first becomes integral.
    """
    kind = "array<struct<size:bigint,id:bigint,dup:int,base:int,p:double>>"
    with_p = lambda x, p: F.struct(x["size"].alias("size"), x["id"].alias("id"), x["dup"].alias("dup"), x["base"].alias("base"), p.alias("p"))

    def step(state: Column, x: Column) -> Column:
        o = state["open"]
        a, b, p, q = o["size"].cast("double"), x["size"].cast("double"), o["p"], x["p"]
        up = F.least(a * (1 - p), b * q)  # mass that can move from x to the open item
        down = F.least(a * p, b * (1 - q))
        rise = _coin(o, x, salt) * (up + down) < down
        moved = F.when(rise, up).otherwise(-down)
        np = p + moved / a
        nq = q - moved / b
        np = F.when(np < EPS, 0.0).when(np > 1 - EPS, 1.0).otherwise(np)
        nq = F.when(nq < EPS, 0.0).when(nq > 1 - EPS, 1.0).otherwise(nq)
        o_done = (np == 0.0) | (np == 1.0)
        done = F.when(o_done, with_p(o, np)).otherwise(with_p(x, nq))
        rest = F.when(o_done, with_p(x, nq)).otherwise(with_p(o, np))
        return F.when(o.isNull(), F.struct(x.alias("open"), state["done"].alias("done"))).otherwise(F.struct(rest.alias("open"), F.concat(state["done"], F.array(done)).alias("done")))

    start = F.struct(F.lit(None).cast(kind[6:-1]).alias("open"), F.array().cast(kind).alias("done"))
    return F.aggregate(items, start, step)


def decide(items: DataFrame) -> DataFrame:
    """(source, id, size, dup, copies) of items (source, id, size, dup, base, p) with 0 < p < 1."""
    n = items.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    # the tree has as many levels as the largest source needs
    most = n.agg(F.max("n")).first()[0] or 0
    decided = []
    level = 0
    while most > 0:
        # large documents first: what stays open to the end is then a small one
        item = F.struct("size", "id", "dup", "base", "p")
        sized = items.join(n, items["source"].eqNullSafe(n["source"])).drop(n["source"])
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))
        folded = materialize(
            sized.withColumn("block", F.pmod(F.xxhash64("id", "size", "dup", F.lit(level)), blocks))
            .groupBy("source", "block")
            .agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
            .select("source", _fold(F.col("items"), level).alias("f"))
            .select("source", F.col("f.open").alias("open"), F.col("f.done").alias("done")),
            f"mix-level{level}",
        )
        decided.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        items = folded.select("source", "open.*")
        whole = (F.col("p") == 0.0) | (F.col("p") == 1.0)
        decided.append(items.where(whole))
        items = items.where(~whole)
        if most == 1:
            break
        n = items.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        most = n.agg(F.max("n")).first()[0] or 0
        level += 1
    # one fraction a source is left, of a small document: to the nearer side, so that the words come nearest to the target
    last = items.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0))
    out = last
    for d in decided:
        out = out.unionByName(d)
    return out.select("source", "id", "size", "dup", (F.col("base") + F.col("p").cast("int")).alias("copies"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, source, size, dup, source_size, target, copies) for docs (doc_id, source, text).

    dup numbers rows that agree in doc_id, source and size, so that repeated rows keep decisions of their own.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    rows = materialize(sized, "mix-sizes")
    repeated = rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("times"))
    numbered = repeated.select("id", "source", "size", F.explode(F.sequence(F.lit(0), (F.col("times") - 1).cast("int"))).alias("dup"))
    goals = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, most), "mix-targets")
    each = numbered.join(goals, numbered["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = each.withColumn("base", F.when(F.col("size") > 0, F.floor(rate + EPS)).otherwise(0).cast("int")).withColumn("p", F.when(F.col("size") > 0, rate - F.col("base")).otherwise(0.0))
    rated = materialize(rated.withColumn("p", F.when(F.col("p") < EPS, 0.0).otherwise(F.col("p"))), "mix-rates")
    fixed = rated.where("p = 0").select("source", "id", "size", "dup", F.col("base").alias("copies"))
    made = fixed.unionByName(decide(rated.where("p > 0").select("source", "id", "size", "dup", "base", "p")))
    out = made.join(goals, made["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    return out.select(F.col("id").alias("doc_id"), "source", "size", "dup", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, columns unchanged.

    Rows that agree in doc_id, source and size are taken equally often or once more: the first of them, as many as copies() says. Where
    that parts rows of one key, they are numbered and written, the partition in which the last one to be taken lies is found by counts, and
    only its rows are ranked: no task ranks all rows of a key.
    """
    size, low, extra, row, part, n, limit, before, c = (fresh_name(docs, x) for x in ("size", "low", "extra", "row", "part", "copies", "limit", "before", "count"))
    keys = ["doc_id", "source", size]
    chosen = copies(docs, weights, most).withColumnRenamed("size", size).groupBy(*keys).agg(F.min("copies").alias(low), (F.sum("copies") - F.count(F.lit(1)) * F.min("copies")).alias(extra))
    keyed = docs.withColumn(size, n_words(F.col("text")))

    def same(x: str, y: str, on: list[str]) -> Column:
        out = F.lit(True)
        for k in on:
            out = out & F.col(f"{x}.`{k}`").eqNullSafe(F.col(f"{y}.`{k}`"))
        return out

    joined = keyed.alias("d").join(chosen.where((F.col(low) > 0) | (F.col(extra) > 0)).alias("c"), same("d", "c", keys)).select("d.*", low, extra)
    even = joined.where(F.col(extra) == 0).select(*docs.columns, F.col(low).alias(n))
    uneven = materialize(joined.where(F.col(extra) > 0).withColumn(row, F.monotonically_increasing_id()).withColumn(part, F.shiftright(row, 33)), "mix-uneven")
    counts = uneven.groupBy(*keys, extra, part).agg(F.count(F.lit(1)).alias(c))
    w = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    crossing = counts.withColumn(before, F.coalesce(F.sum(c).over(w), F.lit(0))).where((F.col(before) < F.col(extra)) & (F.col(extra) <= F.col(before) + F.col(c)))
    rows = uneven.select(*keys, part, row).alias("d").join(crossing.alias("c"), same("d", "c", [*keys, part])).select("d.*", (F.col(f"c.{extra}") - F.col(f"c.{before}")).alias(extra))
    last = rows.withColumn(c, F.row_number().over(Window.partitionBy(*keys).orderBy(row))).where(F.col(c) == F.col(extra)).select(*keys, F.col(row).alias(limit))
    parted = uneven.alias("d").join(last.alias("c"), same("d", "c", keys)).select("d.*", f"c.{limit}").select(*docs.columns, (F.col(low) + (F.col(row) <= F.col(limit)).cast("long")).alias(n))
    both = even.unionByName(parted)
    return both.where(F.col(n) > 0).withColumn(c, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long")))).select(docs.columns)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
