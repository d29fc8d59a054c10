"""Set-similarity self join of fragments (clone type 3), exact at any threshold.

Above threshold 0 it is a prefix-filter join (Chaudhuri et al. 2006, Bayardo
et al. 2007) between classes of equal token sets: two sets with Jaccard t share one of the
n - ceil(t n) + 1 first tokens of each under any order. The order is rare first: tokens of a bounded list of frequent
ones come last, the most frequent at the very end. Only prefix tokens move, each with the set's size, its own place and
a small bitmap of the set, and they meet in lots by token, one after the other, so that disk holds one lot at a time; size, place and
bitmap rule out nearly all pairs before any set is looked at. The sets themselves are written once. For the pairs that are left, larger bitmaps and then the sets
of what these leave go to buckets where pairs lie close together, once to each bucket, whatever the number of pairs there. The score of two classes holds for all their members, which come in last. At
threshold 0 every pair of fitting size counts, and the sizes are banded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import among, bit_table, in_bits, slot_of
from .storage import HASHES, materialize, release

MOST_SIZE_RATIO = 1.3
#: Tokens of the list of frequent ones at most.
MOST_FREQUENT = 50_000
#: 64-bit words of a set's bitmap.
BITMAP = 8
#: Sets that a Python worker takes at once.
ROWS = 512
#: Prefix tokens of a lot, about, and lots at most.
LOT, MOST_LOTS = 4_000_000, 16
#: Tokens and pairs of a bucket of the exact check, about.
BUCKET_TOKENS, BUCKET_PAIRS = 500_000, 200_000
#: What tells sets apart.
OWN = ["h1", "h2", "n"]


def nested(a: str, b: str) -> Column:
    """Whether a and b lie in one file and the lines of one contain those of the other."""
    holds = lambda x, y: (F.col(f"{x}.start_line") <= F.col(f"{y}.start_line")) & (F.col(f"{x}.end_line") >= F.col(f"{y}.end_line"))
    return (F.col(f"{a}.file_path") == F.col(f"{b}.file_path")) & (holds(a, b) | holds(b, a))


def comparable(a: str, b: str) -> Column:
    """Token counts within the ratio, both above 0, and not nested."""
    n, m = F.col(f"{a}.token_count").cast("double"), F.col(f"{b}.token_count").cast("double")
    return (n > 0) & (m > 0) & (n / m <= F.lit(MOST_SIZE_RATIO)) & (m / n <= F.lit(MOST_SIZE_RATIO)) & ~F.coalesce(nested(a, b), F.lit(False))


def items_of(tokens: Column) -> Column:
    """The distinct tokens as sorted hashes."""
    return F.sort_array(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))))


def with_sets(rows: DataFrame) -> DataFrame:
    """rows with items, unless they have them, and h1, h2, n, which tell the sets apart."""
    if "items" not in rows.columns:
        rows = rows.withColumn("items", items_of(F.col("tokens")))
    return rows.withColumns({"h1": F.xxhash64("items"), "h2": F.hash("items"), "n": F.size("items")})


def _prefixes(frequent: np.ndarray, threshold: float, bits: np.ndarray, lots: int):
    """(rep, n, at, key, bits, lot) for each prefix token of the rows (rep, items, slot) whose slot is in the bits; frequent: the list, most frequent last."""
    order = np.argsort(frequent)
    known = frequent[order]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(in_bits(bits, whole.column(2))))
            for low in range(0, whole.num_rows, ROWS):
                b = whole.slice(low, ROWS)
                column = b.column(1)
                offsets = column.offsets.to_numpy()
                flat = column.values.to_numpy()[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                n = np.diff(offsets)
                rank = np.zeros(len(flat), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    rank = np.where(known[at] == flat, order[at] + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                sorted_ = np.lexsort((flat, rank, row))
                place = np.arange(len(flat)) - np.repeat(offsets[:-1], n)
                take = np.maximum(1, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)
                chosen = place < np.repeat(take, n)
                words = np.zeros((len(n), BITMAP), dtype=np.uint64)
                spread = flat.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                np.bitwise_or.at(words, (row, (spread >> np.uint64(61)).astype(np.int64) % BITMAP), np.uint64(1) << ((spread >> np.uint64(40)) & np.uint64(63)))
                owner, key = row[chosen], flat[sorted_][chosen]
                maps = [pa.array(words[owner, k].view(np.int64)) for k in range(BITMAP)]
                lot = (spread[sorted_][chosen] >> np.uint64(17)) % np.uint64(lots)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(owner)), pa.array(n[owner].astype(np.int32)), pa.array(place[chosen].astype(np.int32)), pa.array(key), *maps, pa.array(lot.astype(np.int32))],
                    names=["rep", "n", "at", "key", *(f"b{k}" for k in range(BITMAP)), "lot"],
                )

    return cut


def _met(keyed: DataFrame, threshold: float) -> DataFrame:
    """(a, b): sets that share a prefix token, without those that sizes, places or bitmaps rule out."""
    n, m = F.col("x.n"), F.col("y.n")
    need = F.lit(threshold / (1 + threshold)) * (n + m) - F.lit(1e-6)
    fits = (F.col("x.rep") < F.col("y.rep")) & (F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - F.lit(1e-9))
    # where the first token shared stands bounds the overlap; every true pair passes there
    fits &= F.least(n - F.col("x.at"), m - F.col("y.at")) >= need
    # a bit that the other set lacks is a token that it lacks
    lacks = lambda p, q: sum((F.bit_count(F.col(f"{p}.b{k}").bitwiseAND(F.bitwise_not(F.col(f"{q}.b{k}")))) for k in range(BITMAP)), F.lit(0))
    fits &= (n - lacks("x", "y") >= need) & (m - lacks("y", "x") >= need)
    met = keyed.alias("x").join(keyed.alias("y"), (F.col("x.key") == F.col("y.key")) & fits)
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _scores(threshold: float):
    def score(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        """(a, b, score) of a bucket's pairs (bucket, a, b) that reach the threshold, by its sets (place, rep, items)."""
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])
        if not pairs.num_rows or not sets.num_rows:
            return schema.empty_table()
        items = pa.concat_arrays(sets["items"].chunks)
        offsets, rep = items.offsets.to_numpy(), sets["rep"].to_numpy()
        flat = items.values.to_numpy()
        order = np.argsort(rep)
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        by_a = np.argsort(a, kind="stable")
        a, b = a[by_a], b[by_a]
        x, y = (order[np.searchsorted(rep, v, sorter=order)] for v in (a, b))
        size = np.diff(offsets).astype(np.int64)
        both = np.zeros(len(a), dtype=np.int64)
        cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(x)], strict=True):
            own = flat[offsets[x[lo]] : offsets[x[lo] + 1]]
            for k in range(lo, hi, ROWS):
                others = y[k : min(hi, k + ROWS)]
                met = np.concatenate([flat[offsets[z] : offsets[z + 1]] for z in others.tolist()])
                hit = own[np.minimum(np.searchsorted(own, met), len(own) - 1)] == met
                both[k : k + len(others)] = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[others])[:-1]]), dtype=np.int64)
        value = both / (size[x] + size[y] - both)
        keep = value >= threshold
        return pa.table([a[keep], b[keep], value[keep]], schema=schema)

    return score


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n, bits) of (rep, items): a bitmap of 4 to 8 bits a token, a power of two in size."""
    for whole in batches:
        for low in range(0, whole.num_rows, ROWS):
            b = whole.slice(low, ROWS)
            offsets, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            bits = []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                size = 1 << max(9, (4 * (hi - lo) - 1).bit_length())
                out = np.zeros(size, dtype=np.uint8)
                out[((flat[lo:hi].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (size - 1)] = 1
                bits.append(np.packbits(out).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets).astype(np.int32)), pa.array(bits, pa.binary())], names=["rep", "n", "bits"])


def _likely(threshold: float):
    def narrow(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        """(a, b, na, nb) of a bucket's pairs that its bitmaps (place, rep, n, bits) leave possible."""
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32())])
        if not pairs.num_rows or not sets.num_rows:
            return schema.empty_table()
        rep, size = sets["rep"].to_numpy(), sets["n"].to_numpy().astype(np.int64)
        maps = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for c in sets["bits"].chunks for x in c]
        width = np.array([len(x) for x in maps])
        order = np.argsort(rep)
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        x, y = (order[np.searchsorted(rep, v, sorter=order)] for v in (a, b))
        turn = np.lexsort((width[y], x))
        a, b, x, y = a[turn], b[turn], x[turn], y[turn]
        keep = np.zeros(len(a), dtype=bool)
        cut = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (width[y[1:]] != width[y[:-1]])]))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(x)], strict=True):
            k = min(width[x[lo]], width[y[lo]])  # the wider one is folded
            own = np.bitwise_or.reduce(maps[x[lo]].reshape(-1, k), axis=0)
            for at in range(lo, hi, ROWS):
                z = y[at : min(hi, at + ROWS)]
                others = np.bitwise_or.reduce(np.stack([maps[j] for j in z.tolist()]).reshape(len(z), -1, k), axis=1)
                n, m = size[x[lo]], size[z]
                need = threshold / (1 + threshold) * (n + m) - 1e-6
                most = np.minimum(n - np.bitwise_count(own & ~others).sum(axis=1, dtype=np.int64), m - np.bitwise_count(others & ~own).sum(axis=1, dtype=np.int64))
                keep[at : at + len(z)] = most >= need
        return pa.table([a[keep], b[keep], size[x[keep]].astype(np.int32), size[y[keep]].astype(np.int32)], schema=schema)

    return narrow


def _dealt(pairs: DataFrame, room: int) -> DataFrame:
    """(bucket, a, b) of the written pairs (a, b, na, nb); a bucket's sets have about room tokens.

    Pairs are dealt out by the least set near them, so that those of a group of similar sets share a bucket; a group with many tokens or pairs is cut into blocks of sets, and each two
    of its blocks are a unit of their own.
    """
    spark = pairs.sparkSession
    ends = F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("na").alias("n")), F.struct(F.col("b").alias("rep"), F.col("nb").alias("n")))).alias("e")
    labels = pairs.select("a", ends).groupBy("e.rep").agg(F.min("a").alias("label")).withColumnRenamed("rep", "a")
    near = materialize(pairs.join(labels, "a"), "near")
    placed = near.select("label", ends).select("label", "e.*").distinct()
    weight = placed.groupBy("label").agg(F.sum("n").alias("w")).join(near.groupBy("label").agg(F.count(F.lit(1)).alias("c")), "label")
    weight = materialize(weight, "weights")
    tokens, count = weight.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens // room) + 1, int(count // BUCKET_PAIRS) + 1)
    blocks = F.greatest(F.ceil(F.col("w") / room), F.ceil(F.sqrt(F.col("c") / BUCKET_PAIRS)))
    # as many at most as there are blocks in all
    large = weight.where((F.col("w") > room) | (F.col("c") > BUCKET_PAIRS)).select("label", blocks.alias("blocks"))
    block = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.col("blocks")), F.lit(0))
    dealt = near.join(F.broadcast(large), "label", "left").select(F.pmod(F.xxhash64("label", block("a"), block("b")), F.lit(buckets)).alias("bucket"), "a", "b")
    dealt = materialize(dealt, "dealt")
    for used in (near, weight):
        release(used)
    return dealt


def _together(pairs: DataFrame, held: DataFrame, room: int, function, schema: str, name: str) -> DataFrame:
    """function of each bucket's pairs and of what held (rep, ...) has of its sets."""
    dealt = _dealt(pairs, room)
    wanted = dealt.select(F.col("bucket").alias("place"), F.explode(F.array("a", "b")).alias("rep")).distinct()
    moved = wanted.join(held, "rep").select("place", *held.columns)
    out = materialize(dealt.groupBy("bucket").cogroup(moved.groupBy("place")).applyInArrow(function, schema), name)
    release(dealt)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of the written pairs (a, b, na, nb) with score >= threshold; sets: (ord, items) of at least their sets.

    Bitmaps with room for their sets go first, an eighth of them at most, and leave few pairs that fail.
    """
    of = lambda p: sets.where(among(F.col("ord"), p.select(F.explode(F.array("a", "b")).alias("rep")).distinct())).select(F.col("ord").alias("rep"), "items")
    bitmaps = materialize(of(pairs).mapInArrow(_wide, "rep long, n int, bits binary"), "bitmaps")
    likely = _together(pairs, bitmaps, 8 * BUCKET_TOKENS, _likely(threshold), "a long, b long, na int, nb int", "likely")
    release(bitmaps)
    found = _together(likely, of(likely), BUCKET_TOKENS, _scores(threshold), "a long, b long, score double", "class-pairs")
    release(likely)
    return found


def _class_pairs(classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of the written classes (rep, n, least, most, size, place of a member) with score >= threshold, a < b."""
    top = sets.select(F.explode("items").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1").orderBy(F.desc("df"), "t").limit(MOST_FREQUENT).toPandas()
    frequent = top["t"].to_numpy(dtype=np.int64)[::-1].copy()
    expected = classes.agg(F.sum(F.col("n") * (1 - threshold) + 1)).first()[0] or 0
    lots = max(1, min(MOST_LOTS, math.ceil(expected / LOT)))
    bits, slots = bit_table(classes.select("rep"))
    schema = "rep long, n int, at int, key long, " + ", ".join(f"b{k} long" for k in range(BITMAP)) + ", lot int"
    keyed = materialize(sets.select(F.col("ord").alias("rep"), "items", slot_of(F.col("ord"), slots).alias("slot")).mapInArrow(_prefixes(frequent, threshold, bits, lots), schema), "prefixes", by="lot", options=HASHES)
    met = [materialize(_met(keyed.where(F.col("lot") == k), threshold), "met") for k in range(lots)]
    release(keyed)
    pairs = reduce(DataFrame.unionByName, met).distinct()
    x, y = classes.alias("x"), classes.alias("y")
    near = pairs.join(x, F.col("a") == F.col("x.rep")).join(y, F.col("b") == F.col("y.rep"))
    near = near.where((F.col("x.least") <= F.lit(MOST_SIZE_RATIO) * F.col("y.most")) & (F.col("y.least") <= F.lit(MOST_SIZE_RATIO) * F.col("x.most")))
    # classes of one member each, one within the other: a file and its function
    near = near.where(~((F.col("x.size") == 1) & (F.col("y.size") == 1) & F.coalesce(nested("x", "y"), F.lit(False))))
    near = materialize(near.select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb")), "class-candidates")
    for used in met:
        release(used)
    found = _verified(near, sets, threshold)
    release(near)
    return found


def similar_pairs(fragments: DataFrame, threshold: float, sets: DataFrame | None = None) -> DataFrame:
    """(a, b, score) with a < b, score >= threshold, comparable; fragments: ord, file_path, lines, token_count, and items or tokens.

    With sets, a written table (ord, items) that has these fragments' sets and maybe others', fragments has h1, h2, n instead (with_sets): so the sets needn't move to be chosen.
    """
    rows = fragments.where("token_count > 0")
    place = ["ord", "file_path", "start_line", "end_line", "token_count"]
    if sets is None and "items" not in rows.columns:
        rows = rows.withColumn("items", items_of(F.col("tokens")))
    if threshold <= 0:
        return _banded(rows.select(*place, "items") if sets is None else rows.select(*place).join(sets.select("ord", "items"), "ord"), threshold)
    mine = None
    if sets is None:
        sets = rows = mine = materialize(with_sets(rows).select(*place, "items", *OWN), "items", options=HASHES)
    members = rows.select(*place, *OWN)
    members = materialize(members.join(members.groupBy(*OWN).agg(F.min("ord").alias("rep"), F.count(F.lit(1)).alias("size")), OWN).select(*place, "n", "rep", "size"), "set-members")
    each = members.groupBy("rep", "n").agg(F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.max("size").alias("size"), *[F.min(c).alias(c) for c in ("file_path", "start_line", "end_line")])
    classes = materialize(each, "set-classes")
    found = _class_pairs(classes, sets, threshold)
    for used in (classes, mine):
        release(used)
    across = found.join(members.withColumnRenamed("rep", "a").alias("x"), "a").join(members.withColumnRenamed("rep", "b").alias("y"), "b").where(comparable("x", "y"))
    out = across.select(F.least("x.ord", "y.ord").alias("a"), F.greatest("x.ord", "y.ord").alias("b"), "score")
    several = members.where("size > 1")
    x, y = several.alias("x"), several.alias("y")
    within = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.ord") < F.col("y.ord")) & comparable("x", "y"))
    return out.unionByName(within.select(F.col("x.ord").alias("a"), F.col("y.ord").alias("b"), F.lit(1.0).alias("score")))


def _banded(rows: DataFrame, threshold: float) -> DataFrame:
    """Every pair of fitting size."""
    band = F.floor(F.log(F.col("token_count").cast("double")) / F.lit(math.log(MOST_SIZE_RATIO + 1e-6)))
    keyed = rows.drop("items").withColumn("key", band)
    right = keyed.withColumn("key", F.explode(F.array(F.col("key") - 1, F.col("key"), F.col("key") + 1)))
    pairs = keyed.alias("a").join(right.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.ord") < F.col("b.ord")) & comparable("a", "b")).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b")).distinct()
    left = pairs.join(rows.select(F.col("ord").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(rows.select(F.col("ord").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    scored = both.select("a", "b", common.alias("i"), F.size("x").alias("n"), F.size("y").alias("m"))
    return scored.select("a", "b", (F.col("i") / (F.col("n") + F.col("m") - F.col("i"))).alias("score")).where(F.col("score") >= F.lit(threshold))
