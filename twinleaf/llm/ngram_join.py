"""N-gram Jaccard join with signature trees, exact at the threshold 3/4.

1. Every text becomes its set of 5-word shingles (64-bit hashes). Equal sets
   form a class, which goes on as the number of one of its rows.
2. Two sets with Jaccard 3/4 share a token among the first n - ceil(3n/4) + 1
   of each under any fixed order. The order here is rare first: tokens in the
   broadcast list of frequent ones (at most MOST_FREQUENT, counted over all documents) come last,
   so that passages which many documents share meet in few groups. The list
   decides speed alone, never the result. The place of a token in the order bounds the size of a
   partner with which it is the first token shared.
3. The sets that share such a token form a group. Runs of equal groups are
   kept once. A group of over 2 * PIECE sets is split into pieces of about PIECE: by the list before its
   sets move, so that no task gets all of a hot token, and by its own count where the list has missed it.
   Sets of a split group for whose size and place no other has room leave it.
4. Per group a signature tree is built and traversed against itself. The
   first round looks for a spanning forest of candidates in each piece, which joins large groups of near
   copies by few exact checks. The second looks for all candidate pairs between different
   components, also between the pieces of a split group: there every set outside
   the group's largest component meets the pieces whose sizes and components leave a link possible.
5. Candidates that bitmaps of four bits a token don't rule out are checked exactly on their whole sets. Components of the
   links come from large and small stars.

A link between sets that the first round has already joined need not be found
again, so no pairs within a group of copies are expanded; all components are exact.

Edge cases: null, empty or blank texts have no shingles and link with nothing.
Fewer than five words form one shingle. Repeated rows give repeated results, and rows that share a doc_id but not
their text are documents of their own. A row without a doc_id links as others do: its component_id is the smallest
doc_id reachable, null if none is. Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.storage import materialize, release
from .shingles import mix, shingle_sets
from .signature_tree import DEN, NUM, SignatureTree, WORDS, bitmap, can_link, wide_bitmap
from .tables import TEXTS, arrow_rows, fresh_name, table

U = np.uint64
#: Tokens of the frequent list at most, and the documents from which a token is frequent.
MOST_FREQUENT, FREQUENT_DF = 100_000, 24
#: Tokens that a task counts at once, and the copies that it must see of one to report it.
COUNTED, LOCAL_DF = 1_500_000, 2
#: Sets of a piece of a split group, about; groups of up to twice as many stay whole.
PIECE = 1024
#: Signatures that a task packs at once, and that a group of packed ones holds about.
FLUSH, PER_TASK = 500_000, 400_000
#: Different sets that a task remembers, so as not to send them twice.
REMEMBERED = 200_000
#: Sets above this size carry a wide bitmap besides.
WIDE_FROM = 1024
#: Keys of a bit table at most: 2^27 bits.
MOST_WANTED = 1 << 23
#: Pairs with their whole sets of a batch that a Python worker takes.
PAIRS = 250
#: Sizes of sets in steps of a twentieth, for what partners a split group has to offer.
STEP = 1.05
ROWS = "frequent boolean, doc_id long, key long, n long, h1 long, h2 long, bits binary, wide binary"
RUNS = "run long, first long, base long, h1 long, n long, largest long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, key, text) a row per document, and one for each token that is frequent among the task's different sets."""
    pool: list[np.ndarray] = []
    seen: set[int] = set()
    held = 0

    def frequent() -> pa.RecordBatch:
        every = np.concatenate(pool) if pool else np.empty(0, U)
        pool.clear()
        every.sort()
        cut = np.append(np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])), len(every)) if len(every) else np.zeros(1, dtype=np.int64)
        c = np.diff(cut)
        h, c = every[cut[:-1][c >= LOCAL_DF]], c[c >= LOCAL_DF]
        zero, none = pa.array(np.zeros(len(h), dtype=np.int64)), pa.nulls(len(h), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([True] * len(h), pa.bool_()), zero, zero, pa.array(c.astype(np.int64)), pa.array(h.view(np.int64)), zero, none, none], names=names)

    names = ["frequent", "doc_id", "key", "n", "h1", "h2", "bits", "wide"]
    for b in batches:
        rows = b.num_rows
        n, h1, h2 = (np.zeros(rows, dtype=np.int64) for _ in range(3))
        bits: list[bytes | None] = [None] * rows
        wide: list[bytes | None] = [None] * rows
        for row, s in shingle_sets(b.column(2)):
            n[row], h1[row], h2[row] = identity(s)
            bits[row] = bitmap(s).tobytes()
            if len(s) > WIDE_FROM:
                wide[row] = wide_bitmap(s)
            if int(h1[row]) not in seen:
                seen.add(int(h1[row]))
                pool.append(s)
                held += len(s)
            if held >= COUNTED:
                yield frequent()
                held = 0
                if len(seen) > REMEMBERED:
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array([False] * rows, pa.bool_()), b.column(0), b.column(1), pa.array(n), pa.array(h1), pa.array(h2), pa.array(bits, pa.binary()), pa.array(wide, pa.binary())], names=names)
    yield frequent()


def identity(s: np.ndarray) -> tuple[int, int, int]:
    """Size and two sums of hashes, which tell sets apart."""
    with np.errstate(over="ignore"):
        a = mix(s).sum(dtype=U)
        c = mix(s ^ U(0x5DEECE66D1234567)).sum(dtype=U)
    return len(s), int(a.view(np.int64)), int(c.view(np.int64))


def prefix_length(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN + 1


def pieces_of(count: np.ndarray) -> np.ndarray:
    """Pieces into which groups of these sizes are split."""
    return np.where(count > 2 * PIECE, -(-count // PIECE), 1).astype(np.int64)


def piece_key(base: np.ndarray, h: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """The piece of the group of token base to which set h belongs: other neighbours in each group."""
    with np.errstate(over="ignore"):
        at = mix(h ^ base) % pieces.astype(U)
        return mix(base + (at + U(1)) * U(0x9E3779B97F4A7C15))


def _signatures(frequent: tuple[np.ndarray, np.ndarray], parts: int):
    """Packs the prefix tokens of the task's different sets by part."""
    common, counts = frequent
    pieces = pieces_of(counts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        sets: list[tuple[int, int, np.ndarray]] = []
        split: list[tuple[np.ndarray, int, int, np.ndarray]] = []
        seen: set[tuple[int, int]] = set()
        held = 0

        def rows(key: np.ndarray, h: np.ndarray, n: np.ndarray, most: np.ndarray, base: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            part = (key >> U(40)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            key, h, n, most, part = key[order], h[order], n[order], most[order], part[order]
            base = base[order] if base is not None else None
            cuts = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[lo]], pa.int32()), pa.array([(key[lo:hi] if base is not None else key[lo:hi].astype(np.uint32)).tobytes()]), pa.array([h[lo:hi].tobytes()]), pa.array([n[lo:hi].tobytes()]), pa.array([most[lo:hi].tobytes()]), pa.array([base[lo:hi].tobytes() if base is not None else None], pa.binary())],
                    names=["part", "keys", "sets", "sizes", "largest", "bases"],
                )

        def flush() -> Iterator[pa.RecordBatch]:
            if keys:
                key = np.concatenate(keys)
                times = np.array([len(m) for _, _, m in sets])
                yield from rows(key, np.repeat(np.array([h for h, _, _ in sets], dtype=U), times), np.repeat(np.array([n for _, n, _ in sets], dtype=np.int32), times), np.concatenate([m for _, _, m in sets]), None)
            if split:
                base = np.concatenate([k for k, _, _, _ in split])
                times = np.array([len(k) for k, _, _, _ in split])
                h = np.repeat(np.array([h for _, h, _, _ in split], dtype=U), times)
                n = np.repeat(np.array([n for _, _, n, _ in split], dtype=np.int32), times)
                yield from rows(piece_key(base, h, pieces[np.searchsorted(common, base)]), h, n, np.concatenate([m for _, _, _, m in split]), base)
            keys.clear(), sets.clear(), split.clear()

        for b in batches:
            for _, s in shingle_sets(b.column(0)):
                with np.errstate(over="ignore"):
                    h = int(mix(s).sum(dtype=U))
                n = len(s)
                if (n, h) in seen:
                    continue
                seen.add((n, h))
                take = prefix_length(n)
                # if the first token shared is the one at place i, the overlap is at most n - i: the partner has largest tokens at most
                largest = ((4 * n - 7 * np.arange(take, dtype=np.int64)) // 3).astype(np.int32)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    hit = common[at] == s
                    rare = s[~hit][:take]
                    more = take - len(rare)
                    if more:
                        often, place = s[hit], at[hit]
                        chosen = np.lexsort((often, counts[place]))[:more]
                        often, place = often[chosen], place[chosen]
                        big = pieces[place] > 1
                        if big.any():
                            split.append((often[big], h, n, largest[take - more :][big]))
                            held += int(big.sum())
                        largest = np.concatenate([largest[: take - more], largest[take - more :][~big]])
                        rare = np.concatenate([rare, often[~big]])
                else:
                    rare = s[:take]
                if len(rare):
                    keys.append(mix(rare))
                    sets.append((h, n, largest))
                    held += len(rare)
                if held >= FLUSH:
                    yield from flush()
                    held = 0
                    if len(seen) > REMEMBERED:
                        seen.clear()
        yield from flush()

    return pack


def _split_runs(key: np.ndarray, base: np.ndarray, h: np.ndarray, n: np.ndarray, most: np.ndarray) -> pd.DataFrame:
    """Members of pieces: a piece is a run of its own, dealt out by itself."""
    run = mix(key).view(np.int64)
    return pd.DataFrame({"run": run, "first": run, "base": pd.array(base.view(np.int64), dtype="Int64"), "h1": h.view(np.int64), "n": n, "largest": most})


def _runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """(run, first, base, h1, n, largest): the sets of each token that two sets or more share; equal groups once.

    first deals the groups out: those with the same smallest set go together, the pieces of a split one apart.
    """
    out = [pd.DataFrame({"run": pd.Series(dtype="int64"), "first": pd.Series(dtype="int64"), "base": pd.Series(dtype="Int64"), "h1": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "largest": pd.Series(dtype="int64")})]
    for split, rows in pdf.groupby(pdf["bases"].notna()):
        key = np.concatenate([np.frombuffer(x, dtype=U if split else np.uint32) for x in rows["keys"]])
        h = np.concatenate([np.frombuffer(x, dtype=U) for x in rows["sets"]])
        n = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in rows["sizes"]])
        most = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in rows["largest"]])
        order = np.lexsort((-most, h, n, key))
        base = np.concatenate([np.frombuffer(x, dtype=U) for x in rows["bases"]])[order] if split else None
        key, h, n, most = key[order], h[order], n[order], most[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (n[1:] != n[:-1])
        key, h, n, most = key[new], h[new], n[new].astype(np.int64), most[new].astype(np.int64)
        if split:
            out.append(_split_runs(key, base[new], h, n, most))
            continue
        for _ in range(3):  # a set without another of fitting size in its group has no partner there
            if not len(key):
                break
            rank = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) << 32
            at = rank + n
            others = np.searchsorted(at, rank + most, side="right") - np.searchsorted(at, rank + (NUM * n + DEN - 1) // DEN, side="left") - (n <= most)
            keep = others > 0
            key, h, n, most = key[keep], h[keep], n[keep], most[keep]
            if keep.all():
                break
        if not len(key):
            continue
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (DEN * n[:-1] < NUM * n[1:])  # also where sizes break apart
        cut = np.flatnonzero(first)
        size = np.diff(np.append(cut, len(key)))
        # a group that the list of frequent tokens has missed
        pieces = np.repeat(pieces_of(size), size)
        if (big := pieces > 1).any():
            # a part's keys are told apart by 32 bits; parts of a group whose sizes break apart stay apart
            base = mix((U(int(rows["part"].iloc[0])) << U(32) | key.astype(U)) + (np.repeat(np.arange(len(cut), dtype=U), size) << U(48)))
            out.append(_split_runs(piece_key(base[big], h[big], pieces[big]), base[big], h[big], n[big], most[big]))
        with np.errstate(over="ignore"):
            run = mix(np.add.reduceat(mix(h ^ U(0x2545F4914F6CDD1D)), cut) + size.astype(U))
        every = np.repeat(size > 1, size) & ~big
        smallest = np.minimum.reduceat(h, cut)
        got = pd.DataFrame({"run": np.repeat(run, size).view(np.int64), "first": np.repeat(smallest, size).view(np.int64), "h1": h.view(np.int64), "n": n, "largest": most})[every]
        got = got.groupby(["run", "first", "h1", "n"], as_index=False, sort=False)["largest"].max()
        out.append(got.assign(base=pd.array([None] * len(got), dtype="Int64"))[["run", "first", "base", "h1", "n", "largest"]])
    return pd.concat(out)


def _search(spanning: bool):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        """A row is a set with the groups that it is in, and its largest partner in each."""
        pdf = pdf.sort_values("rep", kind="stable")
        times = pdf["runs"].map(len).to_numpy()
        run, most, at = np.concatenate(list(pdf["runs"])), np.concatenate(list(pdf["limits"])), np.repeat(np.arange(len(pdf)), times)
        order = np.lexsort((-most, at, run))
        run, most, at = run[order], most[order], at[order]
        reps, sizes, labels, wides = (pdf[c].to_numpy() for c in ("rep", "n", "label", "wide"))
        rep, size, label, wide = reps[at], sizes[at], labels[at], wides[at]
        table = np.frombuffer(b"".join(pdf["bits"]), dtype=U).reshape(-1, WORDS)
        cut = np.append(np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])), len(run))
        a, b = [], []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            once = np.unique(rep[lo:hi], return_index=True)[1] + lo if hi - lo > 1 else ()
            if len(once) < 2:
                continue
            i, j = SignatureTree(size[once], table[at[once]], label[once], most[once], list(wide[once])).pairs(spanning)
            a.append(rep[once][i])
            b.append(rep[once][j])
        x = np.concatenate(a) if a else np.empty(0, dtype=np.int64)
        y = np.concatenate(b) if b else np.empty(0, dtype=np.int64)
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

    return search


def _sets(wanted: np.ndarray | None):
    """(n, h1, h2, wide, tokens) of the rows (key, text, slot) whose slot is in the wanted bits; equal keys once a task."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            if wanted is not None:
                slot = b.column(2).to_numpy(zero_copy_only=False)
                b = b.filter(pa.array((wanted[slot >> 6] >> (slot & 63).astype(U) & U(1)).astype(bool)))
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                fresh = []
                for row, key in enumerate(part.column(0).to_pylist()):
                    if key not in seen:
                        seen.add(key)
                        fresh.append(row)
                rows = [s for _, s in shingle_sets(part.column(1).take(pa.array(fresh, pa.int64())))]
                if rows:
                    n, h1, h2 = zip(*map(identity, rows))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (n, h1, h2)), pa.array([wide_bitmap(s) for s in rows], pa.binary()), pa.array([s.tobytes() for s in rows], pa.binary())], names=["n", "h1", "h2", "wide", "tokens"])
            if len(seen) > REMEMBERED:
                seen.clear()

    return sets


def row_key() -> Column:
    """Tells rows apart by doc_id and text; rows that agree in both may stand for each other."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def bit_table(keys: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The slots of n keys as bits (16 each, 16 MB at most), and the number of slots."""
    size = 1 << max(10, (16 * n - 1).bit_length())
    slot = F.pmod(F.xxhash64("key"), F.lit(size))
    words = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("v")).toPandas()
    bits = np.zeros(size >> 6, dtype=U)
    bits[words["w"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64).view(U)
    return bits, size


def token_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(rep, wide, tokens): the shingle sets of the classes in needed (rep, key, n, h1, h2).

    For up to MOST_WANTED of them a bit table of their rows' keys goes to the
    tasks, so that only their sets leave the scan. Beyond, their texts are joined.
    """
    n = needed.count()
    schema = "n long, h1 long, h2 long, wide binary, tokens binary"
    rows = docs.select(row_key().alias("key"), "text")
    if n > MOST_WANTED:
        found = rows.join(needed.select("key"), "key", "left_semi").select("key", "text", F.lit(0).alias("slot")).mapInArrow(_sets(None), schema)
    else:
        bits, size = bit_table(needed.select("key"), n)
        found = rows.select("key", "text", F.pmod(F.xxhash64("key"), F.lit(size)).alias("slot")).mapInArrow(_sets(bits), schema)
    return found.join(needed.select("rep", "n", "h1", "h2"), ["n", "h1", "h2"]).select("rep", "wide", "tokens").dropDuplicates(["rep"])


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, size of a, bits of a, size of b, bits of b) the pairs that the wide bitmaps don't rule out."""
    for x in batches:
        n1, n2 = x.column(2).to_pylist(), x.column(4).to_pylist()
        keep = [k for k in range(x.num_rows) if can_link(n1[k], np.frombuffer(x.column(3)[k].as_buffer(), dtype=np.uint8), n2[k], np.frombuffer(x.column(5)[k].as_buffer(), dtype=np.uint8))]
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([x.column(0).take(at), x.column(1).take(at)], names=["a", "b"])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        keep = []
        for k in range(x.num_rows):
            s, t = (np.frombuffer(x.column(c)[k].as_buffer(), dtype=U) for c in (2, 3))
            both = len(np.intersect1d(s, t, assume_unique=True))
            if DEN * both >= NUM * (len(s) + len(t) - both):
                keep.append(k)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([x.column(0).take(at), x.column(1).take(at)], names=["a", "b"])


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets reach the threshold."""
    spark = docs.sparkSession
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    needed = materialize(ends.join(classes.select("rep", "key", "n", "h1", "h2"), "rep"), "join-needed")
    with arrow_rows(spark, TEXTS):
        sets = materialize(token_sets(docs, needed), "join-sets")
    size = F.expr("octet_length(tokens) div 8")
    left = pairs.join(sets.select(F.col("rep").alias("a"), size.alias("n1"), F.col("wide").alias("w1")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), size.alias("n2"), F.col("wide").alias("w2")), "b").select("a", "b", "n1", "w1", "n2", "w2")
    with arrow_rows(spark, PAIRS):
        likely = materialize(both.mapInArrow(_narrow, "a long, b long"), "join-likely")
        left = likely.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("s")), "a")
        both = left.join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("t")), "b").select("a", "b", "s", "t")
        links = materialize(both.mapInArrow(_check, "a long, b long"), "join-links")
    for used in (sets, likely, needed):
        release(used)
    return links


def step_of(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / float(np.log(STEP))).cast("int")


def fitting(runs: DataFrame) -> DataFrame:
    """runs without those rows of split groups for which no set of the whole group has a fitting size and place.

    What a group offers is told by steps of sizes: of each, the largest partner that any of its sets takes.
    """
    split = runs.where("base is not null")
    step = step_of(F.col("n"))
    offered = split.groupBy("base", step.alias("step")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("largest").alias("most"), F.count(F.lit(1)).alias("c"))
    # one array of some 300 entries at most for a group
    by_base = offered.groupBy("base").agg(F.collect_list(F.struct("step", "lo", "hi", "most", "c")).alias("offers"))
    need = (F.col("n") * NUM + (DEN - 1)) / DEN
    fits = F.exists("offers", lambda o: (o["lo"] <= F.col("largest")) & (o["hi"] >= F.floor(need)) & (o["most"] >= F.col("n")) & ((o["step"] != step) | (o["c"] > 1)))
    return runs.where("base is null").unionByName(split.join(by_base, "base").where(fits).select(runs.columns))


def jaccard_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, components) of docs (doc_id, text): rows (doc_id, key, n, h1, h2) as they stand, and
    (n, h1, h2, rep, key, doc, component, smallest) for each class: its least doc_id, and that of its whole component."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(spark, TEXTS):
        rows = materialize(docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(_summaries, ROWS).withColumn("rep", F.monotonically_increasing_id()), "join-summaries")
    own = rows.where("not frequent")
    top = rows.where("frequent").groupBy("h1").agg(F.sum("n").alias("n")).where(f"n >= {FREQUENT_DF}").orderBy(F.desc("n"), "h1").limit(MOST_FREQUENT).toPandas()
    common, counts = top["h1"].to_numpy(dtype=np.int64).view(U), top["n"].to_numpy(dtype=np.int64)
    order = np.argsort(common)
    chosen = F.min(F.struct("rep", "key")).alias("m")
    classes = materialize(
        own.where("n > 0").groupBy("n", "h1", "h2").agg(chosen, F.min("doc_id").alias("doc"), F.first("bits").alias("bits"), F.first("wide").alias("wide")).select("n", "h1", "h2", "m.rep", "m.key", "doc", "bits", "wide"), "join-classes"
    )
    expected = classes.agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(expected // PER_TASK) + 1)
    packed = docs.select("text").mapInArrow(_signatures((common[order], counts[order]), parts), "part int, keys binary, sets binary, sizes binary, largest binary, bases binary")
    found = packed.groupBy("part").applyInPandas(_runs, RUNS).groupBy("run", "first", "base", "h1", "n").agg(F.max("largest").alias("largest"))
    with arrow_rows(spark, TEXTS):
        met = materialize(found.join(classes.select("h1", "n", "rep"), ["h1", "n"]).select("run", "first", "base", "rep", "n", "largest"), "join-met")
    runs = materialize(fitting(met), "join-runs")
    release(met)
    buckets = parts * 4

    def candidates(members: DataFrame, spanning: bool) -> DataFrame:
        # a set's bitmaps go to a bucket once, whatever the number of its groups there
        bucket = F.pmod(F.xxhash64("first"), F.lit(buckets)).alias("bucket")
        dealt = members.groupBy(bucket, "rep", "n", "label").agg(F.collect_list("run").alias("runs"), F.collect_list("largest").alias("limits")).join(classes.select("rep", "bits", "wide"), "rep")
        return dealt.groupBy("bucket").applyInPandas(_search(spanning), "a long, b long").distinct()

    tried = materialize(candidates(runs.withColumn("label", F.col("rep")), True), "join-pairs")
    first = verified(docs, tried, classes)
    joined = materialize(connected_components(first, "a", "b").withColumnRenamed("node", "rep"), "join-labels")
    labelled = materialize(runs.join(joined, "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component"), "join-labelled")
    release(runs)
    # a row for each group or piece of one; pieces belong together by their token, and a token of any number of sets has few pieces
    told = materialize(
        labelled.groupBy("run", "first", "base").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("largest").alias("reach")), "join-told"
    )
    whole = told.where("base is null and lo <> hi").select("run", "first", F.lit(None).cast("long").alias("base"))
    mixed = told.where("base is not null").groupBy("base").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("base")
    pieces = materialize(told.where("base is not null").join(mixed, "base", "left_semi"), "join-pieces")
    open_runs = materialize(labelled.join(whole.unionByName(pieces.select("run", "first", "base")).select("run", "first"), ["run", "first"], "left_semi"), "join-open")
    split = open_runs.where("base is not null")
    largest = split.groupBy("base", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("base").agg(F.max_by("label", F.struct("c", "label")).alias("usual"))
    outside = split.join(largest, "base").where("label <> usual").select("base", "rep", "n", "largest", "label")
    room = (F.col("least") <= F.col("largest")) & (F.col("most") * DEN >= F.col("n") * NUM) & (F.col("reach") >= F.col("n")) & ((F.col("lo") != F.col("hi")) | (F.col("lo") != F.col("label")))
    guests = outside.join(pieces, "base").where(room).select("run", "first", "base", "rep", "n", "largest", "label")
    members = open_runs.select("run", "first", "base", "rep", "n", "largest", "label").unionByName(guests)
    second = verified(docs, materialize(candidates(members, False).join(tried, ["a", "b"], "left_anti"), "join-pairs"), classes)
    for used in (labelled, told, open_runs, pieces):
        release(used)
    joined = materialize(connected_components(first.unionByName(second), "a", "b").withColumnRenamed("node", "rep"), "join-joined")
    each = classes.select("n", "h1", "h2", "rep", "key", "doc").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # the least row number stands for a component; its smallest doc_id is looked up for those of two classes or more
    smallest = each.join(joined.select("rep"), "rep", "left_semi").groupBy("component").agg(F.min("doc").alias("smallest"))
    return own, each.join(smallest, "component", "left").withColumn("smallest", F.coalesce("smallest", "doc"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    own, classes = jaccard_rows(docs)
    found = own.select("doc_id", "n", "h1", "h2").join(classes.select("n", "h1", "h2", "smallest"), ["n", "h1", "h2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of docs of each component, that of its smallest doc_id; rows without a shingle stay.

    Rows that go are told by their keys: where a bit table of these holds nothing, a row stays without being moved.
    """
    own, classes = jaccard_rows(docs.select("doc_id", "text"))
    by_class = own.where("n > 0").groupBy("n", "h1", "h2", "doc_id", "key").agg(F.count(F.lit(1)).alias("times"))
    placed = materialize(by_class.join(classes.select("n", "h1", "h2", "component"), ["n", "h1", "h2"]).select("component", "doc_id", "key", "times"), "join-placed")
    # nulls are last: a row without an id stays only where none has one
    stays = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("m")).select("component", F.col("m.key").alias("stays"))
    # written first: a join that nothing is grouped after may be split where one component is hot
    judged = materialize(placed.join(stays, "component").select("key", "stays", "times"), "join-judged")
    gone = judged.where("key <> stays").select("key").withColumn("again", F.lit(False))
    repeated = judged.where("key = stays and times > 1").select("key").withColumn("again", F.lit(True))
    marked = materialize(gone.unionByName(repeated).distinct(), "join-marked")
    n = marked.count()
    key, slot, again, word, value = (fresh_name(docs, x) for x in ("key", "slot", "again", "word", "value"))
    rows = docs.withColumn(key, row_key())
    marks = marked.select(F.col("key").alias(key), F.col("again").alias(again))
    if n <= MOST_WANTED:
        words, size = bit_table(marked.select("key"), n)
        bits = docs.sparkSession.createDataFrame(pd.DataFrame({word: np.flatnonzero(words), value: words[words != 0].view(np.int64)}), f"{word} long, {value} long")
        slots = rows.withColumn(slot, F.pmod(F.xxhash64(key), F.lit(size)))
        hit = F.col(value).isNotNull() & (F.expr(f"shiftright({value}, cast({slot} & 63 as int)) & 1") == 1)
        told = slots.join(F.broadcast(bits), F.shiftright(slot, 6) == F.col(word), "left").withColumn(again, hit).drop(word, value, slot)
        free, rows = told.where(~F.col(again)).select(docs.columns), told.where(again).drop(again)
    else:
        free = None
    checked = rows.join(marks, key, "left")
    once = checked.where(again).dropDuplicates([key]).select(docs.columns)
    out = checked.where(F.col(again).isNull()).select(docs.columns).unionByName(once)
    return out if free is None else free.unionByName(out)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
