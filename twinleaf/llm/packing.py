"""Packing documents into fixed sequences by the sum-of-squares rule.

Csirik, Johnson, Kenyon, Orlin, Shor and Weber, "On the sum-of-squares
algorithm for bin packing" (2006): with N(g) open bins of residual gap g, an item goes
where the sum of N(g)^2 becomes smallest. Items are taken from the longest to
the shortest, which leaves short pieces for the last gaps.

Documents are tokenized where they are read; only (doc_id, piece, length,
checksum) move. The pieces are written with a number each, and dealt by a hash of it to shards of about SHARD
pieces (of up to 64 sequences' worth where these are very short), each packed by one task with the 2048 gap counts as its whole state: repeated rows spread like others.
Sequences that a shard leaves with a gap are opened again, and their pieces
are packed anew in shards of the next level, which mix the leftovers of many
shards. It ends when a level fits one shard, or closes sequences of less than LEAST_CLOSED of its pieces: then
the rest is of sizes that don't go together.

Edge cases: null or empty texts give one piece of length 1 (the closing id 0).
Documents over the limit are cut, and only these. Repeated rows are packed one
by one; equal (doc_id, piece) rows stay separate, and a null doc_id stays null. Other columns, whatever their names, play no part.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import materialize
from .tables import small_batches, table
from .tokens import encoder, public_path

CAPACITY = 2048
#: Pieces of a shard, about; shards of very short pieces hold more, so that they fill SEQUENCES of them.
SHARD, SEQUENCES = 4096, 64
END_ID = 0
#: Share of a level's pieces that must end in full sequences for another level to follow.
LEAST_CLOSED = 0.02
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class SumOfSquares:
    """Bins by residual gap; place() returns (bin, offset) of an item."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.filled: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        cap, counts = self.capacity, self.counts
        if not 0 < size <= cap:
            raise ValueError(f"an item of {size} in bins of {cap}")
        # growth of the sum when a bin of gap g + size becomes one of gap g; gap 0 is no open bin
        before = counts[size:]
        after = counts[: cap + 1 - size]
        growth = 2 * (after - before) + 2
        growth[0] = 1 - 2 * before[0]
        growth[before == 0] = np.iinfo(np.int64).max
        growth[-1] = 2 * counts[cap - size] + 1 if size < cap else 0  # a new bin
        to = int(np.argmin(growth))
        gap = to + size
        if to == cap - size:
            at, offset = len(self.filled), 0
            self.filled.append(0)
        else:
            at = self.open[gap].pop()
            counts[gap] -= 1
            offset = cap - gap
        self.filled[at] = offset + size
        if to:
            self.open[to].append(at)
            counts[to] += 1
        return at, offset


def pack_shard(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin holds."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    rule = SumOfSquares(capacity)
    for k in np.argsort(-lengths, kind="stable"):
        bins[k], offsets[k] = rule.place(int(lengths[k]))
    return bins, offsets, np.array(rule.filled, dtype=np.int64)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, in place: no shuffle, and ids never leave the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).raw
        end, step = np.array([END_ID], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for low in range(0, batch.num_rows, 128):
                for row, raw in enumerate(encode(batch.column(1).slice(low, 128).to_pylist()), low):
                    raw += end
                    for piece, at in enumerate(range(0, len(raw), step)):
                        part = raw[at : at + step]
                        rows.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                row, piece, *rest = zip(*rows)
                # ids pass as they are: null ones would make numbers with a fraction of large ones in pandas
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in rest)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """pieces (PIECES and row, a number of each) with sequence_id and offset."""

    full = F.col("length") == capacity
    packed = []

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["shard"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        bins, offsets, filled = pack_shard(rows["length"].to_numpy(), capacity)
        made = {"sequence_id": (key[0].as_py() << 24) + bins, "offset": offsets, "gap": capacity - filled[bins]}
        return pa.table([*rows.columns, *made.values()], names=[*rows.column_names, *made])

    open_pieces = pieces.where(~full)
    level = 0
    left, tokens = open_pieces.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    while left:
        shards = min(-(-left // shard), -(-tokens // (SEQUENCES * capacity)))
        # a level's shards have numbers of their own, so that sequences stay apart
        dealt = open_pieces.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)) + F.lit(level << 34))
        done = materialize(dealt.groupBy("shard").applyInArrow(one, f"{PIECES}, row long, sequence_id long, offset long, gap long"), f"pack{level}")
        last = left
        left, tokens = done.where("gap > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        if shards == 1 or left > (1 - LEAST_CLOSED) * last:
            packed.append(done)
            break
        packed.append(done.where("gap = 0"))
        open_pieces = done.where("gap > 0").drop("sequence_id", "offset", "gap")
        level += 1
    # a full piece is a sequence of its own
    out = pieces.where(full).withColumns({"sequence_id": -F.col("row") - 1, "offset": F.lit(0).cast("long")})
    for p in packed:
        out = out.unionByName(p.drop("gap"))
    return out.drop("row")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    cut = pieces_of(docs, tokenizer_path or public_path("word_bpe_49k.json"), capacity)
    return pack(materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity, shard)


def op3_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
