"""Embedding near-duplicates by NN-descent.

1. Rows with equal vectors form a class, which goes on once, with its weight.
2. A first neighbour graph comes from random hyperplanes: classes are dealt by
   the signs of a few projections, and a bucket is cut by further
   hyperplanes into leaves of at most LEAF vectors, in which each finds its
   NEIGHBOURS nearest. The number of trees grows with the number of cuts.
3. NN-descent: around each vector, its neighbours and those that have it as a neighbour are
   compared with each other; each member takes its PER_CENTRE nearest from there and keeps its nearest of all. Rounds go on while lists change
   much, ROUNDS at most.
4. Edges of at least the threshold give components. A list that is full of such edges is saturated: it may
   lack links to other full lists. Saturated lists are enlarged to twice their length from their neighbours' neighbours,
   again and again up to MOST_NEIGHBOURS. What is saturated even then is searched exactly for links to vectors of other
   components: caps (centre and largest angle) of CAP vectors of a component are compared with
   all other caps, and where they don't prove that nothing links, the vectors are.
   So components don't depend on the length of lists.
5. In each component of more than two vectors all links are counted exactly, without ever emitting a pair. A component of over BLOCK
   vectors is cut into local blocks of CAP; blocks whose caps prove all or none of their pairs linked are counted or passed over as
   a whole, and only the others meet vector by vector.
6. The audit takes AUDIT random vectors of each of three sizes of component and four times as many of those without
   one, finds their links among all vectors, and measures
   how many the components hold, as a mean over vectors with links, apart by size. Below the wanted recall, twice as many hyperplanes
   and further rounds follow; where REPEATS attempts aren't enough, all vectors are searched as saturated ones are.
   The recall is logged and returned.

Edge cases: vectors that are null, empty, zero or hold null or non-finite numbers link with nothing
and are kept. Vectors of different lengths never link. Repeated ids are rows of their own.
A row without a vec_id links as others do: its component_id is the smallest vec_id reachable, null if none is, and of such a component one
row is kept. Other columns, whatever their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.storage import materialize, release
from .tables import table

LOG = logging.getLogger(__name__)
THRESHOLD = 0.95
#: Length of a list, and of a saturated one at most before it is searched exactly.
NEIGHBOURS, MOST_NEIGHBOURS = 12, 48
#: Neighbours that a vector takes from one centre's surroundings, and those that a centre has besides its own list.
PER_CENTRE, BACKWARD = 4, 4
#: Parts to which the vectors that name one neighbour go first, so that a hub is cut down in many tasks.
SALTS = 32
#: Bytes of vectors that meet in one task, about.
TASK_BYTES = 32_000_000
LEAF = 128
TREES = 8
ROUNDS = 3
REPEATS = 3
AUDIT = 200
LARGE = 1000
RECALL = 0.98
SHARED = 0.01
SLICES = 256
BLOCK = 512
BUCKET = 2000
CAP = 256
CAPS = 2048
LIST = "node long, other long, cos double"


def matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of unit length in double precision."""
    x = np.frombuffer(b"".join(vectors), dtype="<f8").reshape(len(vectors), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def by_length(pdf: pd.DataFrame):
    """The rows, apart by the length of their vectors."""
    for _, part in pdf.groupby(pdf["vec"].map(len), sort=True):
        yield part.reset_index(drop=True)


def top_per_node(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = rows.drop_duplicates(["node", "other"]).sort_values(["node", "cos", "other"], ascending=[True, False, True], kind="stable")
    return rows[rows.groupby("node").cumcount() < k]


def leaves(x: np.ndarray, rng: np.random.Generator, most: int = LEAF):
    """Index arrays of at most `most` rows, cut at medians along random directions."""
    stack = [np.arange(len(x))]
    while stack:
        idx = stack.pop()
        if len(idx) <= most:
            yield idx
            continue
        along = x[idx] @ rng.normal(size=x.shape[1])
        order = np.argsort(along, kind="stable")
        half = len(idx) // 2
        stack += [idx[order[:half]], idx[order[half:]]]


def _leaf_lists(k: int, seed: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"node": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "cos": pd.Series(dtype="float64")})]
        for part in by_length(pdf.sort_values("node")):
            x, ids = matrix(part["vec"]), part["node"].to_numpy()
            rng = np.random.default_rng([seed, int(part["bucket"].iloc[0]) & 0xFFFFFFFF])
            for idx in leaves(x, rng):
                if len(idx) < 2:
                    continue
                sims = x[idx] @ x[idx].T
                np.fill_diagonal(sims, -2)
                near = np.argpartition(-sims, min(k, len(idx) - 1) - 1, axis=1)[:, : min(k, len(idx) - 1)]
                rows = np.repeat(np.arange(len(idx)), near.shape[1])
                out.append(pd.DataFrame({"node": ids[idx][rows], "other": ids[idx][near.ravel()], "cos": sims[rows, near.ravel()]}))
        return pd.concat(out)

    return search


def _local_join(k: int, each: int):
    """Compares the members of each centre's surroundings with each other, each taking `each` from there; the centre itself is one of them."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"node": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "cos": pd.Series(dtype="float64")})]
        for part in by_length(pdf):
            unique, first = np.unique(part["node"].to_numpy(), return_index=True)
            x = matrix(part["vec"].iloc[first])
            at = np.searchsorted(unique, part["node"].to_numpy())
            centre = part["centre"].to_numpy()
            order = np.argsort(centre, kind="stable")
            cut = np.append(np.flatnonzero(np.concatenate([[True], np.diff(centre[order]) != 0])), len(order))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                idx = np.unique(at[order[lo:hi]])
                if len(idx) < 2:
                    continue
                sims = x[idx] @ x[idx].T
                np.fill_diagonal(sims, -2)
                m = min(k, len(idx) - 1, each)
                near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                rows = np.repeat(np.arange(len(idx)), m)
                out.append(pd.DataFrame({"node": unique[idx][rows], "other": unique[idx][near.ravel()], "cos": sims[rows, near.ravel()]}))
        found = pd.concat(out)
        return top_per_node(found, k) if len(found) else found

    return search


def _merge(k: int):
    return lambda pdf: top_per_node(pdf[["node", "other", "cos"]], k)


def best(lists: DataFrame, k: int, parts: int, salts: int = 1) -> DataFrame:
    """The k best rows of each node; with salts, only of those that a salt of other brings together."""
    salt = [F.pmod(F.xxhash64("other"), F.lit(salts))] if salts > 1 else []
    dealt = lists.withColumn("part", F.pmod(F.xxhash64("node", *salt), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(_merge(k), LIST)


def _count_small(threshold: float):
    """Links of each vector within its component, weights counted, its own row included."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.sort_values("node").groupby("component", sort=False):
            linked = (x := matrix(own["vec"])) @ x.T >= threshold
            np.fill_diagonal(linked, True)
            out.append(pd.DataFrame({"node": own["node"].to_numpy(), "n": linked @ own["weight"].to_numpy()}))
        return pd.concat(out)

    return count


def _count_pairs(threshold: float):
    """Links between the vectors of two blocks, weights counted."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (a, b), pair in pdf.sort_values("node").groupby(["a", "b"], sort=False):
            p, q = pair[pair["block"] == a], pair[pair["block"] == b]
            linked = matrix(p["vec"]) @ matrix(q["vec"]).T >= threshold
            if a == b:
                np.fill_diagonal(linked, True)
            out.append(pd.DataFrame({"node": p["node"].to_numpy(), "n": linked @ q["weight"].to_numpy()}))
            if a != b:
                out.append(pd.DataFrame({"node": q["node"].to_numpy(), "n": linked.T @ p["weight"].to_numpy()}))
        return pd.concat(out)

    return count


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec, row): vectors in double precision as bytes, null where nothing can link; row is a number to be written with them."""
    values = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists("embedding", lambda v: F.coalesce(v != 0, F.lit(False)))

    def as_bytes(batches):
        import pyarrow as pa

        for b in batches:
            vecs = [None if not ok.as_py() else np.array(v.values.to_numpy(zero_copy_only=False), dtype="<f8").tobytes() for v, ok in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vecs, pa.binary())], names=["vec_id", "vec"])

    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, values).alias("v"), F.coalesce(fine, F.lit(False)).alias("ok")).mapInArrow(as_bytes, "vec_id long, vec binary")
    return found.withColumn("row", F.monotonically_increasing_id())


def trees_for(n: int, threshold: float) -> int:
    """Trees after which a pair at the threshold has shared a leaf but for SHARED of the cases: more planes need more trees."""
    cuts = np.log2(max(1, n / BUCKET)) + np.log2(BUCKET / LEAF) + 1
    same = (1 - np.arccos(threshold) / np.pi) ** cuts
    return max(TREES, int(np.ceil(np.log(SHARED) / np.log1p(-same))))


def first_lists(nodes: DataFrame, n: int, trees: int, seed: int) -> DataFrame:
    """Neighbour lists from random hyperplanes."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / BUCKET)))))

    def dealt(batches):
        for b in batches:
            out = []
            for part in by_length(b):
                x = matrix(part["vec"])
                for t in range(trees):
                    planes = np.random.default_rng([seed, t, x.shape[1]]).normal(size=(x.shape[1], bits + 1))
                    code = ((x @ planes[:, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), dtype=np.int64)
                    out.append(part[["node", "vec"]].assign(bucket=t * (1 << 40) + code, along=x @ planes[:, bits]))
            yield pd.concat(out) if out else pd.DataFrame({"node": pd.Series(dtype="int64"), "vec": pd.Series(dtype="object"), "bucket": pd.Series(dtype="int64"), "along": pd.Series(dtype="float64")})

    rows = nodes.select("node", "vec").mapInPandas(dealt, "node long, vec binary, bucket long, along double")
    # a hot code is cut into slices along one more direction, which keeps a pair beside a hot group together; a hash of the node would not
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.percentile_approx("along", [k / SLICES for k in range(1, SLICES)], 4 * SLICES).alias("cuts")).select("bucket", "c", F.when(F.col("c") > 2 * BUCKET, F.col("cuts")).alias("cuts"))
    rank = F.coalesce(F.size(F.filter("cuts", lambda v: v < F.col("along"))), F.lit(0))
    wanted = F.least(F.ceil(F.col("c") / (2 * BUCKET)), F.lit(SLICES))
    slice_ = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.floor(rank * wanted / SLICES))
    # beyond SLICES of them, a slice is dealt further by a hash
    deal = F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / (2 * BUCKET * SLICES)))
    cut = rows.join(sizes, "bucket").withColumn("bucket", F.xxhash64("bucket", slice_, deal)).select("node", "vec", "bucket")
    return cut.groupBy("bucket").applyInPandas(_leaf_lists(NEIGHBOURS, seed), LIST)


def around(lists: DataFrame, k: int, parts: int) -> DataFrame:
    """(centre, node): the best of a centre's own list and of those that name it, and the centre itself."""
    backward = lists.select(F.col("other").alias("node"), F.col("node").alias("other"), "cos")
    # a hub is named by any number of others: cut down by salts first, so that no task gets all of them; those left out stay in their own lists
    found = best(lists.select("node", "other", "cos").unionByName(best(backward, k + BACKWARD, parts, SALTS)), k + BACKWARD, parts)
    return found.select(F.col("node").alias("centre"), F.col("other").alias("node")).unionByName(found.select(F.col("node").alias("centre"), "node").distinct())


def descend(nodes: DataFrame, lists: DataFrame, k: int, parts: int, centres: DataFrame | None = None, each: int = PER_CENTRE) -> DataFrame:
    """One round of NN-descent, around the given centres (node) or all; lists of k."""
    members = around(lists, k, parts)
    if centres is not None:
        members = members.join(centres.select(F.col("node").alias("centre")), "centre", "left_semi")
    surroundings = members.join(nodes.select("node", "vec"), "node").withColumn("part", F.pmod(F.xxhash64("centre"), F.lit(parts)))
    found = surroundings.groupBy("part").applyInPandas(_local_join(k, each), LIST)
    return best(lists.unionByName(found), k, parts)


def saturated(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """(node) whose list of k is full of links."""
    return lists.where(F.col("cos") >= threshold).groupBy("node").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= k).select("node")


def enlarged(nodes: DataFrame, lists: DataFrame, threshold: float, parts: int) -> tuple[DataFrame, DataFrame]:
    """lists with saturated ones at twice the length, again and again up to MOST_NEIGHBOURS, and the nodes still saturated."""
    k = NEIGHBOURS
    full = materialize(saturated(lists, k, threshold), "emb-full")
    while k < MOST_NEIGHBOURS and not full.isEmpty():
        k *= 2
        now = materialize(descend(nodes, lists, k, parts, full, k), "emb-lists")
        for used in (lists, full):
            release(used)
        lists = now
        full = materialize(saturated(lists, k, threshold), "emb-full")
    return lists, full


def audit(nodes: DataFrame, labels: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """The least recall of components over classes of vectors: those of small components or none, of larger and of large ones.

    A sample of each of four sizes of component is compared with all vectors in blocks. A vector's recall is the share of
    its links that its component holds; classes take the mean over their vectors with links, each sample standing for its size's vectors.
    """
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    size = F.coalesce("size", F.lit(1))
    kinds = nodes.select("node", "vec").join(labels, "node", "left").join(sizes, "component", "left")
    kinds = kinds.withColumn("kind", F.when(size == 1, 0).when(size <= NEIGHBOURS, 1).when(size <= LARGE, 2).otherwise(3))
    totals = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
    asked = [kinds.where(F.col("kind") == k).orderBy(F.xxhash64("node"), "node").limit(queries * (4 if k == 0 else 1)).select("node", "vec", "kind").toPandas() for k in totals]
    asked = pd.concat(asked) if asked else pd.DataFrame()
    if not len(asked):
        return 1.0

    def search(batches):
        for b in batches:
            out = [pd.DataFrame({"q": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64")})]
            for part in by_length(b):
                mine = asked[asked["vec"].map(len) == len(part["vec"].iloc[0])]
                if len(mine):
                    i, j = np.nonzero(matrix(mine["vec"]) @ matrix(part["vec"]).T >= threshold)
                    out.append(pd.DataFrame({"q": mine["node"].to_numpy()[i], "node": part["node"].to_numpy()[j]}))
            found = pd.concat(out)
            yield found[found["q"] != found["node"]]

    links = nodes.select("node", "vec").mapInPandas(search, "q long, node long")
    l2 = labels.select(F.col("node").alias("q"), F.col("component").alias("cq"))
    rows = links.join(labels, "node", "left").join(l2, "q", "left").groupBy("q").agg((F.count(F.when(F.col("component") == F.col("cq"), 1)) / F.count(F.lit(1))).alias("held")).collect()
    kind = dict(zip(asked["node"], asked["kind"], strict=True))
    share = {k: totals[k] / n for k, n in asked["kind"].value_counts().items()}
    worst = 1.0
    for group in ((0, 1), (2,), (3,)):
        weights = [share[kind[r["q"]]] for r in rows if kind[r["q"]] in group]
        if weights:
            worst = min(worst, float(np.average([r["held"] for r in rows if kind[r["q"]] in group], weights=weights)))
    return worst


def _caps(pdf: pd.DataFrame) -> pd.DataFrame:
    """Deals vectors of one component to local blocks of at most CAP; the row of a block's least node has its cap and its weight."""
    out = []
    for part in by_length(pdf):
        for _, own in part.groupby("component", sort=True):
            own = own.sort_values("node").reset_index(drop=True)
            x, ids = matrix(own["vec"]), own["node"].to_numpy()
            for idx in leaves(x, np.random.default_rng(0), CAP):
                idx = np.sort(idx)
                c = x[idx].mean(axis=0)
                c = c / max(np.linalg.norm(c), 1e-300)
                head = np.arange(len(idx)) == 0
                radius = float(np.arccos(np.clip((x[idx] @ c).min(), -1, 1)))
                rows = own.loc[idx, ["node", "vec", "weight", "component"]].assign(block=ids[idx[0]], radius=np.where(head, radius, 0.0))
                rows["mass"] = np.where(head, rows["weight"].sum(), 0)
                rows["centre"] = [c.astype("<f8").tobytes() if h else None for h in head]
                out.append(rows)
    return pd.concat(out)


def blocks_of(members: DataFrame, parts: int) -> DataFrame:
    """members (node, vec, weight, component) in local blocks, with their caps."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    dealt = members.join(sizes, "component").withColumn("piece", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / (16 * CAP))))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("component", "piece"), F.lit(parts * 4)))
    made = dealt.select("node", "vec", "weight", "component", "part").groupBy("part").applyInPandas(_caps, "node long, vec binary, weight long, component long, block long, radius double, mass long, centre binary")
    return materialize(made, "emb-blocks")


PAIR = "a long, ca long, b long, cb long, between double, whole boolean, ma long, mb long"


def _cap_pairs(threshold: float, same: bool):
    """Pairs of blocks that their caps don't prove unlinked, of one component or of different ones; whole: their caps prove all pairs linked."""
    theta = np.arccos(threshold)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in PAIR.split(", ")]
        out = [pd.DataFrame({c: pd.Series(dtype={"between": "float64", "whole": "bool"}.get(c, "int64")) for c in names})]
        for _, group in pdf.groupby(["u", "i", "j"], sort=False):
            i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
            for part in by_length(group.rename(columns={"centre": "vec"})):
                p, q = part[part["chunk"] == i], part[part["chunk"] == j]
                if not len(p) or not len(q):
                    continue
                rp, rq = p["radius"].to_numpy()[:, None], q["radius"].to_numpy()[None, :]
                between = np.arccos(np.clip(matrix(p["vec"]) @ matrix(q["vec"]).T, -1, 1))
                near = between - rp - rq <= theta + 1e-6
                near &= (p["component"].to_numpy()[:, None] == q["component"].to_numpy()) == same
                if i == j:
                    near = np.triu(near, 0 if same else 1)
                r, c = np.nonzero(near)
                whole = (between + rp + rq < theta - 1e-6)[r, c]
                out.append(pd.DataFrame({"a": p["block"].to_numpy()[r], "ca": p["component"].to_numpy()[r], "b": q["block"].to_numpy()[c], "cb": q["component"].to_numpy()[c], "between": between[r, c], "whole": whole, "ma": p["mass"].to_numpy()[r], "mb": q["mass"].to_numpy()[c]}))
        return pd.concat(out)

    return search


def cap_pairs(blocks: DataFrame, threshold: float, same: bool, parts: int) -> DataFrame:
    """PAIR rows of blocks; caps meet in chunks of CAPS, within a component or all."""
    caps = blocks.where("centre is not null").select("block", "component", "radius", "centre", "mass").withColumn("u", F.col("component") if same else F.lit(0).cast("long"))
    chunks = caps.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / CAPS).alias("chunks"))
    spread = caps.join(chunks, "u").withColumn("chunk", F.pmod(F.xxhash64("block"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    spread = spread.select("u", "block", "component", "radius", "centre", "mass", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    dealt = spread.withColumn("part", F.pmod(F.xxhash64("u", "i", "j"), F.lit(parts * 4)))
    return dealt.groupBy("part").applyInPandas(_cap_pairs(threshold, same), PAIR)


def vectors_of(pairs: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """The vectors of the blocks of each pair (a, b), dealt out by pair."""
    both = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")).join(blocks.select("block", "node", "vec", "weight", "component"), "block")
    return both.withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(parts * 4)))


def _any_link(threshold: float):
    """(node, other): one link of each pair of blocks that has any."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (a, b), pair in pdf.groupby(["a", "b"], sort=False):
            p, q = pair[pair["block"] == a], pair[pair["block"] == b]
            sims = matrix(p["vec"]) @ matrix(q["vec"]).T
            r, c = np.unravel_index(int(np.argmax(sims)), sims.shape)
            if sims[r, c] >= threshold:
                found.append((p["component"].iloc[r], q["component"].iloc[c]))
        return pd.DataFrame(found, columns=["node", "other"], dtype="int64")

    return search


def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels after links (node, other) between components; a component without a row in labels is its node."""
    roots = materialize(connected_components(found, "node", "other"), "emb-roots").select(F.col("node").alias("component"), F.col("component").alias("root"))
    alone = roots.join(labels, "component", "left_anti").select(F.col("component").alias("node"), F.col("root").alias("component"))
    return materialize(labels.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")).unionByName(alone), "emb-labels")


def across(nodes: DataFrame, labels: DataFrame, asked: DataFrame, threshold: float, parts: int) -> DataFrame:
    """labels with all links joined that the nodes of asked have to asked nodes of other components: an exact search."""
    members = nodes.join(asked.select("node"), "node", "left_semi").join(labels, "node", "left").select("node", "vec", "weight", F.coalesce("component", "node").alias("component"))
    blocks = blocks_of(members, parts)
    near = materialize(cap_pairs(blocks, threshold, False, parts), "emb-near")
    pair = F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v")
    nearest = near.groupBy(*pair).agg(F.min(F.struct("between", "a", "b")).alias("m")).select("m.a", "m.b")

    def linked(pairs: DataFrame) -> DataFrame:
        return materialize(vectors_of(pairs, blocks, parts).groupBy("part").applyInPandas(_any_link(threshold), "node long, other long"), "emb-across")

    if near.isEmpty():
        release(blocks)
        return labels
    # the nearest blocks of two components first: most that link are joined by these, and need no more
    now = merged(labels, linked(nearest))
    of = now.select(F.col("node"), F.col("component").alias("c"))
    rest = near.join(of.select(F.col("node").alias("a"), F.col("c").alias("na")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("c").alias("nb")), "b", "left")
    rest = materialize(rest.where(F.coalesce("na", "a") != F.coalesce("nb", "b")).join(nearest, ["a", "b"], "left_anti").select("a", "b"), "emb-rest")
    if not rest.isEmpty():
        # components of the blocks are those of before: their links join what these have become
        found = linked(rest)
        to = lambda c: of.select(F.col("node").alias(c), F.col("c").alias(c + "_now"))
        found = found.join(to("node"), "node", "left").join(to("other"), "other", "left").select(F.coalesce("node_now", "node").alias("node"), F.coalesce("other_now", "other").alias("other"))
        now = merged(now, found)
    for used in (blocks, near, rest):
        release(used)
    return now


def link_counts(nodes: DataFrame, labels: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(node, n): rows linked with each vector that has a component, its own rows included."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = materialize(labels.join(sizes, "component").join(nodes.select("node", "vec", "weight"), "node"), "emb-members")
    small = members.where(F.col("size") <= BLOCK).withColumn("part", F.pmod(F.xxhash64("component"), F.lit(parts * 4)))
    out = small.select("node", "vec", "weight", "component", "part").groupBy("part").applyInPandas(_count_small(threshold), "node long, n long")
    large = members.where(F.col("size") > BLOCK).select("node", "vec", "weight", "component")
    if not large.isEmpty():
        blocks = blocks_of(large, parts)
        pairs = materialize(cap_pairs(blocks, threshold, True, parts), "emb-pairs")
        some = vectors_of(pairs.where("not whole"), blocks, parts).groupBy("part").applyInPandas(_count_pairs(threshold), "node long, n long")
        # blocks that are linked as a whole: a number for each block, and each of its vectors has it
        whole = pairs.where("whole")
        by_block = whole.select(F.col("a").alias("block"), F.col("mb").alias("m")).unionByName(whole.where("a <> b").select(F.col("b").alias("block"), F.col("ma").alias("m"))).groupBy("block").agg(F.sum("m").alias("n"))
        out = out.unionByName(some).unionByName(blocks.select("node", "block").join(by_block, "block").select("node", "n"))
    return out.groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "emb-rows")
    good = rows.where("vec is not null")
    nodes = materialize(good.groupBy("vec").agg(F.min("row").alias("node"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight")), "emb-nodes")
    n, size = nodes.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.octet_length("vec")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n * size * (NEIGHBOURS + BACKWARD + 1) // TASK_BYTES) + 1)
    lists, recall = None, 0.0
    for attempt in range(REPEATS):
        start = first_lists(nodes, n, trees_for(n, threshold) << attempt, attempt)
        now = materialize(best(start if lists is None else lists.unionByName(start), NEIGHBOURS, parts), "emb-lists")
        release(lists)
        lists = now
        before = lists.agg(F.sum("cos")).first()[0] or 0.0
        for _ in range(ROUNDS):
            now = materialize(descend(nodes, lists, NEIGHBOURS, parts), "emb-lists")
            release(lists)
            lists = now
            after = lists.agg(F.sum("cos")).first()[0] or 0.0
            if after - before <= 0.002 * abs(before):
                break
            before = after
        lists, full = enlarged(nodes, lists, threshold, parts)
        edges = lists.where(F.col("cos") >= threshold).select("node", "other")
        labels = materialize(connected_components(edges, "node", "other"), "emb-labels")
        labels = across(nodes, labels, full, threshold, parts)
        recall = audit(nodes, labels, threshold)
        LOG.info("attempt %d: recall %.4f over vectors with links", attempt + 1, recall)
        if recall >= RECALL:
            break
    else:
        # no number of trees was enough: all vectors are searched exactly
        labels = across(nodes, labels, nodes, threshold, parts)
        recall = audit(nodes, labels, threshold)
        LOG.warning("recall %.4f after an exact search of all vectors", recall)
    counts = link_counts(nodes, labels, threshold, parts)
    known = nodes.join(labels, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = known.groupBy("root").agg(F.min("least").alias("smallest"))
    known = known.join(smallest, "root").select("vec", "node", "root", "smallest", (F.coalesce("n", "weight") - 1).alias("n_links"))
    component = F.coalesce("smallest", "vec_id")
    return rows.join(known, "vec", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.when(component.isNull(), F.coalesce("root", "row") == F.col("row")).otherwise(F.coalesce(component == F.col("vec_id"), F.lit(False))).alias("kept"),
        F.lit(float(recall)).alias("recall"),
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
