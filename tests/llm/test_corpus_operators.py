"""N-gram join, packing, mixing, embeddings and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from twinleaf.llm import embedding_dedup, mixing, ngram_join, packing
from twinleaf.llm.shingles import shingle_sets
from twinleaf.llm.signature_tree import SignatureTree, bitmap, can_link, wide_bitmap
from twinleaf.llm.tokens import PieceEncoder, public_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def components(sets):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    out = [None, "", " \t", "a b", "A b", "a b c d", "é È", "É è"]
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([4, 5, 9, 30, 90, 300]))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append((" " if rng.random() < 0.8 else "\n ").join(copy))
    out += [" ".join(rng.choices(vocabulary, k=40) + passage) for _ in range(40)]
    base = rng.choices(vocabulary, k=120)
    for _ in range(80):  # one large group of near copies
        copy = list(base)
        copy[rng.randrange(120)] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    out.append(" ".join(rng.choices(vocabulary, k=4000)))
    return out


@pytest.mark.parametrize("piece", [ngram_join.PIECE, 8])
def test_ngram_join(spark, monkeypatch, piece):
    """Also with groups split into small pieces; the tasks read the constants from the driver's closures."""
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    monkeypatch.setattr(ngram_join, "FREQUENT_DF", 4)
    texts = corpus()
    more = [(9, texts[9], "y"), (None, "a b", "z"), (None, "no id", "z"), (None, "no id", "z"), (9, "another text of nine", "z")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + more, "doc_id long, text string, component_id string")
    got = ngram_join.jaccard_components(docs.repartition(3)).collect()
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets)
    assert len(got) == len(texts) + len(more)
    odd = [tuple(r) for r in got if r.doc_id is None]
    # without an id: the component of "a b", and one of their own without any id
    assert sorted(odd, key=str) == [(None, 1, 3), (None, 1, None), (None, 1, None)]
    nines = [tuple(r) for r in got if r.doc_id == 9]
    assert sorted(nines) == sorted([(9, len(sets[9]), want[9])] * 2 + [(9, 1, 9)])
    for r in got:
        if r.doc_id not in (None, 9):
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(i for i, t in rows if i is not None and t != more[-1][1]) == sorted(k for k, c in want.items() if k == c)
    assert rows.count((None, "no id")) == 1 and rows.count((9, more[-1][1])) == 1 and sum(i is None for i, _ in rows) == 1


def test_ngram_join_of_nothing(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = ngram_join.jaccard_components(spark.createDataFrame([(2, None), (1, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2)]


def test_shingle_hashes_follow_the_words():
    texts = corpus()
    got = dict(shingle_sets(pa.array(texts, pa.string())))
    by_hash = {}
    for i, t in enumerate(texts):
        want = shingles(t)
        assert len(got.get(i, ())) == len(want)
        by_hash.setdefault(want, set()).add(tuple(got.get(i, ())))
    assert all(len(v) == 1 for v in by_hash.values())


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, int(rng.choice([1, 4, 20, 100, 1500])), dtype=np.int64).astype(np.uint64)
        for _ in range(rng.integers(1, 5)):
            keep = base[rng.random(len(base)) > 0.05]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, max(1, len(base) // 30), dtype=np.int64).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    wide = [wide_bitmap(s) for s in sets]
    tree = SignatureTree(sizes, np.stack([bitmap(s) for s in sets]), np.arange(len(sets)), 2 * sizes, [w if len(s) > 1024 else None for w, s in zip(wide, sets, strict=True)])
    i, j = tree.pairs(False)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    true = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 4 * (x := len(np.intersect1d(sets[a], sets[b]))) >= 3 * (sizes[a] + sizes[b] - x)}
    assert true and true <= found and len(found) < len(sets) * 10
    bits = [np.frombuffer(w, dtype=np.uint8) for w in wide]
    assert all(can_link(sizes[a], bits[a], sizes[b], bits[b]) for a, b in true)


def test_packing(spark):
    rng = random.Random(6)
    texts = [None, "", "x", "hello world " * 1500] + [" ".join(rng.choices(["alpha", "beta", "gamma,", "Straße"], k=rng.choice([3, 80, 500]))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(2, "x")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), shard=40).toPandas()
    e = PieceEncoder(public_path("word_bpe_49k.json"))
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*(e.tokenizer.encode(text, add_special_tokens=False).ids if text else []), 0], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == s["length"].cumsum().to_numpy() - s["length"].to_numpy()).all() and s["length"].sum() <= 2048
    bound = -(-got["length"].sum() // 2048)
    assert got["sequence_id"].nunique() <= bound * 1.05 + 2
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sum_of_squares_places_where_the_sum_is_least():
    rng = random.Random(2)
    rule, gaps = packing.SumOfSquares(20), Counter()
    for _ in range(200):
        size = rng.randint(1, 20)
        options = {}
        for gap in [g for g in gaps if g >= size and gaps[g]] + [20]:
            after = Counter(gaps)
            if gap != 20 or gaps[20]:
                after[gap] -= 1
            after[gap - size] += 1
            options[gap] = sum(n * n for g, n in after.items() if g)
        at, offset = rule.place(size)
        assert options[20 - offset] == min(options.values())
        if offset:
            gaps[20 - offset] -= 1
        gaps[20 - offset - size] += 1


def test_mixing(spark):
    rng = random.Random(3)
    sources = ["a", "b", "c", "ä", None, "tiny"]
    rows = [(i, rng.choices(sources, [5, 9, 5, 5, 5, 1])[0], " ".join(["w"] * rng.choice([0, 1, 5, 40, 90]))) for i in range(1500)]
    rows += [(1, rows[1][1], rows[1][2]), (7000, "z-empty", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, s, t in rows:
        size[s] += len(t.split()) if t else 0
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, free = sum(size.values()), {}, set(order)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = Counter()
    for r in got:
        assert 0 <= r.copies <= 3 and r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.copies * r.size
    for s in order:
        assert abs(taken[s] - target[s]) <= 90
    again = mixing.copies(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +Counter({k: v for k, v in ((k, sum(r.copies for r in got if (r.doc_id, r.source) == k)) for k in {(r.doc_id, r.source) for r in got})})
    assert mixing.copies(docs.limit(0)).count() == 0


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = [rng.normal(size=16) for _ in range(300)]
    centre = rng.normal(size=16)
    x += [centre + rng.normal(size=16) * 0.02 for _ in range(90)] + [x[0]] * 5 + [x[1] + rng.normal(size=16) * 0.05]
    rows = [(i, [float(v) for v in x_], i % 3) for i, x_ in enumerate(np.asarray(x, dtype=np.float32))]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [], 0), (1004, [1.0, None], 0), (1005, [3.0, 4.0], 0), (1006, [6.0, 8.0], 0), (1007, [float("inf")] * 16, 0)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()
    by = {r.vec_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    v = np.asarray(x, dtype=np.float32).astype(np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    links = v @ v.T >= 0.95
    reach = links.copy()
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    for i in range(len(rows)):
        assert (by[i].n_links, by[i].component_id) == (links[i].sum() - 1, int(np.argmax(reach[i]))), i
        assert by[i].kept == (by[i].component_id == i)
    for i in (1000, 1001, 1002, 1003, 1004, 1007):
        assert tuple(by[i])[:4] == (i, 0, i, True)
    assert by[1006].component_id == 1005 and by[1005].n_links == 1
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices(["tion", "the", "ing", "of", "ed"], k=rng.randint(1, 3)))
    clean = [" ".join(word() for _ in range(rng.randint(60, 120))) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[i], "en", "s1", 0) for i in range(10)] + [(200, "too short", "en", "s1", 9), (201, "# " * 90, "en", "s2", 0), (202, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == columns
        if k == 2:
            assert sorted(r.doc_id for r in docs.collect()) == list(range(60))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {r.doc_id for r in got} <= set(range(60))
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in docs.collect())


def test_pipeline_of_odd_rows_and_of_nothing(spark, tmp_path):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices(["tion", "the", "ing", "of", "ed"], k=rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b, c = text(80), text(90), text(20_000)
    rows = [(None, a, "en", "s1", 1, 0.1), (None, a, "en", "s1", 1, 0.2), (3, b, None, None, None, 0.3), (3, b, None, None, None, 0.4), (4, c, "en", "s2", 9, None), (5, None, None, None, None, None), (6, "", "en", "s1", 0, None)]
    rows += [(100 + k, text(70), "en", f"s{k % 3}", 1, 0.0) for k in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "one" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "one" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == [x.split(" ")[0] for x in schema.split(", ")]
    left = Counter((r.doc_id, r.text) for r in docs.collect())
    assert left == Counter([(None, a), (3, b), (4, c), *((r[0], r[1]) for r in rows if (r[0] or 0) >= 100)])
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
