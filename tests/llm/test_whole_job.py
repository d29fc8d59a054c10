"""Cases in which an operator once did less than the whole job."""

import json
import random
from collections import Counter

import numpy as np
import pytest

from twinleaf.llm import chat_format, embedding_dedup, license_scan, mixing, ngram_join, packing


def table(spark, x):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_tight_groups_that_fill_each_other_s_lists(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=16)
    b = rng.normal(size=16)
    a /= np.linalg.norm(a)
    b -= a * (a @ b)
    b /= np.linalg.norm(b)
    near, far = a * 0.96 + b * np.sqrt(1 - 0.96**2), -a
    x = np.array([c + rng.normal(size=16) * 0.002 for c in (a, near, far) for _ in range(40)])
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table(spark, x)).collect()}
    assert {(r.component_id, r.n_links) for i, r in got.items() if i < 80} == {(0, 79)}
    assert {(r.component_id, r.n_links) for i, r in got.items() if i >= 80} == {(80, 39)}
    assert sorted(i for i, r in got.items() if r.kept) == [0, 80]


def test_lost_pairs_beside_a_large_group_count_in_the_audit(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=16) + rng.normal(size=(400, 16)) * 0.01
    pairs = np.repeat(rng.normal(size=(30, 16)), 2, axis=0) + rng.normal(size=(60, 16)) * 0.01
    rows = [(i, np.asarray(v, dtype="<f8").tobytes(), 1) for i, v in enumerate(np.concatenate([hot, pairs]))]
    nodes = spark.createDataFrame(rows, "node long, vec binary, weight long")
    whole = [(i, 0) for i in range(400)] + [(i, i - i % 2) for i in range(400, 460)]
    assert embedding_dedup.audit(nodes, spark.createDataFrame(whole, "node long, component long"), 0.95) == 1.0
    assert embedding_dedup.audit(nodes, spark.createDataFrame(whole[:400], "node long, component long"), 0.95) == 0.0
    # the trees grow with the planes, and a hot code still has its pairs in one leaf
    assert embedding_dedup.trees_for(2_000_000, 0.95) > embedding_dedup.trees_for(20_000, 0.95)


def test_arguments_keep_their_json_types_and_turns_their_content(spark):
    tools = [("t", k, k, False) for k in ("integer", "number", "boolean", "string", "array", "object")]
    fine = {"integer": 5, "number": 1.5, "boolean": True, "string": "5", "array": [1, None], "object": {"b": {"z": 1, "a": 2}, "a": "é"}}
    wrong = {"integer": "5", "number": "1.5", "boolean": "true", "string": 5, "array": "[]", "object": [1]}
    calls = [{"id": "a", "name": "t", "arguments": fine}, {"id": "b", "name": "t", "arguments": wrong}, {"id": "c", "name": "t", "arguments": "text"}]
    rows = [(1, k, "assistant", json.dumps({"content": f"say {k}", "tool_calls": [c]})) for k, c in enumerate(calls)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schemas = chat_format.tool_schemas(spark, tools)
    got = {r.turn: r for r in chat_format.format_chat(turns, schemas).collect()}
    assert [got[k].valid for k in range(3)] == [True, False, False]
    for k, c in enumerate(calls):
        want = {"content": f"say {k}", "role": "assistant", "tool_calls": [c]}
        assert got[k].message == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    problems = {r.call_id: r.problems for r in chat_format.validated(chat_format.tool_calls(turns), schemas).collect()}
    assert problems == {"a": [], "b": sorted(f"type:{k}" for k in wrong), "c": ["type:arguments"]}


def test_bsd_texts_are_told_apart_and_parts_are_no_whole_licence(spark):
    two, three, mit = (license_scan.TEMPLATES[k] for k in ("BSD-2-Clause", "BSD-3-Clause", "MIT"))
    half = three[: three.index("3. Neither")]
    rows = [(1, two), (2, three), (3, half), (4, mit), (5, mit[: mit.index(" IN NO EVENT")])]
    got = {(r.doc_id, r.license): r.coverage for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, v in got.items() if v == 1} == {(1, "BSD-2-Clause"), (2, "BSD-3-Clause"), (4, "MIT")}
    assert not any(doc == 3 for doc, _ in got)


def test_licences_with_words_put_in_or_left_out(spark):
    words = license_scan.TEMPLATES["MIT"].split(" ")
    extra = [f"w{k}" for k in range(20)]
    rows = [(1, " ".join(words[:80] + extra + words[80:])), (2, " ".join(words[:70] + words[82:]))]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {r.license for r in got.values()} == {"MIT"} and got[1].coverage == 1 and 0.9 < got[2].coverage < 1
    assert (got[1].start_char, got[1].end_char) == (0, len(rows[0][1]) - 1)


@pytest.mark.parametrize("most", [12, 48])
def test_adjoining_dense_clusters_hubs_and_odd_ids(spark, monkeypatch, most):
    """Lists of two clusters are full of their own members, whose cross pairs all link; also where lists aren't enlarged."""
    monkeypatch.setattr(embedding_dedup, "MOST_NEIGHBOURS", most)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "CAP", 16)
    rng = np.random.default_rng(9)
    a, b = np.eye(24)[:2]
    near = a * 0.965 + b * np.sqrt(1 - 0.965**2)
    x = [c + rng.normal(size=24) * 0.004 for c in (a, near) for _ in range(60)]
    hub = np.eye(24)[5]
    x += [hub] + [hub * 0.952 + np.eye(24)[6 + k] * np.sqrt(1 - 0.952**2) for k in range(15)]  # each links with the hub alone
    x += list(rng.normal(size=(40, 24)))
    x = np.asarray(x)
    ids = [5 * k for k in range(len(x))]
    rows = [(i, [float(v) for v in y], "n") for i, y in zip(ids, x, strict=True)]
    rows += [(None, rows[0][1], "n"), (0, rows[1][1], "n"), (None, [float(v) for v in -hub], "n"), (None, [float(v) for v in -hub], "n")]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")).collect()
    v = np.asarray([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    links = v @ v.T >= 0.95
    reach = links.copy()
    for _ in range(7):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    named = [r[0] for r in rows]
    want = Counter()
    for k, i in enumerate(named):
        others = [named[j] for j in np.flatnonzero(reach[k]) if named[j] is not None]
        want[i, int(links[k].sum()) - 1, min(others, default=None)] += 1
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.component_id is not None)
    assert sorted(r.kept for r in got if r.component_id is None) == [False, True]
    assert {r.recall for r in got} == {1.0}


def test_equal_turns_chains_and_circles(spark):
    call = lambda *ids, **more: json.dumps({"tool_calls": [{"id": i, "name": "search", "arguments": {"query": i}} for i in ids]} | more)
    answer = lambda i, **more: json.dumps({"tool_call_id": i, "content": {"b": 1, "a": [i]}} | more)
    rows = [
        (1, 0, "user", "go"), (1, 1, "tool", answer("b")), (1, 2, "assistant", call("a", "b")), (1, 2, "user", "same number"), (1, 2, "assistant", call("a", "b")),
        (1, 3, "tool", answer("a", tool_calls=[{"id": "c", "name": "fetch", "arguments": {"url": "u"}}])), (1, 4, "tool", answer("c")),
        (2, 0, "tool", answer("x", tool_calls=[{"id": "y", "name": "odd"}])), (2, 1, "tool", answer("y", tool_calls=[{"id": "x", "name": "odd"}])),
        (None, 0, "assistant", call("n")), (3, None, "tool", answer("gone")), (4, 0, "assistant", '{"tool_calls":[]}'), (4, 1, "user", "x" * 300_000), (4, 2, "tool", "plain"),
    ]
    turns = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, path string")
    got = chat_format.format_chat(turns.drop("path")).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.position, r.path, r.message))
    assert [(r.turn, r.position, len(r.path.split(".")) if r.path else 0) for r in one] == [(0, 0, 0), (2, 2, 0), (2, 2, 0), (2, 2, 0), (3, 2, 1), (4, 2, 2), (1, 2, 1)]
    assert Counter(r.message for r in one)['{"content":"same number","role":"user"}'] == 1
    made = [r for r in one if r.turn == 2 and r.role == "assistant"]
    assert len(made) == 2 and made[0].message == made[1].message and json.loads(made[0].message)["tool_calls"][1]["id"] == "b" and made[0].linked and made[0].valid
    both = next(r for r in one if r.turn == 3)
    assert json.loads(both.message) == {"content": {"a": ["a"], "b": 1}, "role": "tool", "tool_call_id": "a", "tool_calls": [{"arguments": {"url": "u"}, "id": "c", "name": "fetch"}]} and both.linked and both.valid
    assert [(r.position, r.path, r.linked, r.valid) for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.turn)] == [(0, "", True, False), (1, "", True, False)]
    assert next(r for r in got if r.conv_id is None).linked is False and next(r for r in got if r.conv_id == 3).linked is False
    assert [(r.linked, r.valid) for r in got if r.conv_id == 4] == [(None, None)] * 3
    assert chat_format.format_chat(turns.limit(0).drop("path")).count() == 0


def test_names_of_licences(spark):
    t = license_scan.TEMPLATES
    cc = "This work is licensed under a Creative Commons {} 4.0 International License."
    rows = [(1, cc.format("Attribution-NonCommercial")), (2, cc.format("Attribution-ShareAlike")), (3, cc.format("Attribution")), (4, cc.format("Attribution-Unknown")), (5, "Released under the BSD License."),
            (6, t["Apache-2.0-header"]), (7, "Released under the new License."), (8, t["LGPL-3.0-header"]), (9, t["0BSD"]), (10, t["MIT"] + "\n\n" + t["Apache-2.0-line"]), (None, t["ISC"]), (11, None), (12, "")]
    got = sorted((r.doc_id or 0, r.license) for r in license_scan.scan(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, coverage double")).collect())
    assert got == [(0, "ISC"), (1, "CC-BY-NC-4.0-line1"), (2, "CC-BY-SA-4.0-line1"), (3, "CC-BY-4.0-line1"), (5, "BSD-line"), (6, "Apache-2.0-header"), (8, "LGPL-3.0-header"), (9, "0BSD"), (10, "Apache-2.0-line"), (10, "MIT")]
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planted_licences_against_their_places(spark):
    """Every template among random words, some words of long ones changed; a plain alignment of words gives what is covered."""
    rng = random.Random(3)
    rows, want = [], {}
    for k, (name, text) in enumerate(license_scan.TEMPLATES.items()):
        noise = lambda n: [f"zq{rng.randint(0, 10**6)}" for _ in range(n)]
        words = text.split(" ")
        changed = set(rng.sample(range(1, len(words) - 1), len(words) // 40)) if len(words) > 40 else set()
        planted = [f"zz{k}" if i in changed else w for i, w in enumerate(words)]
        before, after = noise(rng.randint(0, 400)), noise(rng.randint(0, 400))
        head = " ".join(before) + (" " if before else "")
        body = " ".join(planted)
        rows.append((k, head + body + " " + " ".join(after)))
        bare = body.rstrip(".>/\"')").rstrip()
        want[k] = (name, len(head) + (len(body) - len(body.lstrip("\"<("))), len(head) + len(bare))
    rows.append((1000, " ".join(f"zq{rng.randint(0, 10**6)}" for _ in range(60_000)) + " " + license_scan.TEMPLATES["Zlib"]))
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.license, r.start_char, r.end_char) for r in got if r.doc_id < 1000} == want and len(got) == len(rows)
    assert all(r.coverage > 0.85 for r in got) and next(r for r in got if r.doc_id == 1000).license == "Zlib"


def test_repeated_rows_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SEQUENCES", 1)
    docs = spark.createDataFrame([(None, "same text here")] * 500 + [(7, "same text here")] * 500, "doc_id long, text string")
    got = packing.pack_documents(docs, shard=100).toPandas()
    assert got["sequence_id"].map(lambda x: x >> 24).nunique() > 1
    assert len(got) == 1000 and got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1


def test_rows_that_share_a_key_are_mixed_by_count(spark):
    """Rows without an id, of one source and size: some are taken once more than others, whatever their number."""
    rows = [(None, "a", f"w{k} x y", k) for k in range(700)] + [(1, "a", "same same same", 0)] * 60 + [(k, "b", "one two three four", k) for k in range(200)] + [(5, "c", "p " * 900, 0), (6, "c", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies long").repartition(5)
    taken = mixing.copies(docs.select("doc_id", "source", "text")).collect()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want, got = Counter(), Counter()
    for r in taken:
        want[r.doc_id, r.source, r.size] += r.copies
    times = Counter()
    for r in mixed.collect():
        got[r.doc_id, r.source, len((r.text or "").split())] += 1
        times[r.doc_id, r.source, r.text, r.copies] += 1
    assert got == +want
    free = [times[None, "a", f"w{k} x y", k] for k in range(700)]
    assert max(free) - min(free) == 1 and sum(free) == want[None, "a", 3]


def test_a_hot_passage_in_many_different_texts(spark, monkeypatch):
    """Groups of a passage that makes up three quarters of many texts, which the list of frequent tokens knows or has missed."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"u{rng.randint(0, 10**9)}" for _ in range(rng.choice([6, 9, 17, 19]))]) for _ in range(260)]
    texts += [" ".join(passage[k:]) for k in range(12)]

    def sets(t):
        w = t.split(" ")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    every = [sets(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(every[i] & every[j])
            if 100 * both >= 75 * len(every[i] | every[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "PIECE", 16)
    for least in (4, 10**6):
        monkeypatch.setattr(ngram_join, "FREQUENT_DF", least)
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
        assert got == {i: root(i) for i in range(len(texts))}


def test_the_sample_of_rules_is_drawn_from_few_files(spark, tmp_path):
    from twinleaf.llm import quality_rules

    docs = spark.createDataFrame([(k, f"text {k % 60}", "m") for k in range(1200)], "doc_id long, text string, n_words string")
    docs.repartitionByRange(60, "doc_id").write.parquet(str(tmp_path / "d"))
    rows = spark.read.parquet(str(tmp_path / "d")).select("doc_id", "text")
    got = quality_rules.sample_of(rows, rows=10_000, files=4).collect()
    assert 20 <= len(got) <= 400 and got == quality_rules.sample_of(rows, rows=10_000, files=4).collect()
    assert 300 < quality_rules.sample_of(docs, rows=600).count() < 900
    assert quality_rules.sample_of(docs.limit(0)).count() == 0
