import random

import pytest
from pyspark.sql import functions as F

from twinleaf.operators.basis import basis_counts, basis_groups, is_basis, matches_suffix
from twinleaf.operators.components import connected_components
from twinleaf.operators.groups import similar_groups, without_containers
from twinleaf.operators.similarity import similar_pairs
from twinleaf.plans.detect import detect

FRAGMENT = "ord long, fragment_id string, file_path string, language string, fragment_type string, start_line int, end_line int, source_text string"


def fragments(spark, rows):
    return spark.createDataFrame([(i, f"f{i}", p, "Python", "function", s, e, t) for i, p, s, e, t in rows], FRAGMENT)


def groups(found):
    out = {}
    for r in found.members.collect():
        out.setdefault((r.clone_type, r.group_id), set()).add(r.ord)
    return sorted((t, sorted(m)) for (t, _), m in out.items())


def test_three_types(spark):
    rows = [
        (1, "/a.py", 1, 5, "def f(x): return x"), (2, "/b.py", 1, 5, "def f(x): return x"), (3, "/c.py", 1, 5, "def g(y): return y"), (4, "/d.py", 1, 5, "def h(z): return z"),
        (5, "/e.py", 1, 5, "a b c d e f g h i j"), (6, "/f.py", 1, 5, "a b c d e f g h i + k"), (7, "/g.py", 1, 5, "1 2"),
    ]
    found = detect(fragments(spark, rows), threshold=0.7)
    assert groups(found) == [(1, [1, 2]), (2, [3, 4]), (3, [5, 6])]
    assert found.counts().first().asDict() == {"type1_groups": 1, "type2_groups": 1, "type3_groups": 1}


def test_skipped_types_assign_nothing(spark):
    rows = [(1, "/a.py", 1, 5, "x = y"), (2, "/b.py", 1, 5, "x = y")]
    assert groups(detect(fragments(spark, rows), (2,))) == [(2, [1, 2])]
    found = detect(fragments(spark, rows), (3,))
    assert groups(found) == [(3, [1, 2])]
    assert found.members.first().similarity_score == 1.0


def test_empty_input_and_empty_fragments(spark):
    assert groups(detect(fragments(spark, []))) == []
    assert groups(detect(fragments(spark, [(1, "/a", 1, 1, ""), (2, "/b", 1, 1, "")]))) == [(1, [1, 2])]


def _brute(rows, t):
    """Pairs by definition: rows (ord, path, start, end, tokens)."""
    out = {}
    for i, (a, p, s, e, x) in enumerate(rows):
        for b, q, u, v, y in rows[i + 1 :]:
            if p == q and ((s <= u and e >= v) or (u <= s and v >= e)):
                continue
            if not x or not y or len(x) / len(y) > 1.3 or len(y) / len(x) > 1.3:
                continue
            score = len(set(x) & set(y)) / len(set(x) | set(y))
            if score >= t:
                out[(min(a, b), max(a, b))] = score
    return out


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.8, 1.0])
def test_pairs_groups_and_pruning_against_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 10))
    rows = []
    for k in range(60):
        s = rng.randint(1, 6)
        base = [f"w{rng.randint(0, 3)}_{j}" for j in range(rng.choice([3, 10, 13]))] + [f"z{rng.randint(0, 5)}"] * rng.randint(0, 1)
        rows.append((k, f"/f{rng.randint(0, 6)}", s, s + rng.randint(0, 4), base if rng.random() > 0.05 else []))
    df = spark.createDataFrame([(*r[:4], len(r[4]), r[4]) for r in rows], "ord long, file_path string, start_line int, end_line int, token_count int, tokens array<string>")
    pairs = similar_pairs(df, threshold)
    want = _brute(rows, threshold)
    assert {(r.a, r.b): r.score for r in pairs.collect()} == want
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    by_id = {r[0]: r for r in rows}
    expect = {}
    for r in {root(x) for pair in want for x in pair}:
        members = [x for x in parent if root(x) == r]
        gone = set()
        for i in members:
            for j in members:
                if i < j and by_id[i][1] == by_id[j][1]:
                    (_, _, s, e, _), (_, _, u, v, _) = by_id[i], by_id[j]
                    if (s <= u and e >= v) or (u <= s and v >= e):
                        gone.add(i if e - s >= v - u else j)
        kept = [m for m in members if m not in gone]
        if len(kept) >= 2:
            scores = [s for (a, b), s in want.items() if a in kept and b in kept]
            expect[f"t3-{r}"] = (sorted(kept), min(scores) if scores else None)
    got = {}
    for r in similar_groups(pairs, df).collect():
        got.setdefault(r.group_id, ([], r.similarity_score))[0].append(r.ord)
    assert {k: (sorted(m), s) for k, (m, s) in got.items()} == expect


def test_container_goes_and_equal_spans_drop_the_earlier(spark):
    df = spark.createDataFrame([(1, "/a", 1, 17), (2, "/a", 3, 16), (3, "/b", 1, 9), (4, "/b", 1, 9)], "ord long, file_path string, start_line int, end_line int")
    members = df.select(F.lit("g").alias("group_id"), "ord")
    assert sorted(r.ord for r in without_containers(members, df).collect()) == [2, 4]


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(70)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert connected_components(df.limit(0)).count() == 0


def test_basis(spark):
    rows = [(1, "/x/A/IInfuser.gs"), (2, "/x/a/b.gs"), (3, "/y/b.gs"), (4, "b.gs")]
    df = spark.createDataFrame(rows, "ord long, p string")
    got = lambda c: [r.ord for r in df.where(c).orderBy("ord").collect()]
    assert got(matches_suffix(F.col("p"), "iinfuser.GS")) == [1]
    assert got(matches_suffix(F.col("p"), "a/b.gs")) == [2]
    assert got(is_basis(F.col("p"), ["/y/b.gs"], ["/x/a"], [])) == [2, 3]
    assert got(is_basis(F.col("p"), [], [], [])) == []
    members = spark.createDataFrame([("g", 1, True), ("g", 1, False), ("h", 2, True), ("i", 1, False)], "group_id string, clone_type int, is_basis boolean")
    kept = basis_groups(members)
    assert {(r.group_id, r.basis_internal) for r in kept.collect()} == {("g", False), ("h", True)}
    assert basis_counts(kept).first().asDict() == {"basis_type1_groups": 1, "basis_type2_groups": 1, "basis_type3_groups": 0}
