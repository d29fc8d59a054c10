"""What the similarity join, reports and written tables leave on disk or move."""

import os
import random

import pytest
from pyspark.sql import functions as F

from twinleaf.operators.similarity import similar_pairs
from twinleaf.operators.storage import materialize
from twinleaf.plans.detect import detect
from twinleaf.plans.report import report_members


@pytest.fixture(autouse=True)
def no_broadcasts(spark):
    """As with large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def moved(spark):
    """Bytes that tasks have written for shuffles so far."""
    found = spark._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_sets_of_near_copies_move_once_a_place_and_not_with_each_pair(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(3000)]
    rows = [(k, f"/f{k}", 1, 9, 3000, [*base[:2900], *(f"x{k}_{j}" for j in range(100))]) for k in range(60)] + [(100 + k, f"/g{k}", 1, 9, 50, [f"v{rng.randint(0, 10**6)}" for _ in range(50)]) for k in range(20)]
    df = spark.createDataFrame(rows, "ord long, file_path string, start_line int, end_line int, token_count int, tokens array<string>")
    before = moved(spark)
    found = {(r.a, r.b): r.score for r in similar_pairs(df, 0.8).collect()}
    assert found == {(a, b): 2900 / 3100 for a in range(60) for b in range(a + 1, 60)}
    # the sets have 1.4 MB, those of all pairs 85 MB
    assert moved(spark) - before < 20_000_000


def test_shuffle_files_go_when_a_table_is_written(spark):
    def files():
        top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in top for _, _, names in os.walk(str(d)) for f in names if f.startswith("shuffle_")}

    before = files()
    assert materialize(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count(), "counts").count() == 7
    left = files() - before
    # count() above leaves one of its own, the write none
    assert len(left) <= 3 * 2, left


def test_report_moves_the_texts_of_members_alone(spark):
    rng = random.Random(4)
    rows = [(k, f"f{k}", f"/f{k}", "Python", "file", 1, 1, " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(2000))) for k in range(200)]
    rows += [(500 + k, f"f{500 + k}", f"/c{k}", "Python", "file", 1, 1, "same = 1") for k in range(2)]
    df = spark.createDataFrame(rows, "ord long, fragment_id string, file_path string, language string, fragment_type string, start_line int, end_line int, source_text string")
    df = materialize(df, "texts")
    found = detect(df, (1,))
    before = moved(spark)
    got = report_members(found, df, F.col("file_path") == "/c0").collect()
    assert sorted((r.ord, r.source_text, r.token_count, r.is_basis, r.basis_internal) for r in got) == [(500, "same = 1", 3, True, False), (501, "same = 1", 3, False, False)]
    assert moved(spark) - before < 1_000_000
