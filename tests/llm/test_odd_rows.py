"""Null ids, large ids beside null ones, clashing columns and empty tables."""

from twinleaf.llm import html_extract, language_id, mixing, ngram_join, packing, quality_rules
from twinleaf.llm.language_id import BackoffModel

BIG = (1 << 60) + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, lang_pred string, score double, words string"


def docs(spark):
    long = " ".join(f"w{i} and w{i + 1}" for i in range(70))
    rows = [(None, long, "en", "a"), (BIG, long + " more", None, "a"), (None, None, None, None), (BIG + 1, "x y", "en", None), (None, long, "en", "a")]
    return spark.createDataFrame([(*r, 1, 7, 7, "x", 0.5, "w") for r in rows], SCHEMA)


def test_null_ids_keep_large_ones_exact(spark):
    got = packing.pack_documents(docs(spark).select("doc_id", "text")).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [BIG, BIG + 1]
    assert sum(r.doc_id is None for r in got) == 3
    pages = spark.createDataFrame([(None, "u", "<p>one</p>"), (BIG, None, None)], "page_id long, url string, html string")
    got = html_extract.main_text(pages, html_extract.train(made=20)).collect()
    assert {r.page_id for r in got} == {None, BIG}


def test_rows_without_an_id_stay_in_stages(spark):
    table = docs(spark)
    kept = quality_rules.quality_filter(table)
    assert kept.columns == table.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, BIG]
    named = language_id.identify(table, language_id.train(table))
    assert named.columns == [*table.columns, "_lang_pred", "_score"] and named.count() == 5
    # the two copies without an id are near copies of one that has one; a text without words is like nothing
    assert sorted((r.doc_id or 0, r.text is None) for r in ngram_join.one_of_each_group(table).collect()) == [(0, True), (BIG, False), (BIG + 1, False)]
    mixed = mixing.mix(table)
    taken = mixing.copies(table.select("doc_id", "source", "text"))
    assert mixed.columns == table.columns
    assert mixed.where("doc_id is null").count() == sum(r.copies for r in taken.collect() if r.doc_id is None) > 0


def test_empty_tables(spark):
    none = docs(spark).where("false")
    assert packing.pack_documents(none.select("doc_id", "text")).count() == 0
    assert mixing.mix(none).count() == language_id.language_filter(none).count() == ngram_join.one_of_each_group(none).count() == quality_rules.quality_filter(none).count() == 0


def test_numerals_are_no_letters():
    model = BackoffModel.fit([("aa", "word", 3), ("bb", "wort", 3)])
    assert model.predict("½ ² Ⅷ")[0] == "und" and model.predict("½ word")[0] == "aa"
