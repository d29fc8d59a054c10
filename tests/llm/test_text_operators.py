"""Quality rules, language identification, HTML extraction, licences, chat, rollups."""

import json
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from twinleaf.llm import queries as llm
from twinleaf.llm import chat_format, html_extract, language_id, license_scan, quality_rules, token_rollups
from twinleaf.llm.block_labeller import DIM, Featurizer, Labeller, padded
from twinleaf.llm.html_blocks import blocks
from twinleaf.llm.tokens import PieceEncoder, public_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    """The base counts by definition."""
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    n = len(w)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed)


def sample_texts():
    rng = random.Random(2)
    out = [None, "", " \n\t ", "a", "é b c", "a b c a b c", "x " * 60, "# *\n# *\n\n y", "word" * 3000]
    out += [" ".join(rng.choice(["a", "bb", "ccc", "d#", "e\n"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    return out


def test_quality_counts_and_sql(spark, tmp_path):
    texts = sample_texts()
    docs = spark.createDataFrame([(i % 50, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = quality_rules.op8_quality_rules(spark, str(tmp_path)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, [r[:7] for r in got])) == sorted(map(key, [(i % 50, *counts(t)) for i, t in enumerate(texts)]))
    assert all(not r.kept for r in got if r.base_failed)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(key, got)) == sorted(map(key, con.execute(quality_rules.OP8_SQL).fetchall()))
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.quality_filter(docs.limit(0)).count() == 0


def test_cascade_order_follows_rejection_per_cost(spark):
    from pyspark.sql import functions as F

    docs = spark.range(100).select(F.col("id").cast("string").alias("text"))
    rules = [quality_rules.Rule("never", F.lit(False)), quality_rules.Rule("often", F.col("text") < "9")]
    ordered, measured = quality_rules.order_by_rejection_per_cost(docs, rules)
    assert [r.name for r in ordered] == ["often", "never"] and len(measured) == 2
    assert docs.select(quality_rules.cascade(ordered).alias("v")).where("v is null").count() == 11


def test_language(spark):
    rng = random.Random(1)
    stems = {"aa": ["tion", "the", "ing", "of"], "bb": ["ción", "el", "que", "ñar"], "cc": ["keit", "der", "und", "sch"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(stems))
        rows.append((i, " ".join("".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(30)), lang if i % 5 else None, "x"))
    rows += [(1000, None, "aa", "x"), (1001, "12 % !", "aa", "x"), (1002, "", None, "x"), (0, rows[0][1], rows[0][2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.train_on_own(docs)
    out = language_id.identify(docs.drop("score"), model).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id >= 1000:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert 0 < r.score <= 1
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang and r.doc_id < 1000]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    kept = language_id.language_filter(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    empty = language_id.train_on_own(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs.drop("score"), empty).collect()} == {"und"}


def test_backoff_goes_to_shorter_grams():
    m = language_id.BackoffModel.fit([("aa", "tion", 5), ("bb", "xyz", 5)])
    assert m.predict("tion")[0] == "aa" and m.predict("ration")[0] == "aa" and m.predict("zzz")[0] == "bb"
    one = lambda t: m.scores(pa.array([t]))[0][0]
    assert np.allclose(one("tion tion new"), 2 * one("tion") + one("new"))


def test_scores_against_a_plain_restatement():
    """Word by word with dictionaries, as the method says; also a text of many words."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    counted = Counter((lang, word()) for lang in ("aa", "bb", "cc") for _ in range(150))
    counted = [(lang, w, n) for (lang, w), n in counted.items()]
    m = language_id.BackoffModel.fit(counted)
    langs = sorted({x for x, _, _ in counted})
    total = {x: sum(n for a, _, n in counted if a == x) + 1 for x in langs}
    logs = {w: [math.log((sum(n for a, v, n in counted if (a, v) == (x, w)) + 0.5) / total[x]) for x in langs] for _, w, _ in counted}

    def cut(w, k):
        w = f"^{w}$" if k > 1 else w
        return [w[i : i + k] for i in range(len(w) - k + 1)]

    pieces = {x: Counter() for x in langs}
    for x, w, n in counted:
        for k in (1, 2, 3, 4):
            for g in cut(w, k):
                pieces[x][g] += n
    size = {(x, k): sum(n for g, n in pieces[x].items() if len(g) == k) + 1 for x in langs for k in (1, 2, 3, 4)}
    known = {g for p in pieces.values() for g in p}

    def vector(w):
        if w in logs:
            return logs[w]
        for k in (4, 3, 2, 1):
            gs = [g for g in cut(w, k) if g in known]
            if gs:
                return [sum(math.log((pieces[x][g] + 0.5) / size[x, k]) for g in gs) / len(gs) for x in langs]
        return [0.0] * len(langs)

    texts = [None, "", "12 !", "É", "zzz", "a", *(" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(60)), " ".join(word() for _ in range(60_000))]
    names, scores = m.predict_all(pa.array(texts, pa.string()))
    for text, name, score in zip(texts, names, scores, strict=True):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words:
            assert (name, score) == ("und", 0.0)
            continue
        s = [sum(v) / math.sqrt(len(words)) for v in zip(*map(vector, words))]
        e = [math.exp(x - max(s)) for x in s]
        assert abs(score - max(e) / sum(e)) < 1e-6 and abs(e[langs.index(name)] - 1) < 1e-6


def test_the_sample_takes_each_id_once(spark):
    rows = [(7, "only one text here", "aa")] * 900 + [(100 + i, f"other words {i}", "bb") for i in range(120)] + [(None, f"no id {i % 4}", "cc") for i in range(40)]
    got = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 60).collect()
    assert len(got) == 60 and len({r.text for r in got}) == 60
    every = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5000).collect()
    assert Counter(r.lang for r in every) == {"aa": 1, "bb": 120, "cc": 4}


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    model = Labeller.fresh(1)
    model.weights = [w.astype(np.float64) for w in model.weights]
    pages = [rng.normal(size=(n, DIM)) for n in (3, 5)]
    x, mask = padded(pages)
    y = (rng.random(mask.shape) > 0.5).astype(float) * mask
    _, grads = model.gradients(x, mask, y)
    for k in range(8):
        at = tuple(rng.integers(s) for s in model.weights[k].shape)
        keep, eps = model.weights[k][at], 1e-3
        model.weights[k][at] = keep + eps
        up, _ = model.gradients(x, mask, y)
        model.weights[k][at] = keep - eps
        down, _ = model.gradients(x, mask, y)
        model.weights[k][at] = keep
        assert abs((up - down) / (2 * eps) - grads[k][at]) < 2e-4


def test_blocks():
    texts = lambda s: [b.text for b in blocks(s)]
    assert texts("<p>a < b &amp b<b>c</b>d<br>e<ul><li>x<li>y</ul>") == ["a < b & bcd", "e", "x", "y"]
    assert texts('<script>var t="</p>";</script><style>p{}</style><!-- c --><p>t&eacute;\n  xt') == ["té xt"]
    assert texts(None) == texts("") == texts("<p>  </p>") == []
    assert texts("<p>cut <a hre") == ["cut"]
    assert len(blocks("<div>" * 2000 + "x")) == 1


def test_raw_elements_that_never_end():
    texts = lambda s: [b.text for b in blocks(s)]
    assert texts("<article><p>one</p><select><option>z</article><p>rest of the page</p>") == ["one", "rest of the page"]
    for tag in ("svg", "textarea", "script", "style"):
        assert texts(f"<p>a</p><{tag} x=1>gone<p>b</p><div>c</div>") == ["a", "b", "c"]
    assert texts("<p>let <math><mi>x</mi></math> be <object>shown</object></p>") == ["let x be shown"]
    assert texts("<script>" * 3000 + "<p>end</p>") == ["end"]
    deep = "<nav>" + "<div>" * 40 + "<p>menu</p>" + "</div>" * 40 + "</nav>"
    look = Featurizer()
    inside, outside = blocks(deep)[0], blocks(deep.replace("nav>", "section>"))[0]
    assert (look.path(inside.path) != look.path(outside.path)).any()


def page_of(rng, i):
    """(html, main text) of a page that follows no made page: other names, orders and depths, with its text known as it is written."""
    word = lambda: "".join(rng.choices(["ka", "lu", "mor", "tis", "den", "o"], k=rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    main, out = [], []

    def put(tag, text, keep):
        out.append(f"<{tag}>{text.replace('&', '&amp;')}</{tag.split(' ')[0]}>")
        if keep:
            main.append(text)

    out.append(f"<html><head><title>{say(2, 6)}</title><script>if (a < b) x('<p>no</p>')</script></head><body><div class=page-wrap>")
    if rng.random() < 0.7:
        out.append("<nav class=top><ul>" + "".join(f"<li><a href=/{k}>{say(1, 2)}</a></li>" for k in range(rng.randint(3, 8))) + "</ul></nav>")
    if rng.random() < 0.5:
        put('div class="cookie-notice"', say(5, 15), False)
    out.append("<article>")
    put("h1", say(3, 9), True)
    for _ in range(rng.randint(2, 9)):
        put(rng.choice(["p", "p", "p", "h2", "blockquote"]), say(6, 60) + rng.choice([".", " & so on."]), True)
        if rng.random() < 0.1:
            put('div class="ad-box"', say(4, 12), False)
    out.append("</article>")
    if rng.random() < 0.5:
        out.append("<aside>")
        put("p", say(3, 20), False)
        out.append("</aside>")
    if rng.random() < 0.5:
        out.append('<section class="comments">')
        for _ in range(rng.randint(1, 4)):
            put("p", say(3, 25), False)
        out.append("</section>")
    put("footer", f"© {say(2, 8)}", False)
    return "".join(out) + "</div></body></html>", " ".join(main)


def test_extraction_of_pages_that_it_was_not_trained_on(spark):
    rng = random.Random(41)
    made = [page_of(rng, i) for i in range(150)]
    rows = [(i, "u", h, "x") for i, (h, _) in enumerate(made)] + [(900, "u", None, "x"), (901, None, "", "x"), (0, "u", made[0][0], "x"), (902, "u", "<p>" + "<br>".join(f"line {k}." for k in range(1500)), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    # real pages of the training have other texts, and their labels come from the names of their elements
    other = random.Random(1000)
    model = html_extract.train(spark.createDataFrame([(k, page_of(other, k)[0]) for k in range(60)] + [(0, "<p>again</p>")] * 300 + [(None, None)], "page_id long, html string"))
    got = html_extract.main_text(pages.select("page_id", "url", "html"), model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[900] == by[901] == ""
    right = sum(by[i] == want for i, (_, want) in enumerate(made))
    assert right >= 140, right
    assert html_extract.main_text(pages.limit(0).select("page_id", "url", "html"), model).count() == 0
    # and blocks of layouts as in training, other pages
    more = html_extract.made_pages(150, seed=5)
    look = Featurizer()
    share = [((p >= 0.5) == (y > 0.5)).mean() for p, (_, y) in zip(model.probabilities([look.page(b) for b, _ in more]), more, strict=True)]
    assert np.mean(share) > 0.95


def test_licenses(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [(1, f"é intro {apache} tail"), (2, None), (3, ""), (4, "no licence here"), (5, f"{apache}\n{apache}"), (6, "Licensed under the apache  license version TWO"), (1, f"é intro {apache} tail")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "Apache-2.0-line")] * 2 + [(5, "Apache-2.0-line")] * 2
    r = next(x for x in got if x.doc_id == 1)
    assert rows[0][1][r.start_char : r.end_char] == apache[:-1] and r.coverage == 1.0
    long = license_scan.TEMPLATES["MIT"].split(" ")
    del long[10], long[40]
    got = license_scan.scan(spark.createDataFrame([(1, "x " * 50 + " ".join(long))], "doc_id long, text string")).collect()
    assert [x.license for x in got] == ["MIT"] and got[0].matched_words == got[0].template_words - 2


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(40):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 8))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(1, 8))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = max(best[i][j] + (x == y), best[i][j + 1], best[i + 1][j])
        assert license_scan.align(np.array(a), np.array(b), 0)[0] == best[-1][-1]


def test_chat(spark):
    call = json.dumps({"tool_calls": [{"id": "c1", "name": "search", "arguments": {"query": "é\"", "limit": 3}}, {"id": "c2", "name": "search", "arguments": {"limit": "x", "odd": 1}}]})
    rows = [
        (1, 0, "user", "hi \"you\"\n"), (1, 1, "tool", '{"tool_call_id":"c2","content":"late"}'), (1, 2, "assistant", call), (1, 3, "tool", '{"tool_call_id":"c1","content":"r"}'),
        (1, 4, "tool", '{"tool_call_id":"no","content":"r"}'), (2, 0, None, None), (2, 1, "assistant", "{not json tool_calls"), (None, None, "user", "x"),
    ]
    got = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert json.loads(by[1, 0].message) == {"content": 'hi "you"\n', "role": "user"}
    order = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.position, r.path))
    assert [r.turn for r in order] == [0, 2, 3, 1, 4]
    message = json.loads(by[1, 2].message)
    assert message["tool_calls"][0] == {"arguments": {"limit": 3, "query": 'é"'}, "id": "c1", "name": "search"}
    assert by[1, 2].linked is True and by[1, 2].valid is False and by[1, 4].linked is False and by[1, 1].linked is True
    assert by[2, 0].message == '{"content":"","role":"user"}'
    problems = chat_format.validated(chat_format.tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), chat_format.tool_schemas(spark)).collect()
    assert {r.call_id: r.problems for r in problems} == {"c1": [], "c2": ["missing:query", "type:limit", "unknown:odd"]}


def test_tokens_are_the_library_s():
    e = PieceEncoder(public_path("word_bpe_49k.json"))
    texts = ["don't I'LL 's ''s ###'s", "a<|endoftext|>b", "ΟΔΟΣ İx", "½ ²3 é", "", "你好 hello", "\x1c a \x85b\xa0c", "x" * 500, None]
    for t in texts:
        assert e.ids(t).tolist() == (e.tokenizer.encode(t, add_special_tokens=False).ids if t else [])


def test_many_texts_are_the_library_s():
    e = PieceEncoder(public_path("word_bpe_49k.json"))
    rng = random.Random(12)
    signs = "abcdefgzAQZ0123456789 .,;:'\"-_#@!?\n\t" + "àéîõüßçñÆØåŁőžſĳŉ" + "дяжΩλςאبक中文한\u0301½²Ⅷ€™"
    latin = signs[:58]
    texts = ["".join(rng.choices(latin if k % 3 else signs, k=rng.randint(0, 60))) for k in range(4000)]
    texts += [w + rng.choice([" ", "", "'"]) + rng.choice(["'s", "'T", "'re", "n't", "<|endoftext|>", "<|startoftext|>", "1,000.5"]) for w in texts[:1000]]
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    got = [np.frombuffer(x, dtype="<u4").tolist() for low in range(0, len(texts), 128) for x in e.raw(texts[low : low + 128])]
    assert all(g == w.ids for g, w in zip(got, want, strict=True))


ROLLUP = "doc_id long, source string, lang string, text string, n_tokens int"


def test_rollup(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x", "one two"), ("a", "x", "one two"), (None, "y", None), ("b", None, "")], "source string, lang string, text string")
    roll = token_rollups.DeltaRollup(spark, str(tmp_path / "r"))
    assert roll.totals().count() == 0
    assert roll.commit("1", token_rollups.deltas(docs)) and not roll.commit("1", token_rollups.deltas(docs))
    words = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_chars) for r in roll.totals().where("tokenizer_version = 'words@1'").collect()}
    assert words() == {("a", "x"): (2, 4, 14), (None, "y"): (1, 0, 0), ("b", None): (1, 0, 0)}
    assert roll.compact()
    revised = spark.createDataFrame([("a", "x", "three")], docs.schema)
    roll.commit("2", token_rollups.deltas(docs.limit(0)).unionByName(token_rollups.deltas(spark.createDataFrame([("a", "x", "one two")], docs.schema), -1)).unionByName(token_rollups.deltas(revised)))
    assert words()["a", "x"] == (2, 3, 12) and roll.committed() == ["1", "2"]
    roll.commit("3", token_rollups.deltas(spark.createDataFrame([("b", None, "")], docs.schema), -1))
    assert ("b", None) not in words()
    assert not roll.commit("1", token_rollups.deltas(docs)) and words()["a", "x"] == (2, 3, 12)


def test_two_writers_of_a_batch(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x", "one two")], "source string, lang string, text string")
    roll = token_rollups.DeltaRollup(spark, str(tmp_path / "r"))
    data = roll._write(token_rollups.deltas(docs))
    other = roll._write(token_rollups.deltas(docs))
    assert roll._mark("commits/b", [data]) and not roll._mark("commits/b", [other])
    assert not roll.abandon("b") and roll.totals().where("tokenizer_version = 'words@1'").first().n_docs == 1
    # a writer that died before its marker was filled
    roll.fs.create(roll.at(f"{roll.path}/commits/c"), False).close()
    assert roll.committed() == ["b"] and not roll.commit("c", token_rollups.deltas(docs))
    assert roll.abandon("c") and roll.commit("c", token_rollups.deltas(docs)) and roll.committed() == ["b", "c"]


def test_rollup_of_a_history_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    say = lambda: rng.choice([None, "", "Straße don't", " ".join(rng.choices(["alpha", "b2b,", "İx", "naïve"], k=rng.randint(1, 30)))])
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), say(), 7) for i in range(120)]
    rows += [(None, "a", "x", "no id", 7), rows[3], rows[7], (500, "c", "x", " ".join(["long"] * 40_000), 7)]
    docs = spark.createDataFrame(rows, ROLLUP)
    tokenizer = PieceEncoder(public_path("word_bpe_49k.json")).tokenizer
    want = Counter()
    for _, source, lang, text, _ in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids if text else []
        for version, n in (("words@1", len(WORD.findall(text or ""))), ("word_bpe_49k@1", len(ids))):
            for what, x in (("docs", 1), ("tokens", n), ("chars", len(text or ""))):
                want[source, lang, version, what] += x
    got = token_rollups.history(docs, token_rollups.DeltaRollup(spark, str(tmp_path / "r")), (token_rollups.WORDS_V1, token_rollups.BPE_V1)).collect()
    found = {(r.source, r.lang, r.tokenizer_version, k): r[f"n_{k}"] for r in got for k in ("docs", "tokens", "chars")}
    assert found == dict(want)
    assert token_rollups.history(docs.limit(0), token_rollups.DeltaRollup(spark, str(tmp_path / "e")), (token_rollups.WORDS_V1,)).count() == 0


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    got = llm.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(llm.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    key = lambda columns: lambda r: str([r[columns.index(c)] for c in order])
    assert sorted(map(key(got.columns), map(tuple, got.collect()))) == sorted(map(key(want.columns), want.fetchall()))
