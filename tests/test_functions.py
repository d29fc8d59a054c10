import hashlib
import random
import re

from pyspark.sql import functions as F

from twinleaf.functions.keywords import KEYWORDS, profile
from twinleaf.functions.tokens import fingerprint, n_lines, normalised, tokens, with_tokens

PLAIN = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*.*?\*/|[0-9]+(?:\.[0-9]+)?|[a-zA-Z_$][a-zA-Z0-9_$]*|[^\s]', re.S)


def test_tokens_equal_the_plain_pattern(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1.\"'`\\/*\n \u00a0\u2003é$_#|7e") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ['"""d"""', "12.5.6", "7e3", "x$ $x", "a // b\nc /* d */ e", "", '"' + "x" * 50_000 + '"']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokens(F.col("t")).alias("x"), fingerprint(tokens(F.col("t"))).alias("h")).collect()
    for r in rows:
        want = PLAIN.findall(texts[r.i])
        assert r.x == want
        assert r.h == hashlib.sha256("|".join(want).encode()).hexdigest()


def test_null_text_has_no_tokens(spark):
    row = spark.createDataFrame([(None,)], "t string").select(F.size(tokens(F.col("t"))).alias("n")).first()
    assert row.n == 0


def test_renamed_functions_have_equal_normal_forms():
    a = normalised(PLAIN.findall("def foo(x): return x + 1"), "Python")
    b = normalised(PLAIN.findall("def bar(y): return y + 1"), "Python")
    assert a == b == ["def", "ID_0", "(", "ID_1", ")", ":", "return", "ID_1", "+", "LIT_0"]
    assert a != normalised(PLAIN.findall("def bar(y): return y * 1"), "Python")


def test_normalisation_rules():
    n = lambda s, lang="JavaScript": normalised(PLAIN.findall(s), lang)
    assert n("x = 42; y = 42") == ["ID_0", "=", "LIT_0", ";", "ID_1", "=", "LIT_1"]
    assert n("// gone\n/* gone */ null $a a$") == ["null", "$a", "ID_0"]
    assert n("é", None) == ["ID_0"]
    assert n("'") == ["LIT_0"]
    assert n("if", "Cobol") == ["ID_0"]


def test_with_tokens_and_lines(spark):
    rows = spark.createDataFrame([(1, "Python", "a = 1\nb = 2"), (2, "Python", "// only")], "ord long, language string, source_text string")
    got = {r.ord: r for r in with_tokens(rows).withColumn("lines", n_lines(F.col("source_text"))).collect()}
    assert got[1].token_count == 6 and got[1].lines == 2
    assert got[2].normalized_hash == hashlib.sha256(b"").hexdigest()


def test_profiles():
    for language in KEYWORDS:
        assert all(profile(language))
    assert profile("Cobol") == (frozenset(), frozenset())
