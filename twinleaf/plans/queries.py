"""Registered queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keywords import KEYWORDS
from ..functions.tokens import fingerprint, tokens, with_tokens
from ..operators.basis import basis_counts, basis_groups, is_basis, matches_suffix
from ..operators.exact import equal_groups, unassigned
from ..operators.groups import similar_groups, without_containers
from ..operators.similarity import nested, similar_pairs, with_sets
from ..operators.storage import HASHES, materialize, release
from ..sources.extract import large_enough
from ..sources.scan import glob_matches, language_of
from .adapters import conversation_fragments, document_fragments, page_fragments, read
from .detect import detect
from .report import report_groups

THRESHOLD = 0.8
#: The basis of the basis queries: a whole source and one file.
BASIS_DIRECTORY, BASIS_SUFFIX = "src1", "SRC2/7"


def tokenise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = document_fragments(spark, sf_dir).select("ord", tokens(F.col("source_text")).alias("t"))
    return t.select(F.col("ord").alias("doc_id"), F.size("t").alias("token_count"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


def tokenise_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = page_fragments(spark, sf_dir).select("ord", tokens(F.col("source_text")).alias("t"))
    return t.select(F.col("ord").alias("page_id"), F.size("t").alias("token_count"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


def raw_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fragments(spark, sf_dir).select(F.col("ord").alias("doc_id"), fingerprint(tokens(F.col("source_text"))).alias("raw_hash"))


def normalised_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(page_fragments(spark, sf_dir)).select(F.col("ord").alias("page_id"), "raw_hash", "normalized_hash")


def type1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = document_fragments(spark, sf_dir).select("ord", fingerprint(tokens(F.col("source_text"))).alias("raw_hash"))
    return equal_groups(materialize(hashed, "hashes"), "raw_hash", 1).select("representative_hash", F.col("ord").alias("doc_id"))


def type1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = document_fragments(spark, sf_dir).select("ord", fingerprint(tokens(F.col("source_text"))).alias("raw_hash"))
    grouped = hashed.groupBy("raw_hash").agg(F.count(F.lit(1)).alias("members"), F.min("ord").alias("first_doc"))
    return grouped.where("members >= 2").select(F.col("raw_hash").alias("representative_hash"), "members", "first_doc")


def _hashed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(with_tokens(conversation_fragments(spark, sf_dir)).select("ord", "raw_hash", "normalized_hash"), "hashes")


def type2_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type 2 without type 1: exact copies are structural ones too."""
    return equal_groups(_hashed_conversations(spark, sf_dir), "normalized_hash", 2).select("representative_hash", "ord")


def type2_after_type1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed_conversations(spark, sf_dir)
    return equal_groups(unassigned(rows, equal_groups(rows, "raw_hash", 1)), "normalized_hash", 2).select("representative_hash", "ord")


def _candidates(hashed: DataFrame) -> DataFrame:
    """Fragments of hashed (a written table) without an exact copy; their sets stay where they are."""
    rows = hashed.drop("items")
    return materialize(unassigned(rows, equal_groups(rows, "raw_hash", 1)).where("token_count > 0"), "candidates")


def type3_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(with_tokens(document_fragments(spark, sf_dir), structural=False).select("ord", "token_count", "raw_hash"), "fragments")
    return _candidates(rows).select(F.col("ord").alias("doc_id"), "token_count")


def _similar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Similar pairs, and the rows that they are among."""
    hashed = materialize(with_sets(with_tokens(document_fragments(spark, sf_dir), structural=False)).drop("source_text", "tokens"), "fragments", options=HASHES)
    rows = _candidates(hashed)
    pairs = materialize(similar_pairs(rows, THRESHOLD, hashed), "pairs")
    release(hashed)
    return pairs, rows


def type3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir)[0].withColumnsRenamed({"a": "doc_a", "b": "doc_b"})


def type3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(*_similar(spark, sf_dir)).groupBy("group_id", "similarity_score").agg(F.count(F.lit(1)).alias("members"))


def nested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_fragments(spark, sf_dir).select("ord", "file_path", "start_line", "end_line")
    a, b = rows.alias("a"), rows.alias("b")
    joined = a.join(b, (F.col("a.file_path") == F.col("b.file_path")) & (F.col("a.ord") < F.col("b.ord")) & nested("a", "b"))
    return joined.select(F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"))


def pruned_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one group of its file and its turns: the file goes, as does the earlier of equal spans."""
    rows = materialize(conversation_fragments(spark, sf_dir).select("ord", "file_path", "start_line", "end_line"), "fragments")
    return without_containers(rows.select(F.col("file_path").alias("group_id"), "ord"), rows)


def _detected_documents(spark: SparkSession, sf_dir: str):
    fragments = document_fragments(spark, sf_dir)
    return fragments, detect(fragments, (1, 3), THRESHOLD)


def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments, found = _detected_documents(spark, sf_dir)
    scanned = fragments.agg(F.countDistinct("file_path").alias("files_scanned"), F.count(F.lit(1)).alias("fragments_extracted"))
    return scanned.crossJoin(F.broadcast(found.counts()))  # one row each


def _basis_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments, found = _detected_documents(spark, sf_dir)
    paths = fragments.select("ord", is_basis(F.col("file_path"), [], [BASIS_DIRECTORY], [BASIS_SUFFIX]).alias("is_basis"))
    return found.members.join(paths, "ord")


def basis_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basis_groups(_basis_members(spark, sf_dir))


def basis_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basis_counts(basis_groups(_basis_members(spark, sf_dir)))


def path_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("/Root"), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".PY")))
    return read(spark, sf_dir, "documents").select("doc_id", matches_suffix(path, "SRC3/3.py").alias("by_folder"), matches_suffix(path, "23.py").alias("by_name"))


def ext_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension = F.element_at(F.array(*[F.lit(x) for x in (".PY", ".js", ".tsx", ".go", ".md", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", language_of(F.concat(F.lit("/a.b/f"), extension)).alias("language"))


def glob_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("/repo"), "source", F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("path")).where(~glob_matches(F.col("path"), ["*/src1[0-9]/*", "*7"])).select("doc_id")


def line_count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large_enough(document_fragments(spark, sf_dir), 10).select(F.col("ord").alias("doc_id"), "end_line")


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments, found = _detected_documents(spark, sf_dir)
    return report_groups(found, fragments).select("group_id", "clone_type", F.size("members").alias("n_members"), F.to_json("members", {"ignoreNullFields": "false"}).alias("members_json"))


_TOKEN = (
    r"""(?s)"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*.*?\*/|[0-9]+(?:\.[0-9]+)?|[a-zA-Z_$][a-zA-Z0-9_$]*|"""
    r"""[^\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"""
)


def _t(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), $re${_TOKEN}$re$)"


_LINES = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1"
_HASHED = f"h AS (SELECT doc_id, {_t('text')} AS t FROM documents), r AS (SELECT doc_id, t, len(t) AS n, sha256(array_to_string(t, '|')) AS raw_hash FROM h)"
_ONES = "g1 AS (SELECT raw_hash FROM r GROUP BY 1 HAVING count(*) >= 2)"
_CAND = f"{_HASHED}, {_ONES}, c AS (SELECT doc_id, n, list_distinct(t) AS s FROM r WHERE n > 0 AND raw_hash NOT IN (SELECT raw_hash FROM g1))"
_PAIRS = f"""{_CAND}, e AS (SELECT doc_id, unnest(s) AS w FROM c), both_ AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY 1, 2
), p AS (
  SELECT a, b, i / (len(x.s) + len(y.s) - i) AS score FROM both_ JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b
  WHERE x.n::DOUBLE / y.n <= 1.3::DOUBLE AND y.n::DOUBLE / x.n <= 1.3::DOUBLE AND i / (len(x.s) + len(y.s) - i) >= 0.8::DOUBLE
), sym AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (
  SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a
), comp AS (SELECT a AS doc_id, min(least(a, b)) AS root FROM reach GROUP BY 1)"""
_DETECTED = f"""{_PAIRS}, m AS (
  SELECT 't1-' || raw_hash AS group_id, 1 AS clone_type, doc_id FROM r WHERE raw_hash IN (SELECT raw_hash FROM g1)
  UNION ALL SELECT 't3-' || root, 3, doc_id FROM comp
), mb AS (
  SELECT m.*, coalesce(source, '') = 'src1' OR (lower(coalesce(source, '')) = 'src2' AND m.doc_id = 7) AS is_basis FROM m JOIN documents USING (doc_id)
), bg AS (SELECT group_id, clone_type, bool_and(is_basis) AS basis_internal FROM mb GROUP BY 1, 2 HAVING bool_or(is_basis))"""
_CONV = f"""turns AS (SELECT conv_id, turn, coalesce(text, '') AS text, {_LINES} AS lines FROM conversations), placed AS (
  SELECT conv_id * 1048576 + turn + 1 AS ord, conv_id, text, (sum(lines) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::INTEGER AS e, lines FROM turns
), f AS (
  SELECT ord, conv_id::VARCHAR AS file_path, e - lines + 1 AS s, e, text FROM placed
  UNION ALL SELECT conv_id * 1048576, conv_id::VARCHAR, 1, sum(lines)::INTEGER, string_agg(text, chr(10) ORDER BY turn) FROM turns GROUP BY conv_id
)"""


def _normal(source: str, key: str, language: str) -> str:
    """Normalised tokens by windows: source has (key, t)."""
    words = ", ".join(f"'{w}'" for w in sorted(KEYWORDS[language]))
    return f"""tok AS (SELECT {key}, unnest(t) AS w, unnest(range(len(t))) AS pos FROM {source}), kept AS (
  SELECT *, regexp_matches(w, '^[\\p{{L}}_]') AND w NOT IN ({words}) AS is_id, w[1] IN ('"', '''', '`') OR regexp_matches(w, '^[0-9]') AS is_lit
  FROM tok WHERE NOT (starts_with(w, '//') OR (starts_with(w, '/*') AND ends_with(w, '*/')))
), firsts AS (SELECT *, min(pos) OVER (PARTITION BY {key}, w) AS first_pos FROM kept), numbered AS (
  SELECT *, dense_rank() OVER (PARTITION BY {key}, is_id ORDER BY first_pos) - 1 AS id_k,
         sum(CASE WHEN is_lit THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY pos) - 1 AS lit_k FROM firsts
), norm AS (
  SELECT {key}, sha256(string_agg(CASE WHEN is_id THEN 'ID_' || id_k WHEN is_lit THEN 'LIT_' || lit_k::BIGINT ELSE w END, '|' ORDER BY pos)) AS normalized_hash FROM numbered GROUP BY {key}
)"""


_CONV_HASHES = f"""{_CONV}, h AS (SELECT ord, {_t('text')} AS t FROM f), {_normal('h', 'ord', 'Python')}, r AS (
  SELECT ord, sha256(array_to_string(t, '|')) AS raw_hash, coalesce(normalized_hash, sha256('')) AS normalized_hash FROM h LEFT JOIN norm USING (ord)
)"""

QUERIES = {
    f.__name__: f
    for f in (
        tokenise_counts, tokenise_pages, raw_hash, normalised_hash, type1_members, type1_groups, type2_only, type2_after_type1, type3_candidates, type3_pairs, type3_groups,
        nested_pairs, pruned_members, summary_counts, basis_filter, basis_type_counts, path_suffix_match, ext_language, glob_exclude, line_count_filter, report_json,
    )
}

ORACLE_SQL = {
    "tokenise_counts": f"WITH h AS (SELECT doc_id, {_t('text')} AS t FROM documents) SELECT doc_id, len(t)::INTEGER AS token_count, len(list_distinct(t))::INTEGER AS distinct_tokens FROM h",
    "tokenise_pages": f"WITH h AS (SELECT page_id, {_t('html')} AS t FROM pages) SELECT page_id, len(t)::INTEGER AS token_count, len(list_distinct(t))::INTEGER AS distinct_tokens FROM h",
    "raw_hash": f"WITH {_HASHED} SELECT doc_id, raw_hash FROM r",
    "normalised_hash": f"""WITH h AS (SELECT page_id, {_t('html')} AS t FROM pages), {_normal('h', 'page_id', 'JavaScript')}
        SELECT page_id, sha256(array_to_string(t, '|')) AS raw_hash, coalesce(normalized_hash, sha256('')) AS normalized_hash FROM h LEFT JOIN norm USING (page_id)""",
    "type1_members": f"WITH {_HASHED}, {_ONES} SELECT raw_hash AS representative_hash, doc_id FROM r WHERE raw_hash IN (SELECT raw_hash FROM g1)",
    "type1_groups": f"WITH {_HASHED} SELECT raw_hash AS representative_hash, count(*) AS members, min(doc_id) AS first_doc FROM r GROUP BY 1 HAVING count(*) >= 2",
    "type2_only": f"WITH {_CONV_HASHES} SELECT normalized_hash AS representative_hash, ord FROM r WHERE normalized_hash IN (SELECT normalized_hash FROM r GROUP BY 1 HAVING count(*) >= 2)",
    "type2_after_type1": f"""WITH {_CONV_HASHES}, rest AS (SELECT * FROM r WHERE raw_hash NOT IN (SELECT raw_hash FROM r GROUP BY 1 HAVING count(*) >= 2))
        SELECT normalized_hash AS representative_hash, ord FROM rest WHERE normalized_hash IN (SELECT normalized_hash FROM rest GROUP BY 1 HAVING count(*) >= 2)""",
    "type3_candidates": f"WITH {_CAND} SELECT doc_id, n::INTEGER AS token_count FROM c",
    "type3_pairs": f"WITH RECURSIVE {_PAIRS} SELECT a AS doc_a, b AS doc_b, score FROM p",
    "type3_groups": f"""WITH RECURSIVE {_PAIRS}, scored AS (SELECT root, min(score) AS s FROM p JOIN comp ON comp.doc_id = p.a GROUP BY 1)
        SELECT 't3-' || root AS group_id, s AS similarity_score, count(*) AS members FROM comp JOIN scored USING (root) GROUP BY root, s""",
    "nested_pairs": f"""WITH {_CONV} SELECT x.ord AS ord_a, y.ord AS ord_b FROM f x JOIN f y ON x.file_path = y.file_path AND x.ord < y.ord
        AND ((x.s <= y.s AND x.e >= y.e) OR (y.s <= x.s AND y.e >= x.e))""",
    "pruned_members": f"""WITH {_CONV} SELECT x.file_path AS group_id, x.ord FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE x.file_path = y.file_path AND x.ord <> y.ord
        AND ((x.s <= y.s AND x.e >= y.e) OR (y.s <= x.s AND y.e >= x.e)) AND (x.e - x.s > y.e - y.s OR (x.e - x.s = y.e - y.s AND x.ord < y.ord)))""",
    "summary_counts": f"""WITH RECURSIVE {_DETECTED} SELECT (SELECT count(DISTINCT source || '/' || doc_id) FROM documents) AS files_scanned, (SELECT count(*) FROM documents) AS fragments_extracted,
        count(DISTINCT group_id) FILTER (clone_type = 1) AS type1_groups, count(DISTINCT group_id) FILTER (clone_type = 2) AS type2_groups, count(DISTINCT group_id) FILTER (clone_type = 3) AS type3_groups FROM m""",
    "basis_filter": f"WITH RECURSIVE {_DETECTED} SELECT * FROM bg",
    "basis_type_counts": f"""WITH RECURSIVE {_DETECTED} SELECT count(*) FILTER (clone_type = 1) AS basis_type1_groups, count(*) FILTER (clone_type = 2) AS basis_type2_groups,
        count(*) FILTER (clone_type = 3) AS basis_type3_groups FROM bg""",
    "path_suffix_match": "SELECT doc_id, lower(coalesce(source, '')) = 'src3' AND doc_id = 3 AS by_folder, doc_id = 23 AS by_name FROM documents",
    "ext_language": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Python' WHEN 1 THEN 'JavaScript' WHEN 2 THEN 'TypeScript' WHEN 3 THEN 'Go' END AS language FROM documents",
    "glob_exclude": "SELECT doc_id FROM documents WHERE NOT regexp_matches(source, '^src1[0-9]$') AND doc_id % 10 <> 7",
    "line_count_filter": f"SELECT doc_id, ({_LINES})::INTEGER AS end_line FROM documents WHERE {_LINES} >= 10",
}
