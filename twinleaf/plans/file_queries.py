"""Registered queries over files, sessions, whole detections and reports, and the SQL that gives the same rows."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keywords import KEYWORDS, LANGUAGES, profile
from ..functions.tokens import fingerprint, tokens, with_tokens
from ..operators.basis import with_basis
from ..operators.storage import materialize, work_dir
from ..sources.extract import extract_and_normalise, fragments_of
from ..sources.scan import IgnoreRules, scan, target_list
from .adapters import conversation_fragments, document_fragments, document_parts, page_fragments, read
from .detect import detect
from .fixtures import FOLDERS, KINDS, chosen, code, code_files, code_sql, code_tree, extension_sql, folder_sql, fragments_sql, language_sql
from .queries import _CONV, _DETECTED, _HASHED, _LINES, _ONES, BASIS_DIRECTORY, BASIS_SUFFIX, THRESHOLD, _detected_documents, _t
from .report import basis_summary, console, report_groups, report_members, summary, write_html, write_reports
from .store import SessionStore

#: Patterns and rules of the scan queries.
EXCLUDE, RULES = ["*/gen", "*7.py"], ["# a note", "_Sub/", "*.java", "!1*.java"]


def _relative(files: DataFrame, root: str) -> DataFrame:
    return files.select("file_ord", F.substring("path", len(root) + 2, 1_000_000).alias("path"), "language", F.decode("content", "UTF-8").alias("text"))


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = code_tree(spark, sf_dir)
    return _relative(scan(spark, [root]), root)


def scan_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = code_tree(spark, sf_dir)
    return _relative(scan(spark, [root], EXCLUDE, IgnoreRules(RULES, root)), root).drop("text")


def scan_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file, a folder, the folder of all, one that is missing, and the first again: each file once, in the order of the roots."""
    root = code_tree(spark, sf_dir)
    first = read(spark, sf_dir, "documents").where("doc_id = 0").select(F.coalesce("source", F.lit("none"))).first()
    named = [f"{root}/{first[0]}/{FOLDERS[0]}/0{KINDS[0][0]}"] if first else []
    return _relative(scan(spark, [*named, f"{root}/src1/pkg", root, f"{root}/missing", *named]), root).drop("text")


def target_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of a list with notes, blanks and blank lines: one line per nation."""
    names = [r.n_name for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    lines = [x for k, n in enumerate(names) for x in (("# " if k % 3 == 0 else "  ") + n + " ", "")]
    return spark.createDataFrame(list(enumerate(target_list(lines))), "place int, path string")


def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = IgnoreRules(["*.py", "!/src1/*.py", "src2/", "/src3/1*"], "/repo")
    path = F.concat(F.lit("/repo/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), chosen([x[0] for x in KINDS], F.pmod("doc_id", F.lit(7))))
    return read(spark, sf_dir, "documents").select("doc_id", rules.ignores(path).alias("ignored"))


def _fragments(found: DataFrame) -> DataFrame:
    return found.where("error is null").select(F.col("file_ord").alias("doc_id"), "language", "fragment_type", "start_line", "end_line", "source_text")


def extract_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragments(fragments_of(code_files(spark, sf_dir)))


def extract_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragments(fragments_of(code_files(spark, sf_dir), 1, True))


def extract_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python that doesn't parse, with a byte that is no UTF-8; every seventh file can't be read."""
    doc = F.col("doc_id")
    head = F.concat(F.lit("def f"), doc.cast("string"), F.lit("(:\n"), F.repeat(F.lit("    x = 1\n"), F.pmod(doc, F.lit(13)).cast("int")), F.lit("    y = '"))
    content = F.concat(F.encode(head, "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit("'\nz = 1\n"), "UTF-8"))
    files = read(spark, sf_dir, "documents").select(doc.alias("file_ord"), F.lit("/b.py").alias("path"), F.lit("Python").alias("language"), F.when(F.pmod(doc, F.lit(7)) != 0, content).alias("content"))
    return fragments_of(files, 1).select(F.col("file_ord").alias("doc_id"), "fragment_type", "start_line", "end_line", "source_text", F.col("error").isNotNull().alias("failed"))


def node_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a node by its bytes: from the first bracket of a file on, without its last line feed."""
    nodes = code_files(spark, sf_dir).withColumns({"start_byte": F.instr(F.decode("content", "UTF-8"), "(") - 1, "end_byte": F.octet_length("content") - 1})
    found = extract_and_normalise(nodes)
    return found.select(F.col("file_ord").alias("doc_id"), F.size("tokens").alias("token_count"), fingerprint(F.col("tokens")).alias("raw_hash"), fingerprint(F.col("normalized_tokens")).alias("normalized_hash"))


def normalised_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of six languages in turn, and of none."""
    rows = page_fragments(spark, sf_dir).withColumn("language", chosen([x[1] for x in KINDS], F.pmod("ord", F.lit(7))))
    return with_tokens(rows).select(F.col("ord").alias("page_id"), "token_count", "raw_hash", "normalized_hash")


def hash_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(conversation_fragments(spark, sf_dir)).select("ord", "token_count", "raw_hash", "normalized_hash")


def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(x, len(KEYWORDS[x]), len(profile(x)[0]), len(profile(x)[1]), ",".join(sorted(e for e, y in LANGUAGES.items() if y == x))) for x in KEYWORDS]
    rows.append(("Cobol", len(KEYWORDS.get("Cobol", ())), len(profile("Cobol")[0]), len(profile("Cobol")[1]), ""))
    return spark.createDataFrame(rows, "language string, keywords int, identifier_kinds int, literal_kinds int, extensions string")


def _store(spark: SparkSession) -> SessionStore:
    return SessionStore(spark, f"{work_dir(spark)}/store-{uuid.uuid4().hex}")


def _stored(store: SessionStore, spark: SparkSession, sf_dir: str) -> str:
    session = store.create(["/docs"], {"types": [1]})
    fragments = with_tokens(document_fragments(spark, sf_dir), structural=False)
    store.save_fragments(session, fragments)
    store.save_groups(session, detect(store.fragments(session), (1,)))
    return session


def store_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _store(spark) as store:
        rows = store.fragments(_stored(store, spark, sf_dir))
    return rows.select("ord", "fragment_id", "file_path", F.size("tokens").alias("n_tokens"), fingerprint(F.col("tokens")).alias("tokens_hash"), "token_count")


def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments by their ids: those numbered as nations are, and one that isn't there."""
    ids = [f"file-{r.n_nationkey}" for r in read(spark, sf_dir, "nation").select("n_nationkey").collect()]
    with _store(spark) as store:
        session = _stored(store, spark, sf_dir)
        rows = store.fragments_by_id(session, [*ids, "file-none"])
        one, none = store.fragment(session, ids[0]), store.fragment(session, "file-none")
    return rows.select("fragment_id", "ord", F.lit(one is not None and none is None).alias("by_one"))


def store_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _store(spark) as store:
        groups = store.clone_groups(_stored(store, spark, sf_dir))
    return groups.select("group_id", "clone_type", "representative_hash", "similarity_score", F.array_join("member_fragment_ids", ",").alias("members"))


def store_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _store(spark) as store:
        rows = store.fragments_of_groups(_stored(store, spark, sf_dir))
    return rows.select("group_id", "fragment_id", "file_path")


def store_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of three sessions: one kept, one deleted, one undone by an exception."""
    store = _store(spark)
    with store:
        kept, gone = _stored(store, spark, sf_dir), _stored(store, spark, sf_dir)
    with store:
        store.delete(gone)
    try:
        with store:
            undone = _stored(store, spark, sf_dir)
            store.delete(kept)
            raise KeyError("undo")
    except KeyError:
        pass
    with store:
        listed = store.sessions()
        row = (len(listed), listed == [kept], store.count(kept), store.session(kept).count(), store.session(gone).count(), store.session(undone).count())
    return spark.createDataFrame([row], "sessions int, is_kept boolean, fragments long, kept_rows long, deleted_rows long, undone_rows long")


def _members(spark: SparkSession, sf_dir: str, types: tuple[int, ...]) -> DataFrame:
    found = detect(document_parts(spark, sf_dir), types, THRESHOLD)
    return found.members.select("group_id", "clone_type", "representative_hash", "similarity_score", "ord")


def detect_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir, (1, 2, 3))


def detect_types_2_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir, (2, 3))


def detect_type_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir, (3,))


def basis_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute files and folders, and endings, joined with the paths."""
    rows = document_fragments(spark, sf_dir).withColumn("file_path", F.concat(F.lit("/Repo/"), "file_path"))
    files = [f"/Repo/src4/{k}" for k in range(50)]
    return with_basis(rows, files, ["/Repo/src1"], ["SRC2/7", "23", "repo/src5/5"]).select(F.col("ord").alias("doc_id"), "is_basis")


def basis_none_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a report without a basis, and with one that matches nothing."""
    fragments, found = _detected_documents(spark, sf_dir)
    count = lambda x: report_groups(found, fragments, x).count()
    return spark.createDataFrame([(count(None), count(F.lit(False)))], "without long, unmatched long")


def _marked(spark: SparkSession, sf_dir: str):
    fragments, found = _detected_documents(spark, sf_dir)
    marks = with_basis(fragments.select("ord", "file_path"), [], [BASIS_DIRECTORY], [BASIS_SUFFIX]).select("ord", "file_path", F.col("is_basis").alias("in_basis")).distinct()
    return fragments.join(materialize(marks, "marked"), ["ord", "file_path"], "left").withColumn("in_basis", F.coalesce("in_basis", F.lit(False))), found


def report_json_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments, found = _marked(spark, sf_dir)
    rows = report_groups(found, fragments, F.col("in_basis"))
    return rows.select("group_id", "clone_type", "basis_internal", F.size("members").alias("n_members"), F.to_json("members", {"ignoreNullFields": "false"}).alias("members_json"))


def report_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of a written JSON report, read again, and whether a report in both formats names both files."""
    fragments, found = _marked(spark, sf_dir)
    rows = materialize(report_members(found, fragments, F.col("in_basis")), "report")
    with tempfile.TemporaryDirectory() as folder:
        paths = write_reports("both", os.path.join(folder, "r"), rows, summary(found, fragments, 1), "s", ["/docs"], ["src1"])
        both = [os.path.basename(p) for p in paths] == ["r.json", "r.html"] and all(map(os.path.isfile, paths))
        with open(paths[0], encoding="utf-8") as f:
            data = json.load(f)
    head = both and data["basis_paths"] == ["src1"] and data["session_id"] == "s" and "generated_at" in data
    out = [(g["group_id"], g["clone_type"], g["representative_hash"], g.get("similarity_score"), g["basis_internal"], len(g["members"]), sum(m["is_basis"] for m in g["members"]), data["summary"]["type1_groups"], head) for g in data["clone_groups"]]
    return spark.createDataFrame(out, "group_id string, clone_type int, representative_hash string, similarity_score double, basis_internal boolean, n_members int, n_basis int, type1_groups int, whole boolean")


def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments, found = _marked(spark, sf_dir)
    rows = materialize(report_members(found, fragments, F.col("in_basis")), "report")
    with tempfile.TemporaryDirectory() as folder:
        with open(write_html(os.path.join(folder, "r.html"), rows, summary(found, fragments, 1), "s", ["/docs"], ["src1"]), encoding="utf-8") as f:
            page = f.read()
    out = (page.count("<details>"), page.count("<pre>"), page.count(">BASIS<"), page.count("Basis-to-Basis"), page.count("No structural clones found."))
    return spark.createDataFrame([out], "groups int, members int, basis_members int, internal_groups int, no_type2 int")


def report_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments, found = _marked(spark, sf_dir)
    counts = basis_summary(report_members(found, fragments, F.col("in_basis")))
    lines = console(summary(found, fragments, fragments.count()), counts).split("\n")
    return spark.createDataFrame([(x,) for x in lines], "line string")


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a run over a tree of files: exact clones among functions and classes of 10 lines or more."""
    from ..cli import main

    root = code_tree(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:
        args = [root, "--types", "1,x", "--code-blocks-only", "--format", "json", "--output", "r", "--output-dir", folder, "--db-dir", f"{root}-db", "--conf-dir", os.path.join(folder, "conf"), "--exclude", "*/gen"]
        if main(args, spark):
            raise RuntimeError("the run failed")
        with open(os.path.join(folder, "r.json"), encoding="utf-8") as f:
            data = json.load(f)
    names = ("files_scanned", "fragments_extracted", "type1_groups", "type2_groups", "type3_groups")
    members = sum(len(g["members"]) for g in data["clone_groups"])
    return spark.createDataFrame([(*(data["summary"][n] for n in names), members)], ", ".join(f"{n} int" for n in (*names, "members")))


_KW = "kw(language, word) AS (VALUES " + ", ".join(f"('{x}', '{w}')" for x in KEYWORDS for w in sorted(KEYWORDS[x])) + ")"


def _normal_by_language(source: str, key: str) -> str:
    """Normalised hashes by windows: source has (key, language, t)."""
    return f"""{_KW}, tok AS (SELECT {key}, language, unnest(t) AS w, unnest(range(len(t))) AS pos FROM {source}), kept AS (
  SELECT tok.*, regexp_matches(w, '^[\\p{{L}}_]') AND kw.word IS NULL AS is_id, w[1] IN ('"', '''', '`') OR regexp_matches(w, '^[0-9]') AS is_lit
  FROM tok LEFT JOIN kw ON kw.language = tok.language AND kw.word = w WHERE NOT (starts_with(w, '//') OR (starts_with(w, '/*') AND ends_with(w, '*/')))
), firsts AS (SELECT *, min(pos) OVER (PARTITION BY {key}, w) AS first_pos FROM kept), numbered AS (
  SELECT *, dense_rank() OVER (PARTITION BY {key}, is_id ORDER BY first_pos) - 1 AS id_k,
         sum(CASE WHEN is_lit THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY pos) - 1 AS lit_k FROM firsts
), norm AS (
  SELECT {key}, sha256(string_agg(CASE WHEN is_id THEN 'ID_' || id_k WHEN is_lit THEN 'LIT_' || lit_k::BIGINT ELSE w END, '|' ORDER BY pos)) AS normalized_hash FROM numbered GROUP BY {key}
)"""


def _tree_sql(where: str) -> str:
    return f"""SELECT *, source || '/' || folder || '/' || name AS path FROM (
      SELECT doc_id, coalesce(source, 'none') AS source, {folder_sql()} AS folder, doc_id || {extension_sql()} AS name, {language_sql()} AS language, {code_sql()} AS text FROM documents
    ) WHERE language IS NOT NULL AND folder NOT IN ('node_modules', 'build'){where}"""


_NEST = "((x.s <= y.s AND x.e >= y.e) OR (y.s <= x.s AND y.e >= x.e))"


_PARTS = f"""f AS (
  SELECT doc_id * 2 AS ord, concat_ws('/', source, doc_id::VARCHAR) AS file_path, 1 AS s, {_LINES} AS e, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT doc_id * 2 + 1, concat_ws('/', source, doc_id::VARCHAR), 1, {_LINES} - 1, regexp_replace(text, '\\n[^\\n]*\\z', '') FROM documents WHERE contains(text, chr(10))
)"""


def _detection_sql(types: tuple[int, ...]) -> str:
    """Members of groups of document_parts by definition."""
    ones = "(SELECT raw_hash FROM r GROUP BY 1 HAVING count(*) >= 2)" if 1 in types else "(SELECT 'none')"
    twos = "(SELECT normalized_hash FROM rest1 GROUP BY 1 HAVING count(*) >= 2)" if 2 in types else "(SELECT 'none')"
    return f"""WITH RECURSIVE {_PARTS}, h AS (SELECT ord, 'Python' AS language, {_t('text')} AS t FROM f), {_normal_by_language('h', 'ord')}, r AS (
      SELECT h.ord, file_path, s, e, t, len(t) AS n, sha256(array_to_string(t, '|')) AS raw_hash, coalesce(normalized_hash, sha256('')) AS normalized_hash FROM h JOIN f USING (ord) LEFT JOIN norm ON norm.ord = h.ord
    ), m1 AS (SELECT * FROM r WHERE raw_hash IN {ones}), rest1 AS (SELECT * FROM r WHERE ord NOT IN (SELECT ord FROM m1)),
    m2 AS (SELECT * FROM rest1 WHERE normalized_hash IN {twos}), c AS (
      SELECT *, list_distinct(t) AS d FROM rest1 WHERE n > 0 AND ord NOT IN (SELECT ord FROM m2)
    ), w AS (SELECT ord, unnest(d) AS w FROM c), shared AS (
      SELECT x.ord AS a, y.ord AS b, count(*) AS i FROM w x JOIN w y ON x.w = y.w AND x.ord < y.ord GROUP BY 1, 2
    ), p AS (
      SELECT a, b, i / (len(x.d) + len(y.d) - i) AS score FROM shared JOIN c x ON x.ord = a JOIN c y ON y.ord = b
      WHERE x.n::DOUBLE / y.n <= 1.3::DOUBLE AND y.n::DOUBLE / x.n <= 1.3::DOUBLE AND i / (len(x.d) + len(y.d) - i) >= 0.8::DOUBLE AND NOT (x.file_path = y.file_path AND {_NEST})
    ), sym AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
    comp AS (SELECT a AS ord, min(least(a, b)) AS root FROM reach GROUP BY 1), laid AS (SELECT comp.root, c.* FROM comp JOIN c USING (ord)), stay AS (
      SELECT root, ord FROM laid x WHERE NOT EXISTS (SELECT 1 FROM laid y WHERE x.root = y.root AND x.file_path = y.file_path AND x.ord <> y.ord AND {_NEST}
        AND (x.e - x.s > y.e - y.s OR (x.e - x.s = y.e - y.s AND x.ord < y.ord)))
    ), m3 AS (SELECT * FROM stay WHERE root IN (SELECT root FROM stay GROUP BY 1 HAVING count(*) >= 2)), scores AS (
      SELECT k.root, min(score) AS score FROM p JOIN m3 k ON k.ord = p.a JOIN m3 l ON l.ord = p.b GROUP BY 1
    )
    SELECT 't1-' || raw_hash AS group_id, 1 AS clone_type, raw_hash AS representative_hash, NULL::DOUBLE AS similarity_score, ord FROM m1
    UNION ALL SELECT 't2-' || normalized_hash, 2, normalized_hash, NULL, ord FROM m2
    UNION ALL SELECT 't3-' || m3.root, 3, NULL, score, ord FROM m3 LEFT JOIN scores USING (root)"""


_IGNORED = "(folder = '_Sub' OR (name LIKE '%.java' AND name NOT LIKE '1%.java'))"
_DOC = f"d AS (SELECT doc_id, concat_ws('/', source, doc_id::VARCHAR) AS file, lang, source, ({'length(coalesce(text, %s)) - length(replace(coalesce(text, %s), chr(10), %s)) + 1' % (chr(39) * 2, chr(39) * 2, chr(39) * 2)})::INTEGER AS end_line, coalesce(text, '') AS text FROM documents)"
_SCORES = "scored AS (SELECT 't3-' || root AS group_id, min(score) AS s FROM p JOIN comp ON comp.doc_id = p.a GROUP BY 1)"


def _member_json(basis: bool) -> str:
    flag = ", is_basis := is_basis" if basis else ""
    return f"""to_json(list(struct_pack(fragment_id := 'file-' || d.doc_id, file := file, language := lang, fragment_type := 'file', start_line := 1, end_line := end_line, token_count := n::INTEGER, source_text := d.text{flag}) ORDER BY d.doc_id))::VARCHAR"""


QUERIES = {
    f.__name__: f
    for f in (
        scan_files, scan_excluded, scan_roots, target_lines, ignore_rules, extract_fragments, extract_code_blocks, extract_broken, node_tokens, normalised_languages, hash_all, language_profiles,
        store_fragments, store_lookup, store_groups, store_group_members, store_sessions, detect_all_types, detect_types_2_3, detect_type_3, basis_targets, basis_none_or_empty, report_json_basis,
        report_written, report_html, report_console, command_line,
    )
}

ORACLE_SQL = {
    "scan_files": f"SELECT row_number() OVER (ORDER BY source, folder, name) - 1 AS file_ord, path, language, text FROM ({_tree_sql('')})",
    "scan_excluded": f"SELECT row_number() OVER (ORDER BY source, folder, name) - 1 AS file_ord, path, language FROM ({_tree_sql('')}) WHERE folder <> 'gen' AND name NOT LIKE '%7.py' AND NOT {_IGNORED}",
    "scan_roots": f"""SELECT row_number() OVER (ORDER BY CASE WHEN doc_id = 0 THEN 0 WHEN source = 'src1' AND folder = 'pkg' THEN 1 ELSE 2 END, source, folder, name) - 1 AS file_ord, path, language FROM ({_tree_sql('')})""",
    "target_lines": "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INTEGER AS place, trim(n_name) AS path FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) WHERE k % 3 <> 0",
    "ignore_rules": "SELECT doc_id, (doc_id % 7 = 0 AND coalesce(source, 'none') <> 'src1') OR coalesce(source, 'none') = 'src2' OR (coalesce(source, 'none') = 'src3' AND starts_with(doc_id::VARCHAR, '1')) AS ignored FROM documents",
    "extract_fragments": f"WITH {fragments_sql()} SELECT * FROM fragments WHERE end_line - start_line + 1 >= 10",
    "extract_code_blocks": f"WITH {fragments_sql()} SELECT * FROM fragments WHERE fragment_type <> 'file'",
    "extract_broken": """WITH b AS (SELECT doc_id, (doc_id % 13)::INTEGER AS k, 'def f' || doc_id || '(:' || chr(10) || repeat('    x = 1' || chr(10), (doc_id % 13)::INTEGER) || '    y = ''' || chr(65533) || '''' AS f FROM documents)
        SELECT doc_id, 'function' AS fragment_type, 1 AS start_line, k + 2 AS end_line, f AS source_text, false AS failed FROM b WHERE doc_id % 7 <> 0
        UNION ALL SELECT doc_id, 'file', 1, k + 4, f || chr(10) || 'z = 1' || chr(10), false FROM b WHERE doc_id % 7 <> 0
        UNION ALL SELECT doc_id, 'error', 0, 0, '', true FROM b WHERE doc_id % 7 = 0""",
    "node_tokens": f"""WITH src AS (SELECT doc_id, {language_sql()} AS language, {code_sql()} AS text FROM documents WHERE doc_id % 7 < 6),
        h AS (SELECT doc_id, language, {_t("substr(text, instr(text, '('), length(text) - instr(text, '('))")} AS t FROM src), {_normal_by_language('h', 'doc_id')}
        SELECT doc_id, len(t)::INTEGER AS token_count, sha256(array_to_string(t, '|')) AS raw_hash, coalesce(normalized_hash, sha256('')) AS normalized_hash FROM h LEFT JOIN norm USING (doc_id)""",
    "normalised_languages": f"""WITH h AS (SELECT page_id, {language_sql('page_id')} AS language, {_t('html')} AS t FROM pages), {_normal_by_language('h', 'page_id')}
        SELECT page_id, len(t)::INTEGER AS token_count, sha256(array_to_string(t, '|')) AS raw_hash, coalesce(normalized_hash, sha256('')) AS normalized_hash FROM h LEFT JOIN norm USING (page_id)""",
    "hash_all": f"""WITH {_CONV}, h AS (SELECT ord, 'Python' AS language, {_t('text')} AS t FROM f), {_normal_by_language('h', 'ord')}
        SELECT ord, len(t)::INTEGER AS token_count, sha256(array_to_string(t, '|')) AS raw_hash, coalesce(normalized_hash, sha256('')) AS normalized_hash FROM h LEFT JOIN norm USING (ord)""",
    "language_profiles": """SELECT * FROM (VALUES ('Python', 35, 2, 6, '.py'), ('JavaScript', 39, 3, 6, '.cjs,.js,.mjs'), ('TypeScript', 66, 4, 6, '.ts,.tsx'), ('Java', 53, 2, 6, '.java'),
        ('Gosu', 55, 2, 6, '.gs,.gsx'), ('Go', 28, 3, 7, '.go'), ('Cobol', 0, 0, 0, '')) AS v(language, keywords, identifier_kinds, literal_kinds, extensions)""",
    "store_fragments": f"""WITH {_HASHED} SELECT r.doc_id AS ord, 'file-' || r.doc_id AS fragment_id, concat_ws('/', source, r.doc_id::VARCHAR) AS file_path, n::INTEGER AS n_tokens, raw_hash AS tokens_hash, n::INTEGER AS token_count
        FROM r JOIN documents USING (doc_id)""",
    "store_lookup": "SELECT 'file-' || doc_id AS fragment_id, doc_id AS ord, true AS by_one FROM documents WHERE doc_id IN (SELECT n_nationkey FROM nation)",
    "store_groups": f"""WITH {_HASHED}, {_ONES} SELECT 't1-' || raw_hash AS group_id, 1 AS clone_type, raw_hash AS representative_hash, NULL::DOUBLE AS similarity_score,
        string_agg('file-' || doc_id, ',' ORDER BY doc_id) AS members FROM r WHERE raw_hash IN (SELECT raw_hash FROM g1) GROUP BY raw_hash""",
    "store_group_members": f"""WITH {_HASHED}, {_ONES} SELECT 't1-' || raw_hash AS group_id, 'file-' || doc_id AS fragment_id, concat_ws('/', source, doc_id::VARCHAR) AS file_path
        FROM r JOIN documents USING (doc_id) WHERE raw_hash IN (SELECT raw_hash FROM g1)""",
    "store_sessions": "SELECT 1 AS sessions, true AS is_kept, count(*) AS fragments, 1::BIGINT AS kept_rows, 0::BIGINT AS deleted_rows, 0::BIGINT AS undone_rows FROM documents",
    "detect_all_types": _detection_sql((1, 2, 3)),
    "detect_types_2_3": _detection_sql((2, 3)),
    "detect_type_3": _detection_sql((3,)),
    "basis_targets": """SELECT doc_id, (coalesce(source, '') = 'src4' AND doc_id < 50) OR coalesce(source, '') = 'src1' OR (coalesce(source, '') = 'src2' AND doc_id = 7) OR doc_id = 23
        OR (coalesce(source, '') = 'src5' AND doc_id = 5) AS is_basis FROM documents""",
    "basis_none_or_empty": f"WITH RECURSIVE {_DETECTED} SELECT count(DISTINCT group_id) AS without, 0::BIGINT AS unmatched FROM m",
    "report_json": f"""WITH RECURSIVE {_DETECTED}, {_DOC} SELECT group_id, clone_type, count(*)::INTEGER AS n_members, {_member_json(False)} AS members_json
        FROM m JOIN d USING (doc_id) JOIN r USING (doc_id) GROUP BY group_id, clone_type""",
    "report_json_basis": f"""WITH RECURSIVE {_DETECTED}, {_DOC} SELECT group_id, clone_type, basis_internal, count(*)::INTEGER AS n_members, {_member_json(True)} AS members_json
        FROM mb JOIN bg USING (group_id, clone_type) JOIN d USING (doc_id) JOIN r USING (doc_id) GROUP BY group_id, clone_type, basis_internal""",
    "report_written": f"""WITH RECURSIVE {_DETECTED}, {_SCORES} SELECT group_id, clone_type, CASE WHEN clone_type = 1 THEN substr(group_id, 4) END AS representative_hash, round(any_value(s), 4) AS similarity_score,
        basis_internal, count(*)::INTEGER AS n_members, count(*) FILTER (is_basis)::INTEGER AS n_basis, (SELECT count(*) FROM g1)::INTEGER AS type1_groups, true AS whole
        FROM mb JOIN bg USING (group_id, clone_type) LEFT JOIN scored USING (group_id) GROUP BY group_id, clone_type, basis_internal""",
    "report_html": f"""WITH RECURSIVE {_DETECTED} SELECT count(DISTINCT group_id)::INTEGER AS groups, count(*)::INTEGER AS members, count(*) FILTER (is_basis)::INTEGER AS basis_members,
        count(DISTINCT group_id) FILTER (basis_internal)::INTEGER AS internal_groups, 1 AS no_type2 FROM mb JOIN bg USING (group_id, clone_type)""",
    "report_console": f"""WITH RECURSIVE {_DETECTED}, t AS (SELECT count(DISTINCT group_id) FILTER (clone_type = 1) AS a, count(DISTINCT group_id) FILTER (clone_type = 3) AS c FROM m),
        b AS (SELECT count(*) FILTER (clone_type = 1) AS a, count(*) FILTER (clone_type = 3) AS c FROM bg), n AS (SELECT count(*) AS n FROM documents)
        SELECT unnest(['files scanned: ' || n, 'fragments extracted: ' || n, 'type1 groups: ' || t.a || ' (basis ' || b.a || ')', 'type2 groups: 0 (basis 0)', 'type3 groups: ' || t.c || ' (basis ' || b.c || ')']) AS line FROM t, b, n""",
    "command_line": f"""WITH {fragments_sql()}, g AS (SELECT f.doc_id, {_t('f.source_text')} AS t FROM fragments f JOIN documents USING (doc_id) WHERE fragment_type <> 'file' AND end_line - start_line + 1 >= 10
          AND {folder_sql('f.doc_id')} NOT IN ('node_modules', 'build', 'gen')),
        h AS (SELECT array_to_string(t, '|') AS k, count(*) AS c FROM g GROUP BY 1)
        SELECT (SELECT count(*) FROM documents WHERE doc_id % 7 < 6 AND {folder_sql()} NOT IN ('node_modules', 'build', 'gen'))::INTEGER AS files_scanned, sum(c)::INTEGER AS fragments_extracted,
               count(*) FILTER (c >= 2)::INTEGER AS type1_groups, 0 AS type2_groups, 0 AS type3_groups, (sum(c) FILTER (c >= 2))::INTEGER AS members FROM h""",
}
