import json

import pytest

from twinleaf.cli import main, parse_types
from twinleaf.sources.extract import extract
from twinleaf.sources.scan import IgnoreRules, glob_regex, scan, target_list
from twinleaf.streaming.incremental import growing_groups


def tree(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def names(df, root):
    return [r.path.removeprefix(f"{root}/") for r in df.orderBy("file_ord").collect()]


def test_scan(spark, tmp_path):
    tree(tmp_path, {"a.py": "1", "b.md": "1", ".venv/c.py": "1", "pkg/d.JS": "1", "pkg/gen/e.ts": "1", "node_modules/f.js": "1", "pkg/g.py": "1", ".py": "1"})
    assert names(scan(spark, [str(tmp_path)]), tmp_path) == ["a.py", "pkg/d.JS", "pkg/g.py", "pkg/gen/e.ts"]
    assert names(scan(spark, [str(tmp_path)], ["*/gen"]), tmp_path) == ["a.py", "pkg/d.JS", "pkg/g.py"]
    assert names(scan(spark, [str(tmp_path / "pkg" / "g.py"), str(tmp_path)]), tmp_path)[0] == "pkg/g.py"
    assert scan(spark, [str(tmp_path / "a.py"), str(tmp_path)]).where("path like '%/a.py'").count() == 1
    assert scan(spark, [str(tmp_path / "missing")]).count() == 0
    # a root of an excluded name is entered
    assert names(scan(spark, [str(tmp_path / ".venv")]), tmp_path) == [".venv/c.py"]
    rules = IgnoreRules(["# note", "gen/", "*.js", "*.JS", "!pkg/d.JS"], str(tmp_path))
    assert names(scan(spark, [str(tmp_path)], ignore=rules), tmp_path) == ["a.py", "pkg/d.JS", "pkg/g.py"]


def test_scan_of_odd_names_links_and_closed_files(spark, tmp_path, monkeypatch, caplog):
    tree(tmp_path, {"__init__.py": "x = 1", ".github/b.py": "1", "_private/c d+%41.py": "1", "é/ü.go": "package p", "shut/d.py": "1", "e.py": "no"})
    (tmp_path / "é" / "again").symlink_to(tmp_path)  # a circle
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere.py")
    found = scan(spark, [str(tmp_path), f"file:{tmp_path}/e.py"])
    assert names(found, tmp_path) == [".github/b.py", "__init__.py", "_private/c d+%41.py", "e.py", "shut/d.py", "é/ü.go"]
    assert [r.file_ord for r in found.orderBy("file_ord").collect()] == list(range(6))
    # a folder that can't be listed and a file that can't be read are left out, the run goes on
    from twinleaf.sources import scan as module
    from twinleaf.sources.extract import fragments_of

    def listed(folder):
        if folder.endswith("shut"):
            raise PermissionError("closed")
        return children(folder)

    def read(path):
        if path.endswith("e.py"):
            raise PermissionError("closed")
        return content(path)

    children, content = module.children, module.content_of
    monkeypatch.setattr(module, "children", listed)
    monkeypatch.setattr(module, "content_of", read)
    import pickle

    import pyspark.cloudpickle as cloud

    cloud.register_pickle_by_value(module)  # the tasks get the module as it is here
    try:
        with caplog.at_level("WARNING"):
            found = scan(spark, [str(tmp_path)])
            assert "shut/d.py" not in names(found, tmp_path) and "closed" in caplog.text
            assert [r.path.rsplit("/", 1)[1] for r in found.where("content is null").collect()] == ["e.py"]
            errors = fragments_of(found, 1).where("error is not null").select("file_path", "ord").collect()
            assert len(errors) == 1 and errors[0].file_path.endswith("e.py")
    finally:
        cloud.unregister_pickle_by_value(module)
    assert pickle


def test_ord_of_many_files(spark):
    from twinleaf.sources.extract import PLACES, fragments_of

    files = spark.createDataFrame([(0, "/a.py", "Python", b"x = 1\n"), (5_000_000, "/b.py", "Python", b"y = 1\n")], "file_ord long, path string, language string, content binary")
    assert sorted(r.ord for r in fragments_of(files, 1).collect()) == [0, 5_000_000 * PLACES]


def test_configuration(tmp_path, monkeypatch, caplog):
    from twinleaf import config

    monkeypatch.setenv("TWINLEAF_CONFIG_DIR", str(tmp_path / "conf"))
    folder = config.bootstrap(config.conf_dir())
    assert config.Config().ignore_file() == ".ignore" and (tmp_path / "conf" / "config.ini").exists()
    (tmp_path / "conf" / "config.ini").write_text("[other]\nk = v\n")
    assert config.Config(folder).ignore_file() == ".ignore"
    (tmp_path / "conf" / "config.ini").write_text("[override]\nignore-file = mine\n")
    assert config.Config(config.bootstrap(folder)).ignore_file() == "mine"
    (tmp_path / "conf" / "mine").write_text("*.tmp\n")
    assert len(config.find_ignore(config.Config(folder), "/x").rules) == 1
    (tmp_path / "conf" / "mine").unlink()
    assert config.find_ignore(config.Config(folder), "/x").rules == []  # the default file
    (tmp_path / "conf" / ".ignore").write_bytes(b"\xff\xfe")
    with caplog.at_level("WARNING"):
        assert config.find_ignore(config.Config(folder), "/x") is None
    assert "not valid UTF-8" in caplog.text and "no ignore file" in caplog.text
    assert config.anchor_of(["/a/b", "/a/c"]) == "/a"
    log = config.set_up_logging(folder)
    log.info("a line")
    assert "a line" in (tmp_path / "conf" / "twinleaf.log").read_text()
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()


def test_basis_by_joins(spark):
    from twinleaf.operators.basis import with_basis

    rows = spark.createDataFrame([(1, "/x/A/IInfuser.gs"), (2, "/x/a/b.gs"), (3, "/y/b.gs"), (4, "b.gs"), (5, "")], "ord long, file_path string")
    got = lambda *a: [r.ord for r in with_basis(rows, *a).where("is_basis").orderBy("ord").collect()]
    assert got([], [], ["iinfuser.GS"]) == [1] and got([], [], ["./a/b.gs"]) == [2] and got(["/y/b.gs"], ["/x/a/"], []) == [2, 3] and got([], [], []) == []
    assert got([], [], ["b.gs"]) == [2, 3, 4] and got([f"/no/{k}" for k in range(3000)], ["/x"], []) == [1, 2]


def test_work_folder_of_a_cluster():
    from types import SimpleNamespace

    from twinleaf.operators.storage import work_dir

    conf = lambda **k: SimpleNamespace(conf=SimpleNamespace(get=lambda name, other=None: k.get(name, other)))
    assert work_dir(conf(**{"spark.checkpoint.dir": "s3a://b/x/"})) == "s3a://b/x" and "twinleaf-" in work_dir(conf(**{"spark.master": "local[4]"}))
    with pytest.raises(RuntimeError):
        work_dir(conf(**{"spark.master": "local-cluster[3,2,1024]"}))
    with pytest.raises(RuntimeError):
        work_dir(conf(**{"spark.master": "yarn"}))


def test_normalised_batches_follow_the_rule():
    import random

    import pyarrow as pa

    from twinleaf.functions.tokens import normalised, normalised_batch

    rng = random.Random(4)
    some = ["a", "b_", "if", "func", "é", "ñ", "1", "2.5", '"s"', "'", "`q`", "// c", "/* c */", "/*", "+", "$x", "_", "nil", "你"]
    rows = [None, [], *([rng.choice(some) for _ in range(rng.randint(0, 30))] for _ in range(200))]
    languages = [rng.choice(["Python", "Go", "Java", None, "Cobol"]) for _ in rows]
    got = normalised_batch(pa.array(rows, pa.list_(pa.string())), pa.array(languages, pa.string())).to_pylist()
    assert got == [normalised(r or [], x) for r, x in zip(rows, languages, strict=True)]
    part = pa.array(rows, pa.list_(pa.string())).slice(50, 20)
    assert normalised_batch(part, pa.array(languages, pa.string()).slice(50, 20)).to_pylist() == got[50:70]


def test_globs_and_lists():
    import re

    assert re.match(glob_regex("*/a?[0-9].py"), "/x/y/ab1.py") and not re.match(glob_regex("*.py"), "a.pyc")
    assert target_list(["# c", "", " /a ", "b"]) == ["/a", "b"]
    with pytest.raises(ValueError):
        target_list(["#"])
    assert parse_types("all") == {1, 2, 3} and parse_types("1,x,3") == {1, 3}


def test_extract_python():
    source = b"import os\n\n@dec\ndef f(a):\n    x = 1\n    def g():\n        return 2\n    return g\n\n\nclass C:\n    async def m(self):\n        pass\n"
    got = extract(source, "Python", 1)
    assert [(k, a, b) for k, a, b, _ in got] == [("function", 4, 8), ("function", 6, 7), ("function", 12, 13), ("class", 11, 13), ("file", 1, 14)]
    assert extract(source, "Python", 1, True)[-1][0] == "class"
    assert extract(source, "Python", 10) == [("file", 1, 14, source.decode())]
    assert [k for k, *_ in extract(b"def f(:\n    x\n\n    y\nz = 1\n", "Python", 1)] == ["function", "file"]
    assert extract(b"x", "Cobol") == []


def test_extract_braces():
    js = b"function a(x) { return function () { return '}' } }\nconst b = async (y) => { return y };\nconst c = z => z + 1;\nfunction* g() { }\nclass K { m() { } }\n"
    texts = [(k, t) for k, _, _, t in extract(js, "JavaScript", 1)]
    assert ("function", "function a(x) { return function () { return '}' } }") in texts
    assert ("function", "function () { return '}' }") in texts
    assert ("function", "async (y) => { return y }") in texts and ("function", "z => z + 1") in texts
    assert ("class", "class K { m() { } }") in texts and len(texts) == 6
    java = b"package p;\npublic class A {\n  public A(int x) { if (x > 0) { y(); } }\n  @Override\n  String s() throws E {\n    return new B() { };\n  }\n  abstract void n();\n}\n"
    got = [(k, a, b) for k, a, b, _ in extract(java, "Java", 1)]
    assert got == [("function", 3, 3), ("function", 4, 7), ("class", 2, 9), ("file", 1, 10)]
    go = b"package p\ntype T struct {\n\tx int\n}\nfunc (t T) M(a int) int {\n\treturn a\n}\n"
    assert [(k, a, b) for k, a, b, _ in extract(go, "Go", 1)] == [("function", 5, 7), ("class", 2, 4), ("file", 1, 8)]
    gosu = b"class A {\n  construct(x : int) {\n  }\n  function f(y : String) : int {\n    return 1\n  }\n}\n"
    assert [(k, a, b) for k, a, b, _ in extract(gosu, "Gosu", 1)] == [("function", 2, 3), ("function", 4, 6), ("class", 1, 7), ("file", 1, 8)]


def test_command_line(spark, tmp_path, capsys):
    body = "\n".join(f"    x{k} = {k}" for k in range(12))
    tree(tmp_path / "src", {"a.py": f"def foo():\n{body}\n", "b.py": f"def foo():\n{body}\n", "sub/c.py": f"def bar():\n{body.replace('x', 'y')}\n"})
    (tmp_path / "basis.txt").write_text("a.py\n")
    run = lambda *a: main([str(tmp_path / "src"), "--db-dir", str(tmp_path / "db"), "--conf-dir", str(tmp_path / "conf"), "--output-dir", str(tmp_path / "out"), *a], spark)
    assert run("--code-blocks-only") == 0
    data = json.loads((tmp_path / "out" / "twinleaf-output.json").read_text())
    assert data["summary"] == {"files_scanned": 3, "fragments_extracted": 3, "type1_groups": 1, "type2_groups": 0, "type3_groups": 0}
    assert [m["file"].rsplit("/", 1)[1] for m in data["clone_groups"][0]["members"]] == ["a.py", "b.py"]
    assert "similarity_score" not in data["clone_groups"][0] and "is_basis" not in data["clone_groups"][0]["members"][0] and "basis_paths" not in data
    page = (tmp_path / "out" / "twinleaf-output.html").read_text()
    assert "def foo" in page and "No near duplicates found." in page
    assert run("--code-blocks-only", "--basis", str(tmp_path / "basis.txt"), "--format", "json") == 0
    data = json.loads((tmp_path / "out" / "twinleaf-output.json").read_text())
    assert data["basis_paths"] == ["a.py"] and data["summary"]["basis_type1_groups"] == 1
    assert data["clone_groups"][0]["basis_internal"] is False and data["clone_groups"][0]["members"][0]["is_basis"] is True
    assert "(basis 1)" in capsys.readouterr().out
    assert main([str(tmp_path / "none"), "--db-dir", str(tmp_path / "db"), "--conf-dir", str(tmp_path / "conf")], spark) == 0
    assert main(["--target-list", str(tmp_path / "none")], spark) == 2
    from twinleaf.plans.store import SessionStore

    with SessionStore(spark, str(tmp_path / "db")) as store:
        assert store.sessions() == []
    (tmp_path / "conf" / ".ignore").write_text("sub/\n")
    assert run("--code-blocks-only", "--format", "json", "--types", "2") == 0
    assert json.loads((tmp_path / "out" / "twinleaf-output.json").read_text())["summary"]["files_scanned"] == 2


def test_store(spark, tmp_path):
    from twinleaf.plans.detect import detect
    from twinleaf.plans.store import SessionStore

    store = SessionStore(spark, str(tmp_path / "db"))
    with pytest.raises(RuntimeError):
        store.sessions()
    rows = spark.createDataFrame([(1, "f1", "/a", "Python", "file", 1, 2, "x = 1"), (2, "f2", "/b", "Python", "file", 1, 2, "x = 1")], "ord long, fragment_id string, file_path string, language string, fragment_type string, start_line int, end_line int, source_text string")
    with store:
        s = store.create(["/x"], {"types": "all"})
        store.save_fragments(s, rows)
        store.save_groups(s, detect(store.fragments(s)))
        assert store.count(s) == 2 and store.fragment(s, "f1").file_path == "/a" and store.fragment(s, "no") is None
        assert store.fragments_by_id(s, ["f2"]).count() == 1 and store.fragments_by_id(s, []).count() == 0
        group = store.detection(s).groups.first()
        assert group.n_members == 2 and [r.ord for r in store.group_fragments(s, group.group_id).collect()] == [1, 2]
        assert [r.member_fragment_ids for r in store.clone_groups(s).collect()] == [["f1", "f2"]] and store.fragments_of_groups(s).count() == 2
    with pytest.raises(KeyError), store:
        store.save_fragments(s, rows)
        t = store.create(["/y"], {})
        store.delete(s)
        assert store.sessions() == [t] and store.count(s) == 4
        raise KeyError
    with store:
        assert store.sessions() == [s] and store.count(s) == 2
        store.delete(s)
    with store:
        assert store.sessions() == []


def test_streaming(spark, tmp_path):
    schema = "ord long, source_text string"
    spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], schema).write.parquet(str(tmp_path / "in"))
    q = growing_groups(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("groups").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.members, r.first_ord) for r in spark.table("groups").where("members >= 2").collect()] == [(2, 1)]
