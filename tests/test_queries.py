import pytest
from pyspark.sql import functions as F

from loamdex.operators import fulltext, incremental, navigate
from loamdex.plans import sqlgate
from loamdex.sources.tables import Index, newest_files


@pytest.fixture(scope="module")
def index(spark):
    files = spark.createDataFrame([(1, "a/main.go", "go", ".go", 5), (2, "xmain.go", "go", ".go", 6), (3, "b.py", "python", ".py", 7), (4, "skip", None, "", 8)], "id bigint, path string, language string, extension string, size bigint")
    files = files.select("*", F.lit(1).cast("bigint").alias("mtime"), F.concat(F.lit("h"), "id").alias("content_hash"), F.when(F.col("id") == 4, "skipped").otherwise("indexed").alias("index_status"),
                         F.lit("UTF-8").alias("source_encoding"), F.lit("utf8").alias("encoding_source"), F.lit(0).alias("transcoded"), F.lit(None).cast("string").alias("skip_reason"))
    symbols = spark.createDataFrame([(1, 1, "a/main.go", "go", "type", "Outer", 1, 9, 1, "type Outer", ""), (2, 1, "a/main.go", "go", "function", "run", 2, 6, 3, "func run()", ""), (3, 3, "b.py", "python", "function", "Run", 1, 1, 5, "def Run():", ""),
                                     (4, 3, "b.py", "python", "macro", "parseXconfig", 2, 8, 5, "café au lait", "")],
                                    "id bigint, file_id bigint, path string, language string, kind string, name string, line int, end_line int, column int, signature string, context string")
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["x", "run()", "run() // here", "rerun()", "RUN", "}"], 1)] + [(3, 1, "def Run():"), (3, 2, "run"), (2, 1, "y")], "file_id bigint, line int, text string")
    metrics = spark.createDataFrame([(1, "a/main.go", "go", 6, 1, 1, 4, 2), (2, "xmain.go", "go", 1, 0, 0, 1, 0), (3, "b.py", None, 2, 0, 0, 2, 2)],
                                    "file_id bigint, path string, language string, line_count int, blank_lines int, comment_lines int, code_lines int, symbol_count int")
    runs = spark.createDataFrame([(i, "update", "succeeded", "/r", "/d", f"2022-01-01T00:0{i}:00Z", "", None) for i in range(1, 6)], "id bigint, operation string, status string, root string, db string, started_at string, finished_at string, error_message string")
    return Index(files, lines, symbols, metrics, runs, spark.createDataFrame([("root", "/r"), ("fts5", "1"), ("odd", "x")], "key string, value string"),
                 spark.createDataFrame([("fts", "ready", ""), ("zzz", "ready", ""), ("files", "ready", "")], "name string, status string, updated_at string"))


def names(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_defs(index):
    assert names(navigate.defs(index, "RUN"), "name") == ["run", "Run"]
    assert names(navigate.defs(index, "parse_config"), "name") == ["parseXconfig"]
    assert names(navigate.defs(index, "au lait"), "name") == ["parseXconfig"]
    assert navigate.defs(index, "run", limit=0).count() == 0 and navigate.defs(index, "run", limit=-1).count() == 2
    assert names(navigate.defs_list(index, language="go"), "name") == ["Outer", "run"]


def test_targets(index):
    assert names(navigate.outline(index, "/main.go"), "name") == ["Outer", "run"]
    assert names(navigate.show(index, "main.go", 1), "text") == ["y"]  # the shorter path counts, even within a name
    assert names(navigate.outline(index, "ain.go"), "name") == []


def test_refs(index):
    got = navigate.refs(index, "run").collect()
    assert [(r["path"], r["line"], [s["name"] for s in r["scopes"]]) for r in got] == [("a/main.go", 3, ["Outer", "run"]), ("b.py", 2, [])]
    assert names(navigate.refs_candidates(index, "run", ignore_case=True), "path", "line") == [("a/main.go", 3), ("a/main.go", 5), ("b.py", 2)]
    assert names(navigate.refs_candidates(index, "run", limit=1), "line") == [3]
    assert names(navigate.refs_definitions(index, "run", kinds=["class"]), "line") == []
    with pytest.raises(ValueError):
        navigate.refs_candidates(index, "", limit=1)


def test_listings(index):
    assert names(navigate.files(index, "MAIN"), "path") == ["a/main.go", "xmain.go"]
    assert names(navigate.files(index, status="all"), "path") == ["a/main.go", "b.py", "skip", "xmain.go"]
    assert names(navigate.metrics_summary(index), "language", "lines") == [("go", 7), ("(unknown)", 2)]
    assert navigate.metrics_summary(index, language="(unknown)").count() == 0
    assert names(navigate.stats(index), "key")[:3] == ["root", "files", "skipped_files"] and names(navigate.stats(index), "key")[-1] == "fts5"
    assert names(navigate.components(index), "name") == ["files", "fts", "zzz"]
    assert names(navigate.logs(index, 2), "id") == [5, 4]


def test_fulltext(index):
    posts = fulltext.postings(index.symbols, "id", ["name", "signature", "path"]).persist()
    find = lambda q: sorted(r["id"] for r in fulltext.match(posts, "id", q).collect())
    assert find("RUN") == [2, 3] and find("cafe") == [4] and find("main NOT run") == [1] and find("pars*") == [4]
    assert find('"func run"') == [2] and find('"run func"') == [] and find("name:run") == [2, 3] and find("signature:outer") == [1]
    assert find("(outer OR cafe) AND type") == [1] and find("run lait OR outer") == [1] and find("a/main") == [1, 2]
    for bad in ("", "NOT", "(a", "a )", "name:"):
        with pytest.raises(ValueError):
            find(bad)


def test_reconciliation(spark):
    old = spark.createDataFrame([("same", "1", "indexed"), ("edit", "1", "indexed"), ("gone", "1", "indexed"), ("bad", "1", "indexed"), ("well", "1", "skipped"), ("worse", "1", "skipped"), ("lost", "1", "skipped")], "path string, content_hash string, index_status string")
    new = spark.createDataFrame([("same", "1", "indexed"), ("edit", "2", "indexed"), ("new", "1", "indexed"), ("bad", "2", "skipped"), ("well", "2", "indexed"), ("worse", "2", "skipped"), ("odd", "1", "skipped")], "path string, content_hash string, index_status string")
    got = {r["path"]: r["outcome"] for r in incremental.reconcile(old, new).collect()}
    assert got == {"same": "unchanged", "edit": "updated", "gone": "deleted", "bad": "deleted", "well": "added", "worse": "none", "lost": "none", "new": "added", "odd": "none"}
    c = incremental.update_counts(incremental.reconcile(old, new)).first()
    assert (c["added"], c["updated"], c["deleted"], c["skipped"]) == (2, 1, 2, 3)
    only = incremental.reconcile(old, new, spark.createDataFrame([("edit",)], "path string")).collect()
    assert [r["path"] for r in only] == ["edit"]
    ids = [r["id"] for r in incremental.with_ids(old.select("path"), ["path"], start=10).orderBy("path").collect()]
    assert ids == list(range(11, 18))


def test_newest_files(spark, index):
    twice = index.files.unionByName(index.files.withColumn("mtime", F.lit(0).cast("bigint")).withColumn("size", F.lit(99).cast("bigint"))).unionByName(index.files)
    assert sorted(names(newest_files(twice), "size")) == [5, 6, 7, 8]


@pytest.mark.parametrize("sql", ["delete from files", "select 1; select 2", "select '%update%'", "select replace(path, 'a', 'b') from files", "explain select 1", "pragma journal_mode", "select rowid from files", "select * from a where b match 'c'"])
def test_refused(spark, sql):
    with pytest.raises(sqlgate.Refused):
        sqlgate.run(spark, sql)


def test_dialect(spark, index):
    index.views()
    one = lambda q: sqlgate.run(spark, q).collect()
    assert one("select path from files where path like 'XMAIN%' collate nocase limit -1;")[0][0] == "xmain.go"
    assert one('select "path" from files where path = \'B.PY\' collate nocase')[0][0] == "b.py"
    assert one("select count(*) from files where path glob '*.go'")[0][0] == 2
    assert one("select size / 2, size / 2.0, (size + 1) / 2 / 3 from files where path = 'b.py'")[0][0] == one("select size from files where path = 'b.py'")[0][0] // 2
    assert one("select count(*) from files where path like '%' || 'GO'")[0][0] == 2 == one("select count(*) from files where (path || '') not like 'b%' and path not glob '*.p' || 'y' and path glob '*go'")[0][0]
    assert one("select 7 / 2 union select 7 / 2.0 - 0.5 union all select 1 except select 2")[0][0] is not None
    assert one("select count(*) from files where path like 'b_py' escape '~'")[0][0] == 1 == one("select count(*) from files where path in (select path from files where path like 'B%')")[0][0]
    assert one("select cast('3.5x' as real), cast(null as integer), 'it''s', 'a\\b'")[0][:] == (3.5, None, "it's", "a\\b")
    assert one("select group_concat(line, '-'), group_concat(distinct file_id) from lines where file_id = 3")[0][:] == ("1-2", "3")
    assert one("select 7/2")[0][0] == 3 and one("select cast('12x' as integer), cast('abc' as integer)")[0][:] == (12, 0)
    assert one("select group_concat(line) from lines where file_id = 3")[0][0] == "1,2"
    assert [r["name"] for r in one("pragma table_info(lines)")] == ["file_id", "line", "text"]
    assert one("with recursive n(i) as (select 1 union all select i + 1 from n where i < 3) select max(i) from n")[0][0] == 3
    assert one("select updated_at from components where name = 'fts'")[0][0] == ""
    assert one("select 9007199254740993 as a, 1.5D as b, null as c, 'x\ty' as d")[0]["a"] == 9007199254740993


def test_streams(spark, tmp_path):
    from loamdex.model import SCHEMAS
    from loamdex.streaming.feeds import run_rates

    src = tmp_path / "runs"
    spark.createDataFrame([(1, "u", "succeeded", "/r", "/d", "2022-01-01T00:10:00Z", "", None), (2, "u", "failed", "/r", "/d", "2022-01-01T00:50:00Z", "", "x"), (3, "u", "failed", "/r", "/d", "2022-01-01T00:55:00Z", "", "x")],
                          SCHEMAS["build_runs"]).write.parquet(str(src))
    q = run_rates(spark.readStream.schema(SCHEMAS["build_runs"]).parquet(str(src))).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["status"], r["runs"]) for r in spark.table("rates").collect()) == [("failed", 2), ("succeeded", 1)]
