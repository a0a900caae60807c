import random
import re

import pytest
from pyspark.sql import functions as F

from loamdex.functions import metrics
from loamdex.functions import text as T


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


IDENTIFIERS = [("List<File> fileList", "List", True, True), ("fileList", "List", True, False), ("ArrayList<File>", "List", True, False), ("Listing", "List", True, False), ("list", "List", True, False),
               ("list", "List", False, True), ("前List後", "List", True, False), ("変数 = 変数 + 1", "変数", True, True), ("Äpfel", "äpfel", False, True), ("$List = 1", "List", True, False), ("object.perform!", "perform!", True, True),
               (r"a \E b", r"\E", True, True), ("a.b", "a.b", True, True), ("axb", "a.b", True, False)]


@pytest.mark.parametrize("line,query,case,want", IDENTIFIERS)
def test_identifier(spark, line, query, case, want):
    assert values(spark, T.identifier(F.col("line"), query, not case), [(line,)], "line string") == [want]


@pytest.mark.parametrize("text,want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\n", ["a"]), ("a\r", ["a"]), ("a\n\n", ["a", ""]), ("\n", [""]), ("a\r\nb\rc", ["a", "b", "c"])])
def test_split_lines(spark, text, want):
    assert values(spark, T.split_lines(F.col("t")), [(text,)], "t string") == [want]


def test_like_folds_ascii_only_and_has_no_escape(spark):
    rows = [("parseXconfig",), ("PARSE_CONFIG",), ("Ä",), ("a\\b",), ("100%",), (None,)]
    assert values(spark, T.like_nocase(F.col("t"), "parse_config%"), rows, "t string") == [True, True, False, False, False, None]
    assert values(spark, T.like_nocase(F.col("t"), "ä"), rows, "t string")[2] is False
    assert values(spark, T.like_nocase(F.col("t"), "a\\b"), rows, "t string")[3] is True
    assert values(spark, T.like_nocase(F.col("t"), "~^!|`%"), rows, "t string") == [False] * 5 + [None]


def test_like_against_a_regular_expression(spark):
    rng = random.Random(4)
    alphabet = "aAbB_%\\.ä"
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))),) for _ in range(60)]
    for _ in range(12):
        p = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 4)))
        want = [re.match(T.like_regex(T.ascii_lower(p)), T.ascii_lower(t), re.S) is not None and re.fullmatch(T.like_regex(T.ascii_lower(p))[1:-1], T.ascii_lower(t), re.S) is not None for (t,) in rows]
        assert values(spark, T.like_nocase(F.col("t"), p), rows, "t string") == want


def test_language_and_extension(spark):
    rows = [("a/Makefile",), ("x/y.PY",), ("z.unknown",), ("makefile",), ("a.b/c",), ("x.tsx",), (".bashrc",)]
    assert values(spark, T.detect_language(F.col("p")), rows, "p string") == ["make", "python", None, None, None, "typescript", None]
    assert values(spark, T.extension(F.col("p")), rows, "p string") == ["", ".py", ".unknown", "", "", ".tsx", ".bashrc"]


def test_truncation_keeps_whole_characters(spark):
    rows = [("a" * 600,), ("é" * 300,), ("a" + "漢" * 300,), ("x",), ("",)]
    got = values(spark, T.truncate_bytes(F.col("t"), 500), rows, "t string")
    assert [len(g.encode()) for g in got] == [500, 500, 499, 1, 0]
    assert all(t.startswith(g) for (t,), g in zip(rows, got))


def test_trim(spark):
    assert values(spark, T.trim_space(F.col("t")), [("\t\u00a0a b\u0085\u3000",), ("\u200ba",)], "t string") == ["a b", "\u200ba"]


def classify(spark, language, lines):
    r = metrics.with_metrics(spark.createDataFrame([(language, lines)], "language string, lines array<string>")).first()
    return r["line_count"], r["blank_lines"], r["comment_lines"], r["code_lines"]


@pytest.mark.parametrize("language,lines,want", [
    ("go", ["package main", "", "// x", "func main() {", "\t/* a", "b */", "}"], (7, 1, 3, 3)),
    ("javascript", ["const a = 1; /* open", "body", "*/", "// end"], (4, 0, 3, 1)),
    ("lua", ["--[[ a", "b ]]", "-- c", "x = 1"], (4, 0, 3, 1)),
    ("ruby", ["=begin", "", "=end", "# x", "y"], (5, 1, 3, 1)),
    ("css", ["a {}", "/* x */", "/* y", "z */ b {}"], (4, 0, 3, 1)),
    (None, ["# a", "", "b"], (3, 1, 0, 2)), ("python", [], (0, 0, 0, 0)), ("go", ['s := "/*"', "x"], (2, 0, 1, 1)), ("php", ["# a", "// b", "c"], (3, 0, 2, 1))])
def test_classification(spark, language, lines, want):
    assert classify(spark, language, lines) == want


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_blocks_carry_the_comment_state(spark, block):
    text = {1: ("go", ["a", "/* b", "c", "", "d */ /* e", "f", "g */", "// h", "i"]), 2: ("python", ["# a", "", "b"]), 3: ("go", []), 4: ("css", ["x /*", "y", "z", "*/ a {}", "b {}"])}
    files = spark.createDataFrame([(i, g) for i, (g, _) in text.items()], "file_id bigint, language string")
    lines = spark.createDataFrame([(i, n, s) for i, (_, a) in text.items() for n, s in enumerate(a, 1)], "file_id bigint, line int, text string")
    got = {r["file_id"]: tuple(r)[2:] for r in metrics.with_block_metrics(files, lines, block).collect()}
    assert got == {i: classify(spark, g, a) for i, (g, a) in text.items()}


def test_every_indexed_file_has_metrics(spark):
    from loamdex import catalog

    d = "/root/testdata/sf0.001"
    got = {r["file_id"] for r in catalog.queries()["metrics_indexed"](spark, d).collect()}
    newest = {r["id"]: r["index_status"] for r in spark.read.parquet(f"{d}/files.parquet").orderBy("mtime").collect()}
    assert got == {i for i, status in newest.items() if status == "indexed"}
