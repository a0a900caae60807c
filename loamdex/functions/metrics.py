"""Classification of lines into blank, comment and code: a fold over a file's lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trim_space

# How line comments start, and what opens and closes block comments.
LINE_COMMENTS = {
    ";": ["clojure", "elisp", "scheme"], "--": ["haskell", "lua"],
    "//": ["c", "cpp", "csharp", "go", "java", "javascript", "kotlin", "php", "rust", "scala", "swift", "typescript"],
    "#": ["dockerfile", "elixir", "make", "php", "python", "ruby", "shell"],
}
BLOCK_COMMENTS = {
    ("/*", "*/"): ["c", "cpp", "csharp", "css", "go", "java", "javascript", "kotlin", "php", "rust", "scala", "swift", "typescript"],
    ("{-", "-}"): ["haskell"], ("<!--", "-->"): ["html", "vue"], ("--[[", "]]"): ["lua"], ("=begin", "=end"): ["ruby"],
}


def _starts_line_comment(language: Column, text: Column) -> Column:
    out = F.lit(False)
    for prefix, languages in LINE_COMMENTS.items():
        out = out | (language.isin(*languages) & F.startswith(text, F.lit(prefix)))
    return F.coalesce(out, F.lit(False))


def _delimiter(language: Column, which: int) -> Column:
    out = None
    for pair, languages in BLOCK_COMMENTS.items():
        out = F.when(language.isin(*languages), pair[which]) if out is None else out.when(language.isin(*languages), pair[which])
    return out.otherwise(F.lit(""))


def classify(lines: Column, language: Column, inside: bool = False) -> Column:
    """STRUCT<inside, blank, comment, code> after all lines; inside tells whether the first stands in a block comment.

    Blank lines are blank within a block comment as well. A line in one is a comment, and the one with its end closes it. A line that starts with the
    opener is a comment and opens a block unless it closes on the same line. Any other line is code; it opens a block if its first opener isn't closed on it.
    """
    opener, closer = _delimiter(language, 0), _delimiter(language, 1)

    def add(state: Column, inside: Column, blank: Column, comment: Column) -> Column:
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct(inside.alias("inside"), (state["blank"] + one(blank)).alias("blank"), (state["comment"] + one(~blank & comment)).alias("comment"), (state["code"] + one(~blank & ~comment)).alias("code"))

    def step(state: Column, line: Column) -> Column:
        t = trim_space(line)
        blank = t == ""
        has = F.coalesce(opener, F.lit("")) != ""
        at = F.when(has, F.instr(t, opener)).otherwise(0)
        rest = F.substr(t, at + F.length(opener))
        unclosed = (at > 0) & ~F.contains(rest, closer)
        opens = has & (at == 1)
        comment = state["inside"] | opens | _starts_line_comment(language, t)
        inside = (F.when(blank, state["inside"]).when(state["inside"], ~F.contains(t, closer)).when(opens, unclosed)
                  .when(_starts_line_comment(language, t), F.lit(False)).otherwise(unclosed))
        return add(state, F.coalesce(inside, F.lit(False)), blank, comment)

    zero = F.struct(F.lit(inside).alias("inside"), F.lit(0).alias("blank"), F.lit(0).alias("comment"), F.lit(0).alias("code"))
    return F.aggregate(lines, zero, step)


def with_metrics(files: DataFrame) -> DataFrame:
    """Adds line_count, blank_lines, comment_lines, code_lines to rows with language and lines."""
    m = classify(F.col("lines"), F.coalesce(F.col("language"), F.lit("")))
    return (files.withColumn("m", m).withColumn("line_count", F.size("lines")).withColumn("blank_lines", F.col("m.blank")).withColumn("comment_lines", F.col("m.comment"))
            .withColumn("code_lines", F.col("m.code")).drop("m"))


def with_block_metrics(files: DataFrame, lines: DataFrame, block_lines: int = 2000) -> DataFrame:
    """Adds line_count, blank_lines, comment_lines, code_lines to files (file_id, language, ...) from lines (file_id, line, text).

    A file is folded in blocks of lines, each for both states that it can start in; the blocks' results are put together in order, so that no row holds a
    whole file. A file without lines has zeros.
    """
    language = F.coalesce(F.col("language"), F.lit(""))
    blocks = (lines.groupBy("file_id", F.floor((F.col("line") - 1) / block_lines).alias("block")).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("a"))
              .withColumn("first", F.col("block") <= 0).join(files.select("file_id", "language"), "file_id").withColumn("lines", F.transform("a", lambda r: r["text"])))
    outside = classify(F.col("lines"), language)
    # the first block starts outside of any comment
    sides = blocks.select("file_id", F.struct("block", F.size("lines").cast("bigint").alias("n"), outside.alias("o"), F.when(~F.col("first"), classify(F.col("lines"), language, True)).alias("i")).alias("b"))

    def add(state: Column, b: Column) -> Column:
        m = F.when(state["inside"], F.coalesce(b["i"], b["o"])).otherwise(b["o"])
        return F.struct(m["inside"].alias("inside"), (state["n"] + b["n"]).alias("n"), *((state[c] + m[c]).alias(c) for c in ("blank", "comment", "code")))

    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("n"), *(F.lit(0).alias(c) for c in ("blank", "comment", "code")))
    of = sides.groupBy("file_id").agg(F.array_sort(F.collect_list("b")).alias("bs")).select("file_id", F.aggregate("bs", zero, add).alias("m"))
    count = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit(0)).cast("int")
    return (files.join(of, "file_id", "left").withColumn("line_count", count("n")).withColumn("blank_lines", count("blank")).withColumn("comment_lines", count("comment"))
            .withColumn("code_lines", count("code")).drop("m"))
