"""Full-text search: an inverted index of folded tokens, and queries that are joins of its postings."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import SCHEMAS

SYMBOL_FIELDS = [f.name for f in SCHEMAS["symbols_fts"].fields]
FILE_FIELDS = ["path", "language"]  # besides the content, which is the file's lines


def fold_text(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


#: Accented Latin letters that fold to a plain one, made from Unicode's decompositions.
_PAIRS = [(chr(c), fold_text(chr(c))) for c in range(0xC0, 0x250) if len(fold_text(chr(c))) == 1 and fold_text(chr(c)) != chr(c).lower()]


def tokens(c: Column) -> Column:
    """Folded runs of letters and digits of a text, in order: without case and accents; _ parts words."""
    folded = F.regexp_replace(F.translate(F.lower(c), "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)), r"\p{Mn}", "")
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != "")


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, position, token of each token of the columns."""
    each = None
    for c in columns:
        one = docs.select(F.col(key), F.lit(c).alias("column"), F.posexplode(tokens(F.coalesce(F.col(c), F.lit("")))).alias("position", "token"))
        each = one if each is None else each.unionByName(one)
    return each


def symbol_postings(symbols: DataFrame) -> DataFrame:
    """The postings of symbols by their ids."""
    return postings(symbols, "id", SYMBOL_FIELDS).withColumnRenamed("id", "key")


def file_postings(files: DataFrame, lines: DataFrame, block_lines: int = 1000) -> DataFrame:
    """The postings of indexed files by their ids: path, language, and content, in which positions go on from line to line. A long file's lines are counted
    in blocks, and only the blocks' sums are added up in one place."""
    kept = files.where("index_status = 'indexed'").select("id", *FILE_FIELDS)
    own = lines.join(kept.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("file_id", "line", F.floor(F.col("line") / block_lines).alias("block"), tokens(F.col("text")).alias("ts"))
    sums = own.groupBy("file_id", "block").agg(F.sum(F.size("ts")).alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.select("file_id", "block", earlier(Window.partitionBy("file_id").orderBy("block")).alias("before"))
    within = own.withColumn("n", F.size("ts")).withColumn("within", earlier(Window.partitionBy("file_id", "block").orderBy("line"))).join(before, ["file_id", "block"])
    content = within.select(F.col("file_id").alias("key"), F.lit("content").alias("column"), (F.col("before") + F.col("within")).alias("start"), F.posexplode("ts").alias("p", "token"))
    return postings(kept, "id", FILE_FIELDS).withColumnRenamed("id", "key").withColumn("position", F.col("position").cast("bigint")).unionByName(content.select("key", "column", (F.col("start") + F.col("p")).alias("position"), "token"))


_QUERY = re.compile(r'\s*(?:(NOT|AND|OR)\b|([\w]+)\s*:\s*|"([^"]*)"|([^\s"():]+)|([()]))', re.U)


def match(index: DataFrame, key: str, query: str) -> DataFrame:
    """key of the documents that match a query of terms, prefixes (tok*), phrases, column filters (column:term), AND, OR, NOT and brackets. Terms beside each
    other are joined by AND; NOT takes documents away, as in ``a NOT b``."""
    words = [m for m in _QUERY.finditer(query.strip()) if m[0].strip()]
    at = 0

    def peek() -> re.Match | None:
        return words[at] if at < len(words) else None

    def either() -> DataFrame:
        nonlocal at
        left = both()
        while (m := peek()) and m[1] == "OR":
            at += 1
            left = left.unionByName(both()).distinct()
        return left

    def both() -> DataFrame:
        nonlocal at
        left = without()
        while (m := peek()) and m[1] != "OR" and m[5] != ")":
            if m[1] == "AND":
                at += 1
            left = left.join(without(), key, "left_semi")
        return left

    def without() -> DataFrame:
        nonlocal at
        left = term()
        while (m := peek()) and m[1] == "NOT":
            at += 1
            left = left.join(term(), key, "left_anti")
        return left

    def term() -> DataFrame:
        nonlocal at
        m = peek()
        if m is None or m[1] or m[5] == ")":
            raise ValueError(f"full-text query ends or breaks off: {query!r}")
        at += 1
        if m[5] == "(":
            inner = either()
            if not (c := peek()) or c[5] != ")":
                raise ValueError(f"unclosed bracket in {query!r}")
            at += 1
            return inner
        source = index
        if m[2]:
            source = index.where(F.col("column") == m[2])
            m = peek()
            if m is None or not (m[3] is not None or m[4]):
                raise ValueError(f"column filter without a term in {query!r}")
            at += 1
        if m[3] is not None:
            return phrase(source, key, m[3])
        prefix = m[4].endswith("*")
        parts = [p for p in re.split(r"[\W_]+", fold_text(m[4])) if p]
        if len(parts) > 1:
            return phrase(source, key, m[4])
        if not parts:
            raise ValueError(f"term without letters in {query!r}")
        return source.where(F.startswith(F.col("token"), F.lit(parts[0])) if prefix else F.col("token") == parts[0]).select(key).distinct()

    if not words:
        raise ValueError("empty full-text query")
    out = either()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()[0].strip()!r} in {query!r}")
    return out


def phrase(index: DataFrame, key: str, text: str) -> DataFrame:
    """Documents with the words of a text one after another in one column."""
    words = [p for p in re.split(r"[\W_]+", fold_text(text)) if p]
    if not words:
        return index.limit(0).select(key)
    # each word's postings, moved back to where the phrase would start, have to meet
    at = [index.where(F.col("token") == w).select(key, "column", (F.col("position") - i).alias("start")) for i, w in enumerate(words)]
    out = at[0]
    for other in at[1:]:
        out = out.join(other, [key, "column", "start"], "left_semi")
    return out.select(key).distinct()
