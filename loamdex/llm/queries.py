"""The queries of the training-data operators over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import credentials, docpairs, handwritten, mixing, packing, residue, spans, syntax
from .common import table
from .tokens import VOCABULARY, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_credentials(table(spark, d, "file_lines"), table(spark, d, "files")).select("file_id", "line")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Each such line with only its secret masked."""
    return credentials.find_credentials(table(spark, d, "file_lines"), table(spark, d, "files")).select("file_id", "line", "masked", "rules")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_written(table(spark, d, "file_lines"), table(spark, d, "files")).select("file_id")


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Which sort each such file is of, and what the forest says."""
    return handwritten.not_written(table(spark, d, "file_lines"), table(spark, d, "files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented(table(spark, d, "file_lines"), table(spark, d, "files"), table(spark, d, "symbols")).select("file_id", "line").distinct()


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Signature, body and description of each documented function."""
    return docpairs.pairs(table(spark, d, "file_lines"), table(spark, d, "files"), table(spark, d, "symbols"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "file_lines"), table(spark, d, "files"))


def p4_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "file_lines"), table(spark, d, "files"))


def p4_share(spark: SparkSession, d: str) -> DataFrame:
    """Of each file, how many characters also stand elsewhere."""
    return spans.shared_share(table(spark, d, "file_lines"), table(spark, d, "files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "file_lines"), table(spark, d, "files")).select("file_id")


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each such file, and what language it is instead."""
    return syntax.invalid_files(table(spark, d, "file_lines"), table(spark, d, "files"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, d, "file_lines"), table(spark, d, "files"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p6_unused(spark: SparkSession, d: str) -> DataFrame:
    return packing.unused_room(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p7_draw(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_pages(table(spark, d, "documents"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The pages that stay."""
    return residue.clean_pages(table(spark, d, "documents")).select("doc_id", "lang", "source", "n_chars")


def p1_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of the masked lines, those that aren't lines of the table, or in which anything but masked parts has changed."""
    rows = table(spark, d, "file_lines")
    found = credentials.find_credentials(rows, table(spark, d, "files"))
    parts = F.split("masked", credentials.MASK.replace("*", r"\*"))
    # what is left of a line stands in it in this order, from its beginning to its end
    pattern = F.concat(F.lit("(?s)^"), F.array_join(F.transform(parts, lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), ".*"), F.lit("$"))
    marker = F.col("masked") == F.col("text")
    there = rows.join(found.select("file_id", "line"), ["file_id", "line"], "left_semi").select("file_id", "line", "text", F.lit(True).alias("there")).distinct()
    return (found.join(there, ["file_id", "line", "text"], "left")
            .agg(F.count_if(~marker & (~F.regexp_like("text", pattern) | (F.size(parts) < 2))).alias("changed"), F.count_if(F.col("there").isNull()).alias("unknown")))


def p3_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of the pairs, those without a function or method there, without a description of four words, or twice."""
    symbols = table(spark, d, "symbols").where("kind in ('function', 'method')").select("file_id", "line", "name").distinct()
    found = docpairs.documented(table(spark, d, "file_lines"), table(spark, d, "files"), table(spark, d, "symbols"))
    short = F.size(F.split(F.trim("description"), r"\s+")) < docpairs.WORDS
    per = found.groupBy("file_id", "line", "name").agg(F.count(F.lit(1)).alias("n"), F.max(short).alias("short"))
    return (per.join(symbols.withColumn("there", F.lit(True)), ["file_id", "line", "name"], "left")
            .agg(F.count_if(F.col("there").isNull()).alias("unknown"), F.count_if("short").alias("short"), F.count_if(F.col("n") > 1).alias("twice")))


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """The number of files that the rates are taken of, and whether a rate fits its counts."""
    rates = syntax.invalid_rates(table(spark, d, "file_lines"), table(spark, d, "files"))
    return rates.select("repository", "language", "files", (F.col("invalid").between(0, F.col("files")) & F.col("foreign").between(0, F.col("invalid")) & (F.abs(F.col("rate") * F.col("files") - F.col("invalid")) < 0.01)).alias("fits"))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each profile, the documents of which exactly the tokens, counted anew, are in its containers, containers over their capacity, and documents cut that fit whole."""
    documents, sizes = table(spark, d, "documents"), table(spark, d, "pack_sizes")
    placed = packing.containers(documents, sizes).persist()
    over = placed.groupBy("profile", "capacity", "container").agg(F.sum("tokens").alias("t")).groupBy("profile", "capacity").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    per = placed.groupBy("profile", "capacity", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(1), F.ceil(F.col("own") / F.col("capacity")))
    of = (per.join(token_counts(documents).withColumnRenamed("tokens", "own"), "doc_id", "left").groupBy("profile", "capacity")
          .agg(F.count_if((F.col("t") == F.col("own")) & (F.col("n") == least)).alias("documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity"))).alias("cut")))
    every = sizes.select("profile", "capacity").distinct().join(of, ["profile", "capacity"], "left").join(over, ["profile", "capacity"], "left")
    return every.select("profile", "capacity", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "overfull", "cut")))


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each source, its documents that can be drawn, the share it has to reach, and documents drawn over the cap or that aren't its own.

    A source whose drawn tokens, counted anew, are further from its share of the largest draw than half of its longest document shows what it reached instead.
    """
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    taken = mixing.draw(documents, targets).groupBy("doc_id", "source").agg(F.sum("times").alias("times")).persist()
    own = documents.where("text <> '' and source is not null").select("doc_id", "source").distinct()
    can = own.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    goals = targets.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("g")).select("source", F.col("g.target_share").alias("target_share"), F.col("g.max_repeats").alias("most"))
    of = taken.join(own.withColumn("own", F.lit(True)), ["doc_id", "source"], "left").join(goals, "source").groupBy("source").agg(F.count_if(F.col("times") > F.col("most")).alias("over"), F.count_if(F.col("own").isNull()).alias("foreign"))
    tokens = token_counts(documents, VOCABULARY, "source").where("tokens > 0").join(taken, ["doc_id", "source"], "left").groupBy("source").agg(
        F.sum("tokens").alias("all"), F.max("tokens").alias("longest"), F.sum(F.col("tokens") * F.coalesce("times", F.lit(0))).alias("drawn"))
    asked = (F.col("target_share") > 0) & (F.col("most") >= 1)
    every = Window.partitionBy()  # one row per source of the targets
    total = F.min(F.when(asked, F.col("most") * F.col("all") / F.col("target_share"))).over(every)
    due = F.coalesce(F.when(asked, F.col("target_share") * total), F.lit(0.0))
    # a token more, as the shares are floating-point numbers
    missed = F.abs(F.col("drawn") - due) > F.col("longest") / 2 + 1
    reached = F.when(missed, F.col("drawn") / F.greatest(total, F.lit(1.0))).otherwise(F.col("target_share"))
    return (goals.join(can, "source", "left").join(of, "source", "left").join(tokens, "source", "left")
            .select("source", reached.alias("target_share"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "over", "foreign"))))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each language, its pages, and whether those that stay and those that are left out are all of them."""
    documents = table(spark, d, "documents")
    found = residue.residue_pages(documents).withColumn("out", F.lit(1))
    return (documents.select("doc_id", "lang", "text").join(found, "doc_id", "left").groupBy("lang")
            .agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("out").isNotNull() & (F.coalesce("text", F.lit("")) == "")).alias("empty_out")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_checked, p3_checked, p5_checked, p6_checked, p7_checked, p8_checked, p1_found, p1_redacted, p2_found, p2_kinds, p3_found, p3_pairs, p4_found, p4_spans, p4_share, p5_found, p5_files, p5_rates, p6_containers, p6_unused, p7_draw, p7_shares, p8_found, p8_clean)}


_CURRENT = """with f as (select id, path, language from (select *, row_number() over (partition by id order by mtime desc, language desc) as rn from (select distinct * from files)) where rn = 1 and index_status = 'indexed')
"""
#: All windows of 200 characters of all texts; exact, and too much for more than small tables.
_WINDOWS = """with f as (select id, path, index_status from (select *, row_number() over (partition by id order by mtime desc, language desc) as rn from (select distinct * from files)) where rn = 1 and index_status = 'indexed'),
t as (select file_id, string_agg(text, chr(10) order by line) as text from (select distinct file_id, line, text from file_lines) l where file_id in (select id from f) group by 1),
v as (select file_id, i, hash(substr(text, i, 200)) as h from (select file_id, text, unnest(range(1, length(text) - 198)) as i from t where length(text) >= 200)),
w as (select distinct file_id, h from v), z as (select distinct file_id, i from v where h in (select h from w group by 1 having count(*) > 1)),
g as (select *, sum(fresh) over (partition by file_id order by i) as g from (select *, case when i - lag(i) over (partition by file_id order by i) <= 200 then 0 else 1 end as fresh from z)),
s as (select file_id, min(i) - 1 as start, max(i) + 200 - min(i) as length from g group by file_id, g)
"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL can say at all; the rest is tested against brute force, round trips and held-out cases in tests/llm."""
    return {
        "p1_checked": "select cast(0 as bigint) as changed, cast(0 as bigint) as unknown",
        "p3_checked": "select cast(0 as bigint) as unknown, cast(0 as bigint) as short, cast(0 as bigint) as twice",
        "p5_checked": _CURRENT + "select split_part(path, '/', 1) as repository, language, count(*) as files, true as fits from f where language in ('python', 'javascript', 'typescript', 'go', 'java', 'ruby', 'c', 'shell') group by 1, 2",
        "p6_checked": "select profile, capacity, (select count(distinct doc_id) from documents) as documents, cast(0 as bigint) as overfull, cast(0 as bigint) as cut from (select distinct * from pack_sizes)",
        "p7_checked": "select m.source, target_share, (select count(distinct doc_id) from documents d where d.source = m.source and text <> '') as documents, cast(0 as bigint) as over, cast(0 as bigint) as foreign from (select distinct * from mix_targets) m",
        "p8_checked": "select lang, count(*) as pages, cast(0 as bigint) as empty_out from documents group by 1",
        "p4_found": _WINDOWS + "select distinct a.file_id as file_id_a, b.file_id as file_id_b from w a join w b on a.h = b.h and a.file_id < b.file_id",
        "p4_spans": _WINDOWS + "select s.file_id, f.path, cast(s.start as bigint) as start, cast(s.length as bigint) as length from s join f on f.id = s.file_id",
        "p4_share": _WINDOWS + "select f.id as file_id, f.path, cast(coalesce(length(t.text), 0) as bigint) as n_chars, cast(coalesce((select sum(s.length) from s where s.file_id = f.id), 0) as bigint) as shared_chars from f left join t on t.file_id = f.id",
    }
