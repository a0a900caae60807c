"""Mixing sources to target shares of all tokens.

Each source has a budget of tokens. As many complete epochs as fit are taken first; the rest is drawn by Efraimidis-Spirakis sampling: each
document gets an exponential key scaled by its quality weight, and documents are taken in the order of their keys until the budget is used up.

The order within a source is found without sorting a source in one task: keys fall into fine ranges, the ranges' token sums are added up, and
only the range in which the budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small
from .tokens import VOCABULARY, token_counts

RANGES = 4096
SEED = 20


def quality(documents: DataFrame) -> Column:
    """The mean confidence of a page's lines, between 0.05 and 1; 0.5 where none is known."""
    conf = F.filter(F.transform("line_boxes", lambda x: x["conf"]), lambda x: x.isNotNull())
    mean = F.aggregate(conf, F.lit(0.0), lambda a, x: a + x) / F.size(conf)
    return F.coalesce(F.when(F.size(conf) > 0, F.greatest(F.lit(0.05), F.least(F.lit(1.0), mean))), F.lit(0.5)) if "line_boxes" in documents.columns else F.lit(0.5)


def _weighed(documents: DataFrame, targets: DataFrame, vocabulary: str, seed: int) -> DataFrame:
    rows = documents.withColumn("quality", quality(documents).cast("double"))
    counts = token_counts(rows, vocabulary, "source", "quality").where(F.col("tokens") > 0)
    goal = _goals(targets)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    key = -F.log(u) / F.col("quality")
    # e / (1 + e) rises with the key e and lies between 0 and 1
    return counts.join(small(goal), "source").withColumn("key", key).withColumn("range", F.floor(F.col("key") / (F.col("key") + 1) * RANGES).cast("int"))


def _goals(targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, once per source; rows without a share above 0 or a repeat are left out."""
    return (targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1))
            .groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("g")).select("source", F.col("g.target_share").alias("target_share"), F.col("g.max_repeats").alias("max_repeats")))


def _drawn(documents: DataFrame, targets: DataFrame, total_tokens: int | None, vocabulary: str, seed: int) -> tuple[DataFrame, float]:
    rows = _weighed(documents, targets, vocabulary, seed).persist()
    ranges = rows.groupBy("source", "range").agg(F.sum("tokens").alias("tokens")).persist()
    sums = ranges.groupBy("source").agg(F.sum("tokens").alias("all_tokens")).join(_goals(targets), "source")
    # the most tokens at which every source with any can still reach its share
    most = sums.agg(F.min(F.col("max_repeats") * F.col("all_tokens") / F.col("target_share"))).first()[0]
    total = float(total_tokens) if total_tokens is not None else float(most or 0.0)
    budget = F.least(F.col("target_share") * total, (F.col("max_repeats") * F.col("all_tokens")).cast("double"))
    plan = (sums.withColumn("budget", budget).withColumn("epochs", F.floor(F.col("budget") / F.col("all_tokens") + 1e-12).cast("int"))
            .withColumn("rest", F.when(F.col("epochs") >= F.col("max_repeats"), F.lit(0.0)).otherwise(F.col("budget") - F.col("epochs") * F.col("all_tokens")))
            .select("source", "all_tokens", "budget", "epochs", "rest"))
    w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("source", "range", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("before"), F.col("tokens").alias("in_range")).join(plan, "source")
    placed = rows.select("doc_id", "source", "tokens", "quality", "key", "range").join(before, ["source", "range"])
    whole = placed.where(F.col("before") + F.col("in_range") <= F.col("rest")).withColumn("extra", F.lit(1))
    none = placed.where(F.col("before") >= F.col("rest")).withColumn("extra", F.lit(0))
    v = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a document in which the budget ends is taken if that comes closer to it
    split = (placed.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_range") > F.col("rest")))
             .withColumn("extra", (F.col("before") + F.sum("tokens").over(v) - F.col("tokens") / 2 <= F.col("rest")).cast("int")))
    columns = ["doc_id", "source", "tokens", "quality", (F.col("epochs") + F.col("extra")).cast("int").alias("times")]
    return whole.select(*columns).unionByName(none.select(*columns)).unionByName(split.select(*columns)), total


def draw(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, quality, times: how often each document is taken, those taken at least once.

    Without total_tokens the draw is the largest in which every source reaches its share. With it, a source too small for its share is repeated
    max_repeats times and falls short. Documents without tokens, without a source or of a source without a target are never taken; repeated rows
    count once; empty tables give no rows.
    """
    rows, _ = _drawn(documents, targets, total_tokens, vocabulary, seed)
    return rows.where("times > 0")


def shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """source, target_share, max_repeats, documents, draws, most_times, tokens, share: what each source with a target reached."""
    taken = draw(documents, targets, total_tokens, vocabulary, seed).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("times").alias("draws"), F.max("times").alias("most_times"), F.sum(F.col("tokens") * F.col("times")).alias("tokens"))
    every = Window.partitionBy()  # one row per source of the targets
    return (_goals(targets).join(taken, "source", "left").na.fill(0, ["documents", "draws", "most_times", "tokens"])
            .withColumn("share", F.round(F.col("tokens") / F.greatest(F.sum("tokens").over(every), F.lit(1)), 6)))
