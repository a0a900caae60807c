"""Filling containers of fixed capacity with items of varying length.

Only how many items of each length there are matters for what goes together, and a length is at most the capacity. So the plan is made from a
histogram that never has more rows than the capacity, however many items there are: patterns of lengths with how often each is used. Exact
complements come first: single lengths, pairs and triples are indexed by their sums, and what exactly fills a gap is consumed as often as the counts
allow. What is left is packed by best fit. Every pattern but the last few uses up some length, so the plan is short as well.

The items are then numbered within their length, in two steps over salted groups, and take the places of the plan in that order.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import VOCABULARY, token_counts

PART = 1_000_000  # items of one length that are numbered in one task


def _pair(avail: np.ndarray, total: int) -> tuple[int, int] | None:
    """Lengths a >= b with a + b == total that are there, the most uneven first."""
    if total < 2:
        return None
    top = min(total - 1, len(avail) - 1)
    low = max(1, total - top)
    half = total // 2
    b = np.arange(low, half + 1)
    ok = (avail[b] > 0) & (avail[total - b] > 0) & ((b * 2 != total) | (avail[b] > 1))
    hit = np.flatnonzero(ok)
    return (total - int(b[hit[0]]), int(b[hit[0]])) if len(hit) else None


def complement(avail: np.ndarray, gap: int, sums: np.ndarray) -> list[int] | None:
    """One, two or three lengths that are there and exactly fill the gap. sums: which totals pairs had when last indexed; it only ever has too many."""
    if gap < len(avail) and avail[gap] > 0:
        return [gap]
    if (p := _pair(avail, gap)) is not None:
        return list(p)
    a = np.flatnonzero(avail[:gap] > 0)[::-1]
    tried = 0
    for x in a[sums[gap - a]].tolist():
        if tried and tried % 32 == 0:  # the index is out of date
            sums[:] = _pair_sums(avail, len(sums) - 1)
        tried += 1
        if not sums[gap - x]:
            continue
        avail[x] -= 1
        p = _pair(avail, gap - x)
        avail[x] += 1
        if p is not None:
            return [x, *p]
    return None


def _pair_sums(avail: np.ndarray, capacity: int) -> np.ndarray:
    n = 1 << (2 * capacity + 2).bit_length()
    f = np.fft.rfft((avail > 0).astype(float), n)
    return np.fft.irfft(f * f, n)[:capacity + 1] > 0.5


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths, none over the capacity, with how many containers are filled so. Uses every item exactly once."""
    avail = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in counts.items():
        if 0 < s <= capacity:
            avail[s] = n
    out: list[tuple[list[int], int]] = []

    def use(pattern: list[int], most: int | None = None) -> None:
        sizes, times = np.unique(pattern, return_counts=True)
        m = int((avail[sizes] // times).min())
        m = min(m, most) if most else m
        avail[sizes] -= m * times
        out.append((sorted(pattern, reverse=True), m))

    if avail[capacity]:
        use([capacity])
    sums, stale = _pair_sums(avail, capacity), 0
    aside = np.zeros_like(avail)  # lengths for which no exact filling was found
    while len(left := np.flatnonzero(avail)):
        s = int(left[-1])
        avail[s] -= 1
        pattern, gap, found = [s], capacity - s, None
        while found is None:
            found = complement(avail, gap, sums) if gap else []
            if found is None:
                # the gap is wider than three items, or nothing fits: the longest item that fits goes in, if the mean needs more than three
                fitting = np.flatnonzero(avail[:gap + 1])
                if not len(fitting):
                    break
                x = int(fitting[-1])
                avail[x] -= 1
                pattern.append(x)
                gap -= x
        for x in pattern:
            avail[x] += 1
        if found is None:
            aside[s] += avail[s]
            avail[s] = 0
        else:
            use(pattern + found)
        stale += 1
        if stale % 256 == 0:
            sums = _pair_sums(avail, capacity)
    # best fit, longest first; open containers of equal room and content are kept as one with a count
    rooms: dict[int, list[list]] = {}
    order: list[int] = []
    for s in np.flatnonzero(aside)[::-1].tolist():
        n = int(aside[s])
        while n:
            i = bisect.bisect_left(order, s)
            if i < len(order):
                room = order[i]
                content, m = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(i)
                k = min(n, m)
                if m > k:
                    _open(rooms, order, room, content, m - k)
                _open(rooms, order, room - s, content + [s], k)
                n -= k
            else:
                per = capacity // s
                if n >= per:
                    k = n // per
                    _open(rooms, order, capacity - per * s, [s] * per, k)
                    n -= k * per
                else:
                    _open(rooms, order, capacity - n * s, [s] * n, 1)
                    n = 0
    out += [(content, m) for room in rooms for content, m in rooms[room]]
    return out


def _open(rooms: dict[int, list[list]], order: list[int], room: int, content: list[int], m: int) -> None:
    if room not in rooms:
        bisect.insort(order, room)
        rooms[room] = []
    rooms[room].append([content, m])


def places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length: ranks at which a run of places starts, the first container of the run, and how many items of the length each of its containers takes."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    used: dict[int, int] = {}
    container = 1
    for pattern, m in patterns:
        for s in set(pattern):
            k = pattern.count(s)
            starts, firsts, per = out.setdefault(s, ([], [], []))
            starts.append(used.get(s, 0))
            firsts.append(container)
            per.append(k)
            used[s] = used.get(s, 0) + m * k
        container += m
    return out


def pieces(documents: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """profile, capacity, doc_id, piece, tokens: what has to be placed. A document over the capacity gives full pieces and a last one."""
    counts = token_counts(documents, vocabulary)
    profiles = sizes.where(F.col("capacity") > 0).select("profile", "capacity").distinct()
    # a handful of profiles by nature: each document is repeated for each of them
    each = [(r["profile"], int(r["capacity"])) for r in profiles.orderBy("profile", "capacity").collect()]
    if not each:
        return counts.limit(0).select(F.lit("").alias("profile"), F.lit(0).alias("capacity"), "doc_id", F.lit(0).alias("piece"), "tokens")
    array = F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(c).alias("capacity")) for p, c in each))
    rows = counts.select("doc_id", "tokens", F.explode(array).alias("p")).select("doc_id", "tokens", "p.profile", "p.capacity")
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int")
    return (rows.select("profile", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(1), n)).alias("piece"))
            .select("profile", "capacity", "doc_id", "piece", F.least(F.col("capacity").cast("bigint"), F.col("tokens") - (F.col("piece") - 1) * F.col("capacity").cast("bigint")).alias("tokens")))


def containers(documents: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """profile, capacity, doc_id, piece, tokens, container: a container number from 1 for each document, or each piece of one that is too long.

    Documents without tokens (null or empty texts) need no room and are put in container 1. Repeated rows count once, empty tables give no rows.
    """
    items = pieces(documents, sizes, vocabulary).persist()
    # pieces of one length can be a third of all items, so their number of parts grows with the table
    salts = max(64, -(-items.count() // PART))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sub = salted.groupBy("profile", "capacity", "tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("profile", "capacity", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sub.select("profile", "capacity", "tokens", "salt", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"), "n").persist()
    # at most one row per length up to the capacity, so its size is bound by the profiles alone
    histogram = offsets.groupBy("profile", "capacity", "tokens").agg(F.sum("n").alias("n")).collect()
    by: dict[tuple[str, int], dict[int, int]] = {}
    for r in histogram:
        by.setdefault((r["profile"], r["capacity"]), {})[r["tokens"]] = r["n"]
    where = {key: places(plan(counts, key[1])) for key, counts in by.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.ones(len(pdf), dtype=np.int64)
            rank = pdf["rank"].to_numpy()
            for (profile, capacity, tokens), rows in pdf.groupby(["profile", "capacity", "tokens"], sort=False, dropna=False).indices.items():
                if tokens > 0:
                    starts, firsts, per = (np.asarray(x) for x in where[profile, capacity][tokens])
                    i = np.searchsorted(starts, rank[rows], side="right") - 1
                    out[rows] = firsts[i] + (rank[rows] - starts[i]) // per[i]
            yield pdf.drop(columns="rank").assign(container=out)

    v = Window.partitionBy("profile", "capacity", "tokens", "salt").orderBy("doc_id", "piece")
    ranked = (salted.withColumn("r", F.row_number().over(v) - 1).join(offsets.select("profile", "capacity", "tokens", "salt", "offset"), ["profile", "capacity", "tokens", "salt"])
              .select("profile", "capacity", "doc_id", "piece", "tokens", (F.col("r") + F.col("offset")).alias("rank")))
    return ranked.mapInPandas(place, "profile string, capacity int, doc_id bigint, piece int, tokens bigint, container bigint")


def unused_room(documents: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """profile, capacity, items, containers, least_containers, tokens, unused, unused_share: how well each profile's containers are filled."""
    per = containers(documents, sizes, vocabulary).groupBy("profile", "capacity", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    out = per.groupBy("profile", "capacity").agg(F.sum("items").alias("items"), F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return out.select("profile", "capacity", "items", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), "tokens", "fullest",
                      (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("unused"),
                      F.round((F.col("containers") * F.col("capacity") - F.col("tokens")) / (F.col("containers") * F.col("capacity")), 8).alias("unused_share"))
