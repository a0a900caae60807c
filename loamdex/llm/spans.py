"""Long exact spans shared between files.

Content-defined chunking with a gear rolling hash. The gear hash of the next ``GEAR`` characters is taken at every character;
cut points are the minima of it in every run of ``RUN`` positions, so an insertion moves no cut point but those beside it, and no stretch
of ``RUN`` positions is without one. A chunk runs from a cut point to the first cut point at least ``LEAST`` characters on. Chunks are
deduplicated by digest; the digest takes in the ``KEY`` characters after the cut point as well.

Why no span is lost: the first ``RUN`` positions of any stretch of ``SPAN`` characters hold a cut point that is the same in every file that
has the stretch, its chunk ends inside the stretch (``2 * (RUN - 1) + LEAST + RUN + GEAR - 1 <= SPAN``), and so do the ``KEY = SPAN - RUN + 1`` characters
after it. So two files that share a stretch share a digest, and one of the ``RUN`` windows of ``SPAN`` characters that start at most
``RUN - 1`` before the cut point is alike in both. That window's digest is the exact check.

A long file is worked on in blocks of lines with some lines of the neighbours around them; nothing is held per file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_LINES, blocks_with_context, clean_lines, current_files, indexed_lines, small

SPAN, RUN, GEAR, LEAST = 200, 52, 16, 31
KEY = SPAN - RUN + 1
assert 2 * (RUN - 1) + LEAST + RUN + GEAR - 1 <= SPAN
BEFORE, AFTER = RUN, SPAN + RUN  # lines of the neighbours; each has one character at least, its line end
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = _mix(np.arange(1, 65537, dtype=np.uint64) * _ODD)
_INVERSE = np.uint64(pow(int(_ODD) | 1, -1, 1 << 64))


def _values(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _TABLE[c] if not len(c) or c.max() < 65536 else np.where(c < 65536, _TABLE[c & 0xFFFF], _mix((c.astype(np.uint64) + np.uint64(1)) * _ODD))


class Text:
    """Gear cut points and digests of any stretch of one text."""

    def __init__(self, text: str):
        self.n, v = len(text), _values(text)
        with np.errstate(over="ignore"):
            powers = np.ones(self.n + 1, dtype=np.uint64)
            np.multiply.accumulate(np.full(self.n, _ODD, dtype=np.uint64), out=powers[1:]) if self.n else None
            self.inverse = np.ones(self.n + 1, dtype=np.uint64)
            np.multiply.accumulate(np.full(self.n, _INVERSE, dtype=np.uint64), out=self.inverse[1:]) if self.n else None
            self.prefix = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(v * powers[:-1], out=self.prefix[1:])
        self.values = v

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _ODD)

    def cuts(self) -> np.ndarray:
        m = self.n - GEAR + 1
        if m < RUN:
            return np.zeros(0, dtype=np.int64)
        with np.errstate(over="ignore"):  # gear: each step shifts by one bit, so the low GEAR bits hold the next GEAR characters
            h, k = self.values, 1
            while k * 2 <= GEAR:
                h = (h[:-k] << np.uint64(k)) + h[k:]
                k *= 2
            rest = GEAR - k
            if rest:
                g, j = self.values, 1
                while j < rest:
                    g = (g[:-j] << np.uint64(j)) + g[j:]
                    j *= 2
                h = (h[:m] << np.uint64(rest)) + g[k:k + m]
            h = (h[:m] & np.uint64((1 << GEAR) - 1)).astype(np.uint32)
        low, k = h, 1
        while k * 2 <= RUN:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        low = np.minimum(low[:m - RUN + 1], low[RUN - k:RUN - k + m - RUN + 1])
        top = np.concatenate([np.zeros(RUN - 1, dtype=np.uint32), low, np.zeros(RUN - 1, dtype=np.uint32)])
        k = 1
        while k * 2 <= RUN:
            top = np.maximum(top[:-k], top[k:])
            k *= 2
        top = np.maximum(top[:m], top[RUN - k:RUN - k + m])
        return np.flatnonzero(top == h)


def _neighbours(lines: DataFrame, block_lines: int) -> DataFrame:
    return blocks_with_context(lines, BEFORE, AFTER, block_lines)


def _whole(before: str, own: str, after: str, more_before: bool, more_after: bool) -> tuple[str, int, int]:
    """Text, where the own lines start in it, and how many characters are the block's own (the last line end is if a line follows)."""
    head = before + "\n" if more_before else ""
    return head + own + ("\n" + after if more_after else ""), len(head), len(own) + more_after


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """K, H, file_id, block, at: of each cut point with a whole chunk and KEY characters after it. H is the digest of the next SPAN
    characters, 0 if there are fewer; it tells places of one K apart, so the two have 128 bits together."""
    for pdf in batches:
        out: list[tuple[np.ndarray, ...]] = []
        for f, b, *row in zip(pdf["file_id"], pdf["block"], pdf["before"], pdf["own"], pdf["after"], pdf["more_before"], pdf["more_after"]):
            text, start, own = _whole(*row)
            if len(text) < SPAN:
                continue
            t = Text(text)
            cuts = t.cuts()
            p = cuts[(cuts >= start) & (cuts < start + own)]
            if not len(p):
                continue
            nxt = np.searchsorted(cuts, p + LEAST)
            ok = (nxt < len(cuts)) & (p + KEY <= t.n)
            p, q = p[ok], cuts[np.minimum(nxt, len(cuts) - 1)][ok]
            with np.errstate(over="ignore"):
                key = _mix(t.digest(p, q) ^ (t.digest(p, p + KEY) * _ODD))
            h = np.where(p + SPAN <= t.n, t.digest(p, np.minimum(p + SPAN, t.n)), np.uint64(0))
            out.append((key.view(np.int64), h.view(np.int64), np.full(len(p), f), np.full(len(p), b, dtype=np.int32), (p - start).astype(np.int32)))
        if out:
            yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("k", "h", "file_id", "block", "at"))})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """w, v, file_id, block, at: the digests of all windows of SPAN characters that start at most RUN - 1 before the places ``ats``, and of their first halves;
    the two have 128 bits together."""
    for pdf in batches:
        out = []
        for f, b, ats, *row in zip(pdf["file_id"], pdf["block"], pdf["ats"], pdf["before"], pdf["own"], pdf["after"], pdf["more_before"], pdf["more_after"]):
            text, start, _ = _whole(*row)
            t = Text(text)
            s = np.unique((np.asarray(ats, dtype=np.int64)[:, None] + start - np.arange(RUN)[None, :]).ravel())
            s = s[(s >= 0) & (s + SPAN <= t.n)]
            if len(s):
                out.append((t.digest(s, s + SPAN).view(np.int64), t.digest(s, s + SPAN // 2).view(np.int64), np.full(len(s), f), np.full(len(s), b, dtype=np.int32), (s - start).astype(np.int32)))
        if out:
            yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("w", "v", "file_id", "block", "at"))})


def _pairs_of_sets(sets: DataFrame) -> DataFrame:
    """From a column ``ids`` of sorted file ids per digest: each pair once. Equal sets, of which a long stretch gives many, are joined
    first, and each member of a set is a row of its own before its partners are listed."""
    one = sets.select("ids").distinct().select(F.posexplode("ids").alias("i", "a"), "ids")
    spread = one.where(F.col("i") < F.size("ids") - 1)
    return spread.select(F.col("a").alias("file_id_a"), F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("file_id_b")).distinct()


def _shared(lines: DataFrame, block_lines: int) -> DataFrame:
    """k, h, file_id, block, at: the places whose digest occurs in more than one file. A digest's places are rows of a window, which spills, so one that stands
    in a third of all files is never put together in memory."""
    keys = _neighbours(lines, block_lines).mapInPandas(_chunks, "k bigint, h bigint, file_id bigint, block int, at int")
    of = Window.partitionBy("k")
    return keys.withColumn("least", F.min("file_id").over(of)).withColumn("most", F.max("file_id").over(of)).where("least <> most").drop("least", "most")


def _ids(c: Column) -> Column:
    return F.array_sort(F.collect_set(c))


def shared_pairs(lines: DataFrame, files: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """file_id_a < file_id_b: pairs of indexed files that have a verbatim stretch of at least SPAN characters in common.

    Null texts are empty lines, repeated rows count once, files shorter than SPAN give nothing, empty tables no rows. A stretch repeated
    in one file only isn't shared.
    """
    rows, indexed = clean_lines(lines), current_files(files).select("file_id")
    # few places are left here, so this is where files that don't count are cheap to leave out
    flat = _shared(rows, block_lines).join(indexed, "file_id", "left_semi").persist()
    right = flat.where("h <> 0").groupBy("k", "h").agg(_ids(F.col("file_id")).alias("ids")).where(F.size("ids") > 1)
    # digests whose places don't all go on alike to the right may do so to the left
    alike = flat.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where((F.col("a") != F.col("b")) | (F.col("a") == 0) | (F.col("b") == 0))
    mixed = flat.join(alike.select("k"), "k", "left_semi")
    left = _around(rows, mixed, block_lines).groupBy("w", "v").agg(_ids(F.col("file_id")).alias("ids")).where(F.size("ids") > 1)
    return _pairs_of_sets(right.select("ids").unionByName(left.select("ids")))


def _around(rows: DataFrame, places: DataFrame, block_lines: int) -> DataFrame:
    wanted = places.groupBy("file_id", "block").agg(F.collect_set("at").alias("ats"))
    some = rows.join(small(wanted.select("file_id").distinct()), "file_id", "left_semi")
    return _neighbours(some, block_lines).join(wanted, ["file_id", "block"]).mapInPandas(_windows, "w bigint, v bigint, file_id bigint, block int, at int")


def _lengths(rows: DataFrame) -> DataFrame:
    """file_id, line, n: the length of each line, once; no text moves for it."""
    return rows.select("file_id", "line", F.length("text").alias("n")).groupBy("file_id", "line").agg(F.max("n").alias("n"))


def shared_spans(lines: DataFrame, files: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """file_id, path, start, length: the maximal stretches of each file (in code points from 0) whose every character lies in a window of SPAN characters
    that also stands in another file."""
    rows, indexed = clean_lines(lines), current_files(files).select("file_id")
    flat = _shared(rows, block_lines).join(indexed, "file_id", "left_semi").persist()
    right = flat.where("h <> 0").groupBy("k", "h").agg((F.min("file_id") != F.max("file_id")).alias("both")).where("both").select("k", "h", F.lit(True).alias("goes_on"))
    marked = flat.join(right, ["k", "h"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    w = Window.partitionBy("file_id", "block").orderBy("at")
    # inside a stretch each cut point's window joins on to the one before; only at its ends single windows have to be looked at
    edge = marked.withColumn("inner", F.col("goes_on") & F.coalesce(F.lag("goes_on").over(w) & (F.col("at") - F.lag("at").over(w) <= RUN), F.lit(False)))
    # a window at an end needs all places of its digest, those inside other stretches as well
    ends_of = flat.join(edge.where("not inner").select("k").distinct(), "k", "left_semi")
    windows = _around(rows, ends_of.select("file_id", "block", "at"), block_lines)
    of = Window.partitionBy("w", "v")
    ends = windows.withColumn("least", F.min("file_id").over(of)).withColumn("most", F.max("file_id").over(of)).where("least <> most").select("file_id", "block", "at")
    starts = marked.where("goes_on").select("file_id", "block", "at").unionByName(ends).distinct()
    own = _lengths(rows).groupBy("file_id", F.floor((F.col("line") - 1) / block_lines).cast("int").alias("block")).agg(F.sum(F.col("n") + 1).alias("n"))
    offset = own.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = starts.join(offset.select("file_id", "block", "offset"), ["file_id", "block"]).select("file_id", (F.col("offset") + F.col("at")).alias("start")).distinct()
    v = Window.partitionBy("file_id").orderBy("start")
    grouped = at.withColumn("new", F.coalesce((F.col("start") - F.lag("start").over(v) > SPAN).cast("int"), F.lit(1))).withColumn("g", F.sum("new").over(v))
    spans = grouped.groupBy("file_id", "g").agg(F.min("start").alias("start"), (F.max("start") + SPAN - F.min("start")).alias("length"))
    return spans.join(current_files(files).select("file_id", "path"), "file_id").select("file_id", "path", "start", "length")


def shared_share(lines: DataFrame, files: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """file_id, path, n_chars, shared_chars: of each indexed file, how many of its characters also stand in another file."""
    rows = indexed_lines(lines, files)
    n = _lengths(rows).groupBy("file_id").agg((F.sum(F.col("n") + 1) - 1).alias("n_chars"))
    total = shared_spans(lines, files, block_lines).groupBy("file_id").agg(F.sum("length").alias("shared_chars"))
    return (current_files(files).select("file_id", "path").join(n, "file_id", "left").join(total, "file_id", "left")
            .select("file_id", "path", F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("n_chars"), F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars")))
