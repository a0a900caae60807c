"""Source files that do not parse.

Every file is parsed by the grammar of its own language; where that fails, the other languages are ranked by their tokens and all of their grammars
are tried in that order. A foreign grammar that takes the file points to a wrong extension, none at all to a corrupt file. A file that its own grammar
takes is valid whatever the others say, so they aren't asked about it.

A file of more than one block of lines is cut at statements of the outermost level, and its pieces are parsed in parallel. If all are valid, so is
the file. Only where a piece fails, since a cut may have fallen into a literal, the file is parsed as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_LINES, clean_lines, current_files, small, text_blocks
from .grammars import LANGUAGES, accepts, anchor, check

#: Tokens that are more usual in a language than in others, with weights.
MARKS = {
    "python": [(r"(?m)^\s*def \w+\(.*\).*:\s*$", 4), (r"(?m)^(?:import|from) [\w.]+(?: import .+)?$", 3), (r"(?m):\s*$", 0.5), (r"\bself\.|\bNone\b|\belif\b|\"\"\"", 1)],
    "javascript": [(r"\b(?:var|let|const) \w+ =", 2), (r"\bfunction \w*\(|=>", 2), (r"===|\brequire\(|\bexport\b", 1)],
    "typescript": [(r"\w: (?:string|number|boolean|void|any)\b", 3), (r"\binterface \w+ \{|\bexport (?:const|function|class)\b", 2), (r"=>", 1)],
    "go": [(r"(?m)^package \w+$", 5), (r"(?m)^func ", 3), (r":=", 2)],
    "java": [(r"\b(?:public|private|protected) [\w<>\[\] ]+[({]", 3), (r"(?m)^import [\w.]+;", 3), (r"\bnew \w+", 1)],
    "ruby": [(r"(?m)^\s*end$", 2), (r"(?m)^\s*def \w+", 1), (r"\bdo \|", 3), (r"(?m)^require ['\"]", 3)],
    "c": [(r"(?m)^#(?:include|define|ifdef|ifndef)\b", 4), (r"\b(?:int|char|void|size_t|long)\s+\*?\w+\s*[(=;]", 2), (r"->", 1)],
    "shell": [(r"\A#!.*sh\b", 5), (r"(?m)^\s*(?:fi|done|esac)$", 3), (r"\$\{?\w+", 1), (r"\bthen$", 2)],
}
_MARKS = {lang: [(re.compile(p), w) for p, w in marks] for lang, marks in MARKS.items()}


def ranked(text: str) -> list[str]:
    """The languages by how much the tokens of a text speak for them, most first."""
    score = {lang: sum(w * min(50, sum(1 for _ in p.finditer(text))) for p, w in marks) for lang, marks in _MARKS.items()}
    return sorted(LANGUAGES, key=lambda lang: (-score[lang], lang))


def foreign(text: str, own: str) -> str | None:
    """The likeliest other language whose grammar takes the text."""
    return next((lang for lang in ranked(text) if lang != own and accepts(text, lang)), None)


def _check_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for f, text, language in zip(pdf["file_id"], pdf["text"], pdf["head"]):
            if error := check(text, language):
                rows.append((f, error, foreign(text, language)))
        yield pd.DataFrame(rows, columns=["file_id", "error", "looks_like"]).astype({"file_id": "int64"})


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From each block its part before the first statement of the outermost level, which belongs to the piece before, and the rest."""
    for pdf in batches:
        rows = []
        for f, b, text in zip(pdf["file_id"], pdf["block"], pdf["text"]):
            at = 0 if b == 0 else anchor(text)
            rows.append((f, b, text if at is None else text[:at], None if at is None else text[at:]))
        yield pd.DataFrame(rows, columns=["file_id", "block", "first", "rest"]).astype({"file_id": "int64", "block": "int32"})


def _check_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([(f, check(text, language, piece=b > 0)) for f, b, text, language in zip(pdf["file_id"], pdf["piece"], pdf["text"], pdf["language"])],
                           columns=["file_id", "error"]).astype({"file_id": "int64"})


def _check_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for f, text, language in zip(pdf["file_id"], pdf["text"], pdf["language"]):
            if error := check(text, language):
                rows.append((f, error, foreign(text, language)))
        yield pd.DataFrame(rows, columns=["file_id", "error", "looks_like"]).astype({"file_id": "int64"})


_RESULT = "file_id bigint, error string, looks_like string"


def invalid_files(lines: DataFrame, files: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """file_id, error, looks_like: the indexed files of a supported language that aren't valid in it. looks_like is another language that they are valid
    in, null if there is none.

    Files without lines are valid, lines are numbered from 1 without gaps, null texts are empty lines, files of other languages or none are left out.
    """
    known = current_files(files).where(F.col("language").isin(*LANGUAGES)).select("file_id", F.col("language").alias("head"))
    blocks = text_blocks(lines, known, block_lines)
    single = (F.col("block") == 0) & (F.col("n_lines") < block_lines)
    whole = blocks.where(single & F.col("head").isNotNull() & (F.col("n_lines") > 0)).select("file_id", "text", "head").mapInPandas(_check_files, _RESULT)
    # lines are numbered without gaps, so a file of more than one block has a line of this number; few files do, and only their text moves again
    long = clean_lines(lines).where(F.col("line") >= block_lines).select("file_id").distinct()
    several = text_blocks(clean_lines(lines).join(small(long), "file_id", "left_semi"), None, block_lines)
    parts = several.select("file_id", "block", "text").join(known, "file_id", "left_semi").mapInPandas(_cut, "file_id bigint, block int, first string, rest string")
    w = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a block without such a statement belongs to the last piece before it as a whole
    placed = parts.withColumn("before", F.max(F.when(F.col("rest").isNotNull(), F.col("block"))).over(w))
    halves = placed.select("file_id", F.explode(F.array(F.struct(F.coalesce("before", F.lit(0)).alias("piece"), F.struct("block", F.lit(0).alias("half"), F.col("first").alias("t")).alias("p")),
                                                        F.struct(F.col("block").alias("piece"), F.struct("block", F.lit(1).alias("half"), F.col("rest").alias("t")).alias("p")))).alias("x"))
    pieces = (halves.select("file_id", "x.piece", "x.p").where(F.col("p.t").isNotNull())
              .groupBy("file_id", "piece").agg(F.array_sort(F.collect_list("p")).alias("ps"))
              # a head that stands before a cut within a line end has it already
              .select("file_id", "piece", F.array_join(F.transform("ps", lambda x: F.rtrim(x["t"], F.lit("\n"))), "\n").alias("text"))
              .join(known.withColumnRenamed("head", "language"), "file_id"))
    # the join brought the pieces of a file together; they are spread again
    failing = pieces.repartition("file_id", "piece").mapInPandas(_check_pieces, "file_id bigint, error string").groupBy("file_id").agg(F.max("error").alias("error")).where(F.col("error").isNotNull())
    again = (several.join(failing.select("file_id"), "file_id", "left_semi").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("bs"))
             .select("file_id", F.array_join(F.transform("bs", lambda x: x["text"]), "\n").alias("text"))
             .join(known.withColumnRenamed("head", "language"), "file_id").mapInPandas(_check_whole, _RESULT))
    return whole.unionByName(again)


def invalid_rates(lines: DataFrame, files: DataFrame) -> DataFrame:
    """repository, language, files, invalid, foreign, rate: the share of invalid files of each repository and language."""
    bad = invalid_files(lines, files).select("file_id", F.lit(1).alias("bad"), F.col("looks_like").isNotNull().cast("int").alias("other"))
    every = current_files(files).where(F.col("language").isin(*LANGUAGES)).select("file_id", F.split("path", "/")[0].alias("repository"), "language")
    return (every.join(bad, "file_id", "left").groupBy("repository", "language")
            .agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid"), F.coalesce(F.sum("other"), F.lit(0)).alias("foreign"))
            .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6)))
