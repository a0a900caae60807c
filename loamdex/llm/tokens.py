"""Token counts by a public tokenizer whose vocabulary is read from a file."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary's texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoding(vocabulary: str):
    """The tokenizer of a vocabulary's file: the copy that was sent with the job, or the file itself where there is none, as on the driver."""
    import tiktoken

    sent = SparkFiles.get(os.path.basename(vocabulary)) if SparkFiles._is_running_on_worker else vocabulary
    with open(sent if os.path.exists(sent) else vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (row.split() for row in f if row.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, *columns: str) -> DataFrame:
    """doc_id, tokens and the named columns of each document, once; 0 tokens for null and empty texts. Of contradicting rows of a doc_id the one with most
    tokens counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]])

    if os.path.exists(vocabulary):
        # one file of a few MB, whatever the documents; workers need no copy of their own
        documents.sparkSession.sparkContext.addFile(vocabulary)
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", *columns, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    counted = rows.mapInPandas(count, f"{types}, tokens bigint")
    return counted.groupBy("doc_id").agg(F.max(F.struct("tokens", *columns)).alias("r")).select("doc_id", "r.*")
