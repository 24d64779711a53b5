"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.runtime import ship

#: Ranks of a byte-level BPE; the vocabulary is a parameter and never part of this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The public split pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def encoding(ranks: bytes):
    """The encoding of the contents of a ranks file, kept per worker."""
    import tiktoken

    key = hash(ranks)
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def with_tokens(df: DataFrame, text: str, into: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the number of tokens of a text; null and empty texts have 0. The whole text counts."""
    spark: SparkSession = df.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:  # a fixed file of under a megabyte, sent to every worker once
        ranks = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from skein.llm.tokens import encoding

        enc = encoding(ranks.value)
        for b in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in b], dtype="int64")

    return df.withColumn(into, count(F.col(text)))


def source_key(c: Column) -> Column:
    """One spelling of a source: lower case, blanks and hyphens as underscores; null and blank are 'unknown'."""
    k = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s-]+", "_")
    return F.coalesce(F.nullif(k, F.lit("")), F.lit("unknown"))
