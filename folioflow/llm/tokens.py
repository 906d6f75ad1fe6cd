"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.context import spread

#: Where the vocabulary is, unless a caller names another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's texts are cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, *keep: str, path: str = VOCABULARY) -> DataFrame:
    """The columns to keep and ``n_tokens``; rows without a text or id are left out."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        e = encoding(path)
        return pd.Series([len(e.encode_ordinary(t)) for t in texts])

    return spread(documents.where("text is not null and doc_id is not null").select(*keep, "text")).select(*keep, count("text").alias("n_tokens"))
