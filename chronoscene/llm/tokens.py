"""Sizes of texts in tokens of a public tokenizer: byte-level BPE with 50,256 ids (``byte_bpe_50k.tiktoken``)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern that goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str = TOKENIZER):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens of the whole text, null as 0."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")(text)


def plain_source(source: Column) -> Column:
    """Source names in one spelling: trimmed, lower case, with underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def plain_lang(lang: Column) -> Column:
    """Two-letter language, 'und' for null and blank."""
    short = F.substring(F.lower(F.trim(lang)), 1, 2)
    return F.when(F.coalesce(F.length(short), F.lit(0)) == 2, short).otherwise("und")


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, lang, source, n_tokens)``; only these small columns leave the stage that reads the texts."""
    return documents.select("doc_id", plain_lang(F.col("lang")).alias("lang"), plain_source(F.col("source")).alias("source"), token_count(F.col("text"), path).alias("n_tokens"))
