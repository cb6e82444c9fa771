"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is a parameter; it travels with the job, so
workers need no copy of their own."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE vocabularies of this kind cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load(path: str = TOKENIZER_FILE, pattern: str = PATTERN):
    """A tokenizer from a file of ranks: a base64 token and its rank a line."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, path: str = TOKENIZER_FILE, pattern: str = PATTERN) -> DataFrame:
    """df with text replaced by n_tokens (int) and text_key, a hash by which equal texts can be told.

    Null and empty texts have 0 tokens; a null text has a null key. Texts are counted whole."""
    keep = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c != text), "n_tokens int, text_key string"])

    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load(SparkFiles.get(name), pattern)
        for batch in batches:
            out = batch[[*keep, "__key"]].rename(columns={"__key": "text_key"})
            out.insert(len(keep), "n_tokens", [len(encoding.encode_ordinary(t)) if t else 0 for t in batch[text]])
            yield out

    return df.select(*[F.col(f"`{c}`") for c in keep], F.sha2(F.col(text), 256).alias("__key"), F.col(text)).mapInPandas(count, schema)
