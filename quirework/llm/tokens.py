"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the ranks of the byte-level vocabulary lie; a parameter everywhere, the file is never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's tokenizer splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MADE: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a ranks file, made once per process. Strings of special tokens are ordinary text."""
    if path not in _MADE:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _MADE[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _MADE[path]


def token_sizes(df: DataFrame, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """df without the text and with `tokens` (a column of that name is replaced); 0 for null and empty texts. Whole texts are read."""
    df = df.drop("tokens") if text_col != "tokens" else df
    keep = [f for f in df.schema if f.name != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["tokens bigint"])
    # small batches: texts may be long, and a worker's memory is bounded
    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for pdf in batches:
            out = pdf[[f.name for f in keep]].copy()
            out["tokens"] = [len(e.encode_ordinary(t)) if t else 0 for t in pdf[text_col]]
            yield out

    return df.withColumn(text_col, F.col(text_col).cast("string")).mapInPandas(sized, schema)
