"""Token budget of passages: an optional cap by a byte-pair vocabulary given as a file."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def cap_tokens(text: Column, ranks_path: str, pattern: str, most: int = 500) -> Column:
    """Texts of more tokens than `most` are cut there and end in an ellipsis."""

    @F.pandas_udf(StringType())
    def cut(texts: pd.Series) -> pd.Series:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("passages", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def one(t):
            if t is None:
                return None
            ids = coder.encode_ordinary(t)
            return t if len(ids) <= most else coder.decode(ids[:most]) + "…"

        return texts.map(one)

    return cut(text)
