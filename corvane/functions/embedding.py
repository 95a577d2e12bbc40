"""A deterministic embedder without a model, a cache for it, and the hook for another (RT16, UX4).

The default hashes a text's words and word pairs into a fixed number of dimensions with signs
and normalises the sums.  [ext]: it stands in for a neural model, which is passed as ``embed``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import zlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
_WORD = re.compile(r"\w+")


def hashed(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row for each text; a text without words is a zero row."""
    out = np.zeros((len(texts), dimensions))
    for i, t in enumerate(texts):
        words = _WORD.findall((t or "").lower())
        for w in words + [" ".join(p) for p in zip(words, words[1:])]:
            h = zlib.crc32(w.encode())
            out[i, h % dimensions] += 1 if h >> 16 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def embed_column(text: Column, embed: Callable[[list[str]], np.ndarray] = hashed) -> Column:
    """A column of vectors, by Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed(list(texts)).astype(np.float32)))

    return run(text)


def embed_cached(rows: DataFrame, cache: DataFrame | None, text: str = "content", embed: Callable[[list[str]], np.ndarray] = hashed) -> tuple[DataFrame, DataFrame]:
    """RT16: vectors by the md5 of the text, from the cache where it has them: the rows and the new cache."""
    keyed = rows.withColumn("text_md5", F.md5(text))
    new = keyed.select("text_md5", text).dropDuplicates(["text_md5"])
    if cache is not None:
        new = new.join(cache.select("text_md5"), "text_md5", "left_anti")
    made = new.select("text_md5", embed_column(F.col(text), embed).alias("embedding"))
    cache = made if cache is None else cache.unionByName(made)
    return keyed.join(cache, "text_md5", "left").drop("text_md5"), cache
