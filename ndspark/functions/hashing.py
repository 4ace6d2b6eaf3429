"""FNV-1a, 64 bits, over UTF-8."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the hash.
OFFSET = 14695981039346656037
PRIME = 1099511628211


def fnv1a_array(texts: list[bytes]) -> np.ndarray:
    """Hashes of all texts at once: one step for each byte position, over the texts that reach it."""
    h = np.full(len(texts), OFFSET, np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(lengths) - lengths
    live = np.arange(len(texts))
    for i in range(int(lengths.max(initial=0))):
        live = live[lengths[live] > i]
        h[live] = (h[live] ^ flat[starts[live] + i]) * np.uint64(PRIME)
    return h


def fnv1a(text: str) -> int:
    return int(fnv1a_array([text.encode()])[0])


@F.pandas_udf(T.StringType())
def fnv1a64(s: pd.Series) -> pd.Series:
    """The hash as a decimal number; null for null."""
    known = s.notna()
    out = pd.Series([None] * len(s), dtype=object)
    out[known.to_numpy()] = [str(x) for x in fnv1a_array([x.encode() for x in s[known]])]
    return out


@F.pandas_udf(T.StringType())
def fnv1a64_xor(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exclusive or of both hashes: a key from a location and a version."""
    h = fnv1a_array([x.encode() for x in a.fillna("")]) ^ fnv1a_array([x.encode() for x in b.fillna("")])
    return pd.Series([str(x) for x in h])
