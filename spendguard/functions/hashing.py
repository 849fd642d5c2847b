"""Hash buckets and hash-based random numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "__MISSING__"


def _murmur3_x86_32(texts: pd.Series) -> np.ndarray:
    """Public MurmurHash3 x86 32-bit with seed 0 over the UTF-8 bytes, one block column at a time."""
    raw = [t.encode("utf-8") for t in texts]
    size = np.array([len(b) for b in raw], dtype=np.uint32)
    words = max(1, (int(size.max(initial=0)) + 3) // 4)
    padded = b"".join(b.ljust(4 * words, b"\0") for b in raw)
    blocks = np.frombuffer(padded, dtype="<u4").reshape(len(raw), words)
    rotl = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    h = np.zeros(len(raw), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(words):
            mixed = rotl(blocks[:, i] * c1, 15) * c2
            full = size >= 4 * (i + 1)
            part = ~full & (size > 4 * i)
            h = np.where(full, rotl(h ^ mixed, 13) * np.uint32(5) + np.uint32(0xE6546B64), h)
            h = np.where(part, h ^ mixed, h)
        h ^= size
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


@F.pandas_udf(T.IntegerType())
def _murmur3(texts: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(texts)
    return pd.Series(_murmur3_x86_32(pd.Series(distinct))[codes])


def hash_bucket(c: Column, n: int, mode: str = "native") -> Column:
    """Bucket 0..n-1 of a string; null hashes as a token of its own.

    `native` stays in the JVM.  `compat` gives the buckets of MurmurHash3 (seed 0), for results that
    must line up with feature names written by other tools.
    """
    value = F.coalesce(c.cast("string"), F.lit(MISSING))
    if mode == "native":
        return F.pmod(F.hash(value), F.lit(n)).cast("int")
    if mode == "compat":
        return (F.abs(_murmur3(value).cast("long")) % n).cast("int")
    raise ValueError(f"unknown hash mode {mode!r}")


def one_hot(bucket: Column, n: int) -> Column:
    """Array of n zeros with a one at the bucket."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == bucket).cast("double"))


def unit_hash(seed: int, *cols: Column) -> Column:
    """Uniform number in [0, 1) fixed by the columns and the seed."""
    bits = F.xxhash64(*cols, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))
    return bits.cast("double") / F.lit(float(1 << 53))


def portable_unit(seed: int, c: Column) -> Column:
    """Same as `unit_hash`, built from MD5 so that any SQL engine can recompute it."""
    digest = F.md5(F.concat_ws("|", c.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
