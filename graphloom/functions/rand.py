"""Seeded, hash-based randomness: a value depends on seed and key alone, never on partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """In (0, 1), from the first 52 bits of the md5 of `seed:key:key...`; nulls count as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def uniform_sql(seed: int, *keys: str) -> str:
    """The same for an engine that casts hexadecimal literals to integers."""
    text = " || ':' || ".join([f"'{seed}'", *(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)])
    return f"((CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)"


def uniform_value(seed: int, *keys: object) -> float:
    """The same draw as a number."""
    text = ":".join([str(seed), *("" if k is None else str(k) for k in keys)])
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def lower_half(seed: int, keys: np.ndarray) -> np.ndarray:
    """Whether the draw of each whole number is below 0.5, which the first bit of its md5 tells."""
    start = f"{seed}:"
    return np.array([hashlib.md5(f"{start}{k}".encode()).digest()[0] < 128 for k in keys.tolist()], bool)
