"""Seeded hashes: the only source of randomness, so every job gives the same rows again."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(seed: int, *parts: Column) -> Column:
    """md5 over ``seed:part:part...`` as hex text."""
    text = [F.lit(str(seed))]
    for part in parts:
        text += [F.lit(":"), part.cast("string")]
    return F.md5(F.concat(*text))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits."""
    return F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def below(n: Column, seed: int, *parts: Column) -> Column:
    """A whole number in [0, n)."""
    return F.floor(uniform(seed, *parts) * n).cast("bigint")


def order_key(seed: int, *parts: Column) -> Column:
    """A random 60-bit ordering key."""
    return F.conv(F.substring(digest(seed, *parts), 1, 15), 16, 10).cast("bigint")


ORDER_KEY_MAX = (1 << 60) - 1
