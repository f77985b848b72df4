"""Deterministic draws keyed by data, not by position, so that partitioning can't change a result.

The default draw hashes its key with md5, which SQL engines compute alike. ``replay`` runs the
Mersenne Twister of CPython with the positional seeds instead, for exact replays of old runs.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 42


def draw(n: Column | int, *key: Column | str | int, seed: int = SEED) -> Column:
    """A number in [0, n) that depends on ``key`` and ``seed`` only; null where ``n`` is below 1."""
    parts = [F.lit(str(seed)), *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]]
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
    size = n if isinstance(n, Column) else F.lit(n)
    return F.when(size > 0, number % size.cast("long"))


def pick(pool: tuple[str, ...], *key: Column | str | int, seed: int = SEED) -> Column:
    """A uniform pick from a short pool."""
    return F.element_at(F.array(*map(F.lit, pool)), (draw(len(pool), *key, seed=seed) + 1).cast("int"))


@F.pandas_udf(T.LongType())
def _replayed(row: pd.Series, variant: pd.Series, mask: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    return pd.Series([random.Random(1000003 + int(r) * 1009 + int(v) * 97 + int(m)).randint(int(a), int(b)) for r, v, m, a, b in zip(row, variant, mask, lo, hi)])


def replay(row: Column, variant: Column, mask: Column, lo: Column | int, hi: Column | int) -> Column:
    """``randint(lo, hi)`` of a Mersenne Twister seeded by row, variant and mask number."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return _replayed(row, variant, mask, as_col(lo), as_col(hi))


def date_offset(key: Column, variant: Column, low: int = 30, high: int = 365, seed: int = SEED) -> Column:
    """Days by which all dates of a row's variant move: odd variants forward, even ones back."""
    days = draw(high - low + 1, key, variant, 0, "date_offset", seed=seed) + low
    return F.when(variant % 2 == 1, days).otherwise(-days).cast("int")
