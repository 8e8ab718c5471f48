"""Keyed permutations of 0..n-1 that are computed and not sorted, for null models."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Rounds of a permutation; bits of each of the four numbers that a key makes.
ROUNDS, BITS = 16, 26
LOW31 = (1 << 31) - 1
#: Added to the hashed place once a round.
STEP = 40_503_769


def key_parts(key: Column) -> list[Column]:
    """Four numbers of BITS bits from the md5 of a text."""
    h = F.md5(key)
    return [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << BITS) - 1)) for k in range(4)]


def _places(x: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    for r in range(ROUNDS):
        y = ((((a * (2 * r + 1) + b) * (c + r)) >> 3) % n - x) % n
        t = np.maximum(x, y)
        m = (t & LOW31) + d + STEP * r
        m = ((m * m >> 16) & LOW31) + (t >> 31) + c
        x = np.where((m * m >> 21) & 1 == 1, y, x)
    return x


def group_places(x: np.ndarray, g: np.ndarray, n: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """_places of x, where row i is of group g[i]; n and the four parts of a key are by group, so that the groups' own numbers are made once."""
    of = (lambda v: v[0]) if len(n) == 1 else (lambda v: v[g])
    a, b, c, d = parts
    size, own, add = of(n), of(c), of(d)
    for r in range(ROUNDS):
        y = of((((a * (2 * r + 1) + b) * (c + r)) >> 3) % n) - x
        y += size * (y < 0)
        t = np.maximum(x, y)
        m = (t & LOW31) + (add + STEP * r)
        m *= m
        m >>= 16
        m &= LOW31
        m += (t >> 31) + own
        m *= m
        x = np.where(m >> 21 & 1 == 1, y, x)
    return x


def text_parts(keys: list[str]) -> np.ndarray:
    """key_parts of texts: four rows of numbers."""
    h = [md5(x.encode()).digest() for x in keys]
    return np.frombuffer(b"".join(h), dtype=">u4").reshape(-1, 4).T.astype(np.int64) & (1 << BITS) - 1


@F.pandas_udf(LongType())
def _place(x: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(_places(*(s.to_numpy() for s in (x, n, a, b, c, d))))


def permuted(df: DataFrame, index: str, n: str, key: Column, name: str) -> DataFrame:
    """df with the place to which the permutation of a key sends index, one of 0..n-1.

    Swap or not: a round pairs x with (k - x) mod n, k being the round's own number, and one bit of a hash of the larger of
    the two (squared twice, the middle bits kept) says whether they change places. Each round is its own inverse, so the
    whole is one to one on any n, and each row is computed by itself, nothing is sorted. The rounds run on whole Arrow
    batches: as column expressions their many aliases make Catalyst's constraints of a join grow without bound.
    """
    return df.withColumn(name, _place(F.col(index).cast("long"), F.col(n).cast("long"), *key_parts(key)))


def permuted_sql(rows: str, index: str, n: str, key: str, name: str) -> str:
    """The same in SQL: a query over the rows of `rows`, with the column `name`."""
    part = lambda k: f"(('0x' || substr(_h, {1 + 8 * k}, 8))::BIGINT & {(1 << BITS) - 1})"
    q = f"SELECT * EXCLUDE (_h), {', '.join(f'{part(k)} AS _k{k}' for k in range(4))}, {index}::BIGINT AS _x FROM (SELECT *, md5({key}) AS _h FROM {rows})"
    for r in range(ROUNDS):
        k = f"((((_k0 * {2 * r + 1} + _k1) * (_k2 + {r})) >> 3) % {n})"
        q = f"SELECT *, greatest(_x, _y) AS _t FROM (SELECT *, (({k} - _x) % {n} + {n}) % {n} AS _y FROM ({q}))"
        q = f"SELECT *, (((_t & {LOW31}) + _k3 + {STEP * r}) * ((_t & {LOW31}) + _k3 + {STEP * r}) >> 16) & {LOW31} AS _m FROM ({q})"
        q = f"SELECT * EXCLUDE (_x, _y, _t, _m), CASE WHEN (((_m + (_t >> 31) + _k2) * (_m + (_t >> 31) + _k2)) >> 21) & 1 = 1 THEN _y ELSE _x END AS _x FROM ({q})"
    return f"SELECT * EXCLUDE (_x, _k0, _k1, _k2, _k3), _x AS {name} FROM ({q})"
