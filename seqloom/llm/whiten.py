"""Whitening of embeddings: Welford's updates within partitions, merged across them, then a symmetric QR eigen-solve.

Vectors become whole numbers, floor(scale * c). Each different one is fitted once. A task goes through its vectors and
updates (n, sums, squares about the mean): vector k adds the rank-one matrix (k - 1) / k * outer(x - mean, x - mean), mean
being that of the k - 1 vectors before it; the rank-one terms of a batch are summed by one product of matrices. States are
merged by the formula for two parts in levels of at most FAN states a task, so neither a task nor the driver gets more than
FAN matrices, whatever the number of partitions. Running sums are exact integers.

Defined results: vectors that are null or hold a null or a number that isn't finite have no rows; vectors of different
lengths are whitened apart, each length with its own n; components whose eigenvalue is nothing beside the largest (one
vector, fewer vectors than dimensions) have no rows; an empty table gives an empty result; keys may repeat or be null;
deviations beyond 64 bits are exact in their decimal column.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .eigen import symmetric_qr

#: States that one task merges.
FAN = 16
#: Numbers of a batch that a product of matrices takes at once.
CELLS = 1 << 20
#: An eigenvalue below this part of the largest, times the dimensions, counts as none.
TINY = 1e-12


def finite(v: Column) -> Column:
    inside = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(inside, F.lit(False))


def as_whole(v: Column, scale: int) -> Column:
    """floor(scale * c) of every entry, as longs."""
    return F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


class State:
    """n vectors, their sums (exact) and the matrix of products about their mean."""

    def __init__(self, n: int, sums: list[int], squares: np.ndarray):
        self.n, self.sums, self.squares = n, sums, squares

    @classmethod
    def empty(cls, d: int) -> State:
        return cls(0, [0] * d, np.zeros((d, d)))

    def update(self, x: np.ndarray) -> None:
        """Welford's updates with the rows of x (n, d)."""
        k = self.n + np.arange(1, len(x) + 1, dtype=float)[:, None]
        if x.dtype.kind == "i":
            upto = np.cumsum(x, axis=0)  # of whole numbers, so exact
            before = np.array(self.sums, float) + (upto - x)
            self.sums = [a + int(b) for a, b in zip(self.sums, upto[-1], strict=True)]
        else:
            before = np.array(self.sums, float) + np.cumsum(x, axis=0) - x
            self.sums = [a + b for a, b in zip(self.sums, x.sum(axis=0).tolist(), strict=True)]
        delta = x - before / np.maximum(k - 1, 1)
        self.squares += (delta * ((k - 1) / k)).T @ delta
        self.n += len(x)

    def merge(self, other: State) -> State:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = np.array([b / other.n - a / self.n for a, b in zip(self.sums, other.sums, strict=True)])
        return State(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.squares + other.squares + np.outer(apart, apart) * (self.n * other.n / n))

    def packed(self, d: int, part: int) -> tuple:
        return d, part, self.n, [str(s) if isinstance(s, int) else repr(s) for s in self.sums], self.squares.tobytes()

    @classmethod
    def unpacked(cls, row) -> State:
        d = len(row.sums)
        return cls(int(row.n), [int(s) if s.lstrip("-").isdigit() else float(s) for s in row.sums], np.frombuffer(row.squares).reshape(d, d).copy())


STATE = "d int, part int, n long, sums array<string>, squares binary"
NAMES = ["d", "part", "n", "sums", "squares"]
ARROW = pa.schema([("d", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("squares", pa.binary())])


def matrices(batches: Iterable[pa.RecordBatch], of: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows by the length of their vector, in pieces of CELLS numbers, with the vectors as a matrix."""
    for batch in batches:
        sizes = np.asarray(batch.column(of).value_lengths().to_numpy(zero_copy_only=False), np.int64)
        for d in np.unique(sizes):
            own = batch if (sizes == d).all() else batch.take(pa.array(np.flatnonzero(sizes == d)))
            rows = max(1, CELLS // max(1, int(d)))
            for at in range(0, own.num_rows, rows):
                piece = own.slice(at, rows)
                yield piece, piece.column(of).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, int(d))


def folded(vectors: DataFrame, of: str, seen_by: dict[int, Whitening] | None = None) -> DataFrame:
    """One state for each partition and vector length d: of the vectors, or of what seen_by[d] makes of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, State] = {}
        for _, x in matrices(batches, of):
            d = x.shape[1]
            if seen_by is not None:
                if d not in seen_by or not len(seen_by[d].values):
                    continue
                x = seen_by[d].project(x)
            states.setdefault(d, State.empty(x.shape[1])).update(x)
        part = TaskContext.get().partitionId()
        if states:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([s.packed(d, part) for d, s in states.items()], columns=NAMES), ARROW, preserve_index=False)

    return vectors.select(of).mapInArrow(run, STATE)


def merged(states: DataFrame) -> DataFrame:
    """One state for each vector length, merged in levels of FAN states."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for row in own.sort_values("part").itertuples():
            whole = State.unpacked(row) if whole is None else whole.merge(State.unpacked(row))
        return pd.DataFrame([whole.packed(int(own["d"].iloc[0]), int(own["part"].iloc[0]))], columns=NAMES)

    states = cut(states, "states")
    last = states.agg(F.max("part").alias("part")).first()["part"] or 0
    while last > 0:
        states = states.withColumn("part", F.expr(f"part div {FAN}").cast("int")).groupBy("d", "part").applyInPandas(one, STATE)
        last //= FAN
    return states


@dataclass
class Whitening:
    """Of the vectors of one length: how many, sums, unit components as rows, their eigenvalues, trace, error of the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array([s / self.n for s in self.sums])) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum over dimensions of (n x - S)^2, exact: n^2 x.x - 2 n x.S + S.S, S in three pieces that keep products in 64 bits."""
        n, total = self.n, sum(s * s for s in self.sums)
        if len(x) and (int(x.max(initial=0)) >= 1 << 24 or int(x.min(initial=0)) < -(1 << 24) or x.shape[1] > 1 << 14):
            return [sum((n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x]
        pieces = [np.array([(s >> shift) & ((1 << 24) - 1) if shift < 48 else s >> 48 for s in self.sums], np.int64) for shift in (0, 24, 48)]
        low, mid, high = (x @ p for p in pieces)
        own = (x * x).sum(axis=1)
        return [n * n * int(q) - 2 * n * (int(a) + (int(b) << 24) + (int(c) << 48)) + total for q, a, b, c in zip(own, low, mid, high, strict=True)]


def fit(vectors: DataFrame, of: str = "x", most: int = 4) -> dict[int, Whitening]:
    """By vector length, from a table whose vectors (of whole numbers) are all different. One matrix a length comes to the driver."""
    out = {}
    for row in merged(folded(vectors, of)).toLocalIterator():
        state = State.unpacked(row)
        values, own = symmetric_qr(state.squares / state.n)
        keep = [k for k in range(min(most, len(values))) if values[k] > max(TINY * len(values) * values[0], 0)]
        out[row.d] = Whitening(state.n, state.sums, own[keep], values[keep], float(np.trace(state.squares) / state.n))
    for row in merged(folded(vectors, of, out)).toLocalIterator():
        state = State.unpacked(row)
        out[row.d].identity_error = float(np.abs(state.squares / state.n - np.eye(len(state.sums))).max())
    return out


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256, most: int = 4) -> DataFrame:
    """key, component (from 1), n, deviation (decimal), whitened, explained, identity_error for each row that can be whitened."""
    usable = rows.filter(finite(F.col(vector))).select(F.col(key).alias("key"), as_whole(F.col(vector), scale).alias("x"))
    model = fit(cut(usable.select("x").filter("size(x) > 0").distinct(), "vectors"), "x", most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, "x"):
            m = model.get(x.shape[1])
            k = len(m.values) if m is not None else 0
            if not k:
                continue
            times = np.repeat(np.arange(batch.num_rows), k)
            far = pa.array([str(v) for v in m.deviations(x)]).take(pa.array(times))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(len(times), m.n, np.int64)), far,
                    pa.array(m.project(x).ravel()), pa.array(np.tile(m.values / m.trace, batch.num_rows)), pa.array(np.full(len(times), m.identity_error)),
                ],
                ["key", "component", "n", "far", "whitened", "explained", "identity_error"],
            )

    kind = dict(usable.dtypes)["key"]
    out = usable.mapInArrow(run, f"key {kind}, component int, n long, far string, whitened double, explained double, identity_error double")
    return out.select(F.col("key").alias(key), "component", "n", F.col("far").try_cast("decimal(38,0)").alias("deviation"), "whitened", "explained", "identity_error")
