"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed byte n-grams of unit length. Each language has several centroids, from clustering
its own training vectors by cosine; a text gets the language of the centroid nearest by cosine, and is rejected if it
is farther from it than nearly all training texts of that centroid are.

The fit sees at most `per_lang` rows of each language and about `in_all` of all languages (16 KB each), chosen by a hash of
the key; vectors are made in tasks.

Defined results: a null text or one without a letter is `und` with score 0; rows whose lang is null teach nothing; with
nothing to learn from, every text is `und`; texts are read whole; repeated rows and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import as_bytes, slices

#: Hash buckets of n-grams, lengths of n-grams.
DIM, GRAMS = 4096, (2, 3)
UND = "und"

#: Bytes of a text beyond which it is counted in pieces.
LONG = 1 << 20


def counts(texts: list[bytes]) -> np.ndarray:
    """texts x DIM: how often each bucket's n-grams occur in the lower-cased bytes. No n-gram reaches over a text's end.

    Long texts are counted in pieces, each with the start of the next; what lies in that start alone is counted once less.
    """
    if any(len(t) > LONG for t in texts):
        return np.concatenate([counts([t]) if len(t) <= LONG else _long_counts(t) for t in texts])
    n = len(texts)
    gap = b"\0" * (max(GRAMS) - 1)
    buf = np.frombuffer(gap.join([*(t.lower() for t in texts), b""]) + gap, np.uint8)
    lengths = np.array([len(t) + len(gap) for t in texts])
    base = np.repeat(np.arange(n, dtype=np.int64) * DIM, lengths)
    out = np.zeros(n * DIM, np.int64)
    total = len(base)
    code = buf[:total].astype(np.uint32)
    start = buf[:total] != 0
    for k in range(1, max(GRAMS)):
        code = code * np.uint32(257) + buf[k : total + k]
        if k + 1 in GRAMS:
            whole = start & (buf[k : total + k] != 0)
            bucket = (code * np.uint32(2654435761 + 2 * k)) >> np.uint32(32 - DIM.bit_length() + 1)
            out += np.bincount((base + bucket)[whole], minlength=n * DIM)
    return out.reshape(n, DIM)


def _long_counts(text: bytes) -> np.ndarray:
    out, over = np.zeros((1, DIM), np.int64), max(GRAMS) - 1
    step = LONG - over
    for at in range(0, len(text), step):
        out += counts([text[at : at + step + over]])
        if at + step < len(text):
            out -= counts([text[at + step : at + step + over]])
    return out


def weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count).astype(np.float32) * idf
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]


@dataclass
class Centroids:
    langs: list[str]
    of: np.ndarray
    points: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def nearest(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        near = weighted(counts(texts), self.idf) @ self.points.T
        at = near.argmax(1)
        score = np.clip(near[np.arange(len(at)), at], 0, 1).astype(float)
        return [self.langs[self.of[i]] for i in at], score, score < self.least[at]


def clustered(v: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; starts from the mean's nearest row and then the row that is farthest from all chosen."""
    first = int((v @ v.mean(0)).argmax())
    chosen = [first]
    near = v @ v[first]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    points = v[chosen]
    for _ in range(rounds):
        own = (v @ points.T).argmax(1)
        points = np.stack([v[own == j].mean(0) if (own == j).any() else points[j] for j in range(len(points))])
        points /= np.maximum(np.linalg.norm(points, axis=1), 1e-12)[:, None]
    return points, (v @ points.T).argmax(1)


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 300, in_all: int = 4_000, clusters: int = 4, tail: float = 0.01) -> Centroids | None:
    """Centroids from at most per_lang rows a language, of those where learn holds."""
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(key, text).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    totals = rows.groupBy("lang").count().withColumn("cut", F.lit(-(2.0**63)) + F.least(F.lit(1.0), F.lit(1.5 * per_lang) / F.col("count") + F.lit(0.0)) * F.lit(2.0**64))
    totals = totals.withColumn("most", F.greatest(F.lit(1), F.least(F.lit(per_lang), F.floor(F.lit(in_all) / F.count("*").over(Window.partitionBy())))))  # one row for each language
    few = rows.join(F.broadcast(totals.select("lang", "cut", "most")), "lang").filter(F.col("h") <= F.col("cut"))  # a row for each language, all of which the model holds as well
    best = Window.partitionBy("lang").orderBy("h", F.md5("text"))
    few = few.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= F.col("most")).select("lang", "rank", "text")

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20, 256):
            raw = counts(as_bytes(batch.column("text"))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array([r.tobytes() for r in raw], pa.binary())], ["lang", "rank", "raw"])

    got = few.mapInArrow(vectors, "lang string, rank int, raw binary").toPandas().sort_values(["lang", "rank"])
    if not len(got):
        return None
    raw = np.stack([np.frombuffer(x, np.int32) for x in got["raw"]])
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 1).astype(np.float32)
    v, names = weighted(raw, idf), got["lang"].to_numpy()
    langs = sorted(set(names))
    of, points, least = [], [], []
    for i, name in enumerate(langs):
        mine = v[names == name]
        p, own = clustered(mine, clusters)
        for j in range(len(p)):
            near = (mine[own == j] @ p[j]) if (own == j).any() else np.zeros(1)
            of.append(i)
            least.append(float(np.quantile(near, tail)) - 0.05)
        points.append(p)
    return Centroids(langs, np.array(of), np.concatenate(points).astype(np.float32), np.array(least), idf)


def identify(docs: DataFrame, model: Centroids | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred (nearest language, `und` without letters), score (cosine), rejected (too far from every centroid)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20, 512):
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            names, score, far = model.nearest(as_bytes(batch.column("text"))) if model else ([UND] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool))
            names = [n if x else UND for n, x in zip(names, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(names), pa.array(np.where(letters, score, 0.0)), pa.array(far | ~letters)], ["key", "lang_pred", "score", "rejected"])

    kind = docs.schema[key].dataType.simpleString()
    t = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("key"), t.alias("text"), F.coalesce(t.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)
