"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector. Learned filters of 8 bytes run over the whole text at every fourth byte; overlapping
chunks of 256 bytes, one every 192, keep each filter's maximum. A hidden layer sees each chunk; the mean and the maximum
of its outputs over all chunks give one probability.

The fit sees at most `per_class` labelled rows of each class, chosen by a hash of the key, none of them above `most_bytes`
(so the driver holds a bounded sample), and runs with a fixed seed. Scores are of whole texts.

Defined results: null and empty texts are scored as a text of padding; rows without a label teach nothing; with only one
class to learn from, every score is that class; a key with several labels has the smallest, one with several texts teaches
the one with the smallest hash; texts are read whole; repeated rows and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import release

#: Bytes between filter positions, filter positions in a block, blocks in a chunk, blocks between chunks.
STEP, BLOCK, CHUNK, MOVE = 4, 16, 4, 3
#: Size of a byte's vector, filters, hidden units.
EMBED, FILTERS, HIDDEN = 6, 24, 16
#: Bytes of a text beyond which it is scored in pieces.
LONG = 1 << 20
#: Steps that a fit takes at least, however few rows it has.
LEAST_STEPS = 400


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer, each padded with zeros to whole blocks; their first blocks and numbers of blocks."""
    size = STEP * BLOCK
    blocks = np.array([(len(t) + STEP + size - 1) // size for t in texts])
    return np.frombuffer(b"".join(t + b"\0" * (n * size - len(t)) for t, n in zip(texts, blocks, strict=True)), np.uint8), np.cumsum(blocks) - blocks, blocks


def chunked(first: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of each chunk, and each text's first chunk. Chunks at the end repeat the text's last block."""
    n = np.maximum(1, -(-(blocks - 1) // MOVE))
    starts = np.cumsum(n) - n
    text = np.repeat(np.arange(len(n)), n)
    at = (np.arange(n.sum()) - starts[text]) * MOVE
    return first[text, None] + np.minimum(at[:, None] + np.arange(CHUNK), blocks[text, None] - 1), starts


class ConvNet:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        wide = STEP * EMBED
        self.w = {
            "embed": r.normal(0, 0.5, (256, EMBED)), "near": r.normal(0, wide**-0.5, (wide, FILTERS)), "next": r.normal(0, wide**-0.5, (wide, FILTERS)), "bias": np.zeros(FILTERS),
            "hidden": r.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)), "hidden_bias": np.zeros(HIDDEN), "out": r.normal(0, 0.2, 2 * HIDDEN), "out_bias": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def forward(self, texts: list[bytes]) -> dict:
        w = self.w
        raw, first, blocks = packed(texts)
        x = w["embed"][raw].reshape(-1, STEP * EMBED)
        y = x @ w["near"]
        y[:-1] += x[1:] @ w["next"]
        y += w["bias"]
        np.maximum(y, 0, out=y)
        y[(first + blocks) * BLOCK - 1] = 0  # the only position that would look into the next text
        peak = y.reshape(-1, BLOCK, FILTERS).max(1)
        idx, starts = chunked(first, blocks)
        pooled = peak[idx].max(1)
        h = np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0)
        n = np.diff(np.r_[starts, len(h)])
        both = np.hstack([np.add.reduceat(h, starts) / n[:, None], np.maximum.reduceat(h, starts)])
        z = both @ w["out"] + w["out_bias"]
        return {"raw": raw, "x": x, "y": y, "peak": peak, "idx": idx, "starts": starts, "n": n, "pooled": pooled, "h": h, "both": both, "z": z}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = np.zeros(len(texts))
        short = [i for i, t in enumerate(texts) if len(t) <= LONG]
        if short:
            z[short] = self.forward([texts[i] for i in short])["z"]
        for i, t in enumerate(texts):
            if len(t) > LONG:
                z[i] = self._long(t)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _long(self, text: bytes) -> float:
        """forward() of one text, some chunks at a time: their mean and maximum need no more than one piece in memory."""
        w, size = self.w, STEP * BLOCK
        blocks = (len(text) + STEP + size - 1) // size
        n = max(1, -(-(blocks - 1) // MOVE))
        total, top, piece = np.zeros(HIDDEN), np.full(HIDDEN, -np.inf), max(1, LONG // (size * MOVE))
        for a in range(0, n, piece):
            b = min(n, a + piece)
            low, high = a * MOVE, min(blocks, (b - 1) * MOVE + CHUNK)
            raw = np.frombuffer(text[low * size : high * size + STEP].ljust((high - low) * size + STEP, b"\0"), np.uint8)
            x = w["embed"][raw].reshape(-1, STEP * EMBED)
            y = np.maximum(x[:-1] @ w["near"] + x[1:] @ w["next"] + w["bias"], 0)
            if high == blocks:
                y[-1] = 0
            peak = y.reshape(-1, BLOCK, FILTERS).max(1)
            idx = np.minimum((np.arange(a, b) - a)[:, None] * MOVE + np.arange(CHUNK), high - low - 1)
            h = np.maximum(peak[idx].max(1) @ w["hidden"] + w["hidden_bias"], 0)
            total += h.sum(0)
            top = np.maximum(top, h.max(0))
        return float(np.r_[total / n, top] @ w["out"] + w["out_bias"][0])

    def gradient(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(texts)
        dz = ((1 / (1 + np.exp(-np.clip(f["z"], -30, 30))) - labels) * weight / len(labels)).astype(np.float32)
        g = {"out": f["both"].T @ dz, "out_bias": dz.sum(keepdims=True)}
        d = dz[:, None] * w["out"]
        own = np.repeat(np.arange(len(f["n"])), f["n"])
        dh = (d[:, :HIDDEN] / f["n"][:, None])[own]
        top = f["h"] == f["both"][own, HIDDEN:]
        dh += d[own, HIDDEN:] * top / np.maximum(np.add.reduceat(top, f["starts"]), 1)[own]
        dh *= f["h"] > 0
        g |= {"hidden": f["pooled"].T @ dh, "hidden_bias": dh.sum(0)}
        dp = dh @ w["hidden"].T
        best = f["peak"][f["idx"]].argmax(1)  # chunk x filter: which of its blocks
        block = np.take_along_axis(f["idx"], best, 1)
        inside = f["y"].reshape(-1, BLOCK, FILTERS)[block, :, np.arange(FILTERS)].argmax(2)
        dy = np.zeros_like(f["y"])
        np.add.at(dy, (block * BLOCK + inside, np.arange(FILTERS)[None, :]), dp)
        dy *= f["y"] > 0
        g |= {"near": f["x"].T @ dy, "next": f["x"][1:].T @ dy[:-1], "bias": dy.sum(0)}
        dx = dy @ w["near"].T
        dx[1:] += dy[:-1] @ w["next"].T
        dx = dx.reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(f["raw"], dx[:, e], 256) for e in range(EMBED)], 1)
        return g

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int, batch: int = 32, rate: float = 4e-3) -> None:
        """Adam over shuffled batches; both classes weigh the same."""
        r = np.random.default_rng(11)
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        epochs = max(epochs, -(-LEAST_STEPS * batch // len(texts)))
        t, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), batch):
                at = order[a : a + batch]
                t += 1
                now = rate * (1 - 0.95 * t / total)
                for k, g in self.gradient([texts[i] for i in at], labels[at], weight[at]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1200, most_bytes: int = 1 << 17, epochs: int = 6, tries: int = 3) -> ConvNet | None:
    """A network from at most per_class rows of each class, of the labelled rows where learn holds.

    A fit that doesn't tell its own rows apart starts again from another seed, up to `tries` times; the best is kept.
    """
    marks = labels.filter(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("label")).filter(learn)
    marks = marks.withColumn("h", F.xxhash64(key))
    totals = marks.groupBy("label").count().withColumn("cut", F.lit(-(2.0**63)) + F.least(F.lit(1.0), F.lit(1.5 * per_class) / F.col("count")) * F.lit(2.0**64))
    best = Window.partitionBy("label").orderBy("h", key)
    few = marks.join(F.broadcast(totals.select("label", "cut")), "label").filter(F.col("h") <= F.col("cut"))  # two rows
    few = few.groupBy(key, "h").agg(F.min("label").alias("label")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_class).select(key, "label")
    rows = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= most_bytes)
    rows = rows.join(F.broadcast(few), key).groupBy(F.col(key).alias("key"), "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # 2 * per_class keys at most
    got = rows.toPandas().sort_values("key")
    if not len(got):
        return None
    texts, y = [t.encode() for t in got["text"]], got["label"].to_numpy().astype(np.float32)
    found, least = None, np.inf
    for seed in range(tries):
        net = ConvNet(7 + seed)
        net.train(texts, y, epochs)
        p = np.concatenate([net.scores(texts[a : a + 64]) for a in range(0, len(texts), 64)])
        loss = float(-np.mean(np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-6, 1))))
        if loss < least:
            found, least = net, loss
        if least < 0.1:
            break
    return found


def score(docs: DataFrame, net: ConvNet | None, key: str = "doc_id", text: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs and `name`: the probability of label 1, 0.5 where nothing was learned.

    Only the texts go to Python and only scores come back; the other columns stay where they are.
    """
    if name in docs.columns:
        raise ValueError(f"docs has a column named {name}; give another name")

    def scored(column: pd.Series) -> pd.Series:
        out = np.full(len(column), 0.5)
        at = 0
        while net and at < len(column):  # about 1 MB at a time
            texts, size = [], 0
            while at + len(texts) < len(column) and (not texts or size < 1 << 20):
                texts.append((column.iloc[at + len(texts)] or "").encode())
                size += len(texts[-1])
            out[at : at + len(texts)] = net.scores(texts)
            at += len(texts)
        return pd.Series(out)

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            yield scored(column)
        release()

    return docs.withColumn(name, F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(F.col(text).cast("string")))
