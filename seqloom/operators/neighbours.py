"""Counts of neighbouring words by stream, summed in Arrow batches before and after one shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Words that a task counts at once; bytes of text for each bucket of pairs.
HELD, BUCKET = 1 << 21, 1 << 23


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] numbers), then those of starts[1], ..."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _counted(streams: pa.Array, words: pa.ListArray, share: float, buckets: int) -> pa.RecordBatch:
    """bucket, rows: the pairs of these documents summed, each bucket's as an Arrow stream."""
    sizes = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    code, kinds = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    own = streams.dictionary_encode(null_encoding="encode")
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pos = _ranges(np.zeros(len(sizes), dtype=np.int64), sizes)
    cut = np.minimum(np.maximum(np.floor(sizes * share).astype(np.int64), 4), sizes - 2)[doc]
    train, test = pos + 1 < cut, pos >= cut
    at = np.flatnonzero((sizes[doc] >= 6) & (pos + 1 < sizes[doc]) & (train | test))
    key = (own.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc[at]] * kinds + code[at]) * kinds + code[at + 1]
    key, n = np.unique(key * 2 + test[at], return_counts=True)
    test, key = key & 1, key >> 1
    first = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(first):
        return pa.RecordBatch.from_pydict({"bucket": pa.array([], pa.int64()), "rows": pa.array([], pa.binary())})
    tr, te = np.add.reduceat(n * (1 - test), first), np.add.reduceat(n * test, first)
    key = key[first]
    f, t = key // kinds % kinds, key % kinds
    sums = (pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) >> 32).astype(np.int64)
    bucket = (sums[f] * 31 + sums[t] * 17 >> 3) % buckets
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    table = pa.RecordBatch.from_pydict({
        "stream": own.dictionary.take(pa.array((key // kinds // kinds)[order])), "from": coded.dictionary.take(pa.array(f[order])), "to": coded.dictionary.take(pa.array(t[order])),
        "tr": pa.array(tr[order]), "count": pa.array(te[order]),
    })
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = []
    for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_batch(table.slice(a, b - a))
        rows.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[starts]), "rows": pa.array(rows, pa.binary())})


def _summed(messages: pa.ChunkedArray) -> pa.Table:
    """stream, from, to, tr, count, known of a bucket: sums, and the streams that have the pair in training."""
    parts = pa.concat_tables([pa.ipc.open_stream(m.as_buffer()).read_all() for m in messages])
    got = parts.group_by(["from", "to", "stream"]).aggregate([("tr", "sum"), ("count", "sum")]).combine_chunks()
    f, t = (got[c].combine_chunks().dictionary_encode() for c in ("from", "to"))
    _, pair = np.unique(f.indices.to_numpy().astype(np.int64) * len(t.dictionary) + t.indices.to_numpy(), return_inverse=True)
    trained = np.flatnonzero(got["tr_sum"].to_numpy() > 0)
    trained = trained[np.argsort(pair[trained], kind="stable")]
    sizes = np.bincount(pair[trained], minlength=pair.max() + 1)
    starts = np.cumsum(sizes) - sizes
    each = sizes[pair] * (got["count_sum"].to_numpy() > 0)
    of = _ranges(starts[pair], each)
    known = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), got["stream"].combine_chunks().take(pa.array(trained[of])))
    return pa.table({"stream": got["stream"], "from": got["from"], "to": got["to"], "tr": got["tr_sum"], "count": got["count_sum"], "known": known})


def split_pairs(docs: DataFrame, size: int, share: float) -> DataFrame:
    """stream, from, to, tr, count, known of docs(stream, w): how often each pair of neighbours occurs in training and in test.

    The first `share` of a document's words train (see split_point); documents of under six have no pairs. known are the
    streams with the pair in training, told where it occurs in test. A task sums the pairs of HELD words as numbers of its own vocabulary; what is left
    goes to buckets by both words, one row a bucket, and each bucket is summed again. All rows of a pair are in one bucket;
    `size`, the bytes of all texts, sets their number, so that a bucket doesn't grow with the input.
    """
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            return _counted(whole["stream"].combine_chunks(), whole["w"].combine_chunks(), share, buckets)

        for b in batches:
            b = b.filter(pc.is_valid(b["w"]))
            ends = b["w"].offsets.to_numpy() if len(b) else np.zeros(1, dtype=np.int64)
            a = 0
            while a < len(b):
                z = max(a + 1, int(np.searchsorted(ends, ends[a] + HELD - n, side="right")) - 1)
                held.append(b.slice(a, z - a))
                n += int(ends[z] - ends[a])
                a = z
                if n >= HELD or a < len(b):
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    moved = docs.select("stream", "w").mapInArrow(told, "bucket long, rows binary")
    kind = docs.schema["stream"].dataType.simpleString()
    return moved.groupBy("bucket").applyInArrow(lambda t: _summed(t["rows"]), f"stream {kind}, from string, to string, tr long, count long, known array<{kind}>")
