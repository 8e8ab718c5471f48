"""Exact dedup through a log-structured merge index.

Each task fills memtables of digests. A full memtable is flushed as a sorted run: per digest one entry with the
smallest identifier and the number of rows, cut by digest prefix into buckets, each flushed with its Bloom filter.
Compaction merges a bucket's runs two by two, smallest first: entries that the other run's filter doesn't claim are
passed on, claimed ones are looked up, and of equal digests the smallest identifier stays. Every run is then told what became
of its entries, so that a digest of a third of all rows is joined run by run, never in one place. Rows that share a
digest are hits; their bytes are compared with those of the row that stays, in groups salted by their size, and
rows that differ (a collision) are grouped anew by their bytes.

Identifiers order rows by what stays: most code points in the text first, then smallest key. A row is found again by its
key and a hash of its text, so that repeated and null keys multiply nothing.

Defined results: a null text counts as empty, and all texts without other than white space are equal; repeated keys
are rows of their own; a null key counts as the largest and comes back as null; an empty table gives an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import release
from .common import WS, WS_CLASS, cut, marked, n_parts, prefiltered

#: Rows that a memtable holds before it is flushed.
MEMTABLE = 1 << 17
#: Entries that a bucket should have at most.
BUCKET = 500_000
#: Members of a group that are compared with one copy of the text that stays.
SALT = 64
BITS, PROBES = 10, 3
#: Stands for a null key, which so comes last of all.
NO_KEY = (1 << 63) - 1


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _probes(digests: np.ndarray, n_bits: int) -> np.ndarray:
    """n x PROBES bit positions; digests are uniform already, so two of their words make all probes."""
    words = digests.view(np.dtype((np.uint64, digests.dtype.itemsize // 8))).reshape(len(digests), -1)
    with np.errstate(over="ignore"):
        return (words[:, -1:] + words[:, -2 if words.shape[1] > 1 else -1 :][:, :1] * np.arange(1, 2 * PROBES, 2, dtype=np.uint64)) % np.uint64(n_bits)


def bloom(digests: np.ndarray, n_bits: int) -> np.ndarray:
    bits = np.zeros(n_bits, bool)
    if len(digests):
        bits[_probes(digests, n_bits).ravel()] = True
    return np.packbits(bits)


def claimed(digests: np.ndarray, packed: np.ndarray, n_bits: int) -> np.ndarray:
    if not len(digests):
        return np.zeros(0, bool)
    return np.unpackbits(packed)[_probes(digests, n_bits).astype(np.int64)].all(axis=1)


class Run:
    """Entries sorted by digest: rows, and length and key of the smallest identifier; and their Bloom filter."""

    def __init__(self, digests: np.ndarray, rows: np.ndarray, length: np.ndarray, key: np.ndarray, filter: np.ndarray | None = None):
        self.digests, self.rows, self.length, self.key = digests, rows, length, key
        self.n_bits = max(64, BITS * len(digests) // 8 * 8)
        self.filter = bloom(digests, self.n_bits) if filter is None else filter

    @classmethod
    def flush(cls, digests: np.ndarray, length: np.ndarray, key: np.ndarray) -> Run:
        order = np.lexsort((key, -length, digests))
        digests, length, key = digests[order], length[order], key[order]
        first = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]]) if len(digests) else np.zeros(0, np.int64)
        return cls(digests[first], np.diff(np.r_[first, len(digests)]), length[first], key[first])

    def merge(self, other: Run) -> Run:
        maybe = np.flatnonzero(claimed(self.digests, other.filter, other.n_bits))
        at = np.searchsorted(other.digests, self.digests[maybe])
        real = at < len(other.digests)
        real[real] = other.digests[at[real]] == self.digests[maybe[real]]
        mine, theirs = maybe[real], at[real]
        rows, length, key = (np.array(x) for x in (other.rows, other.length, other.key))
        rows[theirs] += self.rows[mine]
        less = (self.length[mine] > length[theirs]) | ((self.length[mine] == length[theirs]) & (self.key[mine] < key[theirs]))
        length[theirs[less]], key[theirs[less]] = self.length[mine[less]], self.key[mine[less]]
        new = np.ones(len(self.digests), bool)
        new[mine] = False
        to = np.searchsorted(other.digests, self.digests[new])
        return Run(*(np.insert(b, to, a[new]) for a, b in ((self.digests, other.digests), (self.rows, rows), (self.length, length), (self.key, key))))


def compact(runs: list[Run]) -> Run:
    """Size-tiered: the two smallest runs are merged until one is left, so an entry is copied about log2(runs) times."""
    queue = [(len(r.digests), k, r) for k, r in enumerate(runs)]
    heapify(queue)
    while len(queue) > 1:
        one, two = heappop(queue)[2], heappop(queue)[2]
        merged = one.merge(two)
        heappush(queue, (len(merged.digests), len(runs) + len(queue), merged))
    return queue[0][2]


ENTRY = "run string, bucket long, digests binary, row_counts binary, lengths binary, keys binary, filter binary"


def digest_rows(docs: DataFrame, key: str, text: str, digest: Callable[[bytes], bytes], memtable: int) -> DataFrame:
    """key, t (hash of the text), digest, length, run: rows leave in the order of their run's digests."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            held.sort()
            seq += 1
            d, n, k, t = zip(*held, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(t, pa.int64()), pa.array(d, pa.binary()), pa.array(n, pa.int64()), pa.array([f"{part}-{seq}"] * len(d))], ["key", "t", "digest", "length", "run"])
            held.clear()
            return out

        for batch in batches:
            texts = batch.column("text")
            lengths = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_pylist()
            for k, t, x, n in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist(), texts.cast(pa.binary()).to_pylist(), lengths, strict=True):
                held.append((digest((x or b"").translate(None, WS)), n, k, t))
                if len(held) >= memtable:
                    yield flush()
        if held:
            yield flush()
        release()

    return _texts(docs, key, text).mapInArrow(run, "key long, t long, digest binary, length long, run string")


def _flushed(rows: DataFrame, n_buckets: int) -> DataFrame:
    """The index's first level: the runs of every memtable, cut by bucket. A run's rows follow each other, in any batches."""

    def of_run(name: str, own: pd.DataFrame) -> pd.DataFrame:
        d = own["digest"].to_numpy()
        digests = np.array(d, dtype=f"V{len(d[0])}")
        words = np.frombuffer(b"".join(x[:8].ljust(8, b"\0") for x in d), ">u8")
        buckets = (words % np.uint64(n_buckets)).astype(np.int64)
        length, key = own["length"].to_numpy(), own["key"].to_numpy()
        order = np.argsort(buckets, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(buckets[order]) != 0, True])
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            r = Run.flush(as_bytes(digests[at]), length[at], key[at])
            out.append((name, buckets[at[0]], r.digests.tobytes(), r.rows.astype(np.int64).tobytes(), r.length.astype(np.int64).tobytes(), r.key.astype(np.int64).tobytes(), r.filter.tobytes()))
        return pd.DataFrame(out, columns=["run", "bucket", "digests", "row_counts", "lengths", "keys", "filter"])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            for name, own in frame.groupby("run", sort=False):
                if held and held[0]["run"].iloc[0] != name:
                    yield of_run(held[0]["run"].iloc[0], pd.concat(held))
                    held = []
                held.append(own)
        if held:
            yield of_run(held[0]["run"].iloc[0], pd.concat(held))

    return rows.select("run", "digest", "length", "key").mapInPandas(run, ENTRY)


def as_bytes(digests: np.ndarray) -> np.ndarray:
    """Fixed-width bytes that numpy sorts and compares whole; S would drop zero bytes at the end, so each gets a last byte."""
    wide = digests.dtype.itemsize
    full = np.full((len(digests), wide + 8 - wide % 8), 1, np.uint8)
    full[:, :wide] = np.frombuffer(digests.tobytes(), np.uint8).reshape(-1, wide)
    return full.view(f"S{full.shape[1]}").ravel()


def _compacted(level0: DataFrame, wide: int) -> DataFrame:
    """run, digest, keep, size: what became of each entry of each run."""
    size = wide + 8 - wide % 8

    def one(bucket: pd.DataFrame) -> pd.DataFrame:
        runs = [Run(np.frombuffer(r.digests, f"S{size}"), *(np.frombuffer(x, np.int64) for x in (r.row_counts, r.lengths, r.keys)), np.frombuffer(r.filter, np.uint8)) for r in bucket.itertuples()]
        whole = compact(runs)
        out = []
        for name, r in zip(bucket["run"], runs, strict=True):
            at = np.searchsorted(whole.digests, r.digests)
            raw = r.digests.tobytes()
            out.append(pd.DataFrame({"run": name, "digest": [raw[i : i + wide] for i in range(0, len(raw), size)], "keep": whole.key[at], "size": whole.rows[at]}))
        return pd.concat(out).drop_duplicates(["run", "digest"])  # a run that lies in two input splits has two parts

    return level0.groupBy("bucket").applyInPandas(one, "run string, digest binary, keep long, size long")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[bytes], bytes] = sha256, memtable: int = MEMTABLE) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, digest of the text without white space.

    Equal means equal bytes after every white-space character is deleted; digest may be any function with outputs of
    one length, for results never rest on it alone.
    """
    spark = docs.sparkSession
    wide = len(digest(b""))
    rows = cut(digest_rows(docs, key, text, digest, memtable), "digests")
    n_buckets = max(n_parts(spark), rows.count() // BUCKET)
    fate = _compacted(_flushed(rows, n_buckets), wide)
    told = cut(rows.join(fate, ["run", "digest"]).select("key", "t", "digest", "keep", "size", "length"), "fates")
    hits = told.filter("size > 1")
    # Byte verification: a group's own size says among how many salts it is dealt.
    at = ["key", "t"]
    texts = _texts(docs, key, text)
    norm = hits.distinct().join(prefiltered(texts, hits, at).dropDuplicates(at), at).withColumn("norm", F.regexp_replace("text", WS_CLASS, "")).drop("text")
    salts = F.ceil(F.col("size") / SALT)
    found = norm.select(*at, "digest", "keep", "norm", F.pmod(F.xxhash64(*at), salts).alias("salt"))
    stays = norm.filter("key = keep").groupBy("digest", "keep", "size").agg(F.min("norm").alias("base"))
    stays = stays.select("digest", "keep", "base", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    differ = cut(found.join(stays, ["digest", "keep", "salt"]).filter(F.col("norm") != F.col("base")).select("digest").distinct(), "collisions")
    out = told.select("key", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("key") == F.col("keep")).alias("kept"), "digest")
    if not differ.isEmpty():
        out = _regrouped(told, differ, texts)
    return out.withColumns({c: F.when(F.col(c) != NO_KEY, F.col(c)) for c in ("key", "keep_id")}).withColumnRenamed("key", key)


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_KEY)).alias("key")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(_key(key), F.xxhash64(t).alias("t"), t.alias("text"))


def _regrouped(told: DataFrame, bad: DataFrame, texts: DataFrame) -> DataFrame:
    """Groups with a collision are grouped by their bytes; only their rows move."""
    at = ["key", "t"]
    again = told.join(bad, "digest", "left_semi")
    again = again.join(prefiltered(texts, again, at).dropDuplicates(at), at).withColumn("norm", F.regexp_replace("text", WS_CLASS, "")).drop("text")
    best = again.groupBy("norm").agg(F.min(F.struct(-F.col("length"), F.col("key"))).getField("key").alias("keep"), F.count("*").alias("size"))
    redone = again.drop("keep", "size").join(best, "norm")
    both = told.join(bad, "digest", "left_anti").select("key", "keep", "size", "digest").unionByName(redone.select("key", "keep", "size", "digest"))
    return both.select("key", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("key") == F.col("keep")).alias("kept"), "digest")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns. Of rows that repeat key and text one stays.

    Rows that certainly stay, by their key's hash bucket, are never shuffled.
    """
    groups = exact_groups(docs, key, text).select(_key(key), "digest", "kept").groupBy("key", "digest").agg(F.count("*").alias("times"), F.max("kept").alias("kept"))
    moved = cut(groups.filter("times > 1 or not kept"), "not-alone")
    rows = marked(docs.select(F.struct("*").alias("row"), _key(key), F.col(text).cast("string").alias("text")), moved, ["key"], "maybe")
    alone = rows.filter("not maybe").select("row")
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), WS_CLASS, "")
    rows = rows.filter("maybe").select("row", "key", "text", F.unhex(F.sha2(norm, 256)).alias("digest"))
    rows = rows.join(moved, ["key", "digest"], "left")
    first = F.min_by("row", F.struct(-F.length("text"), "text", F.xxhash64("row")))
    twice = rows.filter("kept and times > 1").groupBy("key", "digest").agg(first.alias("row"))
    return alone.unionByName(rows.filter("kept IS NULL").select("row")).unionByName(twice.select("row")).select("row.*")
