"""N-gram Jaccard join: prefix trees of globally ordered shingle sets.

1. A fixed-size count sketch of all shingles gives each one a rarity class. A shingle's token is its class before its
   hash, so that sorting tokens puts rare shingles first, in the same order everywhere.
2. Equal sets are one from here on. Two sets that reach the threshold share a token among their first
   n - ceil(t * n) + 1. One shuffle brings the sets of a token together; those without a partner there of a like size, or
   whose places leave too few tokens to share, drop out. A set meets another at their first common token.
3. There the sizes and the counts of tokens in 64 bins bound the overlap from above; sets without a possible partner
   leave. A token of many sets is dealt out in pairs of blocks, so that no task gets it whole. Tokens at which the very
   same sets are left are one meeting. There finer bins, whose number follows the set's size, test long sets once more.
4. The sets that are left come once to each of their meetings and go one by one through a prefix tree: sets share the overlap of
   their common beginning, and a subtree is left as soon as the tokens that remain can't bring the overlap that its
   smallest set needs. Sets that are known to be connected needn't be compared: what comes out are links that connect
   whatever the full join would, not all pairs.
5. The links' components give each document its class.

Shingles are told apart by 60 bits of their hashes; two different ones of the same class that share these bits count as one.

Defined results: null and empty texts have an empty set and are linked with nothing; a text of fewer words than a shingle
has one shingle, its whole sequence; rows that share a key share a class; null keys count as one largest key; texts are
read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import as_bytes, release, slices
from .common import cut, n_parts, prefiltered
from .components import components
from .shingles import WordHash, shingles

#: The sketch has 2 ** SKETCH counters, sent in parts of 2 ** PART.
SKETCH, PART = 20, 15
#: Bins of the overlap bound.
BINS = 64
#: Of the finer bins of a set's second test, about one for four tokens, there are so many at most.
FINE = 1 << 12
#: Sets of one token that meet in one task.
SET_BLOCK = 1024
#: Of a set's shared tokens so many go along, to tell whether two sets have met before.
FIRST = 16
NO_KEY = (1 << 63) - 1


def needed(a: int, b: int, percent: int) -> int:
    """The smallest intersection i of sets of a and b with 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _input(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.col(text).cast("string").alias("text"))


def sketch(rows: DataFrame, k: int) -> np.ndarray:
    """How many shingles of all texts fall to each counter: the same few MB for any table."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = WordHash(), np.zeros(1 << SKETCH, np.int64)
        for batch in slices(batches, "text"):
            for t in as_bytes(batch.column("text")):
                h = shingles(t, k, words)
                if len(h):
                    np.add.at(total, (h >> np.uint64(64 - SKETCH)).astype(np.int64), 1)
        words.clear()
        release()
        parts = [p.tobytes() for p in total.reshape(-1, 1 << PART)]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in frame["counts"])
        return pd.DataFrame({"part": frame["part"][:1], "counts": [total.tobytes()]})

    got = rows.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    out = np.zeros((1 << SKETCH - PART, 1 << PART), np.int64)
    for r in got:
        out[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def rarity(counts: np.ndarray) -> np.ndarray:
    """Class of each counter, 0 to 7: 0 up to four times the mean, then by doublings."""
    mean = max(1.0, counts.mean())
    return np.clip(np.log2(np.maximum(counts, 1) / mean) - 1, 0, 7).astype(np.uint64)


def ordered_set(text: bytes, k: int, words: WordHash, classes: np.ndarray) -> np.ndarray:
    h = shingles(text, k, words)
    return np.unique((classes[(h >> np.uint64(64 - SKETCH)).astype(np.int64)] << np.uint64(60)) | (h >> np.uint64(4)))


def set_rows(rows: DataFrame, k: int, percent: int, classes: np.ndarray) -> DataFrame:
    """key, n, sig (of the whole set), prefix (tokens), bins (counts of tokens by their last bits, up to 255), fine (more bins of larger sets, else empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in slices(batches, "text"):
            n, sig, prefix, bins, fine = [], [], [], [], []
            for t in as_bytes(batch.column("text")):
                s = ordered_set(t, k, words, classes)
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                prefix.append(s[: len(s) - -(-percent * len(s) // 100) + 1].view(np.int64))
                bins.append(np.minimum(np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
                b = min(FINE, max(BINS, 1 << (len(s) // 4).bit_length() - 1)) if len(s) >= 8 else BINS
                fine.append(np.minimum(np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b), 255).astype(np.uint8).tobytes() if b > BINS else b"")
            offsets = np.r_[0, np.cumsum([len(p) for p in prefix])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefix)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), lists, pa.array(bins, pa.binary()), pa.array(fine, pa.binary())], ["key", "n", "sig", "prefix", "bins", "fine"])
        words.clear()  # a worker that waits for its next task holds no words
        release()

    return rows.mapInArrow(run, "key long, n long, sig binary, prefix array<long>, bins binary, fine binary")


def in_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from rows sorted by keys: a group that a batch cuts is held until it is whole."""
    held: list[pd.DataFrame] = []
    for frame in batches:
        last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
        at = len(frame) - int(last[::-1].argmin()) if not last.all() else 0
        if held and (at or not (held[0][keys].iloc[0] == frame[keys].iloc[0]).all()):
            whole = pd.concat([*held, frame.iloc[:at]], ignore_index=True)
            held = []
            yield whole
        elif at:
            yield frame.iloc[:at]
        held.append(frame.iloc[at:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _meeting(batches: Iterable[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Postings (token, key, n, pos), sorted by token, with another posting of their token that size and position allow.

    Of a pair that meets at places p and q at most the tokens from there on are shared. A token of more than SET_BLOCK
    postings passes whole, as its rows come, so that memory doesn't follow it.
    """
    held, crowd = None, None
    for frame in batches:
        if crowd is not None:
            more = (frame["token"] == crowd).to_numpy()
            if more.any():
                yield frame[more]
                frame = frame[~more]
            if len(frame):
                crowd = None
        if held is not None:
            frame, held = pd.concat([held, frame], ignore_index=True), None
        if not len(frame):
            continue
        token = frame["token"].to_numpy()
        at = int(np.searchsorted(token, token[-1], "left"))
        yield frame.iloc[_with_partner(frame.iloc[:at], percent)]
        held = frame.iloc[at:]
        if len(held) > SET_BLOCK:
            crowd = token[-1]
            yield held
            held = None
    if held is not None:
        yield held.iloc[_with_partner(held, percent)]


def _with_partner(frame: pd.DataFrame, percent: int) -> np.ndarray:
    token, n, left = frame["token"].to_numpy(), frame["n"].to_numpy().astype(np.int64), (frame["n"] - frame["pos"]).to_numpy().astype(np.int64)
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(token)])
    keep = np.zeros(len(token), bool)
    for g in np.unique(size):
        starts = first[size == g]
        if g > SET_BLOCK:
            keep[(starts[:, None] + np.arange(g)).ravel()] = True
        elif g > 1:
            for shift in range(1, g):  # each row with the one so many places on
                a = (starts[:, None] + np.arange(g - shift)).ravel()
                b = a + shift
                need = -(-percent * (n[a] + n[b]) // (100 + percent))
                ok = (np.minimum(left[a], left[b]) >= need) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                keep[a[ok]] = True
                keep[b[ok]] = True
    return np.flatnonzero(keep)


def _possible(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """key, meeting of the rows of the groups (token, i, j) with a partner that the bounds allow and that they aren't known to meet earlier."""
    frame = frame.reset_index(drop=True)
    token, bi, bj = (frame[c].to_numpy() for c in ("token", "i", "j"))
    first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
    size = np.diff(np.r_[first, len(frame)])
    n, side = frame["n"].to_numpy(), frame["side"].to_numpy()
    bins = np.frombuffer(b"".join(frame["bins"]), np.uint8).reshape(-1, BINS)
    full = (bins == 255).any(1)
    keep, sets = np.zeros(len(frame), bool), {}
    toks = frame["tokens"].to_numpy()

    def members(r: int) -> set:
        if r not in sets:
            sets[r] = set(toks[r].tolist())
        return sets[r]

    for g in np.unique(size):
        if g < 2:
            continue
        starts = first[size == g]
        x, y = np.triu_indices(g, 1)
        step = max(1, (1 << 18) // len(x))
        for k in range(0, len(starts), step):
            for c in range(0, len(x), 1 << 18):
                a = (starts[k : k + step, None] + x[None, c : c + (1 << 18)]).ravel()
                b = (starts[k : k + step, None] + y[None, c : c + (1 << 18)]).ravel()
                fit = ((bi[a] == bj[a]) | (side[a] != side[b])) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                a, b = a[fit], b[fit]
                need = -(-percent * (n[a] + n[b]) // (100 + percent))
                most = np.minimum(bins[a], bins[b]).sum(1, dtype=np.int64)
                fit = (most >= need) | (full[a] & full[b])  # a bin of 255 may hold more
                for r, s in zip(a[fit].tolist(), b[fit].tolist(), strict=True):
                    if keep[r] and keep[s]:
                        continue
                    if min(members(r) & members(s), default=token[r]) >= token[r]:
                        keep[r] = keep[s] = True
    return _named(frame[keep], ["token", "i", "j"])


def _named(frame: pd.DataFrame, group: list[str]) -> pd.DataFrame:
    """key, meeting of the rows of each group; a meeting is named by a hash of its keys.

    The same sets at another token are the same meeting. If two names ever agree, two meetings become one, which costs
    comparisons but no link.
    """
    out = frame[[*group, "key"]].sort_values([*group, "key"]).drop_duplicates()
    at, keys = out[group].to_numpy(), out["key"].to_numpy(np.int64)
    meetings = [m for m in np.split(keys, np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1) if len(m)]
    names = [np.uint64(xxhash.xxh3_64_intdigest(m.tobytes())).astype(np.int64) for m in meetings]
    return pd.DataFrame({"key": keys, "meeting": np.repeat(np.array(names, np.int64), [len(m) for m in meetings])})


def _near(n: np.ndarray, fine: list[bytes], percent: int) -> np.ndarray:
    """Which sets of one meeting have a partner there that the counts in fine bins allow. A full bin allows any."""
    keep, width = np.zeros(len(n), bool), np.array([len(f) for f in fine])
    tables = {w: (np.flatnonzero(width == w), np.stack([np.frombuffer(f, np.uint8) for f in fine if len(f) == w])) for w in np.unique(width)}
    for r in range(len(n)):
        for w, (rows, counts) in tables.items():
            fit = (rows > r) & ~(keep[rows] & keep[r]) & (100 * np.minimum(n[rows], n[r]) >= percent * np.maximum(n[rows], n[r]))
            if not fit.any():
                continue
            own, other, b = np.frombuffer(fine[r], np.uint8), counts[fit], min(w, len(fine[r]))
            full = (own == 255).any() | (other == 255).any(1)
            most = np.minimum(own.reshape(-1, b).sum(0, dtype=np.int32), other.reshape(len(other), -1, b).sum(1, dtype=np.int32)).sum(1)
            near = rows[fit][full | (most >= -(-percent * (n[rows[fit]] + n[r]) // (100 + percent)))]
            keep[near] = True
            keep[r] |= len(near) > 0
    return keep


class Node:
    __slots__ = ("edge", "below", "row", "least", "most", "one")

    def __init__(self, edge: np.ndarray, n: int, row: int):
        self.edge, self.below, self.row, self.least, self.most, self.one = edge, {}, None, n, n, row


class Tree:
    """Prefix tree of ordered sets; edges hold runs of tokens. one: a row of the subtree if all its rows are connected, else None."""

    def __init__(self, percent: int):
        self.percent, self.root, self.sets, self.up = percent, Node(np.zeros(0, np.uint64), 1 << 60, 0), [], []
        self.root.most, self.root.one = 0, None

    def find(self, r: int) -> int:
        while self.up[r] != r:
            self.up[r] = r = self.up[self.up[r]]
        return r

    def add(self, s: np.ndarray, link) -> None:
        """Link s with a row of every component that has one near enough, then insert it."""
        row, n = len(self.sets), len(s)
        self.sets.append(s)
        self.up.append(row)
        stack = [(child, 0, 0, 0) for child in self.root.below.values()]
        while stack:
            node, overlap, at, depth = stack.pop()
            if node.one is not None and self.find(node.one) == self.find(row):
                continue
            need = needed(n, max(node.least, -(-self.percent * n // 100)), self.percent)
            if 100 * node.least > 100 * 100 * n // self.percent or 100 * node.most < self.percent * n or overlap + min(n - at, node.most - depth) < need:
                continue
            edge = node.edge
            to = np.searchsorted(s[at:], edge) if at < n else None
            if to is not None:
                inside = to < n - at
                overlap += int(np.count_nonzero(s[at:][to[inside]] == edge[inside]))
                at += int(np.searchsorted(s[at:], edge[-1], "right"))
            depth += len(edge)
            if node.row is not None and overlap >= needed(n, depth, self.percent) and self.find(node.row) != self.find(row):
                link(row, node.row)
                self.up[self.find(node.row)] = self.find(row)
            if node.below and overlap + min(n - at, node.most - depth) >= need:
                stack += [(child, overlap, at, depth) for child in node.below.values()]
        self._insert(s, row)

    def _insert(self, s: np.ndarray, row: int) -> None:
        node, at, n = self.root, 0, len(s)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if node.one is not None and self.find(node.one) != self.find(row):
                node.one = None
            if at == n:
                node.row = row
                return
            child = node.below.get(int(s[at]))
            if child is None:
                child = node.below[int(s[at])] = Node(s[at:], n, row)
                child.row = row
                return
            m = min(len(child.edge), n - at)
            differ = np.flatnonzero(child.edge[:m] != s[at : at + m])
            common = int(differ[0]) if len(differ) else m
            if common < len(child.edge):
                top = Node(child.edge[:common], child.least, child.one)
                top.least, top.most, top.one = child.least, child.most, child.one
                child.edge = child.edge[common:]
                top.below[int(child.edge[0])] = child
                node.below[int(s[at])] = child = top
            node, at = child, at + common


def tree_links(keys: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what the full join of the sets would."""
    tree, out = Tree(percent), []
    for s in sets:
        tree.add(s, lambda a, b: out.append((keys[a], keys[b])))
    return out


def near_links(docs: DataFrame, k: int, percent: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The table of sets (key, n, sig) and links (a, b) whose components are those of the full join."""
    spark = docs.sparkSession
    rows = _input(docs, key, text)
    classes = rarity(sketch(rows, k))
    sets = cut(set_rows(rows, k, percent, classes), "sets")
    reps = sets.filter("n > 0").groupBy("sig").agg(F.min(F.struct("key", "n", "prefix", "bins", "fine")).alias("r")).select("r.*")
    reps = cut(reps, "reps")
    posts = reps.select("key", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    posts = posts.repartition(n_parts(spark), "token").sortWithinPartitions("token")

    def meeting(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _meeting(batches, percent)

    posts = cut(posts.mapInPandas(meeting, "token long, key long, n int, pos int").select("token", "key"), "meetings")
    counts = posts.groupBy("token").count()
    met = posts.join(counts, "token").groupBy("key").agg(F.collect_list(F.struct("token", "count")).alias("met"))
    met = met.join(reps.select("key", "n", "bins"), "key").select("key", "n", "bins", F.slice(F.array_sort("met.token"), 1, FIRST).alias("tokens"), F.explode("met").alias("m"))
    met = met.withColumn("blocks", F.ceil(F.col("m.count") / SET_BLOCK)).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select(F.col("m.token").alias("token"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).cast("int").alias("side"), "key", "n", "bins", F.filter("tokens", lambda x: x < F.col("m.token")).alias("tokens"))
    group = ["token", "i", "j"]
    met = met.repartition(n_parts(spark), *group).sortWithinPartitions(*group)

    def possible(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_groups(batches, group):
            yield _possible(frame, percent)

    chosen = cut(met.mapInPandas(possible, "key long, meeting long").distinct(), "chosen")
    fine = chosen.join(prefiltered(reps, chosen), "key").select("meeting", "key", "n", F.when(F.octet_length("fine") > 0, F.col("fine")).otherwise(F.col("bins")).alias("fine"))
    fine = fine.repartition(n_parts(spark), "meeting").sortWithinPartitions("meeting")

    def near(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_groups(batches, ["meeting"]):
            keep = [_near(own["n"].to_numpy(), own["fine"].tolist(), percent) for _, own in frame.groupby("meeting", sort=False)]
            yield _named(frame[np.concatenate(keep)], ["meeting"])

    chosen = fine.mapInPandas(near, "key long, meeting long")
    at = chosen.groupBy("key").agg(F.collect_set("meeting").alias("at"))
    at = cut(at, "possible")
    whole = at.join(prefiltered(rows, at), "key")  # the texts of documents with a possible partner

    def give(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in slices(batches, "text"):
            s = [ordered_set(t, k, words, classes).tobytes() for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), pa.array(s, pa.binary())], ["key", "at", "set"])
        words.clear()
        release()

    placed = whole.select("key", "at", "text").mapInArrow(give, "key long, at array<long>, set binary").select("key", F.explode("at").alias("meeting"), "set")
    placed = placed.repartition(n_parts(spark), "meeting").sortWithinPartitions("meeting", F.octet_length("set"))

    def join(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_groups(batches, ["meeting"]):
            out = []
            for _, own in frame.groupby("meeting", sort=False):
                out += tree_links(own["key"].tolist(), [np.frombuffer(x, np.uint64) for x in own["set"]], percent)
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        release()

    return sets, placed.mapInPandas(join, "a long, b long")


def classes_of(docs: DataFrame, k: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links) for every row of docs."""
    sets, links = near_links(docs, k, percent, key, text)
    same = sets.filter("n > 0").groupBy("sig").agg(F.min("key").alias("rep"))
    # Rows that share a key are one vertex: their sets' representatives are linked through it.
    twice = sets.filter("n > 0").groupBy("key").agg(F.min("sig").alias("s1"), F.max("sig").alias("s2")).filter("s1 <> s2")
    bridge = sets.filter("n > 0").join(twice, "key", "left_semi").join(same, "sig").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(bridge))
    of_set = cut(same.join(found, same["rep"] == found["v"], "left").select("sig", F.coalesce("component", "rep").alias("component_id")), "classes")
    out = sets.filter("n > 0").join(of_set, "sig").select("key", "n", "component_id").unionByName(sets.filter("n = 0").select("key", "n", F.col("key").alias("component_id")))
    real: Column = F.col("key") != NO_KEY
    return out.select(F.when(real, F.col("key")).alias(key), F.col("n").alias("n_shingles"), F.when(F.col("component_id") != NO_KEY, F.col("component_id")).alias("component_id"))
