"""Repeated strings of bytes: removes every byte of a string of `width` bytes that also starts elsewhere.

1. Anchors (see anchors.py) put each window of `width` bytes under the hash of one of its 64-byte grams, at the same place
   in equal windows. Only anchors that occur twice can have repeated windows.
2. Around these the texts are cut into contexts. A context goes once from each task to the task of its anchor, with the
   number of its places; the places themselves stay apart and are joined with what is found, by a digest of the context.
   An anchor of very many places is dealt out by what all windows of half a block have in common, eight bytes beside the
   core among it, so that texts which share a passage but go on differently are many tasks' work.
3. There a suffix array, made by linear grouping, puts equal windows side by side. Windows are taken in blocks of 16
   neighbouring starts. All windows of a block share a core, which is one symbol of the array; the bytes around it are
   symbols of their own. Contexts that are equal over a block are one entry there, and repeat all of it.
4. Runs of repeated windows become spans of each text.

Everything is judged on the input, within a text as between texts. Different contexts are told apart by their bytes;
equal ones of different tasks by a 128-bit BLAKE2 digest; other hashes only place work.

Defined results: null counts as empty; texts shorter than the width keep everything; rows with equal key and text are two
texts that repeat each other; null keys count as one largest key; an empty table gives an empty result. Texts of any
length are read whole, in overlapping pieces where they are longer than PIECE.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, anchors
from .batches import as_bytes, slices
from .common import cut, discard, n_parts, prefiltered, spread_join
from .ngrams import in_groups
from .suffixes import suffix_array

WIDTH = 400
#: Window starts in a block, and in each half of one.
BLOCK, HALF = 16, 8
#: Places of an anchor beyond which its windows are dealt out by their blocks' cores.
HOT = 2000
#: Symbols that one suffix array gets, beyond the group that brings it there.
SYMBOLS = 100_000
#: Bytes of a text whose anchors are found at once.
PIECE = 1 << 25
NO_KEY = (1 << 63) - 1


def _input(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.xxhash64(t).alias("t"), t.alias("text"))


def anchor_rows(rows: DataFrame, width: int) -> DataFrame:
    def found(texts: list[bytes]) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(x) for x in texts], np.int64)
        ends = np.cumsum(sizes)
        return anchors(np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends, width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts = as_bytes(batch.column("text"))
            long = len(texts) == 1 and len(texts[0]) > PIECE
            for at in range(0, len(texts[0]) - width + 1, PIECE) if long else (0,):
                h, own, pos, lo, hi = found([texts[0][at : at + PIECE + width - 1]] if long else texts)
                keys, ts = (batch.column(c).to_numpy()[own] for c in ("key", "t"))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ts), pa.array(h.view(np.int64)), *(pa.array((x + at).astype(np.int32)) for x in (pos, lo, hi))], ["key", "t", "h", "pos", "lo", "hi"])

    return rows.filter(F.octet_length("text") >= width).mapInArrow(run, "key long, t long, h long, pos int, lo int, hi int")


def block_parts(ctx: bytes, a: int, w: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """block, first and last window start in ctx, start of the core, for the windows 0..w of a context whose anchor is at a."""
    shift = width - GRAM - a  # of window start 0, counted so that every window start is at 0 or later
    for b in range(shift // BLOCK, (shift + w) // BLOCK + 1):
        s0, s1 = max(0, BLOCK * b - shift), min(w, BLOCK * b + BLOCK - 1 - shift)
        yield b, s0, s1, BLOCK * b + BLOCK - 1 - shift


def cut_out(text: bytes, found: Iterable[tuple[int, int, int, int, int]], width: int, hot: int) -> Iterator[tuple[int, int, int, int, bytes, int]]:
    """h, part, a, w, context and its place, for the anchors (h, pos, lo, hi, count) of a text."""
    core = width - BLOCK + 1
    for h, pos, lo, hi, n in found:
        ctx, a, w = text[lo : hi + width], pos - lo, hi - lo
        if n <= hot:
            yield h, 0, a, w, ctx, lo
            continue
        for b, s0, s1, at in block_parts(ctx, a, w, width):
            # Windows that start HALF bytes before the core or earlier hold these bytes, the others as many behind it.
            for first, last, fixed in ((s0, min(s1, at - HALF), ctx[at - HALF : at + core]), (max(s0, at - HALF + 1), s1, ctx[at : at + core + HALF])):
                if first <= last:
                    side = int(first > at - HALF)
                    yield h, xxhash.xxh64_intdigest(fixed, 2 * b + side) >> 1 | 1, a - first, last - first, ctx[first : last + width], lo + first


def digest(h: int, part: int, a: int, w: int, ctx: bytes) -> bytes:
    return hashlib.blake2b(struct.pack("<qqii", h, part, a, w) + ctx, digest_size=16).digest()


def contexts(whole: DataFrame, width: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """The contexts of each task (h, part, id, a, w, ctx, n places) and the places of all (id, key, t, lo), from key, t,
    text and the anchors `at` of each text."""

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[int, int, int, int, bytes, int]]]:
        lists = batch.column("at")
        parts = [lists.values.field(c).to_numpy() for c in ("h", "pos", "lo", "hi", "count")]
        offsets = lists.offsets.to_numpy()
        for r, (key, t, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("t").to_pylist(), as_bytes(batch.column("text")), strict=True)):
            for one in cut_out(text, zip(*(x[offsets[r] : offsets[r + 1]].tolist() for x in parts), strict=True), width, hot):
                yield key, t, one

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            found: dict[tuple, int] = {}
            for _, _, one in pieces(batch):
                found[one[:5]] = found.get(one[:5], 0) + 1
            cols = list(zip(*found, strict=True)) or [()] * 5
            ids = pa.array([digest(*x) for x in found], pa.binary())
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), ids, pa.array(list(found.values()), pa.int64())], ["h", "part", "a", "w", "ctx", "id", "n"])

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = [(digest(*one[:5]), key, t, one[5]) for key, t, one in pieces(batch)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "key", "t", "lo"])

    whole = whole.select("key", "t", "text", "at")
    return whole.mapInArrow(once, "h long, part long, a int, w int, ctx binary, id binary, n long"), whole.mapInArrow(places, "id binary, key long, t long, lo int")


class Windows:
    """Collects the windows of groups of contexts and tells which are repeated."""

    def __init__(self, width: int):
        self.width = width
        self.spans: list[tuple[int, int, int]] = []  # row, first and last repeated window start
        self.symbols: list[int] = []
        self.starts: dict[int, list[tuple[int, int]]] = {}  # symbol's place -> rows and window starts that begin there
        self.cores = 257

    def add(self, rows: list[tuple[int, int, int, bytes, int]]) -> None:
        """rows of one anchor: number, a, w, context, places."""
        core = self.width - BLOCK + 1
        blocks: dict[tuple[int, bytes], list[tuple[int, int, int, int]]] = {}
        for r, (_, a, w, ctx, _) in enumerate(rows):
            for b, s0, s1, at in block_parts(ctx, a, w, self.width):
                blocks.setdefault((b, ctx[at : at + core]), []).append((r, s0, s1, at))
        for (_, _), members in blocks.items():
            if len(members) == 1 and rows[members[0][0]][4] == 1:
                continue
            sides: dict[tuple[bytes, bytes], list[tuple[int, int, int]]] = {}
            for r, s0, s1, at in members:
                ctx = rows[r][3]
                sides.setdefault((ctx[s0:at], ctx[at + core : s1 + self.width]), []).append((r, s0, s1))
            for own in sides.values():
                if len(own) > 1 or rows[own[0][0]][4] > 1:
                    self.spans += [(rows[r][0], s0, s1) for r, s0, s1 in own]
            if len(sides) > 1:
                self.cores += 1
                for (left, right), own in sides.items():
                    for x in range(len(left) + 1):
                        self.starts[len(self.symbols) + x] = [(rows[r][0], s0 + x) for r, s0, s1 in own if s0 + x <= s1]
                    self.symbols += [*(c + 1 for c in left), self.cores, *(c + 1 for c in right), 0]

    def repeated(self) -> list[tuple[int, int, int]]:
        s, sa = self.symbols, suffix_array(self.symbols)
        hit = set()
        for p, q in zip(sa, sa[1:], strict=False):
            if p in self.starts and q in self.starts and s[p : p + BLOCK] == s[q : q + BLOCK]:
                hit |= {p, q}
        return self.spans + [(r, x, x) for p in hit for r, x in self.starts[p]]


def one_each(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows sorted by h, part and id, with equal contexts as one."""
    ids = frame["id"].to_numpy()
    new = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
    if new.all():
        return frame
    first = np.flatnonzero(new)
    return frame.iloc[first].assign(n=np.add.reduceat(frame["n"].to_numpy(), first))


def repeated_windows(ctx: DataFrame, width: int) -> DataFrame:
    """id, n, first, last: runs of repeated window starts in each context, counted from its start, and its places."""
    group = ["h", "part"]
    dealt = ctx.repartition(n_parts(ctx.sparkSession), *group).sortWithinPartitions(*group, "id")

    def told(windows: Windows, ids: list[tuple[bytes, int]]) -> pd.DataFrame:
        out: dict[int, list[tuple[int, int]]] = {}
        for r, s0, s1 in windows.repeated():
            out.setdefault(r, []).append((s0, s1))
        rows = [(*ids[r], a, b) for r, runs in out.items() for a, b in merged(runs, 1)]
        return pd.DataFrame(rows, columns=["id", "n", "first", "last"])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows, ids = Windows(width), []
        for frame in in_groups((one_each(f) for f in batches if len(f)), group):
            frame = one_each(frame)
            h, part = frame["h"].to_numpy(), frame["part"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1]), True])
            a, w, ctxs, n, own = (frame[c].tolist() for c in ("a", "w", "ctx", "n", "id"))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                windows.add([(len(ids) + k - i, a[k], w[k], ctxs[k], n[k]) for k in range(i, j)])
                ids += zip(own[i:j], n[i:j], strict=True)
                if len(windows.symbols) > SYMBOLS or len(ids) > 20_000:
                    yield told(windows, ids)
                    windows, ids = Windows(width), []
        yield told(windows, ids)

    return dealt.mapInPandas(run, "id binary, n long, first int, last int")


def merged(runs: list[tuple[int, int]], touch: int = 0) -> list[tuple[int, int]]:
    """Runs joined where they overlap, or where the next starts at most `touch` after the end of one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + touch:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """key, t (hash of the text), windows: the runs (first, last) of repeated window starts, for texts that have some."""
    rows = _input(docs, key, text)
    found = cut(anchor_rows(rows, width), "anchors")
    many = max(hot, 10 * n_parts(docs.sparkSession))  # rows of a key that are dealt out, see spread_join
    twice = cut(found.groupBy("h").count().filter("count > 1"), "repeated-anchors")
    shared = spread_join(found, twice, ["h"], twice.filter(F.col("count") > many))
    at = cut(shared.groupBy("key", "t").agg(F.collect_list(F.struct("h", "pos", "lo", "hi", "count")).alias("at")), "shared-anchors")
    discard(found, twice)
    whole = at.join(prefiltered(rows, at), ["key", "t"])
    once, places = contexts(whole, width, hot)
    runs = cut(repeated_windows(once, width), "repeated-windows")
    spans = spread_join(places, runs, ["id"], runs.filter(F.col("n") > many)).select("key", "t", (F.col("lo") + F.col("first")).alias("first"), (F.col("lo") + F.col("last")).alias("last"))
    return spans.groupBy("key", "t").agg(F.collect_list(F.struct("first", "last")).alias("windows"))


def without_repeats(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """key, n_bytes, spans (array of start and end in bytes) and kept (binary) of each text; kept is null where all is kept."""
    rows = _input(docs, key, text)
    windows = cut(repeated_spans(docs, width, key, text, hot), "repeated")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, "text"):
            spans, kept = [], []
            for x, runs in zip(as_bytes(batch.column("text")), batch.column("windows").to_pylist(), strict=True):
                own = merged([(r["first"], r["last"] + width) for r in runs])
                ends = [0, *(e for _, e in own)]
                kept.append(b"".join(x[e:s] for e, s in zip(ends, [*(s for s, _ in own), len(x)], strict=True)))
                spans.append([{"start": s, "end": e} for s, e in own])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("t"), pa.array(spans, span), pa.array(kept, pa.binary())], ["key", "t", "spans", "kept"])

    changed = windows.join(prefiltered(rows, windows).dropDuplicates(["key", "t"]), ["key", "t"]).select("key", "t", "windows", "text").mapInArrow(run, "key long, t long, spans array<struct<start:int,end:int>>, kept binary")
    out = rows.select("key", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text"), 256).alias("sha256")).join(changed, ["key", "t"], "left")
    return out.select(F.when(F.col("key") != NO_KEY, F.col("key")).alias(key), "n_bytes", "spans", "kept", "sha256")
