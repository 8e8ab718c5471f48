"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece exactly one token can be the last of its encoding. The tokens that end at a
position come from a suffix-linked automaton of the vocabulary; a candidate is the last token when it is
compatible with the last token of the prefix before it. Back-pointers then give the ids. Words that a task hasn't seen yet
take these steps together, a batch's words of one prefix length at a time; other pieces take them alone.

Defined results: a null or empty text has no ids and decodes to the empty string; texts of any length are
encoded whole; columns besides the key and the text are ignored; repeated rows are encoded each.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import as_bytes, release, slices

#: Stands for the end of a word inside the automaton (private use, never in a byte-level alphabet).
END = ""
#: Printable ASCII without a special token's start: here this pattern cuts as the file's own splitter does, and bytes are their own symbols.
PATTERN = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = re.compile(rb"[!-;=-~]+")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: The same with the letters of Latin-1, which stand for themselves after normalising, and words of such letters and ASCII's.
ACCENTED = "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
LATIN = re.compile(rb"(?:[!-;=-~]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++")
LETTERS = re.compile(rb"(?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++")
LATIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: The byte-level alphabet: bytes without a printable Latin-1 character have one from 256 on.
BYTES = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
#: Chunks, pieces, seams and spines that a worker remembers within a task.
MEMO, PIECES, SEAMS, SPINES = 120_000, 20_000, 1 << 17, 8_000
#: Bits of the table of seams that a batch reads; the longest piece that goes with others, and how many go at once.
TABLE, LONGEST, TOGETHER = 19, 64, 20_000


class Halves(dict):
    """What a function made lately. Of two halves the older one is dropped when the newer is full, so that common keys stay."""

    def __init__(self, make: Callable[[Any], bytes], most: int):
        self.make, self.most, self.older = make, most // 2, {}

    def __missing__(self, key: Any) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out

    def keep(self, key: Any, out: bytes) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = out

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Chunks(Halves):
    """Ids of chunks. A plain word with one sign behind it is made of both, so that only words are remembered."""

    def __init__(self, model: PrefixBpe, most: int):
        super().__init__(model.encode_chunk, most)
        self.signs = frozenset(b".,;:!?)" if model.plain else b"")
        self.latin, self.model = model.latin, model

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk[-1] in self.signs and (chunk[:-1].isalpha() or self.latin and LETTERS.fullmatch(chunk[:-1])):
            return self[chunk[:-1]] + self[chunk[-1:]]
        return super().__missing__(chunk)

    def of(self, chunks: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of different chunks. Plain words that aren't remembered are encoded together."""
        if not (self.latin and self.model.suffix):
            return {c: self[c] for c in chunks}
        out: dict[bytes, bytes] = {}
        signed: list[tuple[bytes, bytes]] = []
        wanted: dict[bytes, str] = {}
        for c in chunks:
            if c[-1] in self.signs and ((word := c[:-1]).isalpha() or LETTERS.fullmatch(word)):
                signed.append((c, word))
                if word in out or word in wanted:
                    continue
            else:
                word = c
            ids = self.get(word)
            if ids is None and (word in self.older or len(word) > LONGEST or not LETTERS.fullmatch(word)):
                ids = self[word]
            if ids is not None:
                out[word] = ids
            elif word not in wanted:
                wanted[word] = word.lower().decode("ascii") if word.isascii() else alphabet(word.decode("utf-8").lower())
        pieces = list(set(wanted.values()))
        made: dict[str, bytes] = {}
        for at in range(0, len(pieces), TOGETHER):
            some = pieces[at : at + TOGETHER]
            made |= zip(some, self.model.encode_pieces(some), strict=True)
        for word, piece in wanted.items():
            out[word] = ids = made[piece]
            self.keep(word, ids)
        for c, word in signed:
            out[c] = out[word] + self[c[-1:]]
        return out


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"={len(ids)}i", *ids)


def alphabet(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(BYTES)


class Links:
    """The automaton of a vocabulary as arrays, for steps of many words at once: edges of the trie, suffix links, and from
    each state the next shorter token that ends there."""

    WIDE = 512  # symbols; the byte-level alphabet has fewer, the last one is a word's end

    def __init__(self, tokens: Iterable[tuple[str, int]]):
        edges: dict[int, int] = {}
        owned, parents, depths = [-1], [0], [0]
        for s, i in tokens:
            node = 0
            for c in s:
                edge = node * self.WIDE + min(ord(c), self.WIDE - 1)
                if (to := edges.get(edge)) is None:
                    to = edges[edge] = len(owned)
                    owned.append(-1)
                    parents.append(edge)
                    depths.append(depths[node] + 1)
                node = to
            owned[node] = i
        self.token, self.depth = np.array(owned, np.int32), np.array(depths, np.int32)
        self.edges = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.edges.tolist()], np.int32)
        self.suffix, self.shorter = np.zeros(len(owned), np.int32), np.zeros(len(owned), np.int32)
        parent, symbol = np.divmod(np.array(parents, np.int64), self.WIDE)
        for d in range(2, int(self.depth.max()) + 1):
            at = np.flatnonzero(self.depth == d)
            self.suffix[at] = end = self.step(self.suffix[parent[at]], symbol[at])
            self.shorter[at] = np.where(self.token[end] < 0, self.shorter[end], end)

    def symbols(self, text: str) -> np.ndarray:
        return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), self.WIDE - 1).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(state), np.int32), np.arange(len(state))
        while len(todo):
            edge = state.astype(np.int64) * self.WIDE + symbol
            at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            hit = self.edges[at] == edge
            out[todo[hit]] = self.to[at[hit]]
            on = ~hit & (state > 0)  # the root without an edge stays the root
            todo, state, symbol = todo[on], self.suffix[state[on]], symbol[on]
        return out


class PrefixBpe:
    """The model of a tokenizers file: the file's own normaliser and splitter, and our encoder."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        self.spine = lru_cache(SPINES)(self._spine)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.born: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pair = vocab[a], vocab[b]
            self.merge[pair] = rank
            self.born.setdefault(vocab[a + b], (*pair, rank))
        self.match = ahocorasick.Automaton()
        for t, i in vocab.items():
            if i not in self.special.values() and self._whole(i):
                s = t[: -len(self.suffix)] + END if self.suffix and t.endswith(self.suffix) else t
                self.match.add_word(s, (i, len(s)))
        self.match.make_automaton()
        self.links = Links((s, i) for s, (i, _) in self.match.items())
        self.plain = PATTERN in json.dumps(spec["pre_tokenizer"]) and "Lowercase" in json.dumps(spec["normalizer"])
        self.latin = self.plain and self._reads_latin()
        self.pieces = Halves(self.encode_piece, PIECES)
        self.piece = self.pieces.__getitem__
        self.seams: dict[int, bool] = {}
        self.seam_keys, self.seam_fits = np.full(1 << TABLE, -1, np.int64), np.zeros(1 << TABLE, bool)

    def _reads_latin(self) -> bool:
        """Does the file treat accented letters as alphabet() does: lower case, nothing else, and bytes as symbols?"""
        normal = self.library.normalizer.normalize_str(ACCENTED)
        return normal == ACCENTED.lower() and [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)] == [alphabet(normal)]

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of a token while it is being built, each with the rank that absorbs it."""
        path = [(token, float("inf"))]
        while token in self.born:
            rank = self.born[token][2]
            token = self.born[token][side]
            path.append((token, rank))
        return path[::-1]

    def _clash(self, a: int, b: int) -> tuple[int, int] | None:
        """The pair over the seam of a and b that merging would join, or None: then a, b is how both together are encoded.

        Both edges are replayed in rank order; at equal ranks the left one goes first, as merging goes from left to right.
        """
        left, right = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        while True:
            (x, gone_x), (y, gone_y) = left[i], right[j]
            rank = self.merge.get((x, y))
            if rank is not None and rank < gone_x and rank <= gone_y:
                return x, y
            if gone_x == gone_y == float("inf"):
                return None
            if gone_x <= gone_y:
                i += 1
            else:
                j += 1

    def _whole(self, token: int) -> bool:
        """Is a token's own string encoded as that token?"""
        if token not in self.born:
            return True
        left, right, _ = self.born[token]
        return self._whole(left) and self._whole(right) and self._clash(left, right) == (left, right)

    def forget(self) -> None:
        """Drop what was remembered, not the model."""
        self.pieces.forget()
        self.seams.clear()
        self.spine.cache_clear()

    def names(self) -> pa.Array:
        return pa.array([self.token_of.get(i) for i in range(max(self.token_of) + 1)])

    def encode_piece(self, piece: str) -> bytes:
        """One piece in the byte-level alphabet; ids are 32-bit numbers one after another."""
        n, known = len(piece) + bool(self.suffix), self.seams
        inner = n - 1 if self.suffix else -1  # a word's end stands after all of its letters
        last, start = [-1] * (n + 1), [0] * (n + 1)  # of each prefix: its last token, and where that starts
        for end, (token, length) in self.match.iter(piece + END if self.suffix else piece):
            end += 1
            if last[end] >= 0 or end == inner:
                continue
            at = end - length
            if at:
                left = last[at]
                if left < 0:
                    continue
                fits = known.get(left << 32 | token)
                if fits is None:
                    fits = self._seam(left, token)
                if not fits:
                    continue
                start[end] = at
            last[end] = token
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = start[at]
        return packed(ids[::-1])

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """encode_piece() of many pieces of a model with an end of words, none empty."""
        ends = np.cumsum([len(p) + 1 for p in pieces])
        starts = np.r_[0, ends[:-1]]
        links, sizes = self.links, ends - starts
        symbols = links.symbols(END.join(pieces) + END)
        last, start = np.full(ends[-1] + 1, -1, np.int32), np.zeros(ends[-1] + 1, np.int32)
        state = np.zeros(len(pieces), np.int32)
        for column in range(1, sizes.max() + 1):
            word = np.flatnonzero(sizes >= column)
            end = starts[word] + column
            state[word] = now = links.step(state[word], symbols[end - 1])
            now = np.where(links.token[now] < 0, links.shorter[now], now)
            now[sizes[word] == column + 1] = 0  # a word's end stands after all of its letters
            while len(now := now[some := now > 0]):
                end = end[some]
                token, at = links.token[now], end - links.depth[now]
                fits, left = links.depth[now] == column, last[at]
                ask = np.flatnonzero(~fits & (left >= 0))
                fits[ask] = self._seams(left[ask], token[ask])
                last[end[fits]], start[end[fits]] = token[fits], at[fits]
                now, end = links.shorter[now[~fits]], end[~fits]
        steps, word, place = [], np.arange(len(pieces)), ends
        while len(word):
            steps.append((word, last[place]))
            place = start[place]
            more = place > starts[word]
            word, place = word[more], place[more]
        many = np.zeros(len(pieces), np.int64)
        for w, _ in steps:
            many[w] += 1
        to = np.cumsum(many)
        ids = np.zeros(to[-1], np.int32)
        for k, (w, t) in enumerate(steps):
            ids[to[w] - 1 - k] = t
        raw, cut = ids.tobytes(), [0, *(4 * to).tolist()]
        return [raw[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def _seams(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE)).view(np.int64)
        out = self.seam_fits[slot]
        away = np.flatnonzero(self.seam_keys[slot] != key)
        if len(away):
            keys, back = np.unique(key[away], return_inverse=True)
            known = self.seams
            made = np.array([fits if (fits := known.get(k)) is not None else self._seam(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()], bool)
            out[away] = made[back]
            # One key for each slot; the others are asked again.
            slots, one = np.unique(slot[away], return_index=True)
            self.seam_keys[slots], self.seam_fits[slots] = key[away[one]], out[away[one]]
        return out

    def _seam(self, a: int, b: int) -> bool:
        if len(self.seams) >= SEAMS:
            self.seams.clear()
        out = self.seams[a << 32 | b] = self._clash(a, b) is None
        return out

    def encode_chunk(self, chunk: bytes) -> bytes:
        """A run of bytes without ASCII white space, over which no piece ever reaches."""
        if self.plain and chunk.isalpha():  # ASCII letters only, as these are bytes
            return self.piece(chunk.lower().decode("ascii"))
        if self.plain and PLAIN.fullmatch(chunk):
            return b"".join(map(self.piece, SPLIT.findall(chunk.lower().decode("ascii"))))
        if self.latin and LATIN.fullmatch(chunk):
            return b"".join([self.piece(alphabet(p)) for p in LATIN_SPLIT.findall(chunk.decode("utf-8").lower())])
        ids = b""
        text = chunk.decode("utf-8")
        while text:
            at, found = min(((k, s) for s in self.special if (k := text.find(s)) >= 0), default=(len(text), ""))
            head = self.library.normalizer.normalize_str(text[:at]) if at else ""
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(head) if head else ():
                ids += self.piece(piece)
            if found:
                ids += packed([self.special[found]])
            text = text[at + len(found) :]
        return ids


@lru_cache(1)
def _memo(path: str) -> tuple[PrefixBpe, Chunks]:
    """A worker's model, which stays for its later tasks, and the chunks that it saw lately."""
    model = PrefixBpe(path)
    release()  # what reading the file took
    return model, Chunks(model, MEMO)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), kind))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """key, ids array<int>: every whole text as the model at `path` (a file on each machine) encodes it.

    decoded adds the column that decode() would make of the ids, without another pass over them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = _memo(path)
        names = model.names()
        for batch in slices(batches, "text", 2 << 20):
            texts = [t.split() for t in as_bytes(batch.column("text"))]
            ids_of = memo.of(set().union(*texts))
            rows = [np.frombuffer(b"".join(map(ids_of.__getitem__, t)), np.int32) for t in texts]
            del texts, ids_of
            ids = _lists(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids, *([_joined(ids, names)] * decoded)], ["key", "ids", *["decoded"] * decoded])
        memo.forget()  # most words of the next task are others; a worker that waits holds the model only
        model.forget()
        release()

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("key", key)


def _joined(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    return pa.compute.binary_join(pa.ListArray.from_arrays(ids.offsets, names.take(ids.values)), " ")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text: the tokens of the ids joined as a file without a decoder joins them, by one space; special tokens stay."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _memo(path)[0].names()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), _joined(batch.column("ids"), names)], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("key"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
