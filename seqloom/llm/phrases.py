"""Collocations by contiguous pattern growth: frequent phrases from projected occurrences, scored by their weakest cut.

Texts are lower-cased, split into pieces at punctuation and into words. Counts are by language.

1. A first pass counts words by language, and hashes of single words and of pairs of words in tables of a fixed size.
2. A second pass makes an occurrence pointer of each word: the word and up to four that follow in its piece. A pointer ends
   before a word or a pair whose table entry is below the support, for no frequent phrase goes on there. Equal pointers of a
   task are added up.
3. Pointers are projected on their first word and dealt to slots by its hash: a task gives each slot one row with all
   pointers that fall there, and the rows of one slot are one group. In it each word is grown to the right depth-first,
   each step keeping the numbers of those pointers that go on with the same word. A word whose entry is above CROWD is
   counted by a plain sum, and its pointers are dealt to slots by their second word too, in so many parts that one has
   about CROWD of them; a pair is whole in its slot. Pointers of a pair that is above CROWD too are counted by sums of all
   their prefixes. So groups stay small, rows follow the text and not the vocabulary, and a passage that is repeated
   everywhere is a few sums.
4. Counts of a candidate's parts are joined to it; of all cuts the lowest score counts. Candidates inside a longer one that
   is as frequent are dropped.

Defined results: null texts are empty, a null language is `und`; languages and texts without words give nothing; repeated rows
count as often as they come; further columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import as_bytes, release, slices
from .common import cut, discard, n_parts

#: Words of the longest phrase.
LONGEST = 5
#: Entries of the hash tables of words and of pairs (bytes sent to a task, at a bit each: 1/8 of it).
WORD_SLOTS, PAIR_SLOTS = 1 << 22, 1 << 24
#: Pointers that one prefix may have in a group, repeats included.
CROWD = 50_000
#: A word above CROWD * DEAL ** k is dealt in DEAL ** (k + 1) parts, for k below DEALS.
DEAL, DEALS = 16, 4
#: The fewest slots of a language, and the most words of all texts for each.
SLOTS, SLOT_WORDS = 1 << 10, 1 << 21
#: Bytes of text that a task looks at together; its pointers are passed on before the next.
TEXT = 4 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The bytes at which pieces end.
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bytes to what tokens are cut from: A-Z in lower case, tabs as spaces, ends of pieces as \n.
CLEAN = bytes(10 if c in BREAKS else 32 if c == 9 else LOWER[c] for c in range(256))
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Numbers(dict):
    """Words to numbers in order of first sight; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0})
        self.words = [b"\n"]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


def numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of all texts as numbers, each piece followed by 0, and the word of each number."""
    numbers = Numbers()
    tokens = b"\n".join(texts).translate(CLEAN).replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, filter(None, tokens)), np.int32)
    return np.append(ids, np.int32(0)), numbers.words


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)


def _pairs(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (first ^ (then * MIX[0])) * MIX[1]
        return (h >> np.uint64(32)) % np.uint64(PAIR_SLOTS)


def by_lang(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    for batch in slices(batches, "text", TEXT):
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = as_bytes(batch.column("text"))
        for lang in dict.fromkeys(langs):
            yield lang, *numbered([texts[i] for i in np.flatnonzero(langs == lang)])


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))


def slot_counts(docs: DataFrame) -> DataFrame:
    """kind, lang, slot, n: words (kind w, slot null) by language, and how often each entry of the two hash tables is hit.

    A task gives a row for each entry that it hits and each language that it sees.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, total = np.zeros(WORD_SLOTS, np.int32), np.zeros(PAIR_SLOTS, np.int32), {}

        def out(kind: str, table: np.ndarray) -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(table)
            for i in range(0, len(at), 1 << 18):
                a = at[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(a)), pa.nulls(len(a), pa.string()), pa.array(a), pa.array(table[a].astype(np.int64))], ["kind", "lang", "slot", "n"])

        for lang, ids, names in by_lang(batches):
            h = _hashes(names, lang)
            real = ids != 0
            total[lang] = total.get(lang, 0) + int(real.sum())
            times = np.bincount(ids, minlength=len(h)).astype(np.int32)
            np.add.at(words, (h[1:] % np.uint64(WORD_SLOTS)).astype(np.int64), times[1:])
            both = np.flatnonzero(real[:-1] & real[1:])
            pair, n = np.unique(_pairs(h[ids[both]], h[ids[both + 1]]), return_counts=True)
            pairs[pair.astype(np.int64)] += n.astype(np.int32)
        yield from out("w1", words)
        yield from out("w2", pairs)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(["w"] * len(total)), pa.array(list(total)), pa.nulls(len(total), pa.int64()), pa.array(list(total.values()))], ["kind", "lang", "slot", "n"])
        release()

    return docs.mapInArrow(run, "kind string, lang string, slot long, n long")


#: Entries of a hash table that are packed together.
BLOCK = 1 << 16


def reached(seen: DataFrame, kind: str, size: int, least: int):
    """A bit for each entry of a table: was it hit `least` times? Packed by blocks; size / 8 bytes go to the driver and out again."""

    def packed(block: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BLOCK, bool)
        bits[block["slot"].to_numpy() % BLOCK] = True
        return pd.DataFrame({"block": [block["slot"].iloc[0] // BLOCK], "bits": [np.packbits(bits).tobytes()]})

    hit = seen.filter((F.col("kind") == kind) & (F.col("n") >= least)).select("slot")
    out = bytearray(size // 8)
    for block, bits in hit.groupBy(F.expr(f"slot div {BLOCK}")).applyInPandas(packed, "block long, bits binary").toLocalIterator():
        out[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = bits
    return seen.sparkSession.sparkContext.broadcast(bytes(out))


#: No slot: a pointer that is sums of all its prefixes.
ALL = -1


class Bits:
    """The bits of a table from reached(), read where they lie."""

    def __init__(self, table) -> None:  # noqa: ANN001  a broadcast
        self.packed = np.frombuffer(table.value, np.uint8)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def projected(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pointers (lang, words, slot, crowded, n) by their slot: a row for each, and sums (slot ALL) of what isn't grown."""
    table = pa.Table.from_batches(held).group_by(["lang", "words", "slot", "crowded"]).aggregate([("n", "sum")])
    grow: dict[tuple[str, int, bool], tuple[list[str], list[int]]] = {}
    sums: dict[tuple[str, str], int] = {}
    for lang, words, slot, crowded, n in zip(*(table.column(c).to_pylist() for c in ("lang", "words", "slot", "crowded", "n_sum")), strict=True):
        if crowded:
            for end in [*(i for i, c in enumerate(words) if c == " "), len(words)] if slot == ALL else [words.index(" ")]:
                k = lang, words[:end]
                sums[k] = sums.get(k, 0) + n
        if slot != ALL:
            said, times = grow.setdefault((lang, slot, crowded), ([], []))
            said.append(words)
            times.append(n)
    rows = [(lang, slot, crowded, "\n".join(said), np.array(times, np.int64).tobytes(), sum(times)) for (lang, slot, crowded), (said, times) in grow.items()]
    rows += [(lang, ALL, True, phrase, b"", n) for (lang, phrase), n in sums.items()]
    for at in range(0, len(rows), 1 << 12):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + (1 << 12)], strict=True), (pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "slot", "crowded", "words", "n", "total"])


def pointers(docs: DataFrame, slots: int, words, pairs, full_pairs, full_words: list) -> DataFrame:  # noqa: ANN001  broadcasts
    """lang, slot, crowded, words, n, total of each task's pointers by slot: their words (one line each), how often, and how often in all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, often_pair, full_pair, *full = map(Bits, (words, pairs, full_pairs, *full_words))
        for lang, ids, names in by_lang(batches):
            held: list[pa.RecordBatch] = []
            h = _hashes(names, lang)
            slot = (h % np.uint64(WORD_SLOTS)).astype(np.int64)
            may = often[slot]
            may[0] = False
            ids = np.where(may[ids], ids, 0)
            both = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
            pair = np.zeros(len(ids), np.int64)  # the entry of each word's pair with the next
            pair[both] = _pairs(h[ids[both]], h[ids[both + 1]]).astype(np.int64)
            goes = np.zeros(len(ids), bool)  # does a pointer go on from here to the next word
            goes[both] = often_pair[pair[both]]
            starts = np.flatnonzero(ids)
            if not len(starts):
                continue
            window = np.zeros((len(starts), LONGEST), np.int32)
            window[:, 0] = ids[starts]
            on = np.ones(len(starts), bool)
            for k in range(1, LONGEST):
                on = on & goes[np.minimum(starts + k - 1, len(ids) - 1)]
                window[on, k] = ids[starts[on] + k]
            above = sum(f[slot].astype(np.int64) for f in full)  # of each word: how many thresholds it is above
            parts = np.uint64(DEAL) ** above.astype(np.uint64)
            one, two = window[:, 0], window[:, 1]
            crowded = above[one] > 0
            with np.errstate(over="ignore"):
                to = (h[one] + h[two] % parts[one] * MIX[1]) * MIX[0] >> np.uint64(32)
            to = np.where(crowded & ((two == 0) | full_pair[pair[starts]]), ALL, (to % np.uint64(slots)).astype(np.int32)).astype(np.int32)
            order = np.lexsort(window.T[::-1])
            window, crowded, to = window[order], crowded[order], to[order]
            first = np.flatnonzero(np.r_[True, (window[1:] != window[:-1]).any(axis=1)])
            n = np.diff(np.r_[first, len(window)])
            window, crowded, to = window[first], crowded[first], to[first]
            for at in range(0, len(window), 1 << 16):
                some = slice(at, at + (1 << 16))
                said = [b" ".join([names[i] for i in row if i]) for row in window[some].tolist()]
                held.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(said)), pa.array(said, pa.binary()).cast(pa.string()), pa.array(to[some]), pa.array(crowded[some]), pa.array(n[some])], ["lang", "words", "slot", "crowded", "n"]))
            yield from projected(held)
        release()

    return docs.mapInArrow(run, "lang string, slot int, crowded boolean, words string, n binary, total long")


def grown(prefix: str, rest: list[str], n: np.ndarray, support: int) -> list[tuple[str, int]]:
    """Phrases that begin with a word, itself first, and how often each comes; rest and n: what follows it, and how often."""
    words = [r.split(" ") if r else [] for r in rest]
    size = np.array([len(w) for w in words])
    number: dict[str, int] = {}
    table = np.full((len(words), LONGEST - 1), -1)
    for i, w in enumerate(words):
        table[i, : len(w)] = [number.setdefault(x, len(number)) for x in w]
    names, out = list(number), []

    def extend(phrase: str, at: np.ndarray, more: int) -> None:
        total = int(n[at].sum())
        if total < support:
            return
        out.append((phrase, total))
        at = at[size[at] > more]
        if not len(at):
            return
        then = table[at, more]
        order = np.argsort(then, kind="stable")
        at, then = at[order], then[order]
        cuts = np.flatnonzero(np.r_[True, then[1:] != then[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            extend(f"{phrase} {names[then[a]]}", at[a:b], more + 1)

    extend(prefix, np.arange(len(words)), 0)
    return out


def by_slot(frames: Iterable[pd.DataFrame], support: int) -> Iterator[pd.DataFrame]:
    """Grows each first word of each slot by itself; the rows of a slot follow each other, in one frame or several."""

    def done(own: list[tuple[str, int, bool, str, bytes]]) -> Iterator[tuple[str, str, int]]:
        n = np.frombuffer(b"".join(r[4] for r in own), np.int64)
        by: dict[str, tuple[list[str], list[int]]] = {}
        for i, words in enumerate(x for r in own for x in r[3].split("\n")):
            first, _, rest = words.partition(" ")
            rests, at = by.setdefault(first, ([], []))
            rests.append(rest)
            at.append(i)
        lang, _, crowded = own[0][:3]
        for first, (rests, at) in by.items():
            times = n[at]
            if int(times.sum()) >= support:
                for found in grown(first, rests, times, support)[int(crowded) :]:  # a crowded word itself is in the sums
                    yield lang, *found

    def frame(rows: Iterable[tuple[str, str, int]]) -> pd.DataFrame:
        return pd.DataFrame(list(rows), columns=["lang", "phrase", "f"]).astype({"f": "int64"})

    held: list[tuple[str, int, bool, str, bytes]] = []
    for some in frames:
        for row in some.itertuples(index=False, name=None):
            if held and held[0][:3] != row[:3]:
                yield frame(done(held))
                held = []
            held.append(row)
    if held:
        yield frame(done(held))


def frequent(docs: DataFrame, support: int, text: str = "text", lang: str = "lang", crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, f for every phrase of at most five words that comes at least `support` times; and lang, n of all words."""
    docs = _rows(docs, text, lang)
    seen = cut(slot_counts(docs).groupBy("kind", "lang", "slot").agg(F.sum("n").alias("n")), "slots")
    totals = cut(seen.filter("kind = 'w'").select("lang", "n"), "totals")
    words, pairs, full_pairs = reached(seen, "w1", WORD_SLOTS, support), reached(seen, "w2", PAIR_SLOTS, support), reached(seen, "w2", PAIR_SLOTS, crowd + 1)
    full_words = [reached(seen, "w1", WORD_SLOTS, crowd * DEAL**k + 1) for k in range(DEALS)]
    slots = max(SLOTS, -(-(totals.agg(F.sum("n")).first()[0] or 0) // SLOT_WORDS))
    rows = cut(pointers(docs, slots, words, pairs, full_pairs, full_words), "pointers")
    at = ["lang", "slot", "crowded"]
    own = rows.filter(F.col("slot") != ALL).drop("total").repartition(*at).sortWithinPartitions(*at)
    grew = own.mapInPandas(lambda frames: by_slot(frames, support), "lang string, phrase string, f long")
    sums = rows.filter(F.col("slot") == ALL).select("lang", F.col("words").alias("phrase"), F.col("total").alias("n"))
    short = sums.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= support)
    out = cut(grew.unionByName(short), "phrases")
    discard(seen, rows)
    return out, totals


def first_of_each(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first `most` rows of each group with their rank: first of parts of it, then of fewer parts, so no task sorts a group."""
    parts = n_parts(rows.sparkSession)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int"))
    while True:
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
        if parts == 1:
            return rows.drop("_part")
        parts = -(-parts // 32)
        rows = rows.withColumn("_part", F.expr(f"_part div 32").cast("int"))


def collocations(docs: DataFrame, support: int = 100, percent: int = 100, most: int = 2000, text: str = "text", lang: str = "lang", crowd: int = CROWD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by the score of their weakest cut."""
    f, totals = frequent(docs, support, text, lang, crowd)
    words = F.split("phrase", " ")
    of_two = f.filter(F.instr("phrase", " ") > 0)
    # Inside a longer one that is as frequent, but for `percent`.
    inside = of_two.filter(F.size(words) > 2).select("lang", "f", F.size(words).alias("m"), words.alias("w"))
    inside = inside.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("k"))
    inside = inside.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.col("m") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))).alias("phrase"))
    around = inside.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = of_two.withColumnRenamed("f", "a").join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (100 * F.col("around") < percent * F.col("a"))).drop("around")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substr(phrase, length(left) + 2)"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(F.broadcast(totals), "lang") if totals.count() <= 10_000 else cuts.join(totals, "lang")
    cuts = cuts.withColumn("score", F.expr("(cast(a AS DECIMAL(38,0)) * n * 1000) div (cast(l AS DECIMAL(38,0)) * r)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return first_of_each(best, "lang", order, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
