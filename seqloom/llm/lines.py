"""Line dedup: an exact set-similarity join over the lines of all texts (DataFrame operations only).

A line is the set of its lower-cased words. A later line goes if an earlier one, by key and line number, has a Jaccard
similarity of at least the threshold with it, be that one kept or not; lines without words stay.

1. Lines that are equal after lower-casing, told by a SHA-256 digest, are one set; all of them but the first go.
2. Two sets that reach the threshold differ in few words, at most d of both together, by their sizes. Words are dealt to
   more than d parts by their hash, so some part holds the same words in both. Sizes fall into classes whose sets are
   dealt to the same number of parts; a set joins the class of each size that a larger partner may have.
3. Parts are ordered by their words, most first, and a set shows only its first d + 1: fewer can't all differ, and small
   parts, which many sets share, stay at home. Several words seldom recur together, so the sets that meet in a part are
   mostly near ones, however large the corpus and however common its words.
4. Each set first meets only the earliest set of each of its parts. Sets that find an earlier partner so are no later side
   from then on, so that a group of near copies costs its size and not its square. The others then meet all sets of their
   parts, those of a part of many sets in blocks, so that no task gets one whole.
5. What has met is verified on the words themselves. Texts are read again for these lines only, and for those that lose
   lines.

Words are told apart by 64 bits where sets are dealt to parts, and texts of one key by 32 where sets meet.

Defined results: null counts as empty text, which is one empty line; rows with equal key and text are the same lines, and
stay or go together; null keys count as one largest key; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard, marked, prefiltered

#: Ratio of the largest and the smallest size of a class of sets.
RATIO = 1.6
#: Sets of one part beyond which they meet in blocks of so many.
CROWD = 4096
NO_KEY = (1 << 63) - 1


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.xxhash64(t).alias("t"), t.alias("text"))


def _words(text: Column) -> Column:
    """What stands between single white spaces."""
    for c in "\t\x0b\x0c\r\n":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def tokens_of(lowered: Column) -> Column:
    """The distinct words of a lower-cased line; words are divided by space and the ASCII controls 9 to 13."""
    return F.array_distinct(_words(lowered))


def lines_of(texts: DataFrame) -> DataFrame:
    """key, t, no, line (lower-cased) and its digest, for every line that has words."""
    lines = texts.select("key", "t", F.posexplode(F.split(F.lower("text"), "\n")).alias("no", "line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.withColumn("sig", F.substring(F.unhex(F.sha2("line", 256)), 1, 16))


AT = ["key", "t", "no"]


def _in_key() -> Column:
    """A line's number and 32 bits of its text's hash: its place within its key."""
    return F.call_function("shiftleft", F.col("no").cast("long"), F.lit(32)).bitwiseOR(F.col("t").bitwiseAND(F.lit((1 << 32) - 1))).alias("x")


def _class(n: Column) -> Column:
    return F.floor(F.log(n) / F.lit(log(RATIO))).cast("int")


def _top(of: Column) -> Column:
    """The largest size in a class, or one more."""
    return F.ceil(F.pow(F.lit(RATIO), of + 1))


def _most(n: Column, percent: int) -> Column:
    """The largest size of a partner."""
    return F.floor(n * 100 / percent)


def _differ(sizes: Column, percent: int) -> Column:
    """Words that two near sets of so many words together differ in, at most."""
    return F.floor(sizes * (100 - percent) / (100 + percent)).cast("int")


def _parts(of: Column, percent: int) -> Column:
    """Parts of the sets of a class: more than two of them may differ in, and some that stay at home."""
    d = _differ(2 * _top(of), percent)
    return (d + 1 + F.ceil(d / 3)).cast("long")


def _shown(n: Column, of: Column, part: Column, words: Column) -> Column:
    """A part by its number of words (255 at most, most first) and 55 bits of a hash: in this order a set shows its parts."""
    return F.call_function("shiftleft", (255 - F.least(n, F.lit(255))).cast("long"), F.lit(55)).bitwiseOR(F.shiftrightunsigned(F.xxhash64(of, part, words), 9))


def _bits(upper: int) -> Column:
    """64 bits of which each of the words that belong here turns one."""
    one = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(w, 32).bitwiseAND(F.lit(63)).cast("int"))
    own = lambda w: F.shiftrightunsigned(w, 38).bitwiseAND(F.lit(1)) == upper
    return F.aggregate("words", F.lit(0).cast("long"), lambda all_, w: F.when(own(w), all_.bitwiseXOR(one(w))).otherwise(all_))


def sets_of(lines: DataFrame, percent: int) -> DataFrame:
    """sig, key, t, no (of the earliest line, by which the set is known), many (lines), own, n, low, high and shown.

    There is one row for each class that a set joins, `own` in its own; `shown` has the hashes of the parts to meet in.
    Each word turns one of the 128 bits of low and high, so that sets differ in at least as many words as bits.
    """
    first = lines.select("sig", F.struct(*AT).alias("first"), "line").groupBy("sig").agg(F.min("first").alias("first"), F.count("*").alias("many"), F.any_value("line").alias("line"))
    sets = first.select("sig", "first.*", "many", F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))).alias("words"))
    sets = sets.select("*", F.size("words").alias("n"), _bits(0).alias("low"), _bits(1).alias("high"))
    sets = sets.withColumn("class", F.explode(F.sequence(_class(F.col("n")), _class(_most(F.col("n"), percent)))))
    # Each step uses columns that the one before made: what a lambda used of an expression would be made again for each word.
    sets = sets.withColumn("parts", _parts(F.col("class"), percent))
    dealt = F.transform("words", lambda w: F.call_function("shiftleft", F.pmod(w, F.col("parts")), F.lit(40)).bitwiseOR(F.shiftrightunsigned(w, 24)))
    sets = sets.withColumn("dealt", F.sort_array(dealt)).drop("words")
    of = lambda i: F.shiftright(F.get("dealt", i), 40)
    sets = sets.withColumn("starts", F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.get("dealt", i).bitwiseXOR(F.get("dealt", i - 1)) >= 1 << 40)))
    sets = sets.withColumn("ends", F.concat(F.slice("starts", F.lit(2), F.col("n")), F.array("n")))
    words = lambda i, j: F.aggregate(F.sequence(i, j - 1), F.lit(0).cast("long"), lambda all_, at: all_.bitwiseXOR(F.get("dealt", at)))
    full = F.zip_with("starts", "ends", lambda i, j: _shown(j - i, F.col("class"), of(i), words(i, j)))
    sets = sets.withColumn("full", F.sort_array(full)).withColumn("shows", _differ(F.col("n") + F.least(_top(F.col("class")), _most(F.col("n"), percent)), percent) + 1)
    # Of a set that fills too few parts, the parts without words follow; it shows all as if they were, which only adds to what meets.
    none = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: _shown(F.lit(0), F.col("class"), p, F.lit(0).cast("long")))
    shown = F.when(F.size("full") < F.col("shows"), F.concat("full", none)).otherwise(F.slice("full", F.lit(1), F.col("shows")))
    return sets.select("sig", *AT, "many", (F.col("class") == _class(F.col("n"))).alias("own"), "n", "low", "high", shown.alias("shown"))


def _needed(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / (100 + percent))


def _let_go(df: DataFrame) -> None:
    """Spark drops the shuffles of tables that were written and that nothing refers to; they would stay beside the next ones."""
    gc.collect()
    df.sparkSession._jvm.System.gc()  # Spark's cleaner follows the driver's collector


def met_sets(sets: DataFrame) -> DataFrame:
    """part, key, x, many, n, low, high and lead, for the sets of every part that two or more sets show; lead is its earliest set."""
    posts = sets.select(F.explode("shown").alias("part"), "key", _in_key()).repartition("part")
    # All of its columns are asked for, so that both sides of the join read one shuffle; what is built of it is small.
    twice = posts.groupBy("part").agg(F.count("*").alias("many"), *(f(c).alias(f"{n}{c}") for c in ("key", "x") for n, f in (("min", F.min), ("max", F.max))))
    twice = twice.filter("minkey < maxkey OR minx < maxx").select("part", "many")
    met = cut(posts.join(twice.hint("shuffle_hash"), "part"), "line-posts")
    del posts, twice
    _let_go(sets)
    told = met.join(sets.filter("own").select("key", _in_key(), "n", "low", "high"), ["key", "x"])
    out = cut(told.repartition("part").select("part", "key", "x", "many", "n", "low", "high", F.first(F.struct("key", "x", "n", "low", "high")).over(Window.partitionBy("part").orderBy("key", "x")).alias("lead")), "line-met")
    discard(met)
    return out


def _may_be_near(n: Column, low: Column, high: Column, ny: Column, lowy: Column, highy: Column, percent: int) -> Column:
    return F.bit_count(low.bitwiseXOR(lowy)) + F.bit_count(high.bitwiseXOR(highy)) <= _differ(n + ny, percent)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """key, t, no: the later one of each of the pairs (keyx, xx, keyy, xy) whose words reach the threshold."""
    wanted = cut(pairs.select(F.col("keyx").alias("key"), F.col("xx").alias("x")).unionByName(pairs.select(F.col("keyy").alias("key"), F.col("xy").alias("x"))).distinct(), "line-wanted")
    # Only lines move, and of them those that share a hash bucket with a wanted one.
    lines = texts.select("key", "t", F.posexplode(F.split(F.lower("text"), "\n")).alias("no", "line")).select("*", _in_key())
    found = cut(wanted.join(prefiltered(lines, wanted, ["key", "x"]).dropDuplicates(AT), ["key", "x"]), "line-words")
    for s in "xy":
        pairs = pairs.join(found.select(F.col("key").alias(f"key{s}"), F.col("x").alias(f"x{s}"), F.struct(*AT).alias(f"at{s}"), F.col("line").alias(f"line{s}")), [f"key{s}", f"x{s}"])
    wx, wy = tokens_of(F.col("linex")), tokens_of(F.col("liney"))
    near = F.size(F.array_intersect(wx, wy)) >= _needed(F.size(wx), F.size(wy), percent)
    out = cut(pairs.filter(near).select(F.greatest("atx", "aty").alias("later")).select("later.*").distinct(), "line-later")
    discard(wanted, found)
    return out


def _first_matches(texts: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """key, t, no: sets near to the earliest set of one of their parts, or that set where it is the later one."""
    near = _may_be_near(*(F.col(c) for c in ("n", "low", "high", "lead.n", "lead.low", "lead.high")), percent)
    apart = met.filter((F.col("key") != F.col("lead.key")) | (F.col("x") != F.col("lead.x"))).filter(near)
    pairs = cut(apart.select(F.col("key").alias("keyx"), F.col("x").alias("xx"), F.col("lead.key").alias("keyy"), F.col("lead.x").alias("xy")).distinct(), "line-pairs")
    done = _verified(pairs, texts, percent)
    discard(pairs)
    return done


def _other_matches(texts: DataFrame, met: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """key, t, no: of the sets that aren't done, those near to any other set of their parts."""
    # Of two sets, one is the lead; of more, the others haven't met each other yet.
    more = met.filter((F.col("many") > 2) & ((F.col("key") != F.col("lead.key")) | (F.col("x") != F.col("lead.x")))).withColumn("blocks", F.ceil(F.col("many") / CROWD))
    own = F.pmod(F.xxhash64("key", "x"), F.col("blocks")).alias("block")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    x = more.join(done.select("key", _in_key()), ["key", "x"], "left_anti")
    x = x.select("part", own, *(F.col(c).alias(f"{c}x") for c in ("key", "x", "n", "low", "high")))
    y = more.select("part", each, *(F.col(c).alias(f"{c}y") for c in ("key", "x", "n", "low", "high")))
    # Which of two lines of one key is the later one is seen from their texts.
    meet = x.join(y.hint("shuffle_merge"), ["part", "block"]).filter("keyy < keyx OR (keyy = keyx AND xy <> xx)")
    meet = meet.filter(_may_be_near(*(F.col(c) for c in ("nx", "lowx", "highx", "ny", "lowy", "highy")), percent))
    pairs = cut(meet.select("keyx", "xx", "keyy", "xy").distinct(), "line-pairs")
    out = _verified(pairs, texts, percent)
    discard(pairs)
    return out


def later_matches(texts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, t, no: the sets (by their first line) with an earlier line near to them."""
    met = met_sets(sets)
    done = _first_matches(texts, met, percent)
    more = _other_matches(texts, met, done, percent)
    discard(met)
    return done.unionByName(more).distinct()


def removed_lines(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, t (hash of the text) and removed (line numbers from 0, in order), for texts that lose lines."""
    texts = _texts(docs, key, text)
    sets = cut(sets_of(lines_of(texts), percent), "line-sets")
    _let_go(sets)
    gone = later_matches(texts, sets, percent)
    # A set of one line that has no earlier match says nothing about any line.
    fate = sets.filter("own").select("sig", *AT, "many").join(gone.withColumn("gone", F.lit(True)), AT, "left").filter("many > 1 or gone")
    fate = cut(fate.select("sig", F.struct(*AT).alias("first"), F.coalesce("gone", F.lit(False)).alias("gone")), "line-fates")
    discard(sets)
    lines = prefiltered(lines_of(texts).select("key", "t", "no", "sig"), fate, ["sig"])
    lost = lines.join(fate, "sig").filter(F.col("gone") | (F.struct("key", "t", "no") > F.col("first")))
    return lost.groupBy("key", "t").agg(F.sort_array(F.collect_set("no")).alias("removed"))


def without_lines(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_lines, n_removed and kept (the lines that stay, joined by line ends) for every row of docs.

    Texts that certainly lose nothing, by their key's hash bucket, are never shuffled.
    """
    removed = cut(removed_lines(docs, percent, key, text), "removed-lines")
    texts = marked(_texts(docs, key, text), removed, ["key", "t"], "maybe")
    none = F.array().cast("array<int>")
    at = ["key", "t"]
    rows = texts.filter("maybe").select(*at, "text").join(removed, at, "left").select("key", "text", F.coalesce("removed", none).alias("removed"))
    rows = rows.unionByName(texts.filter("not maybe").select("key", "text", none.alias("removed")))
    rows = rows.select("key", "text", "removed", F.split("text", "\n").alias("lines"))
    rows = rows.withColumn("n", F.size("lines"))
    # Runs of lines between the removed ones; each is cut out whole.
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), "removed"), F.concat("removed", F.array("n")), lambda a, b: F.slice(F.col("lines"), a + 2, b - a - 1))
    kept = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return rows.select(F.when(F.col("key") != NO_KEY, F.col("key")).alias(key), F.col("n").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), kept.alias("kept"))
