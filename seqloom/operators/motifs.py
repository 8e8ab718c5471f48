"""K-mers, motif hits and motif families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; strings of two lengths differ in the longer one's length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b))).otherwise(F.aggregate(pairs, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0))))


def string_entropy(s: Column, alphabet: str = "ACGTN") -> Column:
    """Bits of the letters of an alphabet."""
    n = F.length(s)

    def term(c: str) -> Column:
        p = (n - F.length(F.replace(s, F.lit(c), F.lit("")))) / n
        return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))

    return F.when(n > 0, sum((term(c) for c in alphabet[1:]), term(alphabet[0]))).otherwise(F.lit(0.0))


def low_complexity(s: Column, alphabet: str = "ACGTN") -> Column:
    """Empty, three quarters of one letter, or one to four letters repeated from end to end."""
    n = F.length(s)
    most = F.greatest(*[n - F.length(F.replace(s, F.lit(c), F.lit(""))) for c in alphabet])
    cyclic = F.lit(False)
    for k in range(1, 5):
        cyclic = cyclic | (F.substring(F.repeat(F.substring(s, 1, k), F.ceil(n / k).cast("int")), F.lit(1), n) == s)
    return (n == 0) | (most >= n * 0.75) | cyclic


def kmer_stats(kmers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kmer, count, first_pos, last_pos, gap_mean, gap_std (population) of k-mers(keys, pos, kmer)."""
    from pyspark.sql.window import Window

    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy(*keys, "kmer").orderBy("pos"))
    g = kmers.withColumn("gap", gap)
    return g.groupBy(*keys, "kmer").agg(F.count("*").alias("count"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gap_mean"), F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("gap_std"))


def hamming_pairs(kmers: DataFrame, k: int, most: int, both_strands: bool = True) -> DataFrame:
    """a < b, distance, rc: pairs of distinct k-mers at most `most` apart, directly or as reverse complements.

    Pigeonhole: with at most `most` differing places one of `most` + 1 blocks is equal, so pairs meet by block, not each
    with each.
    """
    cuts = [k * j // (most + 1) for j in range(most + 2)]
    blocks = lambda c: F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.substring(c, cuts[j] + 1, cuts[j + 1] - cuts[j]).alias("s")) for j in range(most + 1)]))
    left = kmers.select(F.col("kmer").alias("a"), blocks(F.col("kmer")).alias("blk"))
    right = kmers.select(F.col("kmer").alias("b"), F.col("kmer").alias("w"), F.lit(False).alias("rc"))
    if both_strands:
        right = right.unionByName(kmers.select(F.col("kmer").alias("b"), reverse_complement(F.col("kmer")).alias("w"), F.lit(True).alias("rc")))
    right = right.select("*", blocks(F.col("w")).alias("blk"))
    met = left.join(right, "blk").filter("a < b").select("a", "b", "w", "rc").distinct()
    return met.withColumn("distance", hamming(F.col("a"), F.col("w"))).filter(F.col("distance") <= most).select("a", "b", "distance", "rc")


def components(links: DataFrame, vertices: DataFrame, v: str) -> DataFrame:
    """v, component (the smallest vertex reachable) by links(a, b): smallest labels spread along links, and labels of labels.

    Each round is written to the checkpoint folder; rounds grow with the logarithm of the longest path.
    """
    from ..session import checkpointed

    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(vertices.select(F.col(v).alias("v"), F.col(v).alias("l")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        spread = labels.join(near, "v", "left").select("v", "l", F.least("l", F.coalesce("m", "l")).alias("n"))
        jump = spread.select(F.col("v").alias("n"), F.col("n").alias("n2"))
        new = checkpointed(spread.join(jump, "n").select("v", "l", F.least("n", "n2").alias("n")))
        if new.filter(~F.col("l").eqNullSafe(F.col("n"))).isEmpty():
            return new.select(F.col("v").alias(v), F.col("n").alias("component"))
        labels = new.select("v", F.col("n").alias("l"))


def consensus(strings: DataFrame, keys: list[str], s: str, weight: str | None = None) -> DataFrame:
    """keys, consensus, support: the heaviest letter of each place, the smallest of equal ones, and its mean share."""
    from pyspark.sql.window import Window

    w = F.col(weight) if weight else F.lit(1)
    letters = strings.select(*keys, w.alias("w"), F.posexplode(F.split(s, "")).alias("p", "c")).groupBy(*keys, "p", "c").agg(F.sum("w").alias("w"))
    by = Window.partitionBy(*keys, "p")
    best = letters.withColumns({"r": F.row_number().over(by.orderBy(F.col("w").desc(), "c")), "share": F.col("w") / F.sum("w").over(by)}).filter("r = 1")
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "c"))), lambda x: x["c"]), "").alias("consensus"), F.avg("share").alias("support"))


def motif_hits(df: DataFrame, keys: list[str], seq: str, motifs: DataFrame, both_strands: bool = True, chunk: int = 1 << 16) -> DataFrame:
    """keys, motif, strand, pos0, pos1 of every occurrence of motifs(motif) of any lengths, overlapping ones too.

    Sequences (one-byte letters) are cut into chunks that overlap by the longest motif less one letter, and a hit starts in
    the chunk's own part, so none is lost or doubled at an edge. A motif is filed under its first letters, as many as the
    shortest has (SEED at most); places meet motifs by these letters and what meets is compared whole. A motif that is its
    own reverse complement hits on both strands.
    """
    from ..sources.streams import chunked

    forms = motifs.select(F.col("motif").alias("motif"), F.col("motif").alias("form"), F.lit("+").alias("strand")).filter("motif <> ''").distinct()
    if both_strands:
        forms = forms.unionByName(forms.select("motif", reverse_complement(F.col("motif")).alias("form"), F.lit("-").alias("strand")))
    size = forms.agg(F.min(F.length("form")).alias("least"), F.max(F.length("form")).alias("most")).first()
    seed, most = min(SEED, size["least"] or 1), size["most"] or 1
    forms = forms.withColumns({"_seed": F.left("form", F.lit(seed)), "_n": F.length("form")})
    pieces = chunked(df, keys, seq, chunk, most - 1)
    n = F.octet_length("piece")
    starts = F.when(n >= seed, F.sequence(F.lit(1), F.least(n - seed + 1, F.lit(chunk))))
    places = pieces.select(*keys, "start", "piece", F.explode(starts).alias("_s"))
    # A place takes no more of the piece with it than the longest motif needs.
    places = places.select(*keys, (F.col("start") + F.col("_s") - 1).alias("pos0"), F.substring(F.col("piece"), F.col("_s"), F.lit(most)).cast("string").alias("_ahead"))
    met = places.withColumn("_seed", F.left("_ahead", F.lit(seed))).join(forms, "_seed").filter(F.startswith("_ahead", F.col("form")))
    return met.select(*keys, "motif", "strand", "pos0", (F.col("pos0") + F.col("_n")).alias("pos1"))


#: Letters by which places and motifs meet.
SEED = 8


def longest_common(df: DataFrame, key: str, seq: str, chunk: int = 1 << 16) -> DataFrame:
    """substring, length: the longest strings that all sequences of df(key, seq), keys being unique, have in common; none if any is empty.

    Rank doubling: places whose strings of h letters are equal share a class, named by its smallest place; classes of h at
    two places h apart make those of 2 h, and of any length between. Places whose class isn't in every sequence go at once,
    as no longer common string starts there. So each step is a join and a grouping of at most one row a letter, and a
    length of L takes about 2 log2(L) steps.
    """
    from ..session import checkpointed
    from ..sources.streams import chunked

    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(seq), F.lit("")).alias("s"))
    n, least = rows.agg(F.count("*"), F.coalesce(F.min(F.length("s")), F.lit(0))).first()
    nothing = rows.select(F.col("s").alias("substring")).limit(0).withColumn("length", F.length("substring"))
    if not least:
        return nothing

    def common(places: DataFrame, by: list[str]) -> DataFrame:
        """k, pos, ck, cp: the places whose class, named anew by its first place, is in all sequences."""
        first = places.groupBy(*by, "k").agg(F.min("pos").alias("pos")).groupBy(*by).agg(F.count("*").alias("in"), F.min(F.struct("k", "pos")).alias("c")).filter(F.col("in") == n)
        same = places.join(first.select(*by, F.col("c.k").alias("ck2"), F.col("c.pos").alias("cp2")), by)
        return checkpointed(same.select("k", "pos", F.col("ck2").alias("ck"), F.col("cp2").alias("cp")))

    def joined(ranks: DataFrame, apart: int) -> DataFrame:
        ahead = ranks.select("k", (F.col("pos") - apart).alias("pos"), F.col("ck").alias("ck_b"), F.col("cp").alias("cp_b"))
        return ranks.join(ahead, ["k", "pos"])

    pair = ["ck", "cp", "ck_b", "cp_b"]
    letters = chunked(rows, ["k"], "s", chunk).select("k", "start", F.posexplode(F.split(F.col("piece").cast("string"), "")).alias("i", "letter")).filter("letter <> ''")
    ranks = common(letters.select("k", (F.col("start") + F.col("i")).alias("pos"), "letter"), ["letter"])
    if ranks.isEmpty():
        return nothing
    low, best = 1, ranks
    while 2 * low <= least and not (more := common(joined(best, low), pair)).isEmpty():
        low, best = 2 * low, more
    half, ranks, high = low, best, min(2 * low - 1, least)
    while low < high:
        middle = (low + high + 1) // 2
        more = common(joined(ranks, middle - half), pair)
        low, high, best = (low, middle - 1, best) if more.isEmpty() else (middle, high, more)
    named = best.select(F.col("ck").alias("k"), F.col("cp").alias("pos")).distinct()
    return named.join(rows, "k").select(F.substring(F.col("s"), (F.col("pos") + 1).cast("int"), F.lit(low)).alias("substring")).distinct().withColumn("length", F.length("substring"))


def period_counts(hits: DataFrame, keys: list[str], pos: str, most: int) -> DataFrame:
    """keys, period (1 to most), pairs: how many places of a set have another one so far ahead; periods without pairs have no row.

    64 places are the bits of a number. A hit is put into its own word and, as what comes ahead, into the words before it, so
    one grouping gives each word all that it meets, and a period is a shift, an AND and a count of bits: dense sequences
    cost a row for 64 places and nothing is joined.
    """
    words = -(-most // 64)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(pos), F.lit(64)).cast("int"))
    placed = hits.select(*keys, F.floor(F.col(pos) / 64).alias("_w"), bit.alias("_bit"), F.explode(F.sequence(F.lit(0), F.lit(words))).alias("_j"))
    ahead = [F.coalesce(F.bit_or(F.when(F.col("_j") == j, F.col("_bit"))), F.lit(0).cast("long")).alias(f"_b{j}") for j in range(words + 1)]
    masks = placed.groupBy(*keys, (F.col("_w") - F.col("_j")).alias("_w")).agg(*ahead).filter("_b0 <> 0")

    def pairs(p: int) -> Column:
        q, r = divmod(p, 64)
        far = F.col(f"_b{q}") if r == 0 else F.shiftrightunsigned(f"_b{q}", r).bitwiseOR(F.call_function("shiftleft", F.col(f"_b{q + 1}"), F.lit(64 - r)))
        return F.sum(F.bit_count(F.col("_b0").bitwiseAND(far))).alias(f"p{p}")

    wide = masks.groupBy(*keys).agg(*[pairs(p) for p in range(1, most + 1)])
    rows = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"p{p}").alias("pairs")) for p in range(1, most + 1)])).alias("x"))
    return rows.select(*keys, "x.period", "x.pairs").filter("pairs > 0")


def longest_tandem(df: DataFrame, keys: list[str], seq: str, chunk: int = 1 << 16) -> DataFrame:
    """keys, longest: the longest repetition of one pair of letters, in letters, at even places; sequences under four letters have no row.

    Each chunk is folded by itself into its first and last pair, their runs and its longest run; a sequence's chunks are
    then folded in order, a few values for each. A pair with N ends a run.
    """
    from ..sources.streams import chunked

    chunk -= chunk % 2
    pieces = chunked(df.filter(F.length(seq) >= 4), keys, seq, chunk).filter(F.octet_length("piece") > 1)
    units = F.transform(F.sequence(F.lit(0), F.floor(F.octet_length("piece") / 2).cast("int") - 1), lambda k: F.substring(F.col("piece"), k * 2 + 1, F.lit(2)).cast("string"))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"), F.lit(0).alias("head"), F.lit(0).alias("count"))

    def one(acc: Column, u: Column) -> Column:
        same = (u == acc["last"]) & ~F.contains(u, F.lit("N"))
        run, count = F.when(same, acc["run"] + 1).otherwise(1), acc["count"] + 1
        return F.struct(u.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"), F.when(run == count, run).otherwise(acc["head"]).alias("head"), count.alias("count"))

    told = pieces.select(*keys, "start", F.substring("piece", 1, 2).cast("string").alias("first"), F.aggregate(units, start, one).alias("f"))
    parts = told.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "first", "f"))).alias("parts"))

    def merge(acc: Column, p: Column) -> Column:
        f = p["f"]
        joined = (acc["last"] == p["first"]) & ~F.contains(p["first"], F.lit("N"))
        run = F.when(f["head"] == f["count"], F.when(joined, acc["run"] + f["count"]).otherwise(f["run"])).otherwise(f["run"])
        return F.struct(f["last"].alias("last"), run.alias("run"), F.greatest(acc["most"], f["most"], F.when(joined, acc["run"] + f["head"]).otherwise(0)).alias("most"))

    nothing = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    return parts.select(*keys, (F.aggregate("parts", nothing, merge)["most"] * 2).alias("longest"))


def skeleton_blocks(df: DataFrame, keys: list[str], seq: str, intervals: DataFrame, a: str, b: str, gap: int) -> DataFrame:
    """keys, name, start, end, spacer, block: a, and b `gap` letters after a's start, both whole inside one of intervals(keys, r_start, r_end, name).

    A block counts once for each name, however many intervals of that name hold it.
    """
    from .intervals import overlaps

    found = motif_hits(df, keys, seq, df.sparkSession.createDataFrame([(a,), (b,)], "motif string"), both_strands=False)
    first = found.filter(F.col("motif") == a).select(*keys, F.col("pos0").alias("start"))
    then = found.filter(F.col("motif") == b).select(*keys, (F.col("pos0") - gap).alias("start"), F.col("pos1").alias("end"))
    blocks = first.join(then, [*keys, "start"])
    held = overlaps(blocks, intervals, keys, 64).filter("r_start <= start AND end <= r_end").select(*keys, "name", "start", "end").distinct()
    text = lambda x, y: F.substring(F.col(seq), (x + 1).cast("int"), (y - x).cast("int"))
    out = held.join(df.select(*keys, seq), keys)
    return out.select(*keys, "name", "start", "end", text(F.col("start") + len(a), F.col("start") + gap).alias("spacer"), text(F.col("start"), F.col("end")).alias("block"))
