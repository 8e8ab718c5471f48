"""Sequences made of the benchmark texts' letters: k-mers, hits, families; and intervals of orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.intervals import as_of, overlaps
from ..operators.motifs import components, consensus, hamming, hamming_pairs, kmer_stats, longest_common, low_complexity, motif_hits, period_counts, reverse_complement, string_entropy
from ..sources.streams import chunked, kmers
from .catalog import query, t

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
K = 6


def seqs(spark: SparkSession, d: str, name: str = "benchmark", key: str = "item_id") -> DataFrame:
    """key, seq: each text's letters as bases, anything else as N."""
    return t(spark, d, name).select(F.col(key).alias("item_id"), F.regexp_replace(F.translate(F.lower("text"), LETTERS, BASES), "[^ACGT]", "N").alias("seq"))


SEQ = f"seqs AS (SELECT item_id, regexp_replace(translate(lower(text), '{LETTERS}', '{BASES}'), '[^ACGT]', 'N', 'g') AS seq FROM benchmark)"
KM = f"""{SEQ}, km0 AS (SELECT item_id, unnest(range(length(seq) - {K - 1})) AS pos, seq FROM seqs WHERE length(seq) >= {K}),
km AS (SELECT item_id, pos, substr(seq, pos + 1, {K}) AS kmer FROM km0 WHERE NOT contains(substr(seq, pos + 1, {K}), 'N'))"""


def km(spark: SparkSession, d: str) -> DataFrame:
    return kmers(seqs(spark, d), ["item_id"], "seq", K)


_KEY = " + ".join(f"(instr('CGT', substr(kmer, {j + 1}, 1)) * {4 ** (K - 1 - j)})" for j in range(K))


@query("s7_kmers", f"WITH {KM} SELECT item_id, pos, kmer, ({_KEY})::BIGINT AS symbol FROM km")
def s7(spark: SparkSession, d: str) -> DataFrame:
    return km(spark, d)


@query("s8_sequence_region", f"WITH {SEQ} SELECT item_id, substr(seq, 11, 20) AS region FROM seqs WHERE length(seq) > 10")
def s8(spark: SparkSession, d: str) -> DataFrame:
    return seqs(spark, d).filter(F.length("seq") > 10).select("item_id", F.substring("seq", 11, 20).alias("region"))


@query("p7_reverse_complement", f"WITH {KM} SELECT DISTINCT kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) AS revcomp FROM km")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return km(spark, d).select("kmer").distinct().withColumn("revcomp", reverse_complement(F.col("kmer")))


_CNT = ", ".join(f"(length(seq) - length(replace(seq, '{c}', '')))::BIGINT AS {c.lower()}" for c in "ACGTN")


@query("p8_composition", f"WITH s AS (SELECT doc_id, regexp_replace(translate(lower(text), '{LETTERS}', '{BASES}'), '[^ACGT]', 'N', 'g') AS seq FROM documents), c AS (SELECT doc_id, {_CNT} FROM s) SELECT *, CASE WHEN a + c + g + t > 0 THEN round((g + c) / (a + c + g + t), 9) ELSE 0 END AS gc_rate FROM c")
def p8(spark: SparkSession, d: str) -> DataFrame:
    s = seqs(spark, d, "documents", "doc_id").select(F.col("item_id").alias("doc_id"), *[(F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit("")))).cast("long").alias(c.lower()) for c in "ACGTN"])
    acgt = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    return s.withColumn("gc_rate", F.when(acgt > 0, F.round((F.col("g") + F.col("c")) / acgt, 9)).otherwise(F.lit(0.0)))


@query("p9_string_entropy", f"WITH {KM}, l AS (SELECT DISTINCT kmer FROM km), x AS (SELECT kmer, unnest(string_split(kmer, '')) AS c FROM l), n AS (SELECT kmer, c, count(*) / {K}.0::DOUBLE AS p FROM x WHERE c <> '' GROUP BY ALL) SELECT kmer, round(-sum(p * log2(p)), 6) + 0.0 AS bits FROM n GROUP BY 1")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return km(spark, d).select("kmer").distinct().withColumn("bits", F.round(string_entropy(F.col("kmer")), 6) + F.lit(0.0))


@query("p11_low_complexity", f"""WITH {KM}, l AS (SELECT DISTINCT kmer FROM km) SELECT kmer, (greatest({', '.join(f"length(kmer) - length(replace(kmer, '{c}', ''))" for c in 'ACGT')}) >= {K * 0.75} OR {' OR '.join(f"substr(repeat(substr(kmer, 1, {k}), {-(-K // k)}), 1, {K}) = kmer" for k in range(1, 5))}) AS low FROM l""")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return km(spark, d).select("kmer").distinct().withColumn("low", low_complexity(F.col("kmer")))


_WHOLE = f"""WITH {SEQ} SELECT a.item_id AS a, b.item_id AS b, CASE WHEN length(a.seq) <> length(b.seq) THEN greatest(length(a.seq), length(b.seq))
  ELSE coalesce(list_sum([(substr(a.seq, i, 1) <> substr(b.seq, i, 1))::INT FOR i IN range(1, length(a.seq) + 1)]), 0) END::INT AS distance FROM seqs a JOIN seqs b ON b.item_id = a.item_id + 1"""


@query("p10_hamming", _WHOLE)
@query("p10b_hamming_whole", _WHOLE)
def p10b(spark: SparkSession, d: str) -> DataFrame:
    """Each whole sequence with the next one: short ones and ones of two lengths too."""
    return neighbour_distances(seqs(spark, d))


def neighbour_distances(s: DataFrame) -> DataFrame:
    """a, b, distance of s(item_id, seq): each sequence with that of the next item_id."""
    b = s.select((F.col("item_id") - 1).alias("item_id"), F.col("seq").alias("seq2"))
    return s.join(b, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), hamming(F.col("seq"), F.col("seq2")).alias("distance"))


@query("p14_block_slices", f"WITH {SEQ}, b AS (SELECT item_id, o // 47 AS block, substr(seq, (o + 1)::INT, 47) AS s FROM (SELECT item_id, seq, unnest(range(0, length(seq), 47)) AS o FROM seqs)) SELECT item_id, block, substr(s, 1, 18) AS a_sequence, substr(s, 19, 16) AS spacer, substr(s, 35, 13) AS b_sequence, CASE WHEN length(s) < 47 THEN 'short' WHEN contains(s, 'N') THEN 'has_n' ELSE 'ok' END AS validation FROM b")
def p14(spark: SparkSession, d: str) -> DataFrame:
    """Every block of 47 letters in its three parts."""
    pieces = chunked(seqs(spark, d), ["item_id"], "seq", 47 * 1024)
    b = pieces.select("item_id", "start", "piece", F.explode(F.sequence(F.lit(0), F.octet_length("piece") - 1, F.lit(47))).alias("at"))
    b = b.select("item_id", ((F.col("start") + F.col("at")) / 47).cast("long").alias("block"), F.substring(F.col("piece"), F.col("at") + 1, F.lit(47)).cast("string").alias("s"))
    v = F.when(F.length("s") < 47, "short").when(F.contains("s", F.lit("N")), "has_n").otherwise("ok")
    return b.select("item_id", "block", F.substring("s", 1, 18).alias("a_sequence"), F.substring("s", 19, 16).alias("spacer"), F.substring("s", 35, 13).alias("b_sequence"), v.alias("validation"))


@query("p23_normalised_digest", f"WITH {SEQ} SELECT item_id, substr(sha256(seq), 1, 12) AS sha12 FROM seqs")
def p23(spark: SparkSession, d: str) -> DataFrame:
    return seqs(spark, d).select("item_id", F.left(F.sha2("seq", 256), F.lit(12)).alias("sha12"))


@query("a11_kmer_stats", f"""WITH {KM}, g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY item_id, kmer ORDER BY pos) AS gap FROM km)
SELECT item_id, kmer, count(*) AS count, min(pos) AS first_pos, max(pos) AS last_pos, round(coalesce(avg(gap), 0), 6) AS gap_mean, round(coalesce(stddev_pop(gap), 0), 6) AS gap_std FROM g GROUP BY ALL""")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return kmer_stats(km(spark, d), ["item_id"]).withColumns({c: F.round(c, 6) for c in ("gap_mean", "gap_std")})


@query("t4_top_kmers", f"WITH {KM} SELECT kmer, count(*) AS count FROM km GROUP BY 1 ORDER BY count DESC, kmer LIMIT 32")
def t4(spark: SparkSession, d: str) -> DataFrame:
    return km(spark, d).groupBy("kmer").count().orderBy(F.col("count").desc(), "kmer").limit(32)


@query("j10_revcomp_counts", f"WITH {KM}, c AS (SELECT kmer, count(*) AS count FROM km GROUP BY 1) SELECT a.kmer, a.count, coalesce(b.count, 0) AS revcomp_count FROM c a LEFT JOIN c b ON b.kmer = reverse(translate(a.kmer, 'ACGT', 'TGCA'))")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """A k-mer and its reverse complement share their smaller form: one grouping gives both counts."""
    c = km(spark, d).groupBy("kmer").count().withColumn("rc", reverse_complement(F.col("kmer")))
    w = Window.partitionBy(F.least("kmer", "rc"))
    both = c.withColumn("total", F.sum("count").over(w))
    return both.select("kmer", "count", F.when(F.col("kmer") == F.col("rc"), F.col("count")).otherwise(F.col("total") - F.col("count")).alias("revcomp_count"))


_HAM = f"list_sum([(substr(a.kmer, i, 1) <> substr(%s, i, 1))::INT FOR i IN range(1, {K + 1})])"
_RC = "reverse(translate(b.kmer, 'ACGT', 'TGCA'))"
FAM = f"""{KM}, top AS (SELECT kmer, count(*) AS count FROM km GROUP BY 1),
lk AS (SELECT a.kmer AS a, b.kmer AS b, {_HAM % 'b.kmer'}::INT AS distance, false AS rc FROM top a, top b WHERE a.kmer < b.kmer AND {_HAM % 'b.kmer'} <= 1
  UNION ALL SELECT a.kmer, b.kmer, {_HAM % _RC}::INT, true FROM top a, top b WHERE a.kmer < b.kmer AND {_HAM % _RC} <= 1)"""


def top(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct k-mer with its count."""
    return km(spark, d).groupBy("kmer").count()


@query("j8_hamming_links", f"WITH {FAM} SELECT * FROM lk")
def j8(spark: SparkSession, d: str) -> DataFrame:
    return hamming_pairs(top(spark, d), K, 1)


# Smallest labels spread one link in each of twenty rounds; no two of these k-mers of one family are farther apart.
FAMILY = f"""{FAM}, e AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
sp AS (SELECT kmer AS v, kmer AS l, 0 AS round FROM top UNION ALL
  SELECT v, min(l), round + 1 FROM (SELECT v, l, round FROM sp UNION ALL SELECT e.a, sp.l, sp.round FROM sp JOIN e ON e.b = sp.v) s WHERE round < 20 GROUP BY v, round),
fam AS (SELECT v AS kmer, l AS component FROM sp WHERE round = 20)"""


@query("x7_motif_families", f"WITH RECURSIVE {FAMILY} SELECT kmer, component FROM fam")
def x7(spark: SparkSession, d: str) -> DataFrame:
    m = top(spark, d)
    return components(hamming_pairs(m, K, 1), m, "kmer")


def families(spark: SparkSession, d: str) -> DataFrame:
    """component, size, total_count, top_member, consensus, support of the families of k-mers."""
    m = top(spark, d)
    fam = components(hamming_pairs(m, K, 1), m, "kmer").join(m, "kmer")
    g = fam.groupBy("component").agg(F.count("*").alias("size"), F.sum("count").alias("total_count"), F.max_by("kmer", F.struct("count", "kmer")).alias("top_member"))
    return g.join(consensus(fam, ["component"], "kmer", "count"), "component").withColumn("support", F.round("support", 9))


FAMILIES = f"""{FAMILY}, fm AS (SELECT component, kmer, count FROM fam JOIN top USING (kmer)),
fl AS (SELECT component, i AS p, substr(kmer, i::INT, 1) AS c, sum(count) AS w FROM fm, (SELECT unnest(range(1, {K + 1})) AS i) GROUP BY ALL),
fr AS (SELECT *, w / sum(w) OVER (PARTITION BY component, p) AS share, row_number() OVER (PARTITION BY component, p ORDER BY w DESC, c) AS r FROM fl),
fc AS (SELECT component, string_agg(c, '' ORDER BY p) AS consensus, round(avg(share), 9) AS support FROM fr WHERE r = 1 GROUP BY 1),
fs AS (SELECT component, count(*) AS size, sum(count)::BIGINT AS total_count, (max((lpad(count::VARCHAR, 12, '0') || kmer)))[13:] AS top_member FROM fm GROUP BY 1),
families AS (SELECT * FROM fs JOIN fc USING (component))"""


@query("a12_family_stats", f"WITH RECURSIVE {FAMILIES} SELECT * FROM families")
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Families with their consensus, its support and their weights."""
    return families(spark, d)


@query("t5_family_ranking", f"WITH RECURSIVE {FAMILIES} SELECT component, size, total_count, row_number() OVER (ORDER BY total_count DESC, component)::INT AS rank FROM families ORDER BY rank LIMIT 20")
def t5(spark: SparkSession, d: str) -> DataFrame:
    """The heaviest families in order; the rank's window sees twenty rows."""
    best = families(spark, d).orderBy(F.col("total_count").desc(), "component").limit(20)
    return best.select("component", "size", "total_count", F.row_number().over(Window.orderBy(F.col("total_count").desc(), "component")).alias("rank"))


@query("t8_family_signature", f"WITH RECURSIVE {FAMILIES} SELECT consensus AS kmer, total_count AS weight, component AS family, support FROM families ORDER BY total_count DESC, component LIMIT 8")
def t8(spark: SparkSession, d: str) -> DataFrame:
    """The heaviest families' consensus strings as a weighted signature."""
    return families(spark, d).orderBy(F.col("total_count").desc(), "component").limit(8).select(F.col("consensus").alias("kmer"), F.col("total_count").alias("weight"), F.col("component").alias("family"), "support")


@query("a13_consensus", f"""WITH {KM}, c AS (SELECT item_id, i AS p, substr(kmer, i::INT, 1) AS c, count(*) AS n FROM km, (SELECT unnest(range(1, {K + 1})) AS i) GROUP BY ALL),
r AS (SELECT *, n / sum(n) OVER (PARTITION BY item_id, p) AS share, row_number() OVER (PARTITION BY item_id, p ORDER BY n DESC, c) AS r FROM c) SELECT item_id, string_agg(c, '' ORDER BY p) AS consensus, round(avg(share), 9) AS support FROM r WHERE r = 1 GROUP BY 1""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return consensus(km(spark, d), ["item_id"], "kmer").withColumn("support", F.round("support", 9))


@query("x1_motif_hits", f"""WITH {KM}, m AS (SELECT kmer, count(*) AS n FROM km GROUP BY 1 ORDER BY n DESC, kmer LIMIT 8),
h AS (SELECT item_id, pos, km.kmer AS motif, '+' AS strand FROM km JOIN m ON m.kmer = km.kmer UNION ALL SELECT item_id, pos, m.kmer, '-' FROM km JOIN m ON reverse(translate(m.kmer, 'ACGT', 'TGCA')) = km.kmer) SELECT * FROM h""")
def x1(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d)


def hits(spark: SparkSession, d: str) -> DataFrame:
    """item_id, pos, motif, strand of the eight commonest k-mers, eight rows that are broadcast."""
    all_ = km(spark, d)
    m = all_.groupBy("kmer").count().orderBy(F.col("count").desc(), "kmer").limit(8).select(F.col("kmer").alias("motif"))
    forms = m.select("motif", F.col("motif").alias("kmer"), F.lit("+").alias("strand")).unionByName(m.select("motif", reverse_complement(F.col("motif")).alias("kmer"), F.lit("-").alias("strand")))
    return all_.join(F.broadcast(forms), "kmer").select("item_id", "pos", "motif", "strand")


@query("x2_signature_windows", f"""WITH {KM}, m AS (SELECT kmer, count(*) AS n FROM km GROUP BY 1 ORDER BY n DESC, kmer LIMIT 8),
h AS (SELECT item_id, pos, '+' AS strand FROM km JOIN m ON m.kmer = km.kmer UNION ALL SELECT item_id, pos, '-' FROM km JOIN m ON reverse(translate(m.kmer, 'ACGT', 'TGCA')) = km.kmer)
SELECT item_id, pos // 100 AS win, count(*) FILTER (strand = '+') AS hits, count(*) FILTER (strand = '-') AS rc_hits, round((count(*) FILTER (strand = '-') + 1) / (count(*) + 1), 9) AS rc_balance FROM h GROUP BY ALL""")
def x2(spark: SparkSession, d: str) -> DataFrame:
    plus = F.col("strand") == "+"
    g = hits(spark, d).groupBy("item_id", F.floor(F.col("pos") / 100).alias("win")).agg(F.sum(plus.cast("int")).alias("hits"), F.sum((~plus).cast("int")).alias("rc_hits"))
    return g.withColumn("rc_balance", F.round((F.col("rc_hits") + 1) / (F.col("hits") + F.col("rc_hits") + 1), 9))


@query("j13_period_scan", f"""WITH {KM}, m AS (SELECT kmer, count(*) AS n FROM km GROUP BY 1 ORDER BY n DESC, kmer LIMIT 8), h AS (SELECT DISTINCT item_id, pos FROM km JOIN m ON m.kmer = km.kmer)
SELECT (b.pos - a.pos)::INT AS period, count(*) AS pairs FROM h a JOIN h b ON a.item_id = b.item_id AND b.pos - a.pos BETWEEN 1 AND 50 GROUP BY 1""")
def j13(spark: SparkSession, d: str) -> DataFrame:
    """Hit positions as bits of words: a period is a shift and a count."""
    h = hits(spark, d).filter("strand = '+'").select("item_id", "pos").distinct()
    return period_counts(h, ["item_id"], "pos", 50).groupBy("period").agg(F.sum("pairs").alias("pairs"))


@query("x5_cross_counts", f"""WITH {KM}, m AS (SELECT kmer, count(*) AS n FROM km GROUP BY 1 ORDER BY n DESC, kmer LIMIT 5) SELECT item_id, kmer, ((length(seq) - length(replace(seq, kmer, ''))) / {K})::BIGINT AS count FROM seqs, m WHERE contains(seq, kmer)""")
def x5(spark: SparkSession, d: str) -> DataFrame:
    """Non-overlapping occurrences of five motifs in every sequence."""
    m = km(spark, d).groupBy("kmer").count().orderBy(F.col("count").desc(), "kmer").limit(5).select("kmer")
    s = seqs(spark, d).crossJoin(F.broadcast(m)).filter(F.contains("seq", F.col("kmer")))  # five rows
    return s.select("item_id", "kmer", ((F.length("seq") - F.length(F.replace("seq", F.col("kmer"), F.lit("")))) / K).cast("long").alias("count"))


@query("w5_homopolymers", f"WITH {SEQ} SELECT item_id, greatest({', '.join(f"coalesce(list_max([length(x) FOR x IN regexp_extract_all(seq, '{c}+')]), 0)" for c in 'ACGT')})::INT AS longest FROM seqs")
def w5(spark: SparkSession, d: str) -> DataFrame:
    runs = F.regexp_extract_all("seq", F.lit("(A+|C+|G+|T+)"), F.lit(1))
    return seqs(spark, d).select("item_id", F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).alias("longest"))


_IV = """o AS (SELECT o_custkey AS grp, o_orderkey, (epoch(o_orderdate) / 86400)::BIGINT AS start, (epoch(o_orderdate) / 86400)::BIGINT + 1 + o_orderkey % 40 AS "end" FROM orders),
r AS (SELECT o_custkey AS grp, o_orderkey AS other, (epoch(o_orderdate) / 86400)::BIGINT + 10 AS r_start, (epoch(o_orderdate) / 86400)::BIGINT + 40 AS r_end FROM orders),
ov AS (SELECT grp, o_orderkey, other, least("end", r_end) - greatest(start, r_start) AS overlap, "end" - start AS span FROM o JOIN r USING (grp) WHERE start < r_end AND r_start < "end")"""


def ov(spark: SparkSession, d: str) -> DataFrame:
    day = (F.unix_timestamp("o_orderdate") / 86400).cast("long")
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("grp"), "o_orderkey", day.alias("start"), (day + 1 + F.col("o_orderkey") % 40).alias("end"))
    r = t(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("other"), (day + 10).alias("r_start"), (day + 40).alias("r_end"))
    return overlaps(o, r, ["grp"], 32).withColumn("span", F.col("end") - F.col("start"))


@query("j7_interval_overlap", f"WITH {_IV} SELECT grp, o_orderkey, other, overlap FROM ov")
def j7(spark: SparkSession, d: str) -> DataFrame:
    return ov(spark, d).select("grp", "o_orderkey", "other", "overlap")


@query("j7b_overlap_forms", f"WITH {_IV} SELECT o_orderkey, sum(overlap)::BIGINT AS total, least(sum(overlap), any_value(span))::BIGINT AS capped, max(overlap) AS strongest FROM ov GROUP BY 1")
def j7b(spark: SparkSession, d: str) -> DataFrame:
    """The sum, the sum up to the span, and the strongest overlap of each interval."""
    return ov(spark, d).groupBy("o_orderkey").agg(F.sum("overlap").alias("total"), F.least(F.sum("overlap"), F.any_value("span")).alias("capped"), F.max("overlap").alias("strongest"))


@query("p24_overlap_length", """SELECT o_orderkey, greatest(0, least(o_orderkey % 40, 30) - greatest(o_custkey % 35, 5))::BIGINT AS overlap FROM orders""")
def p24(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.intervals import overlap_length

    return t(spark, d, "orders").select("o_orderkey", overlap_length(F.col("o_custkey") % 35, F.col("o_orderkey") % 40, F.lit(5), F.lit(30)).cast("long").alias("overlap"))


@query("j16_as_of", """WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT e.user_id, e.event_id, v.value AS asof_value FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def j16(spark: SparkSession, d: str) -> DataFrame:
    """The latest view's value at each purchase of a user."""
    ev = t(spark, d, "events")
    views = ev.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return as_of(ev.filter("event_type = 'purchase'").select("user_id", "event_id", "ts"), views, ["user_id"], "ts", "value").select("user_id", "event_id", "asof_value")
