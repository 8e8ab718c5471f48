"""Symbol streams and grammars over documents and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.u64 import fnv1a
from ..operators.grammar import baseline, coupling_cells, edges, successors
from ..operators.neighbours import split_pairs
from ..operators.sequence import along, ngrams, pairs, run_lengths, sliding
from ..operators.stats import entropy, mode_of, mutual_information, safe_ratio, top_mass
from ..session import checkpointed
from .catalog import query, t

WORD = r"[^\x20\x09-\x0D]+"


def words() -> Column:
    """The lower-cased words. Splits at one plain letter after another are much cheaper than a pattern."""
    text = F.lower("text")
    for c in "\t\n\x0b\x0c\r":
        text = F.array_join(F.split(text, c), " ")
    return F.array_remove(F.split(text, " "), "")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """stream (lang), doc_id, pos, symbol: the lower-cased words of all documents."""
    return t(spark, d, "documents").select(F.col("lang").alias("stream"), "doc_id", F.posexplode(words()).alias("pos", "symbol"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """stream, doc_id, w (words), n: a document's words are one row, so its pairs need no shuffle and no window."""
    return t(spark, d, "documents").select(F.col("lang").alias("stream"), "doc_id", words().alias("w")).withColumn("n", F.size("w"))


def word_pairs(docs: DataFrame) -> DataFrame:
    """pos, from, to of each document's neighbours, with its other columns."""
    both = F.arrays_zip(F.slice("w", F.lit(1), F.col("n") - 1).alias("from"), F.slice("w", F.lit(2), F.col("n") - 1).alias("to"))
    other = [c for c in docs.columns if c not in ("w", "n")]
    return docs.filter("n > 1").select(*other, F.posexplode(both).alias("pos", "p")).select(*other, "pos", F.col("p.from").alias("from"), F.col("p.to").alias("to"))


TOK = rf"""tok AS (SELECT lang AS stream, doc_id, unnest(range(len(w))) AS pos, unnest(w) AS symbol
  FROM (SELECT *, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents))"""


def walk(spark: SparkSession, d: str) -> DataFrame:
    """stream (user), pos, symbol (event type), value, sec: the events of each user in order."""
    w = along(["user_id"], ["ts", "event_id"])
    return t(spark, d, "events").select(F.col("user_id").alias("stream"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("event_type").alias("symbol"), "value", F.unix_timestamp("ts").alias("sec"), "event_id", "ts")


WALK = """walk AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS symbol, value,
  floor(epoch(ts))::BIGINT AS sec, event_id, ts FROM events)"""


@query("s4_tokens_stream", f"WITH {TOK} SELECT stream, doc_id, pos::BIGINT AS pos, symbol FROM tok")
def s4(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).withColumn("pos", F.col("pos").cast("long"))


@query(
    "s5_csv_bins",
    """WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT least(greatest(floor((l_extendedprice - lo) * 15 / (hi - lo)), 0), 15)::BIGINT AS symbol, count(*) AS count FROM lineitem, r GROUP BY 1""",
)
def s5(spark: SparkSession, d: str) -> DataFrame:
    """A numeric column as 16 symbols over its own range; the range is one row."""
    line = t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("x"))
    r = line.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = F.least(F.greatest(F.floor((F.col("x") - F.col("lo")) * 15 / (F.col("hi") - F.col("lo"))), F.lit(0)), F.lit(15))
    return line.crossJoin(F.broadcast(r)).groupBy(b.cast("long").alias("symbol")).count()


@query(
    "s2_bytes_stream",
    """SELECT item_id, (i - 1)::BIGINT AS pos, (('0x' || substr(hex(encode(text)), (2 * i - 1)::INT, 2))::INT)::BIGINT AS symbol
FROM (SELECT item_id, text, unnest(range(1, octet_length(encode(text)) + 1)) AS i FROM benchmark)""",
)
def s2(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.streams import bytes_stream

    return bytes_stream(t(spark, d, "benchmark").select("item_id", F.encode("text", "utf-8").alias("content")), ["item_id"], "content")


_S3 = """SELECT item_id, s::BIGINT AS pos, substr(hex(encode(text)), (2 * s + 1)::INT, 16) AS w FROM (SELECT item_id, text, unnest(range(0, octet_length(encode(text)) - 7, 4)) AS s FROM benchmark)"""
_M = 1 << 64
_S3_FNV = f"""list_reduce(list_prepend({1469598103934665603}::HUGEINT, [('0x' || h)::HUGEINT FOR h IN regexp_extract_all(w, '..')]),
  lambda a, b: ((xor(a::UBIGINT, b::UBIGINT))::HUGEINT * 1099511628211 % {_M})::HUGEINT)"""


@query("s3_byte_windows", f"WITH x AS ({_S3}), h AS (SELECT item_id, pos, {_S3_FNV} AS h FROM x) SELECT item_id, pos, (CASE WHEN h >= {1 << 63}::HUGEINT THEN h - {_M}::HUGEINT ELSE h END)::BIGINT AS symbol FROM h")
def s3(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.streams import byte_windows

    return byte_windows(t(spark, d, "benchmark").select("item_id", F.encode("text", "utf-8").alias("content")), ["item_id"], "content", 8, 4)


_M = 1 << 64
_FNV_SQL = f"""list_reduce(list_prepend({1469598103934665603}::HUGEINT, [('0x' || h)::HUGEINT FOR h IN regexp_extract_all(hex(encode(w)), '..')]),
  lambda a, b: ((xor(a::UBIGINT, b::UBIGINT))::HUGEINT * 1099511628211 % {_M})::HUGEINT)"""


_SYMBOLS = f"""WITH {TOK}, w AS (SELECT symbol AS w, count(*) AS count FROM tok GROUP BY 1), h AS (SELECT w, count, {_FNV_SQL} AS h FROM w)
SELECT w AS token, count, (CASE WHEN h >= {1 << 63}::HUGEINT THEN h - {_M}::HUGEINT ELSE h END)::BIGINT AS symbol FROM h"""


@query("s4b_token_hashes", _SYMBOLS)
@query("s4c_token_symbols", _SYMBOLS)
def s4c(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct token of whatever length with its symbol."""
    return tokens(spark, d).groupBy(F.col("symbol").alias("token")).count().withColumn("symbol", fnv1a(F.col("token")))


@query(
    "w1_adjacent_pairs",
    f"""WITH {TOK}, p AS (SELECT *, lead(symbol) OVER (PARTITION BY doc_id ORDER BY pos) AS "to" FROM tok)
SELECT stream, doc_id, count(*) AS transitions, count(DISTINCT (symbol, "to")) AS kinds FROM p WHERE "to" IS NOT NULL GROUP BY 1, 2""",
)
def w1(spark: SparkSession, d: str) -> DataFrame:
    """Each document's pairs and their kinds, within its row."""
    docs = documents(spark, d).filter("n > 1")
    joined = F.zip_with(F.slice("w", F.lit(1), F.col("n") - 1), F.slice("w", F.lit(2), F.col("n") - 1), lambda a, b: F.concat(a, F.lit(" "), b))  # no word holds a space
    return docs.select("stream", "doc_id", (F.col("n") - 1).cast("long").alias("transitions"), F.size(F.array_distinct(joined)).cast("long").alias("kinds"))


@query(
    "a1_transition_counts",
    f"""WITH {WALK}, p AS (SELECT *, lead(symbol) OVER (PARTITION BY stream ORDER BY pos) AS nxt FROM walk)
SELECT symbol AS "from", nxt AS "to", count(*) AS count, min(pos)::BIGINT AS first FROM p WHERE nxt IS NOT NULL GROUP BY 1, 2""",
)
def a1(spark: SparkSession, d: str) -> DataFrame:
    return edges(pairs(walk(spark, d), ["stream"], ["pos"], "symbol"), [], "pos")


@query("a2_symbol_counts", f"WITH {TOK} SELECT stream, count(*) AS symbols, count(DISTINCT symbol) AS unique_symbols FROM tok GROUP BY 1")
def a2(spark: SparkSession, d: str) -> DataFrame:
    """Exact, by counting each symbol first: the second count then sees one row for each."""
    return tokens(spark, d).groupBy("stream", "symbol").count().groupBy("stream").agg(F.sum("count").alias("symbols"), F.count("*").alias("unique_symbols"))


@query(
    "a3_entropy",
    f"""WITH {TOK}, c AS (SELECT stream, symbol, count(*) AS n FROM tok GROUP BY 1, 2), p AS (SELECT stream, n / sum(n) OVER (PARTITION BY stream) AS p FROM c)
SELECT stream, round(-sum(p * log2(p)), 6) AS bits, round(-sum(p * ln(p)), 6) AS nats FROM p GROUP BY 1""",
)
def a3(spark: SparkSession, d: str) -> DataFrame:
    counts = tokens(spark, d).groupBy("stream", "symbol").count()
    bits = entropy(counts, ["stream"])
    return bits.select("stream", F.round("entropy", 6).alias("bits"), F.round(F.col("entropy") * F.ln(F.lit(2.0)), 6).alias("nats"))


@query(
    "a4_top_mass",
    f"""WITH {TOK}, c AS (SELECT stream, symbol, count(*) AS n FROM tok GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY n DESC, symbol) AS r FROM c)
SELECT stream, {', '.join(f"round(sum(CASE WHEN r <= {k} THEN n ELSE 0 END) / sum(n), 9) AS top{k}_mass" for k in (1, 8, 32))} FROM r GROUP BY 1""",
)
def a4(spark: SparkSession, d: str) -> DataFrame:
    out = top_mass(tokens(spark, d).groupBy("stream", "symbol").count(), ["stream"], [1, 8, 32], "symbol")
    return out.select("stream", *[F.round(f"top{k}_mass", 9).alias(f"top{k}_mass") for k in (1, 8, 32)])


@query(
    "a5_baseline_symbol",
    f"""WITH {WALK}, c AS (SELECT stream, symbol, count(*) AS count FROM walk GROUP BY 1, 2)
SELECT stream, symbol, count FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY count DESC, symbol) AS r FROM c) WHERE r = 1""",
)
def a5(spark: SparkSession, d: str) -> DataFrame:
    return mode_of(walk(spark, d).groupBy("stream", "symbol").count(), ["stream"], "symbol")


@query(
    "a6_best_successor",
    f"""WITH {WALK}, p AS (SELECT *, lead(symbol) OVER (PARTITION BY stream ORDER BY pos) AS nxt FROM walk),
e AS (SELECT stream, symbol, nxt, count(*) AS count, min(pos)::BIGINT AS first FROM p WHERE nxt IS NOT NULL GROUP BY ALL)
SELECT stream, symbol AS "from", nxt AS "to", count, first FROM (SELECT *, row_number() OVER (PARTITION BY stream, symbol ORDER BY count DESC, first, nxt) AS r FROM e) WHERE r = 1""",
)
def a6(spark: SparkSession, d: str) -> DataFrame:
    return successors(edges(pairs(walk(spark, d), ["stream"], ["pos"], "symbol"), ["stream"], "pos"), ["stream"])


def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """stream, from, to, tr, count, known: how often each pair occurs in training and in test, and the streams that train it, written once.

    The first 70 % of a document's symbols train. Only counts by stream and pair are shuffled.
    """
    size = t(spark, d, "documents").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return checkpointed(split_pairs(documents(spark, d), size, 0.7))


SPLIT = f"""{TOK}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM tok),
sp AS (SELECT stream, doc_id, pos, symbol, lead(symbol) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt, least(greatest(floor(n * 0.7::DOUBLE), 4), n - 2)::BIGINT AS cut FROM n WHERE n >= 6),
tr AS (SELECT stream, symbol, nxt, count(*) AS c FROM sp WHERE nxt IS NOT NULL AND pos + 1 < cut GROUP BY ALL),
te AS (SELECT stream, symbol, nxt, count(*) AS c FROM sp WHERE nxt IS NOT NULL AND pos >= cut GROUP BY ALL)"""


@query(
    "j1_edge_membership",
    f"""WITH {SPLIT} SELECT te.stream, sum(te.c)::BIGINT AS test_transitions, sum(CASE WHEN tr.c IS NULL THEN 0 ELSE te.c END)::BIGINT AS in_grammar
FROM te LEFT JOIN tr USING (stream, symbol, nxt) GROUP BY 1""",
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    test = pair_counts(spark, d).filter("count > 0")
    return test.groupBy("stream").agg(F.sum("count").alias("test_transitions"), F.sum(F.when(F.col("tr") > 0, F.col("count")).otherwise(0)).alias("in_grammar"))


_MATRIX = f"""{SPLIT}, r AS (SELECT stream AS "row", sum(c) AS n FROM te GROUP BY 1), k AS (SELECT DISTINCT stream AS col FROM tr),
h AS (SELECT te.stream AS "row", tr.stream AS col, sum(te.c) AS hits FROM te JOIN tr USING (symbol, nxt) GROUP BY ALL),
m AS (SELECT r."row", k.col, n::BIGINT AS test_transitions, coalesce(hits, 0)::BIGINT AS hits FROM r CROSS JOIN k LEFT JOIN h ON h."row" = r."row" AND h.col = k.col)"""


@query(
    "j2_coupling_matrix",
    f"""WITH {_MATRIX} SELECT "row", col, test_transitions, hits, round(hits / test_transitions, 9) AS kgram_accuracy, test_transitions - hits AS out_of_grammar,
round((test_transitions - hits) / test_transitions, 9) AS surprise_rate FROM m""",
)
def j2(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    return m.withColumns({c: F.round(c, 9) for c in ("kgram_accuracy", "surprise_rate")})


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return coupling_of(pair_counts(spark, d))


def coupling_of(counted: DataFrame) -> DataFrame:
    """The matrix of pair_counts; a pair's row has the streams that train it, so nothing is joined for it."""
    test = counted.filter("count > 0")
    hits = test.select(F.col("stream").alias("row"), F.explode("known").alias("col"), "count").groupBy("row", "col").agg(F.sum("count").alias("hits"))
    cols = counted.filter("tr > 0").select(F.col("stream").alias("col")).distinct()
    return coupling_cells(test, cols, hits)


@query(
    "a15_accuracy_lift",
    f"""WITH {SPLIT}, ts AS (SELECT stream, symbol, count(*) AS c FROM sp WHERE pos >= 1 AND pos < cut GROUP BY ALL),
b AS (SELECT stream, symbol AS bs FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY c DESC, symbol) AS r FROM ts) WHERE r = 1),
x AS (SELECT te.stream, sum(te.c) AS n, sum(CASE WHEN tr.c IS NULL THEN 0 ELSE te.c END) AS hit, sum(CASE WHEN te.nxt = b.bs THEN te.c ELSE 0 END) AS bh, any_value(b.bs) AS baseline_symbol
  FROM te LEFT JOIN tr USING (stream, symbol, nxt) JOIN b ON b.stream = te.stream GROUP BY 1)
SELECT stream, baseline_symbol, round(bh / n, 9) AS baseline_accuracy, round(hit / n, 9) AS kgram_accuracy, round(hit / n - bh / n, 9) AS lift, round((n - hit) / n, 9) AS surprise_rate FROM x""",
)
def a15(spark: SparkSession, d: str) -> DataFrame:
    counted = pair_counts(spark, d)
    test = counted.filter("count > 0")
    # Targets of training pairs are the training symbols from the second on.
    symbols = counted.filter("tr > 0").groupBy("stream", F.col("to").alias("symbol")).agg(F.sum("tr").alias("count"))
    base = baseline(symbols, test)
    hit = test.groupBy("stream").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("tr") > 0, F.col("count")).otherwise(0)).alias("hit"))
    acc = safe_ratio(F.col("hit"), F.col("n"))
    return hit.join(base, "stream").select("stream", "baseline_symbol", F.round("baseline_accuracy", 9).alias("baseline_accuracy"), F.round(acc, 9).alias("kgram_accuracy"), F.round(acc - F.col("baseline_accuracy"), 9).alias("lift"), F.round(safe_ratio(F.col("n") - F.col("hit"), F.col("n")), 9).alias("surprise_rate"))


@query("a18_self_cross", f"""WITH {_MATRIX} SELECT "row" = col AS is_self, count(*) AS cells, round(avg(hits / test_transitions), 9) AS accuracy FROM m GROUP BY 1""")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d).groupBy((F.col("row") == F.col("col")).alias("is_self")).agg(F.count("*").alias("cells"), F.round(F.avg("kgram_accuracy"), 9).alias("accuracy"))


@query("a18b_carriers_receivers", f"""WITH {_MATRIX}, x AS (SELECT *, hits / test_transitions AS a FROM m WHERE "row" <> col)
SELECT 'carrier' AS side, col AS stream, count(*) AS cells, round(avg(a), 9) AS avg_accuracy, round(min(a), 9) AS min_accuracy, round(max(a), 9) AS max_accuracy FROM x GROUP BY ALL
UNION ALL SELECT 'receiver', "row", count(*), round(avg(a), 9), round(min(a), 9), round(max(a), 9) FROM x GROUP BY ALL""")
def a18b(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d).filter(F.col("row") != F.col("col"))
    aggs = [F.count("*").alias("cells"), *[F.round(f("kgram_accuracy"), 9).alias(f"{n}_accuracy") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]]
    return m.groupBy(F.lit("carrier").alias("side"), F.col("col").alias("stream")).agg(*aggs).unionByName(m.groupBy(F.lit("receiver").alias("side"), F.col("row").alias("stream")).agg(*aggs))


@query("j5_asymmetry", f"""WITH {_MATRIX}, x AS (SELECT *, hits / test_transitions AS a FROM m)
SELECT p."row" AS a, p.col AS b, round(p.a, 9) AS forward, round(q.a, 9) AS backward, round(p.a - q.a, 9) AS asymmetry FROM x p JOIN x q ON p."row" = q.col AND p.col = q."row" WHERE p."row" < p.col""")
def j5(spark: SparkSession, d: str) -> DataFrame:
    """One pass instead of a self-join: both directions of a pair meet in one group."""
    m = matrix(spark, d).filter(F.col("row") != F.col("col"))
    ahead = F.col("row") < F.col("col")
    g = m.groupBy(F.least("row", "col").alias("a"), F.greatest("row", "col").alias("b")).agg(F.max(F.when(ahead, F.col("kgram_accuracy"))).alias("f"), F.max(F.when(~ahead, F.col("kgram_accuracy"))).alias("k"))
    return g.select("a", "b", F.round("f", 9).alias("forward"), F.round("k", 9).alias("backward"), F.round(F.col("f") - F.col("k"), 9).alias("asymmetry"))


@query("a18c_lift_histogram", f"""WITH {_MATRIX}, x AS (SELECT hits / test_transitions AS a FROM m), lim AS (SELECT min(a) AS lo, max(a) AS hi FROM x)
SELECT least(floor((a - lo) / (hi - lo) * 8), 7)::BIGINT AS bin, count(*) AS cells FROM x, lim GROUP BY 1""")
def a18c(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d).select(F.col("kgram_accuracy").alias("a"))
    r = m.agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    b = F.least(F.floor((F.col("a") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 8), F.lit(7))
    return m.crossJoin(F.broadcast(r)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("cells"))


@query("w4_run_lengths", f"""WITH {WALK}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY stream, symbol ORDER BY pos) AS g FROM walk),
r AS (SELECT stream, symbol, min(pos) AS start, count(*) AS length FROM g GROUP BY stream, symbol, g) SELECT stream, symbol, start::BIGINT AS start, length FROM r""")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return run_lengths(walk(spark, d), ["stream"], ["pos"], "symbol").select("stream", "symbol", "start", "length")


@query("w4b_longest_run", f"""WITH {WALK}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY stream, symbol ORDER BY pos) AS g FROM walk),
r AS (SELECT stream, symbol, count(*) AS length FROM g GROUP BY stream, symbol, g) SELECT symbol, max(length) AS longest, count(*) AS runs FROM r GROUP BY 1""")
def w4b(spark: SparkSession, d: str) -> DataFrame:
    return run_lengths(walk(spark, d), ["stream"], ["pos"], "symbol").groupBy("symbol").agg(F.max("length").alias("longest"), F.count("*").alias("runs"))


@query("w11_ngrams", f"""WITH {WALK}, g AS (SELECT symbol || '>' || lead(symbol, 1) OVER w || '>' || lead(symbol, 2) OVER w AS ngram FROM walk WINDOW w AS (PARTITION BY stream ORDER BY pos))
SELECT ngram, count(*) AS count FROM g WHERE ngram IS NOT NULL GROUP BY 1""")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return ngrams(walk(spark, d), ["stream"], ["pos"], "symbol", 3).groupBy("ngram").count()


@query("w13_sliding_windows", f"""WITH {WALK}, x AS (SELECT stream, symbol, unnest(range(greatest(0, floor((pos - 20) / 5.0)::BIGINT + 1), floor(pos / 5.0)::BIGINT + 1)) AS win FROM walk),
c AS (SELECT stream, win, symbol, count(*) AS n FROM x GROUP BY ALL), p AS (SELECT stream, win, n, n / sum(n) OVER (PARTITION BY stream, win) AS p FROM c)
SELECT stream, win, sum(n)::BIGINT AS n, count(*) AS unique_symbols, round(-sum(p * log2(p)), 6) + 0.0 AS entropy_bits FROM p GROUP BY ALL""")
def w13(spark: SparkSession, d: str) -> DataFrame:
    counts = sliding(walk(spark, d), "pos", 20, 5).groupBy("stream", "win", "symbol").count()
    out = entropy(counts, ["stream", "win"])
    return out.select("stream", "win", F.col("total").alias("n"), F.col("kinds").alias("unique_symbols"), F.round("entropy", 6).alias("entropy_bits"))


@query("w14_fixed_windows", f"WITH {WALK} SELECT floor(sec / 86400)::BIGINT AS win, symbol, count(*) AS count FROM walk GROUP BY ALL")
def w14(spark: SparkSession, d: str) -> DataFrame:
    return walk(spark, d).groupBy(F.floor(F.col("sec") / 86400).alias("win"), "symbol").count()


@query("w15_rolling_ngram_stride", f"""WITH {TOK}, g AS (SELECT doc_id, pos, symbol || ' ' || lead(symbol, 1) OVER w || ' ' || lead(symbol, 2) OVER w AS gram FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, count(*) AS grams, count(DISTINCT gram) AS unique_grams FROM g WHERE gram IS NOT NULL AND pos % 2 = 0 GROUP BY 1""")
def w15(spark: SparkSession, d: str) -> DataFrame:
    """Every second 3-gram of each document, within the row: no shuffle until the counts."""
    docs = documents(spark, d).filter("n >= 3")
    g = F.transform(F.sequence(F.lit(0), F.size("w") - 3, F.lit(2)), lambda i: F.array_join(F.slice("w", i + 1, F.lit(3)), " "))
    return docs.select("doc_id", g.alias("g")).select("doc_id", F.size("g").cast("long").alias("grams"), F.size(F.array_distinct("g")).cast("long").alias("unique_grams"))


@query("a19_envelope", f"""WITH {WALK}, c AS (SELECT stream, symbol, count(*) AS n FROM walk GROUP BY ALL)
SELECT symbol, round(avg(n), 10) AS mean, round(stddev_pop(n), 9) AS std, min(n) AS min, max(n) AS max FROM c GROUP BY 1""")
def a19(spark: SparkSession, d: str) -> DataFrame:
    c = walk(spark, d).groupBy("stream", "symbol").count()
    return c.groupBy("symbol").agg(F.round(F.avg("count"), 10).alias("mean"), F.round(F.stddev_pop("count"), 9).alias("std"), F.min("count").alias("min"), F.max("count").alias("max"))


@query("w17_window_zscore", f"""WITH {WALK}, c AS (SELECT floor(sec / 86400)::BIGINT AS win, count(*) AS n, count(DISTINCT stream) AS u, avg(value) AS v FROM walk GROUP BY 1),
b AS (SELECT avg(n) AS mn, stddev_pop(n) AS sn, avg(u) AS mu, stddev_pop(u) AS su, avg(v) AS mv, stddev_pop(v) AS sv FROM c)
SELECT win, round((greatest(0, (n - mn) / sn) + greatest(0, (u - mu) / su) + greatest(0, (v - mv) / sv)) / 3, 6) AS score FROM c, b""")
def w17(spark: SparkSession, d: str) -> DataFrame:
    """Mean of one-sided z-scores of each day's figures against all days; the baseline is one row."""
    c = walk(spark, d).groupBy(F.floor(F.col("sec") / 86400).alias("win")).agg(F.count("*").alias("n"), F.count_distinct("stream").alias("u"), F.avg("value").alias("v"))
    c = checkpointed(c)  # one row for each day
    b = c.agg(*[f(x).alias(f"{n}{x}") for x in "nuv" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = sum((F.greatest(F.lit(0.0), (F.col(x) - F.col(f"m{x}")) / F.col(f"s{x}")) for x in "uv"), F.greatest(F.lit(0.0), (F.col("n") - F.col("mn")) / F.col("sn")))
    return c.crossJoin(F.broadcast(b)).select("win", F.round(z / 3, 6).alias("score"))


@query("t3_top_edges", f"""WITH {TOK}, p AS (SELECT symbol, lead(symbol) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tok)
SELECT symbol AS "from", nxt AS "to", count(*) AS count FROM p WHERE nxt IS NOT NULL GROUP BY ALL ORDER BY count DESC, symbol, nxt LIMIT 50""")
def t3(spark: SparkSession, d: str) -> DataFrame:
    e = edges(word_pairs(documents(spark, d).select("w", "n")), [])
    return e.orderBy(F.col("count").desc(), "from", "to").limit(50)


@query("j11_aligned_drift", f"""WITH {WALK} SELECT a.stream, b.stream AS other, count(*) AS n, round(avg((a.symbol <> b.symbol)::INT), 9) AS hamming FROM walk a JOIN walk b ON a.pos = b.pos AND b.stream = a.stream + 1 GROUP BY ALL""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    w = walk(spark, d).select("stream", "pos", "symbol")
    b = w.select((F.col("stream") - 1).alias("stream"), "pos", F.col("symbol").alias("s2"))
    return w.join(b, ["stream", "pos"]).groupBy("stream").agg(F.count("*").alias("n"), F.round(F.avg((F.col("symbol") != F.col("s2")).cast("int")), 9).alias("hamming")).withColumn("other", F.col("stream") + 1)


@query("s9_stream_slice", f"WITH {WALK} SELECT stream, pos, symbol FROM walk WHERE pos BETWEEN 3 AND 12")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return walk(spark, d).select("stream", "pos", "symbol").filter(F.col("pos").between(3, 12))


@query("a21_mutual_information", f"""WITH {WALK}, p AS (SELECT symbol AS a, lead(symbol) OVER (PARTITION BY stream ORDER BY pos) AS b FROM walk), c AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL),
x AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c) SELECT round(sum(n / t * log2(n * t / (na * nb))), 6) AS mi FROM x""")
def a21(spark: SparkSession, d: str) -> DataFrame:
    e = edges(pairs(walk(spark, d), ["stream"], ["pos"], "symbol"), []).withColumn("all", F.lit(1))
    return mutual_information(e, ["all"], ["from"], ["to"]).select(F.round("mi", 6).alias("mi"))


