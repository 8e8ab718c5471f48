"""Null models over user states, simulations, governance of conversation turns, sinks and streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as G
from ..operators.grammar import split_point
from ..operators.permute import permuted_sql
from ..operators.resample import auto_draws, gates, pair_samples, shuffled_pairs
from ..operators.simulate import SERIES, genesis, lattice, planted, series, uniform_series
from ..operators.stats import null_scores
from ..operators.words import CAUSAL, has, steps
from ..session import checkpointed
from .catalog import query, t
from .fields import rule_table
from .streams import _MATRIX, WALK, coupling_of, documents, pair_counts, walk

REPLICATES = 40


def _accuracy(counts: DataFrame) -> DataFrame:
    """replicate, metric, value of counts(replicate, from, to, count): weighted top-1 share of the next state given the state."""
    c = counts.groupBy("replicate", "from").agg(F.max("count").alias("top"), F.sum("count").alias("n"))
    return c.groupBy("replicate").agg((F.sum("top") / F.sum("n")).alias("value")).withColumn("metric", F.lit("weighted_top1"))


def _determinism(c: DataFrame) -> DataFrame:
    """replicate, metric, value: _accuracy and the mean entropy (bits) of the next state over the states."""
    from pyspark.sql.window import Window

    p = F.col("count") / F.sum("count").over(Window.partitionBy("replicate", "from"))
    g = c.withColumn("_h", -p * F.log2(p)).groupBy("replicate", "from").agg(F.max("count").alias("top"), F.sum("count").alias("n"), F.sum("_h").alias("h"))
    both = g.groupBy("replicate").agg((F.sum("top") / F.sum("n")).alias("weighted_top1"), F.avg("h").alias("mean_entropy"))
    return both.unpivot("replicate", ["weighted_top1", "mean_entropy"], "metric", "value")


def state_scores(w: DataFrame, within: list[str], metrics: Callable[[DataFrame], DataFrame] = _accuracy, low: tuple[str, ...] = (), part: Column | None = None, replicates: int = REPLICATES) -> DataFrame:
    """Scores of the metrics of w(stream, pos, symbol) against symbols shuffled within groups."""
    from ..operators.sequence import pairs

    observed = metrics(pairs(w.withColumn("replicate", F.lit(0)), ["stream"], ["pos"], "symbol").groupBy("replicate", "from", "to").count())
    null = shuffled_pairs(w.select("stream", "pos", "symbol", *[c for c in within if c != "stream"]), within, "symbol", replicates, part=part)
    return null_scores(metrics(checkpointed(null)), observed, low=low)


def states(spark: SparkSession, d: str) -> DataFrame:
    return walk(spark, d).select("stream", "pos", "symbol", F.lit("all").alias("everything"), F.floor(F.col("sec") / 86400).alias("win"), F.floor(F.pmod(F.col("sec"), F.lit(86400)) / 6171.5).alias("slot"), F.floor(F.pmod(F.col("sec"), F.lit(86400)) / 3600).alias("family"))


SCORED = ["observed", "null_mean", "null_sd", "z", "p"]


#: Streams of one piece of a large group.
PIECE = 64


def null_test(spark: SparkSession, d: str, within: list[str], replicates: int = REPLICATES) -> DataFrame:
    part = None if within == ["stream"] else F.floor(F.col("stream") / PIECE)
    return state_scores(states(spark, d), within, part=part, replicates=replicates).withColumns({c: F.round(c, 6) for c in SCORED})


def null_sql(within: str, replicates: int = REPLICATES) -> str:
    """The same draws: a value goes to the place that the same permutation of its number within the group gives."""
    acc = lambda t, name: f"""{name}p AS (SELECT replicate, symbol AS f, lead(symbol) OVER (PARTITION BY replicate, stream ORDER BY pos) AS t FROM {t}),
{name}c AS (SELECT replicate, f, t, count(*) AS n FROM {name}p WHERE t IS NOT NULL GROUP BY ALL), {name}g AS (SELECT replicate, f, max(n) AS top, sum(n) AS n FROM {name}c GROUP BY ALL),
{name} AS (SELECT replicate, sum(top) / sum(n) AS value FROM {name}g GROUP BY 1)"""  # noqa: E731
    return f"""WITH {WALK}, w AS (SELECT stream, pos, symbol, floor(sec / 86400)::BIGINT AS win, floor((sec % 86400) / 6171.5::DOUBLE)::BIGINT AS slot, floor((sec % 86400) / 3600)::BIGINT AS family FROM walk),
ix AS (SELECT *, row_number() OVER (PARTITION BY {within} ORDER BY stream, pos) - 1 AS i, count(*) OVER (PARTITION BY {within}) AS n FROM w), reps AS (SELECT ix.{within}, i, n, symbol, replicate FROM ix, range({replicates}) x(replicate)),
mv AS ({permuted_sql('reps', 'i', 'n', f"'1|' || replicate || '|' || {within}", 'place')}), nl AS (SELECT mv.replicate, ix.stream, ix.pos, mv.symbol FROM mv JOIN ix ON ix.{within} = mv.{within} AND ix.i = mv.place), ob AS (SELECT 0 AS replicate, stream, pos, symbol FROM w),
{acc('nl', 'nv')}, {acc('ob', 'ov')},
s AS (SELECT o.value AS observed, avg(n.value) AS m, stddev_pop(n.value) AS sd, sum((n.value >= o.value)::INT) AS ge, count(*) AS iterations FROM nv n, ov o GROUP BY o.value)
SELECT 'weighted_top1' AS metric, round(observed, 6) AS observed, round(m, 6) AS null_mean, round(sd, 6) AS null_sd, round((observed - m) / sd, 6) AS z, round((ge + 1) / (iterations + 1), 6) AS p, iterations FROM s"""


@query("n2_state_shuffle", null_sql("stream"))
def n2(spark: SparkSession, d: str) -> DataFrame:
    """States permuted within each user, who keeps their frequencies."""
    return null_test(spark, d, ["stream"])


@query("n3_window_shuffle", null_sql("win"))
def n3(spark: SparkSession, d: str) -> DataFrame:
    return null_test(spark, d, ["win"])


@query("n4_slot_shuffle", null_sql("slot"))
def n4(spark: SparkSession, d: str) -> DataFrame:
    return null_test(spark, d, ["slot"])


@query("a32_n8_gates")
def n8(spark: SparkSession, d: str) -> DataFrame:
    return evidence_gates(states(spark, d))


def evidence_gates(w: DataFrame) -> DataFrame:
    scores = state_scores(w, ["stream"], _determinism, ("mean_entropy",))
    return gates(scores, [("weighted_top1", 10.0, 0.05, "high"), ("mean_entropy", -3.0, 0.05, "low")])


@query("n1_pair_null")
def n1(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of each cell of j2's matrix on pairs sampled from the row's test symbols, by sampling mode.

    A row's pairs are drawn once for each mode and read by every column's grammar. Its symbols are arrays of BLOCK places,
    so a draw meets one row of them for either side and only counts of drawn pairs go on.
    """
    known = pair_counts(spark, d).filter("tr > 0").select(F.col("stream").alias("col"), "from", "to")
    symbols, sizes = test_symbols(spark, d)
    draws = sizes.agg(auto_draws(F.min("edges")).alias("draws"))
    rows = sizes.crossJoin(F.broadcast(draws))  # one row
    alone = spark.range(1).select(F.lit("every").alias("stream"))
    out = None
    for mode in ("symbol_shuffle", "rotation", "block_boundary"):
        one = pair_samples(rows, alone, mode, 7).select(F.lit(mode).alias("mode"), "row", "pos_a", "pos_b")
        out = one if out is None else out.unionByName(one)
    held = symbols.groupBy(F.col("stream").alias("row"), F.floor(F.col("at") / BLOCK).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]).alias("w"))
    held = checkpointed(held)

    drawn = checkpointed(drawn_pairs(out, held))
    samples = drawn.groupBy("mode", "row").agg(F.sum("c").alias("samples"))
    hits = drawn.join(known.hint("merge"), ["from", "to"]).groupBy("row", "col", "mode").agg(F.sum("c").alias("hits"))
    cells = samples.crossJoin(F.broadcast(known.select("col").distinct()))  # as many as streams
    got = cells.join(hits, ["row", "col", "mode"], "left")
    return got.select("row", "col", (F.coalesce("hits", F.lit(0)) / F.col("samples")).alias("null_accuracy"), "samples", "mode")


def drawn_pairs(draws: DataFrame, held: DataFrame) -> DataFrame:
    """mode, row, from, to, c of draws(mode, row, pos_a, pos_b), whose symbols are in held(row, block, w).

    Both sides are shuffled: draws are made from a few rows, by whose size Spark would take them for a table to broadcast.
    """

    def looked_up(df: DataFrame, pos: str, name: str) -> DataFrame:
        """A block starts with its first place, so a place is its element."""
        return df.withColumn("block", F.floor(F.col(pos) / BLOCK)).join(held.hint("merge"), ["row", "block"]).withColumn(name, F.get("w", (F.col(pos) % BLOCK).cast("int"))).drop("w", "block", pos)

    return looked_up(looked_up(draws, "pos_a", "from"), "pos_b", "to").groupBy("mode", "row", "from", "to").agg(F.count("*").alias("c"))


#: Places of a stream's test symbols that are one row.
BLOCK = 1024


def test_symbols(spark: SparkSession, d: str, width: int = 1000) -> tuple[DataFrame, DataFrame]:
    """stream, at, symbol: pair_counts' test symbols of each stream, numbered from 0 by document and place; and stream, n, edges of it.

    Documents are numbered within ranges of identifiers and ranges by their counts, so that no window holds a whole stream's symbols.
    """
    docs = documents(spark, d).withColumn("part", F.floor(F.col("doc_id") / width)).filter("n >= 6").withColumn("cut", split_point("n", 0.7))
    docs = docs.select("stream", "part", "doc_id", (F.col("n") - F.col("cut")).alias("m"), F.slice("w", (F.col("cut") + 1).cast("int"), (F.col("n") - F.col("cut")).cast("int")).alias("w"))
    from pyspark.sql.window import Window

    before = lambda w: F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = docs.groupBy("stream", "part").agg(F.sum("m").alias("m"), F.sum(F.col("m") - 1).alias("edges"))
    sizes = parts.groupBy("stream").agg(F.sum("m").alias("n"), F.sum("edges").alias("edges"))
    starts = parts.select("stream", "part", before(Window.partitionBy("stream").orderBy("part")).alias("start"))
    placed = docs.withColumn("in_part", before(Window.partitionBy("stream", "part").orderBy("doc_id"))).join(starts, ["stream", "part"])
    symbols = placed.select("stream", (F.col("start") + F.col("in_part")).alias("first"), F.posexplode("w").alias("i", "symbol"))
    return symbols.select("stream", (F.col("first") + F.col("i")).alias("at"), "symbol"), sizes


@query(
    "j4_observed_null",
    f"""WITH {_MATRIX}, a AS (SELECT stream, symbol, sum(c) AS a FROM te GROUP BY ALL), b AS (SELECT stream, nxt, sum(c) AS b FROM te GROUP BY ALL),
y AS MATERIALIZED (SELECT a.stream AS "row", tr.stream AS col, tr.nxt, sum(a.a)::BIGINT AS a FROM tr JOIN a ON a.symbol = tr.symbol GROUP BY ALL),
z AS (SELECT y."row", y.col, sum(y.a * b.b::BIGINT)::DOUBLE AS e FROM y JOIN b ON b.nxt = y.nxt AND b.stream = y."row" GROUP BY ALL)
SELECT m."row", m.col, round(hits / test_transitions, 9) AS kgram_accuracy, round(e / (1.0::DOUBLE * test_transitions * test_transitions), 9) AS null_accuracy,
  round(hits / test_transitions - coalesce(e / (1.0::DOUBLE * test_transitions * test_transitions), 0), 9) AS lift FROM m LEFT JOIN z ON z."row" = m."row" AND z.col = m.col""",
)
def j4(spark: SparkSession, d: str) -> DataFrame:
    """The observed matrix beside its null by cell: here the accuracy expected of pairs drawn from symbol frequencies."""
    edges = pair_counts(spark, d)
    left = edges.groupBy("stream", F.col("from").alias("s")).agg(F.sum("count").alias("a")).filter("a > 0")
    right = edges.groupBy("stream", F.col("to").alias("s")).agg(F.sum("count").alias("b")).filter("b > 0")
    total = edges.groupBy(F.col("stream").alias("row")).agg(F.sum("count").alias("n"))
    known = edges.filter("tr > 0").select(F.col("stream").alias("col"), "from", "to")
    x = known.join(left.select(F.col("stream").alias("row"), F.col("s").alias("from"), "a"), "from").join(right.select(F.col("stream").alias("row"), F.col("s").alias("to"), "b"), ["row", "to"])
    null = x.groupBy("row", "col").agg(F.sum(F.col("a") * F.col("b")).alias("e")).join(total, "row").select("row", "col", (F.col("e") / (F.col("n").cast("double") * F.col("n"))).alias("null_accuracy"))
    m = coupling_of(edges).select("row", "col", "kgram_accuracy")
    out = m.join(null, ["row", "col"], "left").withColumn("lift", F.col("kgram_accuracy") - F.coalesce("null_accuracy", F.lit(0.0)))
    return out.withColumns({c: F.round(c, 9) for c in ("kgram_accuracy", "null_accuracy", "lift")})


@query("n7_pass_rule", f"""WITH {WALK}, c AS (SELECT stream % 2 AS side, symbol, count(*) AS n FROM walk GROUP BY ALL), a AS (SELECT side, max(n) / sum(n) AS v FROM c GROUP BY 1)
SELECT round(p.v, 9) AS plant, round(q.v, 9) AS control, p.v >= q.v + 0.05 AS passed FROM a p, a q WHERE p.side = 0 AND q.side = 1""")
def n7(spark: SparkSession, d: str) -> DataFrame:
    c = walk(spark, d).groupBy((F.col("stream") % 2).alias("side"), "symbol").count().groupBy("side").agg((F.max("count") / F.sum("count")).alias("v"))
    one = c.agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("plant"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("control"))
    return one.select(F.round("plant", 9).alias("plant"), F.round("control", 9).alias("control"), (F.col("plant") >= F.col("control") + 0.05).alias("passed"))


_M = 1 << 64


@query(
    "s15_uniform_series",
    f"""WITH s AS (SELECT i, ((i + 1)::HUGEINT * {0x9E3779B97F4A7C15}::HUGEINT % {_M}::HUGEINT + 42) % {_M}::HUGEINT AS z FROM range(2000) t(i)),
a AS (SELECT i, xor(z::UBIGINT, z::UBIGINT >> 30)::HUGEINT AS z FROM s), b AS (SELECT i, (z % {1 << 32} * {0xBF58476D1CE4E5B9}::HUGEINT + (z // {1 << 32} * {0xBF58476D1CE4E5B9 & 0xFFFFFFFF} % {1 << 32}) * {1 << 32}) % {_M}::HUGEINT AS z FROM a),
c AS (SELECT i, xor(z::UBIGINT, z::UBIGINT >> 27)::HUGEINT AS z FROM b), e AS (SELECT i, (z % {1 << 32} * {0x94D049BB133111EB}::HUGEINT + (z // {1 << 32} * {0x94D049BB133111EB & 0xFFFFFFFF} % {1 << 32}) * {1 << 32}) % {_M}::HUGEINT AS z FROM c),
f AS (SELECT i, xor(z::UBIGINT, z::UBIGINT >> 31) AS z FROM e) SELECT i, round((z >> 11)::DOUBLE / {1 << 53}::DOUBLE * 2 - 1, 12) AS x FROM f""",
)
def s15(spark: SparkSession, d: str) -> DataFrame:
    return uniform_series(spark, 2000, 42).withColumn("x", F.round("x", 12))


@query("s15b_series")
def s15b(spark: SparkSession, d: str) -> DataFrame:
    runs = t(spark, d, "region").select(F.explode(F.array(*[F.lit(k) for k in SERIES])).alias("kind"), (F.col("r_regionkey") + 1).cast("long").alias("seed"))
    return series(runs, 400)


@query("i1_genesis")
def i1(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("n_nationkey").cast("double")
    p = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), (i * 0.2 - 2 + F.sin(i * 0.17) * 0.35).alias("e"), (i * 0.2 - 2 + F.cos(i * 0.1241) * 0.35).alias("phi"), (F.cos(i * 0.17) * 0.02).alias("de"), (F.sin(i * 0.1241) * -0.02).alias("dphi"))
    return genesis(p, 64).select("i", "e", "phi", "x", "lock", "raw", "dom", "alignment", "resonance", "injection", "stability")


@query("i2_lattice")
def i2(spark: SparkSession, d: str) -> DataFrame:
    s = steps(rule_table(spark, d).filter(has("flags", CAUSAL)))
    return lattice(s.select(F.col("stream").alias("run"), F.col("sequence_index").alias("step"), "x_start", "x_end", "drive_x", "gain", "bias"), 64, 50)


@query("s16_plant", f"""WITH {WALK}, n AS (SELECT *, count(*) OVER (PARTITION BY stream) AS n, (pos - 2 + 7000) % 7 AS k FROM walk) SELECT stream, pos, CASE WHEN pos >= 2 AND k < 3 AND pos - k + 3 <= n THEN ['x', 'y', 'z'][(k + 1)::INT] ELSE symbol END AS symbol, pos >= 2 AND k < 3 AND pos - k + 3 <= n AS planted FROM n""")
def s16(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = walk(spark, d).select("stream", "pos", "symbol", F.count("*").over(Window.partitionBy("stream")).alias("n"))
    return planted(w, "stream", "pos", ["x", "y", "z"], 7, 2).drop("n")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, envelope, response: a made-up request and response for each conversation turn, wrong in several ways."""
    c = t(spark, d, "conversations")
    k = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(12))
    actions = F.lit('[{"name":"export","args":{"target":["report"],"mode":["pdf","html"]}},{"name":"open","args":{}}]')
    rules = F.lit('[{"kind":"forbidden_command","name":"open"},{"kind":"forbidden_claim_contains","path":"human_summary","contains":"guarantee"},{"kind":"forbidden_claim_contains","path":"machine_result.args.note","contains":"secretly"},{"kind":"requires_confirmation_if_risk_at_least","risk":"medium"}]')
    envelope = G.envelope_text(F.lit("app"), F.col("text"), F.to_json(F.struct("role")), actions, rules)
    body = F.to_json(F.struct(
        F.when(k == 1, "OTHER").otherwise(G.RESPONSE).alias("schema"), F.when(k == 2, "shout").when(k >= 6, "command").otherwise("answer").alias("type"), F.when(k == 3, "").when(k == 8, "we guarantee").otherwise("done").alias("human_summary"),
        F.when(k == 4, "high").when(k == 9, "medium").otherwise("low").alias("risk"), F.when(k == 11, F.lit(True)).otherwise(F.lit(False)).alias("requires_confirmation"), (k != 5).alias("uses_only_provided_context"),
        F.struct(F.when(k == 6, "open").when(k == 7, "erase").otherwise("export").alias("command"), F.when(k == 10, "secret").otherwise("report").alias("target")).alias("machine_result"),
    ))
    response = F.concat(F.lit("## Summary\n\n```text\n## Machine Result\n```\n\n## Machine Result\n\n```json\n"), body, F.lit("\n```\n"))
    return c.select("conv_id", "turn", k.alias("k"), envelope.alias("envelope"), response.alias("response"))


_ERRORS = {1: "response schema is not KRESP01", 2: "response type is missing or invalid", 3: "human_summary is missing", 4: "high or critical risk requires confirmation", 5: "response declares external context usage", 6: "response uses a forbidden command", 7: "command is not listed in Allowed Actions", 8: "response contains a forbidden claim", 9: "policy requires confirmation for this risk level", 10: "machine_result.target is not allowed for this command"}
_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in _ERRORS.items())


@query("g2_validate_response", f"WITH x AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 12 AS k FROM conversations) SELECT conv_id, turn, CASE k {_CASES} END AS error, k IN (0, 11) AS accepted, CASE WHEN k BETWEEN 1 AND 10 THEN 'reject' WHEN k = 11 THEN 'queue_confirmation' ELSE 'accept_answer' END AS decision FROM x")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return G.validated(turns(spark, d)).select("conv_id", "turn", "error", "accepted", "decision")


@query("g8_audit")
def g8(spark: SparkSession, d: str) -> DataFrame:
    return G.audit(G.validated(turns(spark, d)), ["conv_id", "turn"])


@query("s17_section_json", "SELECT conv_id, turn, 'text' AS kind FROM conversations")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """A heading inside a fence is text; the block under the real heading is found."""
    got = G.section_json(F.col("response"), "Machine Result")
    return turns(spark, d).select("conv_id", "turn", F.when(F.get_json_object(got, "$.schema").isNotNull(), "text").alias("kind"))


@query("s18_front_value", "SELECT conv_id, turn, 'KIE01' AS schema_name, 'app' AS domain FROM conversations")
def s18(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", "turn", G.front_value(F.col("envelope"), "schema").alias("schema_name"), G.front_value(F.col("envelope"), "domain").alias("domain"))


@query("g6_workflow", """WITH x AS (SELECT conv_id, turn, (conv_id * 5 + turn) % 6 AS k FROM conversations) SELECT conv_id, turn, CASE k WHEN 1 THEN 'duplicate workflow step target: export_document' WHEN 2 THEN 'duplicate workflow step target: open_preview'
WHEN 3 THEN 'workflow dependency violation: open_preview required before save_as' WHEN 4 THEN 'workflow step outside sandbox allowlist' WHEN 5 THEN 'workflow step count outside policy bounds' END AS error FROM x""")
def g6(spark: SparkSession, d: str) -> DataFrame:
    plans = {0: G.TARGETS, 1: ["export_document", "export_document"], 2: ["export_document", "open_preview", "save_as", "open_preview"], 3: ["export_document", "save_as"], 4: ["erase"], 5: []}
    step = lambda target: F.struct(F.lit("emit_ui_command").alias("command"), F.lit(target).alias("target"), F.lit("pdf").alias("mode"), F.lit(None).cast("string").alias("theme"))
    kind = "array<struct<command:string,target:string,mode:string,theme:string>>"
    k = F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(6))
    value = F.array().cast(kind)
    for n, p in plans.items():
        if p:
            value = F.when(k == n, F.array(*[step(x) for x in p]).cast(kind)).otherwise(value)
    return t(spark, d, "conversations").select("conv_id", "turn", G.workflow_error(value).alias("error"))


@query("g10_repair", """SELECT event_id, 'true' AS flag, '1' AS a FROM events""")
def g10(spark: SparkSession, d: str) -> DataFrame:
    bad = F.lit("{“flag”: True, \"a\": 1,}")
    fixed = G.repaired(bad)
    return t(spark, d, "events").select("event_id", F.get_json_object(fixed, "$.flag").alias("flag"), F.get_json_object(fixed, "$.a").alias("a"))


@query("g0_json_fields", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def g0(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("k2_csv_round_trip", "SELECT n_nationkey, n_name FROM nation")
def k2(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV in two appends and read back with its schema."""
    from ..sources.sinks import append_csv, read_csv, scratch

    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    path = scratch(spark, "csv")
    append_csv(n.filter("n_nationkey % 2 = 0"), path)
    append_csv(n.filter("n_nationkey % 2 = 1"), path)
    return read_csv(spark, path, n.schema)


@query("k4_content_manifest", "SELECT item_id, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256 FROM benchmark")
def k4(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import manifest

    return manifest(t(spark, d, "benchmark").select("item_id", F.encode("text", "utf-8").alias("content")), ["item_id"], "content")


@query("k3_json_report", "SELECT r_regionkey AS key, '{\"name\":\"' || r_name || '\"}' AS report FROM region")
def k3(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.to_json(F.struct(F.col("r_name").alias("name"))).alias("report"))


@query("st1_tumbling", "SELECT event_type, strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def st1(spark: SparkSession, d: str) -> DataFrame:
    """The streaming operator over the table as a finished stream; its batch form has the same plan."""
    from ..streaming.windows import tumbling

    return tumbling(t(spark, d, "events"), "ts", "1 day", ["event_type"]).select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


@query("st2_sessions", """WITH f AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 hour THEN 1 ELSE 0 END AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), c AS (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM c GROUP BY user_id, s""")
def st2(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.windows import session_counts

    return session_counts(t(spark, d, "events"), "ts", "6 hours", ["user_id"]).select("user_id", F.unix_timestamp("window.start").alias("start"), "n")
