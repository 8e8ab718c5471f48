"""Joins that must not go through the driver, and null models that grow with their input alone."""

from __future__ import annotations


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bins_of_intervals_are_not_broadcast(spark):
    """A small table of long intervals makes a large one of bins, whose size Spark doesn't know."""
    from seqloom.operators.intervals import overlaps

    a = spark.range(50).selectExpr("id % 3 AS g", "id AS i", "id * 7 AS start", "id * 7 + 1000000 AS end")
    b = spark.range(50).selectExpr("id % 3 AS g", "id AS j", "id * 9 AS r_start", "id * 9 + 10 AS r_end")
    got = overlaps(a, b, ["g"], 32)
    assert "Broadcast" not in plan_of(got)
    want = sum(i % 3 == j % 3 and 7 * i < 9 * j + 10 and 9 * j < 7 * i + 1_000_000 for i in range(50) for j in range(50))
    assert got.count() == want


def test_draws_are_not_broadcast(spark):
    """Draws made from a few rows are many, which the rows' size doesn't tell; neither they nor the symbols go through the driver."""
    from pyspark.sql import functions as F

    from seqloom.operators.resample import pair_samples
    from seqloom.plans.models import BLOCK, drawn_pairs

    rows = spark.createDataFrame([("x", 5000, 3000)], "stream string, n long, draws long")
    draws = pair_samples(rows, spark.createDataFrame([("every",)], "stream string"), "symbol_shuffle", 7).withColumn("mode", F.lit("m"))
    held = spark.range(5000).select(F.floor(F.col("id") / BLOCK).alias("block"), F.struct("id", F.col("id").cast("string").alias("s")).alias("p")).groupBy("block").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]).alias("w")).withColumn("row", F.lit("x"))
    got = drawn_pairs(draws.select("mode", "row", "pos_a", "pos_b"), held)
    pairs = got.collect()
    assert "BroadcastHashJoin" not in plan_of(got)
    want = {}
    for r in draws.collect():
        want[str(r.pos_a), str(r.pos_b)] = want.get((str(r.pos_a), str(r.pos_b)), 0) + 1
    assert {(r["from"], r.to): r.c for r in pairs} == want


def test_packed_shuffles_are_the_shuffles(spark, monkeypatch):
    """Counts of neighbours by replicate, over many blocks of places, against shuffled() row by row; null symbols follow nothing."""
    from pyspark.sql import functions as F

    from seqloom.operators import resample
    from seqloom.operators.sequence import pairs

    monkeypatch.setattr(resample, "SEATS", 16)
    monkeypatch.setattr(resample, "PACKED", 100)
    df = spark.range(400).selectExpr("id % 7 AS stream", "id div 7 AS pos", "id % 3 AS grp", "CASE WHEN id % 50 <> 0 THEN CAST(pmod(xxhash64(id), 5) AS string) END AS symbol")
    for cells in (resample.CELLS, 0):
        monkeypatch.setattr(resample, "CELLS", cells)
        for within, part in ((["stream"], None), (["grp"], F.floor(F.col("stream") / 2))):
            plain = resample.shuffled(df.select("stream", "pos", "symbol", *[c for c in within if c != "stream"]), within, ["stream", "pos"], "symbol", 3, part=part)
            want = pairs(plain, ["replicate", "stream"], ["pos"], "symbol").groupBy("replicate", "from", "to").count().collect()
            got = resample.shuffled_pairs(df, within, "symbol", 3, part=part).collect()
            assert {(r.replicate, r["from"], r.to): r["count"] for r in got} == {(r.replicate, r["from"], r.to): r["count"] for r in want}
            assert any(r["from"] is None for r in got) and all(r.to is not None for r in got)


def test_a_null_test_makes_no_row_for_a_replicate(spark, sf):
    """A value's places in all replicates move together: no explode, and no window by replicate and stream."""
    from seqloom.operators.resample import shuffled_pairs
    from seqloom.plans.models import states

    plan = plan_of(shuffled_pairs(states(spark, sf).select("stream", "pos", "symbol", "win"), ["win"], "symbol", 5))
    assert "Generate" not in plan and "FlatMapCoGroupsInPandas" in plan


def test_pairs_of_many_buffers_and_buckets(spark, monkeypatch):
    """Sums of small buffers against a plain count; null streams, null texts and short ones; the streams that train a pair."""
    import random
    from collections import Counter

    from seqloom.operators import neighbours

    monkeypatch.setattr(neighbours, "HELD", 50)
    r = random.Random(5)
    docs = [(r.choice(["a", "b", None]), None if r.random() < 0.1 else [r.choice("xyzé") * r.choice((1, 2)) for _ in range(r.choice((0, 1, 5, 6, 7, 30, 200)))]) for _ in range(80)]
    want = [Counter(), Counter()]
    for stream, w in docs:
        n = len(w or [])
        cut = min(max(int(n * 0.7), 4), n - 2)
        for i in range(n - 1 if n >= 6 else 0):
            if i + 1 < cut or i >= cut:
                want[i >= cut][stream, w[i], w[i + 1]] += 1
    df = spark.createDataFrame(docs, "stream string, w array<string>").repartition(3)
    out = neighbours.split_pairs(df, 1000, 0.7)
    got = out.collect()
    assert "FlatMapGroupsInArrow" in plan_of(out) and "Generate" not in plan_of(out)
    assert len(got) == len({(x.stream, x["from"], x.to) for x in got})
    for side, name in enumerate(("tr", "count")):
        assert {(x.stream, x["from"], x.to): x[name] for x in got if x[name]} == want[side]
    trained = {}
    for stream, f, t in want[0]:
        trained.setdefault((f, t), set()).add(stream)
    assert all(set(x.known) == trained.get((x["from"], x.to), set()) and len(x.known) == len(set(x.known)) for x in got if x["count"])
    assert neighbours.split_pairs(df.limit(0), 0, 0.7).collect() == []
