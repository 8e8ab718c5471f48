"""Golden values and invariants of functions and operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions.field import variant_id, with_field
from seqloom.functions.u64 import FNV_OFFSET, FNV_PRIME, GAMMA, MIX_1, MIX_2, add64, fnv1a, hash64, mul64, signed, splitmix, unsigned_order
from seqloom.operators.motifs import components, hamming, hamming_pairs, low_complexity
from seqloom.operators.sequence import islands, sessions
from seqloom.operators.simulate import SERIES, field_arrays, genesis, series
from seqloom.sources.streams import bytes_stream, conllu_tokens, fasta_chunks, kmers

M = (1 << 64) - 1


def mix(x: int) -> int:
    x = (x ^ x >> 30) * MIX_1 & M
    x = (x ^ x >> 27) * MIX_2 & M
    return x ^ x >> 31


def test_64_bit_arithmetic(spark):
    r = random.Random(3)
    rows = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(200)] + [(0, M), (1 << 63, 1 << 63), (M, 1)]
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in rows], "a long, b long")
    got = df.select(add64(F.col("a"), F.col("b")), mul64(F.col("a"), MIX_2), hash64(F.col("a"))).collect()
    assert [tuple(g) for g in got] == [(signed(a + b), signed(a * MIX_2), signed(mix(a))) for a, b in rows]


def test_generator_is_random_access(spark):
    want, state = [], 99
    for _ in range(20):
        state = (state + GAMMA) & M
        want.append(signed(mix(state)))
    assert [r[0] for r in spark.range(1, 21).select(splitmix(99, F.col("id"))).orderBy("id").collect()] == want


def test_fnv(spark):
    def fnv(b: bytes) -> int:
        h = FNV_OFFSET
        for c in b:
            h = (h ^ c) * FNV_PRIME & M
        return signed(h)

    words = ["", "a", "héllo", "x y"]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(fnv1a(F.col("w"))).collect()] == [fnv(w.encode()) for w in words]


def test_unsigned_order(spark):
    xs = [signed(x) for x in (5, M, 1 << 63, 0, 7)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x long").orderBy(unsigned_order(F.col("x"))).collect()]
    assert got == [0, 5, 7, signed(1 << 63), -1]


#: Both signs of magnitudes from tiny to huge, zero, and seeded draws between.
POINTS = [0.0, *(sign * 10.0**e for e in (-9, -4, -1, 2) for sign in (1, -1)), *random.Random(17).choices([k / 37 for k in range(-190, 191)], k=25)]


def test_field_identities(spark):
    rows = with_field(spark.createDataFrame([(x,) for x in POINTS], "x double")).collect()
    arrays = field_arrays(np.array(POINTS))
    for j, r in enumerate(rows):
        k = [r[f"k{i}"] for i in range(1, 6)]
        assert r["ek"] == pytest.approx(sum(v * v for v in k) ** 0.5, rel=1e-12)
        assert r["lock"] == pytest.approx(np.tanh(r["ek"] + abs(r["ak"])), rel=1e-12)
        assert abs(k[r["raw"] - 1]) == max(map(abs, k)) and r[f"s{r['dom']}"] == r["dom_score"]
        for c in ("k2", "k4", "k5", "lock", "dom_score"):
            assert r[c] == pytest.approx(arrays[c][j], rel=1e-9, abs=1e-12)


def test_variant_id(spark):
    df = with_field(spark.createDataFrame([(0.5,), (0.5,), (0.7,)], "x double"))
    ids = [r[0] for r in df.select(variant_id(F.col("raw"), F.col("dom"), F.col("lock"), F.col("dom_score"), [F.col(f"k{j}") for j in range(1, 6)])).collect()]
    assert ids[0] == ids[1] != ids[2]


def test_kmers_by_definition(spark):
    r = random.Random(5)
    rows = [(k, "".join(r.choice("ACGTN" if k % 3 else "ACGTé") for _ in range(r.choice((0, 2, 3, 40, 300))))) for k in range(12)]
    for chunk in (7, 64, 1 << 16):
        got = {(x["id"], x["pos"], x["kmer"], x["symbol"]) for x in kmers(spark.createDataFrame(rows, "id int, seq string"), ["id"], "seq", 3, chunk).collect()}
        want = {(k, p, s[p : p + 3], sum("ACGT".index(c) * 4 ** (2 - i) for i, c in enumerate(s[p : p + 3]))) for k, s in rows for p in range(len(s) - 2) if set(s[p : p + 3]) <= set("ACGT")}
        assert got == want


def test_kmers_take_linear_time(spark):
    """A sequence sixteen times as long must not take much more than sixteen times as long."""
    import time

    def seconds(n: int) -> float:
        df = spark.range(1).select("id", F.repeat(F.lit("ACGTTGCA"), n // 8).alias("seq"))
        began = time.time()
        assert kmers(df, ["id"], "seq", 12).count() == n - 11
        return time.time() - began

    seconds(40_000)
    assert seconds(640_000) < 16 * max(seconds(40_000), 0.5)


def test_bytes_golden(spark):
    df = spark.createDataFrame([(1, bytearray(b"ABC\n"))], "id int, content binary")
    assert [r["symbol"] for r in bytes_stream(df, ["id"], "content").orderBy("pos").collect()] == [65, 66, 67, 10]


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 x\nACG\nTAC\n>s2\nNN\n")
    assert {(r["chrom"], r["seq"]) for r in fasta_chunks(spark, str(tmp_path / "a.fa")).collect()} == {("s1", "ACGTAC"), ("s2", "NN")}
    row = lambda i, w: "\t".join([i, w, w, "NOUN", *["_"] * 6])
    (tmp_path / "b.conllu").write_text("# x\n" + row("1", "a") + "\n" + row("2-3", "bc") + "\n" + row("2", "b") + "\n\n" + row("1", "d") + "\n")
    assert sorted(r["form"] for r in conllu_tokens(spark, str(tmp_path / "b.conllu")).collect()) == ["a", "b", "d"]


def test_islands_and_sessions(spark):
    df = spark.createDataFrame([("u", k, s) for k, s in enumerate("aabbba")] + [("v", 0, None), ("v", 1, None)], "u string, i int, s string")
    assert [r["seg"] for r in islands(df, ["u"], ["i"], ["s"]).orderBy("u", "i").collect()] == [0, 0, 1, 1, 1, 2, 0, 0]
    at = spark.createDataFrame([("u", x) for x in (0, 5, 10, 16, 16)], "u string, x int")
    assert [r["cluster"] for r in sessions(at, ["u"], "x", 5, []).orderBy("x").collect()] == [0, 0, 0, 1, 1]


def test_hamming_pairs_lose_none(spark):
    r = random.Random(2)
    ks = sorted({"".join(r.choice("ACGT") for _ in range(6)) for _ in range(150)})
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    dist = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    want = {(a, b, dist(a, w), f) for a in ks for b in ks if a < b for w, f in ((b, False), (rc(b), True)) if dist(a, w) <= 2}
    m = spark.createDataFrame([(k,) for k in ks], "kmer string")
    links = hamming_pairs(m, 6, 2)
    assert {tuple(x) for x in links.collect()} == want
    up = {k: k for k in ks}
    for _ in ks:
        for a, b, _, _ in want:
            up[a] = up[b] = min(up[a], up[b])
    assert {r["kmer"]: r["component"] for r in components(links, m, "kmer").collect()} == up


def test_string_measures(spark):
    df = spark.createDataFrame([("AAAT", "AAAA"), ("ACGTT", "ACG"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(hamming(F.col("a"), F.col("b"))).collect()] == [1, 5, 0]
    assert [r[0] for r in df.select(low_complexity(F.col("a"))).collect()] == [True, False, True]


def test_series_repeat_and_stay_in_range(spark):
    runs = spark.createDataFrame([(k, s) for k in SERIES for s in (1, 2)], "kind string, seed long")
    a, b = (sorted(map(tuple, series(runs, 50).collect())) for _ in range(2))
    assert a == b and len(a) == 50 * 2 * len(SERIES) and all(-1.2 <= r[3] <= 1.2 for r in a)
    for kind in SERIES:
        assert len({r[3] for r in a if r[0] == kind}) > 30


def test_genesis_one_step(spark):
    p = spark.createDataFrame([(0, 0.5, 0.5, 0.0, 0.0)], "i long, e double, phi double, de double, dphi double")
    r = genesis(p, 1).first()
    de = 0.01 * (0.05 - 0.003 * 0.5 + 0.018 * np.sin(0.5))
    assert r["de"] == pytest.approx(de) and r["e"] == pytest.approx(0.5 + 0.01 * de) and 0 < r["alignment"] <= 1


def test_online_transitions(spark, tmp_path):
    from seqloom.streaming.windows import online_transitions

    rows = [("u", k, s) for k, s in enumerate("abca")] + [("v", k, s) for k, s in enumerate("xy")]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "u string, at int, s string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u string, at int, s string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online_transitions(stream, "u", "at", "s").writeStream.format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("online").collect()))
    assert got == [("u", "a", "b"), ("u", "b", "c"), ("u", "c", "a"), ("v", "x", "y")]
