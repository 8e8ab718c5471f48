"""Motifs of any length, interval levels, periods, permutations, ranks, rings, readers, SQL functions and the online grammar on small cases."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F


def letters(seed: int, n: int, of: str = "ACGT") -> str:
    r = random.Random(seed)
    return "".join(r.choice(of) for _ in range(n))


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
def test_motif_hits(spark, chunk):
    from seqloom.operators.motifs import motif_hits

    seqs = [(1, letters(1, 300, "ACG")), (2, "A" * 50), (3, "AC"), (4, ""), (5, None), (6, letters(2, 90, "ACGTN"))]
    motifs = ["AAA", "ACA", "ACGT", seqs[0][1][40:80], seqs[0][1][4:25], seqs[5][1][:40].replace("N", "A"), "AAAAAAAAAAAAAAAA"]
    rc = lambda m: m[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = sorted((k, m, strand, i, i + len(m)) for k, s in seqs for m in set(motifs) for strand, form in (("+", m), ("-", rc(m))) for i in range(len(s or "")) if (s or "")[i : i + len(m)] == form)
    got = motif_hits(spark.createDataFrame(seqs, "k long, s string"), ["k"], "s", spark.createDataFrame([(m,) for m in [*motifs, "AAA"]], "motif string"), chunk=chunk)
    assert sorted(tuple(r) for r in got.select("k", "motif", "strand", "pos0", "pos1").collect()) == want


@pytest.mark.parametrize("seqs", [["xabcabcdy", "zabcabcdzabc", "abcabcd"], ["aaaaaaaaaa", "aaaab", "baaaaa"], ["abc", "def"], ["abc", ""], ["same", "same"], ["ab", "ba"]])
def test_longest_common(spark, seqs):
    from seqloom.operators.motifs import longest_common

    subs = [{s[i:j] for i in range(len(s)) for j in range(i + 1, len(s) + 1)} for s in seqs]
    all_ = set.intersection(*subs)
    want = sorted(s for s in all_ if len(s) == max(map(len, all_)))
    got = longest_common(spark.createDataFrame(list(enumerate(seqs)), "k long, s string"), "k", "s", chunk=3)
    assert sorted(r["substring"] for r in got.collect()) == want


@pytest.mark.parametrize("most", [5, 64, 130])
def test_period_counts(spark, most):
    from seqloom.operators.motifs import period_counts

    r = random.Random(most)
    places = sorted({(k, r.randrange(700)) for k in (0, 1) for _ in range(250)} | {(0, 63), (0, 64), (0, 127), (0, 128)})
    want = {}
    for k, p in places:
        for d in range(1, most + 1):
            if (k, p + d) in places:
                want[k, d] = want.get((k, d), 0) + 1
    got = period_counts(spark.createDataFrame(places, "k long, pos long").repartition(3), ["k"], "pos", most)
    assert {(x["k"], x["period"]): x["pairs"] for x in got.collect()} == want


@pytest.mark.parametrize("chunk", [2, 6, 1 << 16])
def test_longest_tandem(spark, chunk):
    from seqloom.operators.motifs import longest_tandem

    seqs = [(1, "ACACACACGT"), (2, "AACCACAC"), (3, "NNNNNN"), (4, "ACA"), (5, "ACACANACAC"), (6, "A" * 31), (7, letters(3, 200, "AC")), (8, None)]

    def plain(s: str) -> int:
        units = [s[i : i + 2] for i in range(0, len(s) - 1, 2)]
        best = run = 0
        for i, u in enumerate(units):
            run = run + 1 if i and u == units[i - 1] and "N" not in u else 1
            best = max(best, run)
        return 2 * best

    got = {r["k"]: r["longest"] for r in longest_tandem(spark.createDataFrame(seqs, "k long, s string"), ["k"], "s", chunk).collect()}
    assert got == {k: plain(s) for k, s in seqs if s and len(s) >= 4}


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_overlap_levels(spark, width):
    from seqloom.operators.intervals import _cover, overlaps

    r = random.Random(width)
    one = lambda k: (k, "g" if k % 3 else "h", (a := r.randrange(-3000, 3000)), a + r.choice((0, -5, 1, 2, 30, 400, 5000)))
    a, b = [one(k) for k in range(60)], [one(k) for k in range(60)]
    want = sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    got = overlaps(spark.createDataFrame(a, "i long, g string, start long, end long"), spark.createDataFrame(b, "j long, g string, r_start long, r_end long"), ["g"], width)
    assert sorted((x["i"], x["j"], x["overlap"]) for x in got.collect()) == want
    size = spark.range(1).select(F.size(_cover(F.lit(-12345).cast("long"), F.lit(10_000_000).cast("long"), 7)).alias("n")).first()["n"]
    assert size <= 14 * 8


def test_permutations_are_one_to_one(spark):
    from seqloom.operators.permute import permuted

    df = spark.range(30).selectExpr("id AS rep").crossJoin(spark.createDataFrame([(n,) for n in (1, 2, 3, 7, 64, 1001)], "n long")).selectExpr("rep", "n", "explode(sequence(0L, n - 1)) AS i")
    by: dict = {}
    for r in permuted(df, "i", "n", F.concat_ws("|", "rep", "n"), "j").collect():
        by.setdefault((r["n"], r["rep"]), {})[r["i"]] = r["j"]
    assert all(sorted(m.values()) == list(range(n)) for (n, _), m in by.items())
    assert len({tuple(m[i] for i in range(7)) for (n, _), m in by.items() if n == 7}) > 25
    moved = [abs(m[i + 1] - m[i]) == 1 for (n, _), m in by.items() if n == 1001 for i in range(1000)]
    assert sum(moved) / len(moved) < 0.01
    plan = permuted(spark.range(9).withColumn("n", F.lit(9).cast("long")), "id", "n", F.lit("k"), "j")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def test_ranks_and_rings(spark):
    from seqloom.operators.ranks import numbered_within, ranked, ring_neighbours, running_total

    r = random.Random(4)
    rows = [(k, r.randrange(5), r.randrange(100)) for k in r.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "k long, g int, v long").repartition(5)
    order = sorted(rows, key=lambda x: (-x[2], x[0]))
    got = {x["k"]: x["rank"] for x in ranked(df, [F.desc("v"), F.asc("k")]).collect()}
    assert got == {x[0]: i for i, x in enumerate(order, 1)}
    upto = {x["k"]: (x["s"], x["s_of"]) for x in running_total(df, [F.desc("v"), F.asc("k")], "v", "s").collect()}
    total = 0
    for x in order:
        total += x[2]
        assert upto[x[0]] == (total, sum(y[2] for y in rows))
    own = {x["k"]: (x["i"], x["n"]) for x in numbered_within(df, ["g"], F.floor(F.col("k") / 700), [F.col("k")], "i", "n").collect()}
    for g in range(5):
        mine = sorted(x[0] for x in rows if x[1] == g)
        assert all(own[k] == (i, len(mine)) for i, k in enumerate(mine))
    ring = sorted(rows)
    near = {x["k"]: (x["left_v"], x["right_v"]) for x in ring_neighbours(df, "k", ["v"]).collect()}
    assert near == {x[0]: (ring[i - 1][2], ring[(i + 1) % len(ring)][2]) for i, x in enumerate(ring)}
    alone = ring_neighbours(df.limit(1), "k", ["v"]).first()
    assert alone["left_v"] == alone["right_v"] == alone["v"]
    assert ring_neighbours(df.limit(0), "k", ["v"]).count() == ranked(df.limit(0), [F.col("k")]).count() == 0


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_treebank_line_ends(spark, tmp_path, end):
    from seqloom.sources.streams import conllu_tokens

    row = lambda i, form: "\t".join([str(i), form, form, "X", "_", "_", "0", "root", "_", "last"])
    text = end.join(["# one", row(1, "a"), row(2, "b"), "", "# two", "1-2\tx" + "\t_" * 8, row(1, "c"), "  ", row(1, "d"), "", ""])
    (tmp_path / "t.conllu").write_bytes(text.encode())
    got = conllu_tokens(spark, str(tmp_path / "t.conllu")).collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: r["pos"]):
        by.setdefault(r["sentence"], []).append((r["form"], r["misc"]))
    assert sorted(by.values()) == [[("a", "last"), ("b", "last")], [("c", "last")], [("d", "last")]]


def test_tolerant_intervals(spark, tmp_path):
    from seqloom.sources.streams import bed, duplications

    (tmp_path / "a.bed").write_bytes(b"#c\t1\t2\ntrack name=x\nbrowser hide\n\nchr1 5 9 n\r\nchr2,7,8\n  chr3\t1\t4\tx y\nchr4\t4\t4\nchr5\ta\t9\nchr6\t1.5\t9\nchr7 1\n")
    assert sorted(tuple(r) for r in bed(spark, str(tmp_path / "a.bed")).collect()) == [("chr1", 5, 9, "n"), ("chr2", 7, 8, ""), ("chr3", 1, 4, "x")]
    (tmp_path / "d.txt").write_text("#bin\n\n" + "\t".join(["0", "c1", "3", "9", "", "7", "+", "c2", "1", "5"]) + "\n" + "0\tc1\t3\n")
    assert [tuple(r) for r in duplications(spark, str(tmp_path / "d.txt")).collect()] == [("c1", 3, 9, "c1:3-9", 7, "+", "c2:1-5", None)]


def test_delimited_symbols(spark, tmp_path):
    from seqloom.sources.streams import csv_symbols

    (tmp_path / "x.csv").write_text('a|b\n1|0\n2|10\n"3|5\n4\n5|bad\n6|nan\n7|inf\n8| 2.5 |more\n')
    got = lambda **o: [r["symbol"] for r in csv_symbols(spark, str(tmp_path / "x.csv"), 1, 5, "|", **o).orderBy("at").collect()]
    assert got() == [0, 4, 2, 1] and got(low=4.0, high=6.0) == [0, 4, 2, 0] and got(low=3.0, high=3.0) == []
    assert [r["symbol"] for r in csv_symbols(spark, str(tmp_path / "x.csv"), 0, 3, "|", header=False, low=0.0, high=8.0).orderBy("at").collect()] == [0, 0, 1, 1, 1, 1, 2]


def test_sql_functions(spark):
    from seqloom.functions import sql
    from seqloom.functions.field import project, with_field
    from seqloom.functions.u64 import fnv1a
    from seqloom.sources.streams import byte_windows, bytes_stream, kmers

    assert "seq_kmers" in sql.register(spark)
    df = spark.createDataFrame([(1, "ACGTNACGTA"), (2, "é a\tB"), (3, ""), (4, "AC")], "k long, s string")
    df.createOrReplaceTempView("latest_s")
    same = lambda text, want: sorted(map(tuple, spark.sql(text).collect())) == sorted(map(tuple, want.collect()))
    content = df.select("k", F.encode("s", "utf-8").alias("c"))
    assert same("SELECT k, b.* FROM latest_s, LATERAL seq_bytes(CAST(s AS BINARY)) b", bytes_stream(content, ["k"], "c"))
    assert same("SELECT k, b.* FROM latest_s, LATERAL seq_byte_windows(CAST(s AS BINARY), 3, 2) b", byte_windows(content, ["k"], "c", 3, 2))
    assert same("SELECT k, b.* FROM latest_s, LATERAL seq_kmers(s, 3) b", kmers(df, ["k"], "s", 3))
    assert same("SELECT k, seq_fnv1a(CAST(s AS BINARY)) FROM latest_s", df.select("k", fnv1a(F.col("s"))))
    x = spark.createDataFrame([(v,) for v in (-7.5, -1.0, -0.0, 0.0, 1e-13, 0.3, 2.0, 55.0)], "x double")
    x.createOrReplaceTempView("latest_x")
    want = with_field(x).select("x", F.array(*[f"k{j}" for j in range(1, 6)]).alias("k"), "ek", "lock", "raw", "dom", "dom_score", project(F.col("x"), -2.0, 3.0, 0, 4)).orderBy("x", F.col("x").cast("string")).collect()
    got = spark.sql("SELECT x, k, field_energy(k), field_lock(k), field_raw(k), field_dominant(k), field_score(k), field_project(x, -2D, 3D, 0D, 4D) FROM (SELECT x, field_operators(x) AS k FROM latest_x) ORDER BY x, CAST(x AS STRING)").collect()
    for a, b in zip(want, got, strict=True):
        assert a[0] == b[0] and a[4:6] == b[4:6]
        for u, v in zip([*a[1], a[2], a[3], a[6], a[7]], [*b[1], b[2], b[3], b[6], b[7]], strict=True):
            assert u == pytest.approx(v, rel=1e-12)


def test_artifacts(spark, tmp_path):
    from seqloom.sources.artifacts import artifacts

    spark.range(37).coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "broken").write_bytes(b"PAR1 nothing else")
    (tmp_path / "w.wav").write_bytes(b"RIFF" + struct.pack("<I", 36 + 40) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 40) + bytes(40))
    for name, data in (("j", b' {"a":1}'), ("z", b"PK\x03\x04.."), ("e", b""), ("o", b"plain"), (".hidden", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2]: (r["kind"], r["bytes"], r["records"], r["error"] != "") for r in artifacts(spark, str(tmp_path)).collect()}
    parts = [v for k, v in got.items() if k.startswith("part-")]
    assert [(k, n, bad) for k, _, n, bad in parts] == [("parquet", 37, False)]
    assert {k: v for k, v in got.items() if not k.startswith("part-")} == {"broken": ("parquet", 17, None, True), "w.wav": ("riff", 84, 20, False), "j": ("json", 8, None, False), "z": ("zip", 6, None, False), "e": ("empty", 0, None, False), "o": ("other", 5, None, False)}


def test_online_grammar(spark):
    from datetime import datetime, timedelta

    from seqloom.streaming.windows import online_grammar

    r = random.Random(8)
    rows = [(k % 3 if k % 11 else None, datetime(2024, 1, 1) + timedelta(seconds=r.randrange(4000)), k, r.choice("abc")) for k in range(200)]
    df = spark.createDataFrame(rows, "u long, ts timestamp, k long, s string")
    want: dict = {}
    for u in (0, 1, 2, None):
        own = [s for _, _, s in sorted((t, k, s) for x, t, k, s in rows if x == u)]
        for a, b in zip(own, own[1:], strict=False):
            want[u, a, b] = want.get((u, a, b), 0) + 1
    got = {(x["u"], x["from"], x["to"]): x["count"] for x in online_grammar(spark, df, "u", "ts", "k", "s", 3).collect()}
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert online_grammar(spark, df.limit(0), "u", "ts", "k", "s", 3).count() == 0
