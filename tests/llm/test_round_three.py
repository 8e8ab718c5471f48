"""URL filters, whitening and collocations against plain restatements, with the awkward cases."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import eigen, phrases, queries, urls, whiten

SMALL = "/root/testdata/sf0.01"


def test_symmetric_qr():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64):
        for rank in (n, max(1, n // 3)):
            b = r.standard_normal((n, rank)) * r.uniform(0.01, 30, (n, 1))
            a = b @ b.T
            e, q = eigen.symmetric_qr(a)
            assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-11, atol=1e-11 * np.abs(a).max())
            assert np.allclose(q @ q.T, np.eye(n), atol=1e-12) and np.allclose(a @ q.T, q.T * e, atol=1e-11 * max(1, np.abs(a).max()))
    for a in (np.zeros((4, 4)), np.eye(5), np.diag([3.0, 1, 2]), np.ones((6, 6))):
        e, q = eigen.symmetric_qr(a)
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1]) and np.allclose(a @ q.T, q.T * e)
    with pytest.raises(ArithmeticError):
        eigen.symmetric_qr(np.full((3, 3), np.nan))


def test_states_merge_in_any_order():
    r = np.random.default_rng(2)
    x = r.integers(-500, 500, (300, 5)) + 100_000
    whole = whiten.State.empty(5)
    for at in range(0, 300, 7):
        whole.update(x[at : at + 7])
    parts = []
    for a, b in ((0, 1), (1, 200), (200, 300), (300, 300)):
        parts.append(whiten.State.empty(5))
        if b > a:
            parts[-1].update(x[a:b])
    merged = parts[2].merge(parts[0]).merge(parts[3]).merge(parts[1])
    want = np.cov(x.T, bias=True)
    for s in (whole, merged):
        assert s.n == 300 and s.sums == x.sum(axis=0).tolist() and np.allclose(s.squares / 300, want, rtol=1e-10)


def check_whitened(rows, got, most=4):
    """rows: key, vector; got: rows of whitened()."""
    usable = [(k, tuple(int(np.floor(256 * float(c))) for c in v)) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    by_length: dict[int, list] = {}
    for k, x in usable:
        by_length.setdefault(len(x), []).append((k, x))
    count = 0
    for d, own in by_length.items():
        if not d:
            continue
        n, sums, e, q, trace = brute.eigen([x for _, x in own])
        use = [c for c in range(min(most, d)) if e[c] > 1e-9 * max(e[0], 1e-9)]
        mine = {(g["vec_id"], g["component"]): g for g in got}
        once = np.array(sorted({x for _, x in own}), float)
        for c in use:
            y = (once - np.array(sums) / n) @ q[c] / np.sqrt(e[c])
            for k, x in own:
                g = mine[k, c + 1]
                assert g["n"] == n and g["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
                assert abs(abs(g["whitened"]) - abs((np.array(x) - np.array(sums) / n) @ q[c] / np.sqrt(e[c]))) < 1e-8
                assert abs(g["explained"] - e[c] / trace) < 1e-10 and g["identity_error"] < 1e-9
            assert len(y) == n
            count += len(own)
    assert len(got) == count


def test_whitening_small(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(6).round(3).tolist()) for i in range(80)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, [None] * 6), (104, [float("nan")] + [0.0] * 5), (105, [float("inf")] + [0.0] * 5), (106, [-0.0] * 6), (107, [])]
    rows += [(200 + i, r.standard_normal(3).tolist()) for i in range(9)] + [(300, [1.0] * 9)]  # other lengths; one vector alone has no component
    df = spark.createDataFrame([(k, v, k, "x") for k, v in rows], "vec_id long, embedding array<double>, x long, component string").repartition(5)
    got = whiten.whitened(df).collect()
    check_whitened([(k, v) for k, v in rows if k != 300], got)
    by_key: dict = {}
    for g in got:
        by_key.setdefault(g["vec_id"], []).append(g["whitened"])
    assert by_key[100] == by_key[0] and whiten.whitened(df.limit(0)).count() == 0
    assert whiten.whitened(spark.createDataFrame([(None, [1.0, 2.0]), (None, [3.0, 1.0])], "vec_id long, embedding array<double>")).count() == 2


def test_whitening_many_states(spark, monkeypatch):
    monkeypatch.setattr(whiten, "FAN", 2)
    r = np.random.default_rng(4)
    rows = [(i, (r.standard_normal(4) * 10).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = df.select(whiten.as_whole(F.col("embedding"), 256).alias("x")).repartition(13)
    state = whiten.State.unpacked(whiten.merged(whiten.folded(vectors, "x")).collect()[0])
    x = np.floor(np.array([v for _, v in rows]) * 256)
    assert state.n == 60 and np.allclose(state.squares / 60, np.cov(x.T, bias=True))


def test_deviations_are_exact():
    r = random.Random(5)
    sums = [r.randrange(-(1 << 60), 1 << 60) for _ in range(5)]
    w = whiten.Whitening(10**12 + 7, sums, np.zeros((0, 5)), np.zeros(0), 1.0)
    for big in (1 << 23, 1 << 40):
        x = np.array([[r.randrange(-big, big) for _ in sums] for _ in range(20)])
        assert w.deviations(x) == [sum((w.n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


def test_op12_whole_table(spark):
    from seqloom.llm.common import table

    rows = [(x["vec_id"], x["embedding"]) for x in table(spark, SMALL, "embeddings").collect()]
    check_whitened(rows, queries.op12_whitening(spark, SMALL).collect())


URLS = [
    "http://a.com/", "http://a.com", "https://Example.COM/en/1?x=/fr/", "http://www.example.com/en/", "http://m.www.example.com/en/x#y", "http://notexample.com/en/", "x.net/es/", "ftp://b.net/es/?q", "ftp://b.net/es", "b://c.net?/fr/", "://net/fr/a",
    "a://b://net/fr/", "http://é.com/ü", "http://.com/a", "http://com./a", "http://a..com/", None, "", "://", "http:///p", "http://u@a.com:80/en/", "http://example.com/EN/", "http://x.net/fr//a/" + "b/" * 3000, "http://" + "a." * 3000 + "com/q",
]
MORE = [("net", "/fr//a/b", "allow"), ("net", "/fr//a/bb", "block"), ("", "", "block"), ("a.com", "", "block"), ("a.com", "/", "allow"), ("a.com", "/", "block"), ("com", "/é", "block"), ("É.com", "/ü", "allow"), (None, None, "allow"), ("com.", "/a", "block")]


@pytest.mark.parametrize("most_rules", [1000, 0], ids=["broadcast", "shuffled"])
@pytest.mark.parametrize("more", [[], MORE], ids=["given", "more"])
def test_urls(spark, monkeypatch, most_rules, more):
    monkeypatch.setattr(urls, "SHORT", 2)  # many rules and expressions share a short hash
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS * 2)]
    rules = [*queries.URL_RULES, *more]
    out = urls.judged(spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(3), spark.createDataFrame(rules, "host string, path string, verdict string"), most_rules=most_rules)
    merged: dict = {}
    for h, p, v in ((brute.lower(h or ""), p or "", v) for h, p, v in rules):
        merged[h, p] = max(v, merged.get((h, p), v))
    plain = [(h, p, v) for (h, p), v in merged.items()]
    got = {(r["row"]["page_id"]): (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {i: brute.url_verdict(u, plain) for i, u, *_ in rows}


def test_urls_hot_expressions(spark, monkeypatch):
    monkeypatch.setattr(urls, "HEAVY", 0)
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id"), F.lit(".com/en/")).alias("url"))
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    kept = urls.allowed(pages, rules, most_rules=0)
    assert kept.columns == ["page_id", "url"] and kept.count() == 6000
    assert urls.allowed(pages.limit(0), rules).count() == 0 and urls.allowed(pages, rules.limit(0), otherwise="block").count() == 0
    with pytest.raises(Exception, match="allow or block"):
        urls.judged(pages, spark.createDataFrame([("a", "/", "maybe")], "host string, path string, verdict string")).collect()


@pytest.mark.parametrize("crowd", [phrases.CROWD, 2, 0], ids=["one word", "longer prefixes", "all crowded"])
@pytest.mark.parametrize("percent", [100, 60])
def test_collocations(spark, crowd, percent):
    r = random.Random(6)
    words = ["a", "b", "C", "d", "é", "ZZ", "q\x1c", "漢字", "\ue000", "\U0001f600"]
    docs = []
    for _ in range(150):
        own = [r.choice(words[: r.randint(2, 10)]) + r.choice((" ", " ", "  ", "\t", ", ", ".\n", " ? ")) for _ in range(r.randint(0, 40))]
        docs.append((r.choice(("en", "en", "und", None, "xx")), "".join(own)))
    docs += [("en", "the same old line again and on. ") for _ in range(20)]
    docs += [("en", None), (None, ""), ("xx", " \t.;"), ("one", "single"), ("en", "x" * 100_000 + " y" * 50_000)]
    df = spark.createDataFrame([(i, t, lang, "n") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, n string").repartition(4)
    got = [tuple(x) for x in phrases.collocations(df, 8, percent, 60, crowd=crowd).collect()]
    assert sorted(got) == brute.collocations(docs, 8, percent, 60)
    if crowd == 2 and percent == 100:
        assert phrases.collocations(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    """Counts of 10^12 and more multiply exactly."""
    big = spark.range(1).selectExpr("(cast(4000000000000 AS DECIMAL(38,0)) * 9000000000000001L * 1000) div (cast(4000000000001 AS DECIMAL(38,0)) * 4000000000003L) AS s").first()["s"]
    assert big == 4000000000000 * 9000000000000001 * 1000 // (4000000000001 * 4000000000003)


def test_small_tables_in_slots(spark, monkeypatch):
    """Tables in which most words share an entry lose nothing; texts of several batches count once."""
    monkeypatch.setattr(phrases, "TEXT", 1000)
    docs = [("en", " ".join(random.Random(i).choices("abcdefgh", k=60))) for i in range(60)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(2)
    assert sorted(tuple(x) for x in phrases.collocations(df, 15, 100, 500).collect()) == brute.collocations(docs, 15, 100, 500)


@pytest.mark.parametrize("levels", [1, 63, 64, 100, 10_000])
@pytest.mark.parametrize("tag", ["div", "center"])
def test_html_ancestors_at_any_depth(levels, tag):
    """A reader's comment stays one under any number of elements, and an article one."""
    from seqloom.llm import html

    field = html.trained()
    words = "This is a long enough sentence of plain words, with a comma, that reads like any other one here."
    deep = lambda cls: f"<div class={cls}>" + f"<{tag}>" * levels + f"<p>{words} {cls}</p>" * 3 + f"</{tag}>" * levels + "</div>"
    page = f"<html><body><article><h1>Title of it</h1><p>{words} first</p>{deep('body')}</article>{deep('comments')}</body></html>"
    got = html.main_text(page, field)
    assert "first" in got and got.count("here. body") == 3 and "comments" not in got


def test_html_viterbi_and_gradient():
    """Viterbi against all label paths; the forward and backward sums against numeric differences."""
    from itertools import product
    from math import exp, log

    from seqloom.llm.html import Field

    r = random.Random(9)
    for _ in range(40):
        field = Field()
        rows = [[f"f{r.randrange(6)}" for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 8))]
        field.w = {f"f{k}": r.gauss(0, 0.3) for k in range(6)}
        field.pair = [[r.gauss(0, 1) for _ in range(2)] for _ in range(2)]
        value = lambda y, f=field, x=rows: sum(f.w[n] for k, on in enumerate(y) if on for n in x[k]) + sum(f.pair[a][b] for a, b in zip(y, y[1:], strict=False))
        paths = list(product((0, 1), repeat=len(rows)))
        assert value(tuple(field.decode(rows))) == pytest.approx(max(map(value, paths)))
        y = [r.randint(0, 1) for _ in rows]
        likely = lambda: value(tuple(y)) - log(sum(exp(value(p)) for p in paths))  # noqa: E731, B023
        rate, e = 1e-6, 1e-5
        numeric = {}
        for n in field.w:
            old = field.w[n]
            field.w[n] = old + e
            up = likely()
            field.w[n] = old - e
            numeric[n] = (up - likely()) / (2 * e)
            field.w[n] = old
        before = dict(field.w)
        field.step(rows, y, 1.0)
        used = {n for row in rows for n in row}
        for n in used:
            assert field.w[n] - before[n] == pytest.approx(numeric[n], abs=2e-3)


def test_long_texts_in_pieces(monkeypatch):
    """Scores and counts of texts in pieces are those of whole ones."""
    from seqloom.llm import langid, quality

    r = random.Random(10)
    texts = [bytes(r.choice(b"abc def,\xc3\xa9\n") for _ in range(n)) for n in (0, 1, 63, 64, 255, 256, 257, 1000, 4097, 20_000)]
    net = quality.ConvNet()
    whole, counted = net.scores(texts), langid.counts(texts)
    for size in (192, 512, 4096):
        monkeypatch.setattr(quality, "LONG", size)
        monkeypatch.setattr(langid, "LONG", size)
        assert np.allclose(net.scores(texts), whole, atol=1e-6) and (langid.counts(texts) == counted).all()


def test_op4_columns(spark, sf):
    """Every column of the query from the text alone: the WAV file byte by byte, checksums, and the read-back laws."""
    import hashlib
    import struct
    import zlib

    from seqloom.llm import audio
    from seqloom.llm.common import table

    def mulaw(b: int) -> int:
        b = ~b & 255
        v = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
        return -v if b & 128 else v

    def alaw(b: int) -> int:
        b ^= 0x55
        e, v = b >> 4 & 7, (b & 15) << 4
        v = v + 8 if e == 0 else v + 264 << e - 1
        return v if b & 128 else -v

    def told(name: str, x: list[int]) -> str:
        rms = (sum(v * v for v in x) / len(x)) ** 0.5
        return f"{name} rms={rms:.2f} peak={max(map(abs, x))} zc={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))}"

    text = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf, "documents").collect()}
    got = queries.op4_telephony(spark, sf).collect()
    assert len(got) == len(text)
    for r in got[:60]:
        raw = text[r["doc_id"]]
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        head = b"WAVEfmt " + struct.pack("<IHHIIHHH", 18, 7, 1, 8000, 8000, 1, 8, 0) + b"fact" + struct.pack("<II", 4, len(raw)) + b"data" + struct.pack("<I", len(pay))
        media = b"RIFF" + struct.pack("<I", len(head) + len(pay)) + head + pay
        assert (r["media_bytes"], r["media_sha256"], r["tail_crc32"]) == (len(media), hashlib.sha256(media).hexdigest(), zlib.crc32(pay[-16:]))
        pcm = np.array([mulaw(b) for b in pay], np.int16)
        slow = audio.resample(pcm, np.array([0]), np.array([len(pcm)]), 8000, 16000)[0]
        parts = r["feature"].split("; ")
        assert parts[0] == told("pcm16000", slow.tolist()) and parts[1] == told("other", [alaw(b) for b in pay]) and parts[2].startswith("adpcm ")
        assert r["pcm_crc32"] == zlib.crc32(slow.astype("<i2").tobytes())


def test_op1_many_runs():
    """8,000 runs of two entries merge to one, with the smallest identifiers and all rows counted."""
    from seqloom.llm import exact

    runs, want = [], {}
    for k in range(8000):
        d = [f"{(3 * k + j) % 5000:032d}".encode() for j in range(2)]
        for j, x in enumerate(d):
            n, best = want.get(x, (0, (0, 1 << 60)))
            want[x] = n + 1, min(best, (-(k % 7), 2 * k + j))
        runs.append(exact.Run.flush(exact.as_bytes(np.array(d, "V32")), np.array([k % 7, k % 7]), np.array([2 * k, 2 * k + 1])))
    whole = exact.compact(runs)
    raw = whole.digests.tobytes()
    got = {raw[i : i + 32]: (int(n), (-int(length), int(key))) for i, n, length, key in zip(range(0, len(raw), len(raw) // len(whole.rows)), whole.rows, whole.length, whole.key, strict=True)}
    assert got == want


def test_op5_hot_passages_spread(spark):
    """A passage in every text with other bytes around it is not one task's work, and what repeats is still found."""
    from collections import Counter

    from seqloom.llm import repeats
    from seqloom.llm.anchors import anchors

    r = np.random.default_rng(11)
    passage = r.integers(97, 123, 402, dtype=np.uint8).tobytes()
    texts = [r.integers(97, 123, 300, dtype=np.uint8).tobytes() + passage + r.integers(97, 123, 300, dtype=np.uint8).tobytes() for _ in range(200)]
    groups: Counter = Counter()
    for t in texts:
        h, _, pos, lo, hi = anchors(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), 400)
        for a in repeats.cut_out(t, [(int(x), int(p), int(m), int(n), 10_000) for x, p, m, n in zip(h.view(np.int64), pos, lo, hi, strict=True)], 400, 2000):
            groups[a[:2]] += 1
    shared = [n for n in groups.values() if n > 1]
    assert len(groups) > 50 * len(texts) and len(shared) <= 4 and max(shared) <= len(texts)
    docs = [(i, t.decode()) for i, t in enumerate(texts[:40])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: sum(s["end"] - s["start"] for s in x["spans"] or []) for x in repeats.without_repeats(df, 400, hot=3).collect()}
    assert got == {d: n for d, (_, n, _, _) in brute.repeats(docs, 400).items()}
