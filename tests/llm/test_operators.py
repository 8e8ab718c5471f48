"""Each training-data operator against a plain restatement, on small tables with the awkward cases."""

from __future__ import annotations

import hashlib
import random
import struct

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import audio, bpe, exact, html, langid, lines, mixing, ngrams, quality, repeats, suffixes
from seqloom.llm.queries import bpe_file

#: Null key, repeated rows, a repeated key with another text, null, empty and blank texts; and a column named like an inner one.
ODD = [(None, "x y z", "s"), (None, "x y z", "s"), (900, None, None), (901, "", ""), (902, " \t\n", None), (903, "a", "s"), (903, "a", "s"), (904, "A", "s"), (905, "é ü ß\x1c漢", "t")]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r[:2], r[2] if len(r) > 2 else "s", 1) for r in rows], "doc_id long, text string, source string, key int").repartition(parts)


def random_docs(seed: int, n: int = 150):
    r = random.Random(seed)
    base = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 90))) for _ in range(15)]
    docs = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice((0, 0, 0, 1, 3))):
            w[r.randrange(len(w))] = r.choice("xyz") * 3
        docs.append((i, r.choice((" ", "  ", "\n")).join(w)))
    return docs


@pytest.mark.parametrize("digest", [exact.sha256, lambda b: hashlib.sha256(b).digest()[:1]], ids=["sha256", "collisions"])
def test_exact(spark, digest):
    docs = random_docs(1) + [d for d in ODD if d[0] is not None and d[0] != 903] + [(950, "long " * 30000)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(table(spark, docs), digest=digest, memtable=16).collect()}
    groups: dict[str, list] = {}
    for d, t, *_ in docs:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), d))
    want = {d: (min(g)[1], len(g), min(g)[1] == d) for g in groups.values() for _, d in g}
    assert got == want


def test_exact_odd_rows(spark):
    out = exact.exact_groups(table(spark, ODD)).collect()
    assert len(out) == len(ODD) and sum(r["doc_id"] is None for r in out) == 2
    assert {r["group_size"] for r in out if r["doc_id"] == 903} == {2}
    assert exact.exact_groups(table(spark, ODD).limit(0)).count() == 0
    kept = exact.deduplicated(table(spark, ODD))
    assert kept.columns == ["doc_id", "text", "source", "key"] and kept.count() == 5


@pytest.mark.parametrize(("crowd", "percent"), [(32, 80), (2, 80), (3, 60)])
def test_lines(spark, monkeypatch, crowd, percent):
    monkeypatch.setattr(lines, "CROWD", crowd)
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(2000)]
    pool = [" ".join(r.choice(words) for _ in range(r.randint(0, 20))) for _ in range(30)]
    docs = []
    for i in range(40):
        own = []
        for _ in range(r.randint(0, 7)):
            w = r.choice(pool).split(" ")
            for _ in range(r.choice((0, 0, 1, 2))):
                w[r.randrange(len(w))] = r.choice(words)
            own.append(" ".join(w))
        docs.append((i, "\n".join(own)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "a"), (104, "A "), (105, " b\ta\nb\na b")]
    keep = brute.line_matches(docs, percent)
    got = {x["doc_id"]: x["kept"] for x in lines.without_lines(table(spark, docs), percent).collect()}
    assert got == {d: "\n".join((t or "").split("\n")[i] for i in keep[d]) for d, t in docs}


def test_lines_of_common_words(spark):
    """Lines that share many words but aren't near: what is shuffled follows the text and not the pairs of lines."""
    r = random.Random(3)
    docs = [(i, "\n".join(" ".join(f"w{r.randrange(200)}" for _ in range(40)) for _ in range(20))) for i in range(300)]
    docs.append((300, docs[7][1].replace(" ", " more ", 1)))
    summary = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = summary()
    got = {x["doc_id"]: x["n_removed"] for x in lines.without_lines(table(spark, docs)).collect() if x["n_removed"]}
    assert got == {300: 20}
    assert summary() - before < 30 * sum(len(t) for _, t in docs)


def test_lines_odd_rows(spark):
    assert lines.without_lines(table(spark, ODD)).count() == len(ODD)
    assert lines.without_lines(table(spark, ODD).limit(0)).count() == 0


def test_quality(spark):
    r = random.Random(2)
    good = lambda: " ".join("".join(r.choice("aeiourstln") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 200))) + "."
    junk = lambda: " ".join(r.choice(("BUY!!", "###", "$$$", "|")) for _ in range(r.randint(20, 200)))
    docs = [(i, junk() if i % 4 == 0 else good()) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    df = table(spark, [*docs, *ODD])
    net = quality.fit(df, labels, F.lit(True), per_class=100, epochs=8)
    got = quality.score(df.select("doc_id", "text"), net).collect()
    assert len(got) == len(docs) + len(ODD) and all(0 <= x["score"] <= 1 for x in got)
    held = [x for x in got if x["doc_id"] is not None and 300 <= x["doc_id"] < 400]
    assert np.mean([(x["score"] >= 0.5) == (x["doc_id"] % 4 != 0) for x in held]) > 0.95
    assert quality.fit(df, labels.limit(0), F.lit(True)) is None
    assert {x["score"] for x in quality.score(df.select("doc_id", "text"), None).collect()} == {0.5}


def test_network_reads_the_whole_text():
    net = quality.ConvNet()
    a, b = b"word " * 4000, b"word " * 3999 + b"####!"
    assert net.scores([a])[0] != net.scores([b])[0]
    assert np.allclose(net.scores([a, b, b""]), [net.scores([x])[0] for x in (a, b, b"")], atol=1e-6)


def test_network_gradient():
    net = quality.ConvNet()
    texts, y, w = [b"abc def " * 40, b"zz", b"### !!! " * 9], np.array([1, 0, 1], np.float32), np.ones(3)

    def loss() -> float:
        p = net.scores(texts)
        return float(-np.mean(np.log(np.where(y == 1, p, 1 - p))))

    g = net.gradient(texts, y, w)
    for name in net.w:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, e = net.w[name][at], 1e-2
        net.w[name][at] = old + e
        up = loss()
        net.w[name][at] = old - e
        down = loss()
        net.w[name][at] = old
        assert (up - down) / (2 * e) == pytest.approx(float(g[name][at]), rel=0.15, abs=1e-4)


def test_laws_and_blocks():
    mu, a = audio.mulaw_table().astype(int), audio.alaw_table().astype(int)
    assert (mu[0], mu[127], mu[255], mu[128]) == (-32124, 0, 0, 32124) and len(set(mu)) == 255
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256) and len(set(a)) == 256
    block = np.zeros((2, 192), np.uint8)
    block[1, :3] = [0x10, 0x27, 88]
    block[1, 4:] = 0x7F
    out = audio.adpcm_decode(block)
    assert out.shape == (2, 377) and out[1, 0] == 10000

    def one(b: np.ndarray) -> list[int]:
        s, i, got = struct.unpack("<h", b[:2].tobytes())[0], min(int(b[2]), 88), []
        got.append(s)
        for c in b[4:].tolist():
            for n in (c & 15, c >> 4):
                st = audio.STEPS[i]
                d = (st >> 3) + (st if n & 4 else 0) + (st >> 1 if n & 2 else 0) + (st >> 2 if n & 1 else 0)
                s = max(-32768, min(32767, s - d if n & 8 else s + d))
                i = max(0, min(88, i + audio.MOVES[n & 7]))
                got.append(s)
        return got

    r = np.random.default_rng(1).integers(0, 256, (20, 192)).astype(np.uint8)
    assert audio.adpcm_decode(r).tolist() == [one(b) for b in r]


def test_audio_round_trip(spark):
    docs = [*random_docs(3, 40), *ODD, (950, "long " * 40000)]
    back = audio.read_audio(audio.store(table(spark, docs))).collect()
    got: dict = {}
    for x in back:
        got.setdefault(x["doc_id"], set()).add((bytes(x["payload"] or b""), x["n_samples"], len(x["pcm"] or b"")))
    for d, t, *_ in docs:
        raw = (t or "").encode()
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (got[d] == {(b"", None, 0)}) if t is None else (pay, len(raw), 4 * len(pay)) in got[d]
    for law in (audio.ALAW, audio.ADPCM):
        assert audio.read_audio(audio.store(table(spark, docs[:5]), law=law)).filter("payload IS NULL").count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"RIFFxx")), (2, None)], "doc_id long, media binary")
    assert {x["feature"] for x in audio.read_audio(bad).collect()} == {""}
    tone = (np.sin(np.arange(800) * 2 * np.pi * 440 / 8000) * 12000).astype(np.int16)
    up = audio.resample(tone, np.array([0]), np.array([800]), 8000, 16000)[0].astype(float)
    want = np.sin(np.arange(1600) * 2 * np.pi * 440 / 16000) * 12000
    assert np.abs(up - want)[60:-60].max() < 60


def test_suffix_array():
    r = random.Random(1)
    for _ in range(3000):
        s = [r.randrange(r.choice((1, 2, 4))) for _ in range(r.randint(0, 40))]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize(("width", "hot"), [(100, 2000), (100, 3), (400, 2000)])
def test_repeats(spark, width, hot):
    r = random.Random(1)
    src = ["".join(r.choice("ab cdé") for _ in range(900)) for _ in range(4)]
    docs = []
    for i in range(60):
        t = "".join(r.choice("xyz ") for _ in range(r.randint(0, 120)))
        for _ in range(r.randint(0, 3)):
            x, a = list(r.choice(src)), r.randrange(700)
            x = x[a : a + r.randint(50, 700)]
            if r.random() < 0.4 and x:
                x[r.randrange(len(x))] = "Q"
            t += "".join(x) + "".join(r.choice("uvw") for _ in range(r.randint(0, 40)))
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, "ab" * 600), (203, "q" * 399), (204, "q" * 400), (205, docs[3][1])]
    got = {}
    for x in repeats.without_repeats(table(spark, docs), width, hot=hot).collect():
        sp = x["spans"] or []
        got[x["doc_id"]] = (x["n_bytes"], sum(s["end"] - s["start"] for s in sp), len(sp), x["sha256"] if x["kept"] is None else hashlib.sha256(x["kept"]).hexdigest())
    assert got == brute.repeats(docs, width)


def test_repeats_odd_rows(spark):
    assert repeats.without_repeats(table(spark, ODD)).count() == len(ODD)
    assert repeats.without_repeats(table(spark, ODD).limit(0)).count() == 0
    twice = table(spark, [(1, "w" * 50 + "v" * 400), (1, "w" * 50 + "v" * 400)])
    assert {bytes(x["kept"]) for x in repeats.without_repeats(twice).collect()} == {b""}


def test_bpe_same_as_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_file())
    r = random.Random(1)
    letters = "abcdehiilnorstué ñÜ3'!?<|>endoftext 漢字  \x1c\x85ΣİſK ́\n\t👍"
    vocab = [t.replace("</w>", "") for t in lib.get_vocab()]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(1500)] + ["".join(r.choices(vocab, k=r.randint(1, 5))) for _ in range(1500)]
    texts += ["don't I'LL <|endoftext|>a<|startoftext|> b", "<|endoftext|><|endoftext|>", "z" * 30000, *(t for _, t, *_ in ODD if t is not None)]
    df = table(spark, list(enumerate(texts)))
    got = {x["doc_id"]: (x["ids"], x["decoded"]) for x in bpe.encode(df, bpe_file(), decoded=True).collect()}
    for k, t in enumerate(texts):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[k] == (ids, lib.decode(ids, skip_special_tokens=False))
    some = bpe.encode(table(spark, ODD), bpe_file())
    assert some.count() == len(ODD) and bpe.decode(some, bpe_file()).filter("text IS NULL").count() == 0


def test_html_on_made_pages(spark):
    r = random.Random(77)
    pages = [html.labelled_page(r) for _ in range(150)]
    df = spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(pages)] + [(900, None, None), (901, "u", ""), (902, "u", "<p>"), (903, "u", "<script>x</script>"), (904, "u", "plain <b")], "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in html.extract(df).collect()}
    want = {k: "\n".join(" ".join(t.split()) for t in made) for k, (_, made) in enumerate(pages)}
    assert np.mean([got[k] == v for k, v in want.items()]) > 0.85
    assert [got[k] for k in (900, 901, 902, 903)] == [""] * 4
    assert html.extract(df.limit(0)).count() == 0
    b = html.blocks("<body><p>a&amp;b <i>c</i><br>d<p>e<ul><li>f<li>g</ul><script>var x='</p>'</script><!-- <p>no</p> -->h&copy")
    assert [x.text for x in b] == ["a&b c d", "e", "f", "g", "h©"]


def test_mixing(spark):
    r = random.Random(6)
    docs = [(i, "w " * r.randint(0, 40), r.choice(["a", "b", "b", "b", "c", None, "é"])) for i in range(600)] + ODD
    out = mixing.mix(table(spark, docs)).collect()
    assert len(out) == len(docs)
    total, seen = sum(x["size"] for x in out), {}
    for x in out:
        assert 0 <= x["taken"] <= 2 * x["size"]
        s = seen.setdefault(x["source"], [x["source_size"], x["target"], 0, 0])
        s[2] += x["taken"]
        s[3] = max(s[3], x["size"])
    assert sum(s[1] for s in seen.values()) == pytest.approx(1.5 * total)
    weights = {k: (3, 1, 2)[i % 3] for i, k in enumerate(sorted(seen, key=lambda k: (k is None, k or "")))}
    level = [s[1] / weights[k] for k, s in seen.items() if s[1] < 2 * s[0] - 1e-9]
    assert max(level) == pytest.approx(min(level))
    for k, (size, target, taken, largest) in seen.items():
        assert target <= 2 * size + 1e-9 and target / weights[k] <= min(level) + 1e-6 and abs(taken - target) <= largest
    again = mixing.mix(table(spark, docs, 7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    mixed = mixing.mixed_documents(table(spark, docs))
    assert mixed.columns == ["doc_id", "text", "source", "key"] and mixed.count() == sum(x["times"] for x in out)
    assert mixing.mix(table(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 1024), (5, 80, 1024), (3, 60, 5)])
def test_near_classes(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(ngrams, "SET_BLOCK", block)
    docs = random_docs(9, 220) + [(900, None), (901, ""), (902, " \n"), (903, "a"), (904, "A"), (905, "a b"), (906, "q " * 20000)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngrams.classes_of(table(spark, docs), k, percent).collect()}
    assert got == brute.near_classes(docs, k, percent)


def test_near_classes_odd_rows(spark):
    out = ngrams.classes_of(table(spark, ODD)).collect()
    assert len(out) == len(ODD) and {x["component_id"] for x in out if x["doc_id"] in (903, 904)} == {903}
    assert ngrams.classes_of(table(spark, ODD).limit(0)).count() == 0


def test_tree_against_pairs():
    r = random.Random(4)
    for percent in (50, 80, 90):
        sets = list({frozenset(r.sample(range(40), r.randint(1, 30))) for _ in range(40)}) + [frozenset(range(20)), frozenset(range(1, 20))]
        order = [np.array(sorted(s), np.uint64) for s in sorted(sets, key=len)]
        links = ngrams.tree_links(list(range(len(order))), order, percent)

        def classes(pairs) -> list[int]:
            up = list(range(len(order)))
            for _ in order:
                for a, b in pairs:
                    up[a] = up[b] = min(up[a], up[b])
            return up

        full = [(a, b) for b in range(len(order)) for a in range(b) if 100 * len(set(order[a]) & set(order[b])) >= percent * len(set(order[a]) | set(order[b]))]
        assert classes(links) == classes(full) and set(map(frozenset, links)) <= set(map(frozenset, full))


def test_languages(spark):
    r = random.Random(8)
    word = {"en": ("th", "ing", "er", "and"), "de": ("sch", "ein", "ung", "ver"), "fr": ("eau", "ois", "ent", "que")}
    docs = [(i, " ".join("".join(r.choice(word[g]) for _ in range(3)) for _ in range(r.randint(3, 60))), g) for i in range(300) for g in [r.choice(list(word))]]
    rows = [(d, t, g) for d, t, g in docs] + [(900, None, "en"), (901, "", "en"), (902, "12 !! 3", None), (903, "漢", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.col("doc_id") % 2 == 0, per_lang=60, clusters=2)
    got = {x["doc_id"]: x for x in langid.identify(df, model).collect()}
    assert np.mean([got[d]["lang_pred"] == g for d, _, g in docs if d % 2]) > 0.97
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and got[903]["rejected"]
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.fit(df.limit(0), F.lit(True)) is None and {x["lang_pred"] for x in langid.identify(df, None).collect()} == {"und"}


def test_fine_bins_keep_every_near_pair():
    """Sets of different widths, near copies and strangers: no set with a partner is lost, strangers of some size are."""
    from seqloom.llm.ngrams import _near

    rng = np.random.default_rng(9)
    sets = []
    for n in (100, 500, 520, 1020, 2040, 3000):
        base = rng.integers(0, 1 << 60, n, dtype=np.uint64)
        sets += [base, np.r_[base[: int(n * 0.92)], rng.integers(0, 1 << 60, n // 30, dtype=np.uint64)], rng.integers(0, 1 << 60, n, dtype=np.uint64)]
    sets = [np.unique(s) for s in sets]

    def fine(s: np.ndarray) -> bytes:
        b = max(64, 1 << (len(s) // 4).bit_length() - 1)
        return np.minimum(np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b), 255).astype(np.uint8).tobytes()

    keep = _near(np.array([len(s) for s in sets]), [fine(s) for s in sets], 80)
    for i, a in enumerate(sets):
        if any(100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for j, b in enumerate(sets) if i != j):
            assert keep[i]
    assert not keep[-1] and not keep[-4]
    full = [b"\xff" * 64, b"\xff" * 64]
    assert _near(np.array([90000, 90000]), full, 90).all()
    assert not _near(np.array([5]), [bytes(64)], 80).any()


def test_exact_repeated_keys_and_collisions(spark):
    """Keys and null keys that repeat, under a digest of one byte: no row is multiplied, and groups are those of the bytes."""
    docs = random_docs(11, 60) + random_docs(12, 60) + [(None, f"n {i % 7}") for i in range(30)] + [(3, "a b"), (3, "a  b"), (3, "c")]
    got = exact.exact_groups(table(spark, docs), digest=lambda b: hashlib.sha256(b).digest()[:1], memtable=16).collect()
    big = 1 << 62
    groups: dict[str, list] = {}
    for d, t in docs:
        groups.setdefault("".join(t.split()), []).append((-len(t), big if d is None else d))
    best = {g: min(own)[1] for g, own in groups.items()}
    want = sorted((big if d is None else d, best["".join(t.split())], len(groups["".join(t.split())])) for d, t in docs)
    assert sorted((big if r["doc_id"] is None else r["doc_id"], big if r["keep_id"] is None else r["keep_id"], r["group_size"]) for r in got) == want


def test_runs_of_many_batches():
    """A memtable that comes in several frames is one run, with the filter that it was flushed with."""
    r = np.random.default_rng(3)
    d = exact.as_bytes(np.array([bytes(x) for x in r.integers(0, 256, (500, 8), dtype=np.uint8)], "V8"))
    a, b = exact.Run.flush(d[:300], np.ones(300, int), np.arange(300)), exact.Run.flush(d[200:], np.full(300, 2), np.arange(200, 500))
    both = a.merge(b)
    assert len(both.digests) == 500 and both.rows.sum() == 600 and (np.diff(both.digests.argsort()) == 1).all()
    assert exact.claimed(both.digests, both.filter, both.n_bits).all()


CLASH = ["row", "key", "digest", "kept", "times", "maybe", "n", "size", "hash", "s", "below", "_k", "_n", "_s", "_times", "_id", "score", "t", "text_", "bucket", "goes"]


def clashing(spark, rows):
    return table(spark, rows).drop("key").select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))


def test_stages_keep_columns_of_any_name(spark, sf):
    cp = pytest.importorskip("corpus_pipeline")
    df = clashing(spark, [*random_docs(4, 80), *ODD]).cache()
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns, name
        rows = out.collect()
        assert all(r[c] == i for r in rows for i, c in enumerate(CLASH)), name
    with pytest.raises(ValueError):
        quality.score(df, None)


def test_mixing_takes_empty_documents_no_oftener(spark):
    docs = [(i, "", "a") for i in range(40)] + [(100 + i, "w " * 10, "a") for i in range(20)] + [(200 + i, "w " * 50, "b") for i in range(20)]
    out = mixing.mix(table(spark, docs)).collect()
    assert max(x["times"] for x in out) <= 2
    got = [r["doc_id"] for r in mixing.mixed_documents(table(spark, docs)).collect()]
    assert max(map(got.count, set(got))) <= 2 and len(got) == sum(x["times"] for x in out)


def test_audio_feature_is_of_each_file(spark):
    """A file's feature doesn't follow what else its batch holds; all columns as from a plain reading."""
    raw = [bytes(range(192)), b"12345", bytes(384), b"\xff" * 192, b""]
    one = {}
    for k, x in enumerate(raw):
        files = spark.createDataFrame([(k, bytearray(audio.wav(x, audio.MULAW, len(x))))], "doc_id long, media binary")
        one[k] = audio.read_audio(files).first()
    files = spark.createDataFrame([(k, bytearray(audio.wav(x, audio.MULAW, len(x)))) for k, x in enumerate(raw)], "doc_id long, media binary").coalesce(1)
    for r in audio.read_audio(files).collect():
        assert r == one[r["doc_id"]]
        x = raw[r["doc_id"]]
        assert ("adpcm" in r["feature"]) == (len(x) % 192 == 0)
        pcm = audio.mulaw_table()[np.frombuffer(x, np.uint8)].astype(np.int64)
        slow = np.frombuffer(r["pcm"], "<i2").astype(np.int64)
        assert len(slow) == 2 * len(x)
        if len(x):
            rms, peak = (float((slow**2).sum()) / len(slow)) ** 0.5, int(np.abs(slow).max())
            crossings = sum((p < 0) != (q < 0) for p, q in zip(slow[1:], slow[:-1], strict=True))
            assert r["feature"].startswith(f"pcm16000 rms={rms:.2f} peak={peak} zc={crossings}; other ")
            # Even samples stand where the stored ones do; the filter's integer taps move them little.
            assert np.abs(slow[::2] - pcm).max() <= 2 + np.abs(pcm).max() // 500


def test_html_scanner():
    got = lambda h: [b.text for b in html.blocks(h)]
    assert got("<p title='a>b'>x</p><script>if (a<b) '</p>'</SCRIPT >y<!-- a > b -->z") == ["x", "yz"]
    assert got('a < b <p>c</p><p class="open>d <b>e</b></p><p>f') == ["a < b", "c", "d e", "f"]
    assert got("x<p") == ["x"] and got("<style>p{}") == [] and got("<?xml?>a<!doctype html>b</ >c") == ["abc"]
    import time

    for part in ('<a b="', "<div>x", "<script", "<li>a<x>", "</p><q a='", "<!--", "<p><i>"):
        began = time.time()
        html.blocks(part * 50_000)
        assert time.time() - began < 5, part


def test_html_styles_not_learned(spark):
    """Pages of frames whose class names none of the made training pages has: tags and text have to tell."""
    r = random.Random(5)
    para = lambda: " ".join("".join(r.choice("aeiourstln") for _ in range(r.randint(2, 8))) for _ in range(r.randint(25, 60))).capitalize() + "."
    pages, want = [], {}
    for k in range(60):
        body = [para() for _ in range(r.randint(3, 6))]
        links = "".join(f'<li><a href="/{i}">{w}</a></li>' for i, w in enumerate(("Zuhause", "Neues", "Kontakt")))
        inner = "".join(f"<p>{b}</p>" for b in body)
        pages.append((k, "u", f'<html><body><nav class="q{k}"><ul>{links}</ul></nav><main class="z{k}"><article>{inner}</article></main><footer class="y{k}"><p>© {k} Q</p></footer></body></html>'))
        want[k] = "\n".join(body)
    got = {x["page_id"]: x["text"] for x in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert np.mean([got[k] == want[k] for k in want]) > 0.85


def test_network_as_plain_loops():
    """The whole network, one text, filter position and chunk at a time."""
    net = quality.ConvNet(3)
    w, size = net.w, quality.STEP * quality.BLOCK

    def plain(text: bytes) -> float:
        n = (len(text) + quality.STEP + size - 1) // size
        raw = text + b"\0" * (n * size - len(text))
        vec = w["embed"][list(raw)]
        filters = np.zeros((n * quality.BLOCK, quality.FILTERS))
        for p in range(n * quality.BLOCK - 1):
            near = vec[p * quality.STEP : (p + 1) * quality.STEP].ravel()
            after = vec[(p + 1) * quality.STEP : (p + 2) * quality.STEP].ravel()
            filters[p] = np.maximum(near @ w["near"] + after @ w["next"] + w["bias"], 0)
        hidden = []
        for at in range(0, max(1, n - 1), quality.MOVE):
            blocks = [min(at + i, n - 1) for i in range(quality.CHUNK)]
            pooled = np.max([filters[b * quality.BLOCK : (b + 1) * quality.BLOCK].max(0) for b in blocks], axis=0)
            hidden.append(np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0))
        z = float(np.r_[np.mean(hidden, 0), np.max(hidden, 0)] @ w["out"] + w["out_bias"][0])
        return 1 / (1 + np.exp(-z))

    r = random.Random(1)
    texts = [bytes(r.randrange(256) for _ in range(r.choice((0, 1, 59, 60, 61, 64, 255, 256, 700, 3000)))) for _ in range(40)]
    assert np.allclose(net.scores(texts), [plain(t) for t in texts], atol=1e-5)


def test_vectors_as_plain_counts():
    """Counts, weights and the nearest centroid, one n-gram at a time."""
    r = random.Random(2)
    texts = ["".join(r.choice("abcdé ÄX") for _ in range(r.randint(0, 60))).encode() for _ in range(30)] + [b"", b"a", b"ab"]

    def plain(t: bytes) -> np.ndarray:
        out = np.zeros(langid.DIM, np.int64)
        t = t.lower()
        for g in langid.GRAMS:
            for i in range(len(t) - g + 1):
                code = 0
                for c in t[i : i + g]:
                    code = (code * 257 + c) & 0xFFFFFFFF
                out[(code * (2654435761 + 2 * (g - 1)) & 0xFFFFFFFF) >> 20] += 1
        return out

    raw = np.stack([plain(t) for t in texts])
    assert (langid.counts(texts) == raw).all()
    idf = np.random.default_rng(1).uniform(1, 3, langid.DIM).astype(np.float32)
    points = langid.weighted(raw[:5] + 1, idf)
    model = langid.Centroids(["x", "y"], np.array([0, 1, 0, 1, 1]), points, np.full(5, 0.2), idf)
    names, score, far = model.nearest(texts)
    for k, t in enumerate(raw):
        v = [np.log1p(float(c)) * float(f) for c, f in zip(t, idf, strict=True)]
        length = sum(x * x for x in v) ** 0.5 or 1.0
        cosine = [sum(x * float(y) for x, y in zip(v, p, strict=True)) / length for p in points]
        best = int(np.argmax(cosine))
        assert score[k] == pytest.approx(cosine[best], abs=1e-5) and far[k] == (score[k] < 0.2)
        assert sorted(cosine)[-1] - sorted(cosine)[-2] < 1e-6 or names[k] == model.langs[model.of[best]]


def test_languages_repeated_rows_and_long_texts(spark):
    rows = [(1, "the thing and other", "en"), (2, "der die das und schon", "de"), (5, "den dem ein eine", "de"), (6, "they them then this", "en")]
    df = spark.createDataFrame([*rows, *rows, (3, "the thing and other " * 30000, None), (4, None, None)], "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True), in_all=4)
    got = langid.identify(df, model).collect()
    assert len(got) == 10 and {x["lang_pred"] for x in got if x["doc_id"] == 3} == {"en"} and {x["lang_pred"] for x in got if x["doc_id"] == 4} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_long_texts(spark):
    """A text of a million bytes in each operator that has no other such test."""
    long = "\n".join(f"word{i} and some words that follow number {i % 977}" for i in range(20000))
    df = table(spark, [(1, long), (2, long.replace("word7 ", "word8 ")), (3, "short")])
    out = {r["doc_id"]: r for r in lines.without_lines(df).collect()}
    # Of the changed line's eight words seven are in the lines of word7 and of word8, 7 of 9 in all: it stays.
    assert out[3]["n_removed"] == 0 and out[2]["n_removed"] == 19999 and out[1]["n_lines"] == 20000
    page = "<body><article>" + "".join(f"<p>{x}.</p>" for x in long.split("\n")) + "</article></body>"
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page)], "page_id long, url string, html string")
    assert {r["text"].count("\n") for r in html.extract(pages).collect()} == {19999}


def test_repeats_over_pieces(spark, monkeypatch):
    """Texts longer than a piece: the same result wherever the pieces end."""
    r = random.Random(2)
    a = "".join(r.choice("abcd") for _ in range(3000))
    docs = [(1, a + "x" * 50 + a[500:2500]), (2, "y" * 777 + a[1000:1900]), (3, a[:399]), (4, "ab" * 900)]
    monkeypatch.setattr(repeats, "PIECE", 512)
    rows = repeats.anchor_rows(repeats._input(table(spark, docs), "doc_id", "text"), 400).collect()
    whole = {1: len(docs[0][1]), 2: len(docs[1][1]), 4: 1800}
    for d, n in whole.items():
        starts = sorted(s for x in rows if x["key"] == d for s in range(x["lo"], x["hi"] + 1))
        assert starts == list(range(n - 399))
    got = {}
    for x in repeats.without_repeats(table(spark, docs)).collect():
        sp = x["spans"] or []
        got[x["doc_id"]] = (x["n_bytes"], sum(s["end"] - s["start"] for s in sp), len(sp), x["sha256"] if x["kept"] is None else hashlib.sha256(x["kept"]).hexdigest())
    assert got == brute.repeats(docs, 400)


def local_spans(docs: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """What the tasks of op5 find, in one process: runs of repeated window starts of each text."""
    from seqloom.llm.anchors import anchors

    found: dict[int, dict[tuple, list]] = {}
    for d, text in enumerate(docs):
        h, _, pos, lo, hi = anchors(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]), width)
        for one in zip(h.view(np.int64).tolist(), pos.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for k, _, a, w, ctx, at in repeats.cut_out(text, [(*one, 1)], width, 10):
                found.setdefault(k, {}).setdefault((a, w, ctx), []).append((d, at))
    out: list[list[tuple[int, int]]] = [[] for _ in docs]
    for own in found.values():
        windows = repeats.Windows(width)
        windows.add([(r, a, w, ctx, len(places)) for r, ((a, w, ctx), places) in enumerate(own.items())])
        places = list(own.values())
        for r, s0, s1 in windows.repeated():
            for d, at in places[r]:
                out[d].append((at + s0, at + s1))
    return [repeats.merged(x, 1) for x in out]


def test_repeats_of_pieces_cut_anywhere():
    """Texts that start or end at any place of a few strings, so that contexts of one anchor are cut off on either side."""
    width = 100
    for seed in range(400):
        r = random.Random(seed)
        base = [bytes(r.choice(b"abcdefgh") for _ in range(170)) for _ in range(2)]
        docs = []
        for _ in range(16):
            x = r.choice(base)
            x = bytearray(x[r.randrange(45) :] if seed % 2 else x[: r.randint(125, 170)])
            if r.random() < 0.6:
                x[r.randrange(45) if seed % 2 else -1 - r.randrange(45)] = 90
            docs.append(bytes(x))
        count: dict[bytes, int] = {}
        for x in docs:
            for i in range(len(x) - width + 1):
                count[x[i : i + width]] = count.get(x[i : i + width], 0) + 1
        want = [repeats.merged([(i, i) for i in range(len(x) - width + 1) if count[x[i : i + width]] > 1], 1) for x in docs]
        assert local_spans(docs, width) == want, seed
