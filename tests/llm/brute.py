"""Plain restatements of the training-data contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_classes(docs: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> set size, smallest doc_id reachable by links."""
    sets = [(d, shingle_set(t, k)) for d, t in docs]
    up = {d: d for d, _ in sets}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and percent * max(len(s), len(t)) <= 100 * min(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


def repeats(docs: list[tuple[int, str | None]], width: int) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> bytes, bytes removed, removed runs, sha256 of what is left."""
    count: dict[bytes, int] = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for _, b in raw:
        for i in range(len(b) - width + 1):
            count[b[i : i + width]] = count.get(b[i : i + width], 0) + 1
    out = {}
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = len([1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])])
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


def line_matches(docs: list[tuple[int, str | None]], percent: int) -> dict[int, list[int]]:
    """doc_id -> line numbers (from 0) that stay: lines without words, and those that no earlier line is near to."""
    lines = [(d, i, frozenset(WORD.findall(lower(x)))) for d, t in sorted(docs, key=lambda r: r[0]) for i, x in enumerate((t or "").split("\n"))]
    out: dict[int, list[int]] = {d: [] for d, _ in docs}
    for k, (d, i, s) in enumerate(lines):
        hit = s and any(t and 100 * len(s & t) >= percent * len(s | t) for _, _, t in lines[:k])
        if not hit:
            out[d].append(i)
    return out


def eigen(vectors: list[tuple[int, ...]]) -> tuple[int, list[int], np.ndarray, np.ndarray, float]:
    """n, sums, eigenvalues falling, components as rows, trace: of whole vectors, each once."""
    once = sorted(set(vectors))
    x = np.array(once, float)
    v = np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1])
    e, q = np.linalg.eigh(v)
    return len(once), [sum(c) for c in zip(*once, strict=True)], e[::-1], q.T[::-1], float(np.trace(v))


def url_verdict(url: str | None, rules: list[tuple[str, str, str]], otherwise: str = "allow") -> tuple[str, str, str | None, str]:
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = lower(host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, otherwise)


def collocations(docs: list[tuple[str | None, str | None]], support: int, percent: int, most: int) -> list[tuple]:
    """lang, rank, phrase, a, l, r, n, score of (lang, text) rows."""
    count: dict[tuple[str, tuple[str, ...]], int] = {}
    total: dict[str, int] = {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] = total.get(lang, 0) + len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    count[lang, tuple(w[i : i + m])] = count.get((lang, tuple(w[i : i + m])), 0) + 1
    often = {k: f for k, f in count.items() if f >= support}
    out: dict[str, list] = {}
    for (lang, p), a in often.items():
        around = [f for (x, q), f in often.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if len(p) < 2 or any(100 * f >= percent * a for f in around):
            continue
        score, k = min((1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:most], 1))
