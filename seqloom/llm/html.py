"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page's text is cut at the borders of its block elements. Each block is described by its ancestors' tags, class and id
words and by its text (length, share of links, punctuation); the field, trained on labelled pages, scores blocks and
neighbours, and Viterbi decoding tells article from the rest. The labelled pages are made here, from page frames whose
parts are known, with made-up words, so that nothing is learned from the pages themselves.

Defined results: null or empty html, and html without text, give an empty text; scripts, styles, comments and other
content that is never shown are no blocks; unclosed or stray tags are read as browsers do in the simple cases; pages of
any length are read whole; repeated rows and further columns change nothing.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

#: Elements whose content is never article text.
RAW = frozenset("script style title noscript template svg iframe textarea select object math".split())
NAME = re.compile(r"/?([a-zA-Z][^\s>/]*)")
ATTRS = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i img input ins kbd label mark meter output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag closes first when one is open within the same container.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Block elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SECTION = frozenset("article aside body div footer form header main nav section table td ul ol dl figure dialog details".split())

@dataclass
class Block:
    text: str
    above: tuple[str, ...]
    linked: int


def _words(attrs: str) -> tuple[str, ...]:
    return tuple(w for m in NAMES.finditer(attrs) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()) if len(w) > 1)


@lru_cache(maxsize=None)
def _closing(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{name}\s*>", re.I)


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """start, end, closing, name and attributes of each tag; an empty name is what leaves no trace: comments, raw elements.

    No character is looked at more than a few times: once a quote is found open to the end of the page, this and later
    tags end at the next >, whatever their quotes; and a tag without any > takes the rest of the page with it.
    """
    n, loose = len(html), False
    i = html.find("<")
    while i >= 0:
        m = NAME.match(html, i + 1)
        if m:
            name, closing = m[1].lower(), html[i + 1] == "/"
            whole = None if loose else ATTRS.match(html, m.end())
            loose = whole is None
            end = whole.end() if whole else html.find(">", m.end()) + 1
            if not end:
                yield i, n, False, "", ""
                return
            if name in RAW and not closing:
                last = _closing(name).search(html, end)
                end = last.end() if last else n
                yield i, end, False, "", ""
            else:
                yield i, end, closing, name, html[m.end() : end - 1]
        elif html.startswith(("!", "?", "/"), i + 1):
            mark = "-->" if html.startswith("!--", i + 1) else ">"
            end = html.find(mark, i + (4 if len(mark) > 1 else 1))
            end = end + len(mark) if end >= 0 else n
            yield i, end, False, "", ""
        else:
            end = i + 1
        i = html.find("<", end)


def blocks(html: str, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks in page order: text without markup, one space for white space, and what describes their ancestors.

    All ancestors count, however deep a block lies: each element adds its features to a running count when it opens and
    takes them back when it closes. Features that aren't `known` are left out, so that pages of any shape take little.
    """
    out: list[Block] = []
    stack: list[tuple[str, list[str], list[str]]] = []  # tag, its features, features of the nearest section
    open_: Counter[str] = Counter()
    held: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = at = 0
    above: tuple[str, ...] | None = None

    def kept(features: list[str]) -> list[str]:
        return [f for f in dict.fromkeys(features) if known is None or f in known]

    def flush() -> None:
        nonlocal linked, above
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                if above is None:
                    own = kept([f"tag={stack[-1][0] if stack else ''}"])
                    above = (*held, *(stack[-1][2] if stack else ()), *own)
                out.append(Block(text, above, linked))
            parts.clear()
        linked = 0

    def push(tag: str, names: tuple[str, ...]) -> None:
        nonlocal above
        own = kept([f"a={tag}", *(f"c={w}" for w in names)])
        near = kept([f"near={tag}", *(f"n={w}" for w in names)]) if tag in SECTION else stack[-1][2] if stack else []
        stack.append((tag, own, near))
        open_[tag] += 1
        held.update(own)
        above = None

    def pop(k: int) -> None:
        nonlocal above
        for tag, own, _ in stack[k:]:
            open_[tag] -= 1
            for f in own:
                held[f] -= 1
                if not held[f]:
                    del held[f]
        del stack[k:]
        above = None

    def close(names: tuple[str, ...], within: frozenset[str] = frozenset()) -> None:
        if not any(open_[x] for x in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                pop(k)
                return
            if stack[k][0] in within:
                return

    for start, end, closing, tag, attrs in tags(html):
        if start > at:
            parts.append(html[at:start])
            if links:
                linked += start - at
        at = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if closing:
            close((tag,))
        else:
            if tag in ENDS_P:
                close(("p",), SECTION)
            if tag in CLOSES:
                close(CLOSES[tag], SECTION - {"td"})
            if tag not in VOID:
                push(tag, _words(attrs) if attrs else ())
            if tag in SECTION:
                links = 0
    parts.append(html[at:])
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    out = []
    for k, b in enumerate(page):
        f = ["bias", *b.above]
        n = b.text.count(" ") + 1
        g = [f"len={min(n.bit_length(), 6)}", f"link={min(3, int(4 * b.linked / max(1, len(b.text))))}"]
        if b.text[-1] in ".!?…:;\"”»)":
            g.append("ends")
        if "," in b.text:
            g.append("comma")
        if "©" in b.text:
            g.append("copyright")
        if k == 0:
            g.append("first")
        if k == len(page) - 1:
            g.append("last")
        out.append(f + g)
    return out


class Field:
    """Two labels, 1 for article. Weights by feature are for label 1 against 0; pairs are weighed by both labels."""

    def __init__(self) -> None:
        self.w: dict[str, float] = {}
        self.pair = [[0.0, 0.0], [0.0, 0.0]]

    def energies(self, rows: list[list[str]]) -> list[float]:
        get = self.w.get
        return [sum([get(x, 0.0) for x in r]) for r in rows]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi."""
        (p00, p01), (p10, p11) = self.pair
        off = on = 0.0
        back = []
        for k, e in enumerate(self.energies(rows)):
            if k:
                a, b, c, d = off + p00, on + p10, off + p01, on + p11
                back.append((b > a, d >= c))
                off, on = max(a, b), max(c, d)
            on += e
        label = int(on > off)
        path = [label]
        for step in reversed(back):
            label = int(step[label])
            path.append(label)
        return path[::-1]

    def step(self, rows: list[list[str]], labels: list[int], rate: float) -> None:
        """One gradient step on a page's log likelihood, by forward and backward sums."""
        e, p = self.energies(rows), self.pair
        add = lambda x, y: max(x, y) + log(1 + exp(-abs(x - y)))
        fwd = [(0.0, e[0])]
        for x in e[1:]:
            o, n = fwd[-1]
            fwd.append((add(o + p[0][0], n + p[1][0]), add(o + p[0][1], n + p[1][1]) + x))
        bwd = [(0.0, 0.0)]
        for x in reversed(e[1:]):
            o, n = bwd[-1]
            bwd.append((add(p[0][0] + o, p[0][1] + x + n), add(p[1][0] + o, p[1][1] + x + n)))
        bwd.reverse()
        z = add(*fwd[-1])
        for k, r in enumerate(rows):
            d = rate * (labels[k] - exp(min(0.0, fwd[k][1] + bwd[k][1] - z)))
            if abs(d) > 1e-5:
                for x in r:
                    self.w[x] = self.w.get(x, 0.0) * (1 - 1e-4) + d
            if k:
                for i in (0, 1):
                    for j in (0, 1):
                        q = exp(min(0.0, fwd[k - 1][i] + p[i][j] + (e[k] if j else 0.0) + bwd[k][j] - z))
                        p[i][j] += rate * ((labels[k - 1] == i and labels[k] == j) - q)


def labelled_page(r: random.Random) -> tuple[str, list[str]]:
    """A made-up page and the texts of its article's blocks."""
    made: list[str] = []
    word = lambda: "".join(r.choice(("ba", "re", "ti", "on", "sha", "el", "ku", "min", "tor", "é", "ver")) for _ in range(r.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def prose(a: int = 6, b: int = 60) -> str:
        return " ".join(some(3, 14).capitalize() + r.choice(("", "", ",")) + " " + some(1, 5) + r.choice((".", ".", ".", "?", "!")) for _ in range(r.randint(1, max(1, b // 12)))) if r.random() < 0.9 else some(a, b)

    def main(text: str) -> str:
        made.append(text)
        return text

    def named(*names: str) -> str:
        own = " ".join(r.sample(names, r.randint(1, min(2, len(names)))))
        return r.choice((f' class="{own}"', f' id="{own.split()[0]}"', f" class='{own}-{word()}'")) if r.random() < 0.9 else ""

    def part(tag: str, inside: str, *names: str) -> str:
        if tag != "div" and r.random() < 0.3:
            return f"<{tag}>{inside}</{tag}>"
        return f"<{tag}{named(*names)}>{inside}</{tag}>"

    links = lambda n: "<ul>" + "".join(f'<li><a href="/{word()}">{some(1, 3)}</a></li>' for _ in range(n)) + "</ul>"
    text = lambda: r.choice((prose(), f"<p>{prose()}</p>", f"<p>{prose(3, 14)}</p>"))

    def menu() -> str:
        return part(r.choice(("nav", "nav", "div")), r.choice((links(r.randint(2, 9)), " ".join(f'<a href="/{word()}">{some(1, 2)}</a>' for _ in range(r.randint(2, 7))))), "nav", "menu", "navigation", "breadcrumb", "topnav", "navbar", "pagination")

    def advert() -> str:
        return part(r.choice(("div", "div", "aside", "section")), text(), "ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo")

    def sidebar() -> str:
        return part(r.choice(("aside", "aside", "div", "section")), f"<h3>{some(1, 3)}</h3>" + r.choice((links(r.randint(2, 6)), text())), "sidebar", "related", "widget", "aside", "recommended", "trending", "side")

    def notice() -> str:
        return part(r.choice(("div", "section", "dialog")), text() + r.choice(("", f"<button>{some(1, 2)}</button>")), "cookie", "notice", "consent", "alert", "popup", "gdpr", "modal", "overlay")

    def form() -> str:
        return part("form", f"<label>{some(1, 3)}</label><input type=text><p>{prose(3, 14)}</p><button>{some(1, 2)}</button>", "form", "newsletter", "signup", "search", "subscribe", "login", "contact")

    def comments() -> str:
        one = lambda: part(r.choice(("div", "li", "article", "p")), f"<p>{prose()}</p>" if r.random() < 0.6 else prose(), "comment", "reply", "review", "response")
        return part(r.choice(("section", "div", "ol", "aside")), f"<h2>{some(1, 3)}</h2>" + "".join(one() for _ in range(r.randint(1, 5))), "comments", "discussion", "responses", "disqus", "replies")

    def share() -> str:
        return part("div", " ".join(f'<a href="#">{some(1, 2)}</a>' for _ in range(r.randint(2, 5))), "share", "social", "tags", "toolbar", "meta", "byline")

    def article() -> str:
        title = f"<h1>{main(some(2, 12))}</h1>" if r.random() < 0.8 else ""
        body = []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                t = main(prose(1, 90))
                body.append(r.choice((f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<p class={word()}>{t}</p>")))
            elif kind < 0.8:
                body.append(f"<h2>{main(some(1, 8))}</h2>")
            elif kind < 0.86:
                body.append("<ul>" + "".join(f"<li>{main(prose(2, 20))}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote>{main(prose(3, 40))}</blockquote>")
            elif kind < 0.93:
                t, a, b = prose(5, 30), some(1, 3), some(2, 8)
                main(f"{t} {a} {b}")
                body.append(f'<p>{t} <a href="/{word()}">{a}</a> {b}</p>')
            else:
                body.append(r.choice((advert, sidebar, share, notice, form))())
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        inside = title + "".join(body) + (comments() if r.random() < 0.15 else "")
        kind = r.random()
        if kind < 0.55:
            return f"<article{named('post', 'article', 'entry', 'story') if r.random() < 0.4 else ''}>{inside}</article>"
        if kind < 0.7:
            return f"<main>{inside}</main>"
        return part("div", inside, "content", "post", "article", "entry", "story", "main", "body", "text")

    top = r.choice(("", part("header", f"<a href='/'>{some(1, 3)}</a>" + r.choice(("", f"<p>{some(2, 8)}</p>", f"<h1>{some(1, 3)}</h1>")), "header", "masthead", "site", "top", "branding")))
    bits = [menu() if r.random() < 0.8 else "", advert() if r.random() < 0.5 else "", notice() if r.random() < 0.3 else "", sidebar() if r.random() < 0.25 else ""]
    r.shuffle(bits)
    after = [f() for f in (sidebar, comments, advert, form, menu, notice, share) if r.random() < 0.3]
    r.shuffle(after)
    foot = part(r.choice(("footer", "footer", "div")), r.choice((f"&copy; {some(1, 3)} &middot; {prose(3, 16)}", f"<p>&copy; {some(1, 4)}</p>" + links(3), links(4), prose(3, 20))), "footer", "copyright", "bottom", "legal", "foot") if r.random() < 0.9 else ""
    wrap = r.choice(("{}", "{}", '<div class="wrapper">{}</div>', '<div id="page">{}</div>', '<div class="container">{}</div>'))
    return "<html><head><title>x</title></head><body>" + wrap.format(top + "".join(bits) + article() + "".join(after) + foot) + "</body></html>", made


@lru_cache(2)
def trained(pages: int = 800, rounds: int = 10, seed: int = 5) -> Field:
    """A field from so many labelled pages; the same on every machine."""
    r = random.Random(seed)
    rows = []
    for _ in range(pages):
        html, made = labelled_page(r)
        page, left = blocks(html), [" ".join(t.split()) for t in made]
        labels = []
        for b in page:
            hit = bool(left) and b.text == left[0]
            labels.append(int(hit))
            if hit:
                left.pop(0)
        if page and not left:
            rows.append((features(page), labels))
    field = Field()
    for k in range(rounds):
        r.shuffle(rows)
        for f, labels in rows:
            field.step(f, labels, 0.08 / (1 + k))
    return field


def main_text(html: str, field: Field) -> str:
    page = blocks(html, field.w)
    return "\n".join(b.text for b, keep in zip(page, field.decode(features(page)), strict=True) if keep) if page else ""


def extract(pages: DataFrame, field: Field | None = None, html: str = "html", out: str = "text") -> DataFrame:
    """All columns of pages but `html`, and the main text."""
    field = field or trained()
    names = [c for c in pages.columns if c not in (html, out)]
    schema = pages.select(*names, F.lit("").alias(out)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            found = [main_text(x or "", field) for x in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string())], [*names, out])

    return pages.select(*names, F.col(html).cast("string").alias(html)).mapInArrow(run, schema)
