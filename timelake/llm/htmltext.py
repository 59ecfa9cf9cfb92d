"""Main-text extraction from web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks (text between block-level tags), each with features of its ancestor tags (names, roles,
class and id words) and of its text (length, link share, punctuation, marks). A chain of two states, main text or not,
scores block features and state changes; its weights are trained by stochastic gradient ascent on the log-likelihood of
labelled pages (forward-backward), and pages are decoded by Viterbi. The labelled pages are made by `labelled_pages`
from a seed: they vary the layouts that the operator must tell apart. Training takes place once, on the driver; tasks
get the weights.

Text: character references are decoded, white space inside a block becomes one space (a line-break tag counts as white
space), blocks are trimmed, empty ones left out, and the main ones joined by one line break in page order.

Edge cases: null and empty pages, and pages without main text, give the empty text; broken markup, unclosed tags,
comments and quotes are read on as browsers roughly do; very long pages take linear time. Repeated rows give equal
results. Extra columns pass through; `out` is replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>?|([^<]++|<)""", re.S)
#: Attributes one after the other: whole names, so that data-id is no id and a quoted value holds no names.
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["'/=<]""")
_SPEAKING = {"class", "id", "role", "itemprop", "aria-label"}
#: Elements whose content is not text (fixed values of HTML).
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "canvas", "select", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend "
    "li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_HOLDERS = {"ul", "ol", "dl", "table", "div", "section", "article", "menu", "select"}
_TAGS = "nav header footer aside form article main section figure figcaption table td li ul ol dl blockquote pre h1 h2 h3 h4 h5 h6 p head title button label address details menu dialog".split()
#: Words of class, id and role attributes, by what they speak for (fixed values).
_HINTS = {
    "nav": "nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|toc|skip",
    "ad": "ads?|advert|advertisement|adsense|banner|sponsor|sponsored|promo|promotion|dfp",
    "side": "side|sidebar|widget|widgets|related|recommend|recommended|trending|popular|complementary|rail",
    "comment": "comments?|reply|replies|respond|disqus|discussion|commentlist|reviews?",
    "footer": "footer|foot|copyright|legal|contentinfo|colophon",
    "header": "header|masthead|topbar|site-title|logo|branding",
    "notice": "cookie|cookies|consent|gdpr|notice|popup|modal|alert|overlay|subscribe|newsletter|signup|paywall|disclaimer|dialog",
    "share": "share|sharing|social|tags|follow",
    "form": "form|search|login|contact|input",
    "content": "content|article|post|entry|story|main|maincontent|text|articlebody|hentry",
}
_HINT = {k: re.compile(rf"(?:^|[\s_-])(?:{v})(?=$|[\s_-])", re.I) for k, v in _HINTS.items()}
_TEXT = ("bias", "words<4", "words<10", "words<25", "words>=25", "links>0.6", "links>0.2", "links=0", "stop", "copyright", "first", "last", "short link")
FEATURES = [*(f"t:{t}" for t in _TAGS), "inner header", *(f"c:{h}" for h in _HINTS), "hidden", "bare", *_TEXT]
_AT = {f: i for i, f in enumerate(FEATURES)}


@lru_cache(maxsize=100_000)
def _own(name: str, attrs: str) -> frozenset[int]:
    """Features that an element gives to all that it holds."""
    found = {_AT[f"t:{name}"]} if f"t:{name}" in _AT else set()
    if attrs:
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key in _SPEAKING:
                found |= {_AT[f"c:{h}"] for h, p in _HINT.items() if p.search(value)}
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                found.add(_AT["hidden"])
    return frozenset(found)


def _inner(own: frozenset[int], above: frozenset[int]) -> frozenset[int]:
    """A header inside an article or the main part is its headline, not the site's."""
    if _AT["t:header"] in own and (_AT["t:article"] in above or _AT["t:main"] in above):
        return own - {_AT["t:header"]} | {_AT["inner header"]}
    return own


@lru_cache(maxsize=100_000)
def _joined(a: frozenset[int], b: frozenset[int]) -> frozenset[int]:
    return a | b


def leaf_blocks(page: str) -> list[tuple[str, frozenset[int], float]]:
    """(text, ancestor features, share of its characters in links) of each leaf block."""
    out: list[tuple[str, frozenset[int], float]] = []
    none: frozenset[int] = frozenset()
    stack: list[tuple[str, frozenset[int]]] = []
    places: dict[str, list[int]] = {}  # positions of each tag name in the stack
    text: list[str] = []
    linked = pos = in_link = 0
    end = len(page)

    def flush():
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append((whole, stack[-1][1] if stack else none, min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def cut(i: int):
        nonlocal in_link
        while len(stack) > i:
            places[stack.pop()[0]].pop()
        in_link = in_link and bool(places.get("a"))

    match = _TOKEN.match
    while pos < end:
        m = match(page, pos)
        pos = m.end()
        piece = m[7]
        if piece is not None:
            if "&" in piece:
                piece = entities.unescape(piece)
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
            continue
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            text.append(" ")
            continue
        if not closing and name in _RAW:
            if not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, pos)
                pos = close.end() if close else end
            continue
        block = name in _BLOCK
        if block:
            flush()
        if closing:
            if places.get(name):
                cut(places[name][-1])
            continue
        if name in _VOID:
            continue
        if block:
            shut = _CLOSES.get(name, none) | ({"p"} if name not in ("label", "button", "option") else none)
            open_shut = [places[s] for s in shut if places.get(s)]
            if open_shut:
                holder = max((places[h][-1] for h in _HOLDERS if places.get(h)), default=-1)
                within = [p[bisect_right(p, holder)] for p in open_shut if p[-1] > holder]
                if within:
                    cut(min(within))
        if name == "a":
            in_link = 1
        own = _own(name, attrs if block or name in ("a", "span") else "")
        if name == "header" and stack:
            own = _inner(own, stack[-1][1])
        places.setdefault(name, []).append(len(stack))
        stack.append((name, _joined(stack[-1][1], own) if stack and own else own if own else stack[-1][1] if stack else none))
    flush()
    return out


def _text_features(text: str, links: float, first: bool, last: bool, bare: bool) -> list[int]:
    n = text.count(" ") + 1
    found = ["bias", "words<4" if n < 4 else "words<10" if n < 10 else "words<25" if n < 25 else "words>=25", "links>0.6" if links > 0.6 else "links>0.2" if links > 0.2 else "links=0"]
    if text[-1] in ".!?…。\"'”»":
        found.append("stop")
    if "©" in text or "All rights reserved" in text:
        found.append("copyright")
    if links > 0.6 and n < 4:
        found.append("short link")
    if first:
        found.append("first")
    if last:
        found.append("last")
    if bare:
        found.append("bare")
    return [_AT[f] for f in found]


def features(blocks: list[tuple[str, frozenset[int], float]]) -> list[list[int]]:
    return [[*ancestors, *_text_features(t, links, i == 0, i == len(blocks) - 1, not ancestors)] for i, (t, ancestors, links) in enumerate(blocks)]


class Chain:
    """Weights of the block features for the state "main text" and of the four state changes."""

    def __init__(self):
        self.weight, self.change = np.zeros(len(FEATURES)), np.zeros((2, 2))

    def train(self, pages: list[tuple[list[list[int]], list[int]]], epochs: int = 25, rate: float = 0.15, ridge: float = 1e-4, seed: int = 1) -> Chain:
        order = random.Random(seed)
        pages = [p for p in pages if p[0]]
        for epoch in range(epochs):
            order.shuffle(pages)
            step = rate / (1 + epoch / 8)
            for rows, labels in pages:
                e = np.array([self.weight[r].sum() for r in rows])
                one, two = self._marginals(e)
                for r, y, p in zip(rows, labels, one, strict=True):
                    self.weight[r] += step * (y - p)
                for a, b in zip(labels[:-1], labels[1:], strict=True):
                    self.change[a, b] += step
                self.change -= step * two
                self.weight *= 1 - step * ridge
        return self

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of state 1 by block, and expected numbers of the four changes, by forward-backward."""
        n, t = len(e), self.change
        s = np.stack([np.zeros(n), e], 1)
        f, b = np.empty((n, 2)), np.zeros((n, 2))
        f[0] = s[0]
        for i in range(1, n):
            f[i] = s[i] + np.logaddexp(f[i - 1, 0] + t[0], f[i - 1, 1] + t[1])
        for i in range(n - 2, -1, -1):
            x = s[i + 1] + b[i + 1]
            b[i] = np.logaddexp(t[:, 0] + x[0], t[:, 1] + x[1])
        z = np.logaddexp(f[-1, 0], f[-1, 1])
        one = np.exp(f[:, 1] + b[:, 1] - z)
        two = np.exp(f[:-1, :, None] + t + (s + b)[1:, None, :] - z).sum(0) if n > 1 else np.zeros((2, 2))
        return one, two

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest states, by Viterbi."""
        if not rows:
            return []
        w = self.weight.tolist()
        (t00, t01), (t10, t11) = self.change.tolist()
        back, a, b = [], 0.0, sum(w[x] for x in rows[0])
        for r in rows[1:]:
            e = 0.0
            for x in r:
                e += w[x]
            from0, from1 = a + t00 < b + t10, a + t01 < b + t11
            back.append((from0, from1))
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + e
        state = int(b > a)
        states = [state]
        for choice in reversed(back):
            state = int(choice[state])
            states.append(state)
        return states[::-1]


_MARK = ""


def labelled_pages(n: int = 320, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Made-up pages of varied layout with a label for each leaf block: 1 for main text."""
    r = random.Random(seed)
    letters = ["ta", "re", "on", "li", "mo", "en", "sku", "ver", "da", "pim", "os", "ué"]
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=22: words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?"])
    prose = lambda: _MARK + " ".join(sentence() for _ in range(r.randint(1, 5)))
    menu = lambda k=6: "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(r.randint(2, k))) + "</ul>"
    cls = lambda *names: r.choice(['class="{}"', 'id="{}"', 'class="x-{}"', 'class="{} wide"']).format(r.choice(names))

    role = lambda x: f'<div role="{x}">'

    def body():
        parts = []
        if r.random() < 0.85:
            head = f"<h1>{_MARK}{words(2, 9)}{r.choice(['', '.'])}</h1>"
            if r.random() < 0.3:
                head = f"<header{r.choice(['', ' class=x', ' data-id=ad'])}>{head}" + (f"<p>{prose()}</p>" if r.random() < 0.3 else "") + "</header>"
            parts.append(head)
        for _ in range(r.randint(1, 8)):
            x = r.random()
            if x < 0.62:
                parts.append(f"<p{r.choice(['', '', '', ' data-id=ad', ' data-class=menu'])}>{prose()}</p>")
            elif x < 0.68:
                parts.append(f"<p><b>{prose()}<br><p>{prose()}</p>")
            elif x < 0.74:
                parts.append(f"<h2>{_MARK}{words(1, 6)}</h2><p>{prose()}</p>")
            elif x < 0.79:
                parts.append("<ul>" + "".join(f"<li>{_MARK}{sentence(2, 12)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif x < 0.83:
                parts.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif x < 0.86:
                parts.append(f"<pre>{_MARK}{words(3, 20)}</pre>")
            elif x < 0.9:
                parts.append(f'<p>{_MARK}{sentence()} <a href="#">{words(1, 3)}</a> {sentence()}</p>')
            elif x < 0.93:
                parts.append(f"<table><tr><td>{_MARK}{words(1, 3)}</td><td>{_MARK}{words(1, 3)}</td></tr></table>")
            elif x < 0.97:
                parts.append(f"<div {cls('ad', 'advert', 'promo', 'sponsored', 'ads')}>{sentence()}</div>")
            else:
                parts.append(f"<aside>{sentence()}</aside>")
        return "".join(parts)

    def comments():
        one = lambda: f"<div {cls('comment', 'reply')}><p>{sentence()} {sentence()}</p></div>"
        return r.choice([f"<section {cls('comments', 'discussion')}><h3>{words(1, 3)}</h3>", f"<div {cls('comments', 'disqus', 'comment-list')}>"]) + one() * 1 + one() + r.choice(["</section>", "</div>"])

    aside = [
        lambda: f"<nav>{menu()}</nav>",
        lambda: f"<div {cls('menu', 'nav', 'navbar', 'breadcrumb')}>{menu()}</div>",
        lambda: f"<header><h1>{words(1, 3)}</h1><p>{sentence(2, 6)}</p></header>",
        lambda: f"<div {cls('header', 'masthead')}><a href='/'>{words(1, 2)}</a></div>",
        lambda: f"<div {cls('ad', 'banner', 'advert', 'sponsor', 'ads', 'promo')}>{sentence()}{r.choice(['', ' ' + sentence()])}</div>",
        lambda: f"<aside><h3>{words(1, 3)}</h3>{menu()}<p>{sentence()}</p></aside>",
        lambda: f"<div {cls('sidebar', 'widget', 'related')}><h4>{words(1, 3)}</h4><p>{sentence()}</p>{menu(4)}</div>",
        lambda: f"<div {cls('cookie', 'notice', 'consent', 'popup', 'newsletter', 'alert')}><p>{sentence()} {sentence()}</p><button>{words(1, 2)}</button></div>",
        lambda: f"<form><label>{words(1, 3)}</label><input name=q><button>{word()}</button><p>{sentence()}</p></form>",
        lambda: f"<div {cls('share', 'social')}>{menu(4)}</div>",
        lambda: f"{role('navigation')}{menu()}</div>",
        lambda: f"{role('banner')}<p>{sentence(2, 8)}</p></div>",
        lambda: f"{role('complementary')}<h3>{words(1, 3)}</h3><p>{sentence()} {sentence()}</p></div>",
        lambda: f"{role('search')}<label>{words(1, 3)}</label><p>{sentence(2, 6)}</p></div>",
        lambda: f"{role(r.choice(['alert', 'dialog']))}<p>{sentence()}</p><button>{words(1, 2)}</button></div>",
    ]
    foot = [lambda: f"<footer>&copy; {word()}.example &middot; {sentence()}</footer>", lambda: f"<footer><p>{sentence()}</p>{menu(4)}</footer>", lambda: f"<div {cls('footer', 'copyright')}>&copy; {words(1, 4)}</div>", lambda: f"{role('contentinfo')}<p>{sentence()} {sentence()}</p></div>", lambda: f"<div {cls('footer', 'legal', 'colophon')}><p>{sentence()} {sentence()}</p><p>{sentence()}</p></div>"]
    pages = []
    for _ in range(n):
        kind = r.random()
        wrap = ("<article>", "</article>") if kind < 0.6 else ("<main>", "</main>") if kind < 0.72 else (f"<div {cls('content', 'post', 'entry', 'story', 'article')}>", "</div>") if kind < 0.9 else ("<div>", "</div>")
        inner = body() + (comments() if r.random() < 0.2 else "")
        top = "".join(r.choice(aside)() for _ in range(r.randint(0, 4)))
        low = "".join(r.choice(aside)() for _ in range(r.randint(0, 2))) + (comments() if r.random() < 0.2 else "") + (r.choice(foot)() if r.random() < 0.85 else "")
        if r.random() < 0.12:  # unmarked: text alone, or paragraphs right in the body
            lines = [prose() for _ in range(r.randint(1, 6))]
            plain = r.choice([" ".join, "\n\n".join, "<br><br>".join, "<p>".join, lambda x: "".join(f"<p>{y}</p>" for y in x)])(lines)
            pages.append(plain if r.random() < 0.5 else f"<html><head><title>{words(2, 9)}</title></head><body>{plain}{r.choice(foot)() if r.random() < 0.3 else ''}</body></html>")
            continue
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title><style>p{{}}</style></head><body>{top}{wrap[0]}{inner}{wrap[1]}{low}</body></html>")
    return [(p, [int(_MARK in t) for t, *_ in leaf_blocks(p)]) for p in pages]


@lru_cache(maxsize=1)
def model() -> Chain:
    """The chain trained on the labelled pages."""
    clean = lambda blocks: [(t.replace(_MARK, "").strip() or "x", a, x) for t, a, x in blocks]
    return Chain().train([(features(clean(leaf_blocks(p))), labels) for p, labels in labelled_pages()])


def main_text(page: str | None, chain: Chain) -> str:
    if not page:
        return ""
    blocks = leaf_blocks(page)
    return "\n".join(t for (t, *_), y in zip(blocks, chain.decode(features(blocks)), strict=True) if y)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """`pages` with a column `out`, the main text of column `html`."""
    bounded_batches(pages.sparkSession)
    chain = model()
    at = pages.columns.index(html)
    rest = [f for f in pages.schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, chain) for x in b.column(at).to_pylist()]
            keep = [i for i, n in enumerate(b.schema.names) if n != out]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(texts, pa.string())], [*(b.schema.names[i] for i in keep), out])

    return pages.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.StringType())]))


