"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page is parsed into nodes in document order, so that a subtree is a range and
its sums are differences of prefix sums. Trees score each node by its tag and
attribute tokens and those above it, by text and link density of its subtree, by
depth and by its siblings. Pages whose class names are known to none of the tokens,
and pages without names, are scored by trees of their own, trained on such pages.
Decoding then picks the best labelling in which every path from the root runs
outside, article, excluded, in this order: nothing below an excluded node is text,
and an article is not left and entered again. In a fragment with text outside every
tag the document itself may be the article.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cdrforge.llm import boosting
from cdrforge.llm.html_pages import pages

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b|(display\s*:\s*none)""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = set("address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_BLANK = " \t\r\n\f\v\xa0\ufeff"
#: What an opening tag closes first, up to the nearest of the second set.
_CLOSES = {"p": ({"p"}, set()), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: What an open head may hold; all else ends it.
_HEAD = set("head base basefont bgsound link meta noscript script style template title".split())
_NEVER = set("script style noscript template iframe textarea title head select option button input svg canvas object".split())
_GROUPS = ["article main", "nav menu", "header", "footer", "aside", "form input button select option label fieldset textarea", "p pre blockquote", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "a", "div", "section", "table tbody thead tr td th", "b i em strong span br small u sup sub mark code font", "html body head", "script style noscript template iframe title meta link"]
_GROUP = {t: k for k, g in enumerate(_GROUPS) for t in g.split()}
_TOKENS = [
    "content article post entry story main body text",
    "nav menu navbar topnav breadcrumb breadcrumbs pagination pager",
    "header head masthead top branding banner logo",
    "footer foot bottom copyright",
    "side sidebar widget related recommended popular tags rail aside more",
    "ad ads advert advertisement sponsored sponsor promo slot",
    "cookie consent notice popup modal alert gdpr newsletter subscribe overlay",
    "comment comments reply replies response responses respond discussion disqus reader",
    "share social follow buttons",
    "form search login signup contact",
    "hidden",
]
_CLASS = {t: 1 << k for k, g in enumerate(_TOKENS) for t in g.split()}
_TAG_BITS = {"nav": 1 << 1, "menu": 1 << 1, "header": 1 << 2, "footer": 1 << 3, "aside": 1 << 4, "form": 1 << 9, "article": 1 << 11, "main": 1 << 11}
_N_BITS = 12


class Dom(NamedTuple):
    """Nodes in document order; node 0 is the document."""

    parent: list[int]
    tag: list[str]
    bits: list[int]  # of the node's tag and attributes
    above: list[int]  # those of all its ancestors
    chars: list[int]  # of its own text
    marks: list[int]  # of punctuation in it
    texts: list[tuple[int, str]]  # (node, text), and (-1, "") where a block ends
    named: list[bool]  # of the elements with names in their attributes: a token is known


@functools.lru_cache(4096)
def _attributes(raw: str) -> tuple[int, bool]:
    """Tokens, and whether there are names at all."""
    bits, names = 0, False
    for value, hidden, none in _ATTR.findall(raw):
        if hidden or none:
            bits |= _CLASS["hidden"]
        names |= bool(value)
        for token in _WORD.findall(value):
            bits |= _CLASS.get(token.lower(), 0)
    return bits, names


def parse(page: str) -> Dom:
    """Nodes of a page, however broken; unclosed elements end with their parent."""
    dom = Dom([0], ["#"], [0], [0], [0], [0], [], [])
    open_: list[int] = [0]
    live: dict[str, int] = {}  # how many of a name are open: a bare end tag needs no search
    at, end, head = 0, len(page), 0  # head: the node of an open one

    def close(k: int) -> None:
        for node in open_[k:]:
            live[dom.tag[node]] -= 1
        del open_[k:]

    def end_head() -> None:
        nonlocal head
        if head in open_:
            close(open_.index(head))
        head = 0

    def text(raw: str) -> None:
        if "&" in raw:
            raw = html.unescape(raw)
        if head and open_[-1] == head and raw.strip():
            end_head()
        node = open_[-1]
        dom.texts.append((node, raw))
        dom.chars[node] += len(raw)
        dom.marks[node] += raw.count(".") + raw.count(",")

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in _BLOCK:
            dom.texts.append((-1, ""))
        if m[1]:
            for k in range(len(open_) - 1, 0, -1) if live.get(name) else ():
                if dom.tag[open_[k]] == name:
                    close(k)
                    break
            continue
        if head and name not in _HEAD:
            end_head()
        if name in _CLOSES:
            closes, stop = _CLOSES[name]
            for k in range(len(open_) - 1, 0, -1) if any(map(live.get, closes)) else ():
                t = dom.tag[open_[k]]
                if t in closes:
                    close(k)
                    break
                if t in stop or name == "p" and t in _BLOCK:
                    break
        up, node = open_[-1], len(dom.tag)
        dom.parent.append(up)
        dom.tag.append(name)
        bits, names = _attributes(m[3]) if m[3] else (0, False)
        if names:
            dom.named.append(bits > 0)
        dom.bits.append(_TAG_BITS.get(name, 0) | bits)
        dom.above.append(dom.above[up] | dom.bits[up])
        dom.chars.append(0)
        dom.marks.append(0)
        if name in _VOID or m[3].endswith("/") and name in ("svg", "path"):
            continue
        open_.append(node)
        live[name] = live.get(name, 0) + 1
        if name == "head":
            head = node
        if name in _RAW:
            tail = _RAW[name].search(page, at)
            text(page[at : tail.start() if tail else end])
            at = tail.end() if tail else end
            close(len(open_) - 1)
    return dom


def features(doms: list[Dom]) -> np.ndarray:
    """A row for each node of all pages."""
    out = []
    for d in doms:
        n = len(d.tag)
        parent, bits, above = np.array(d.parent), np.array(d.bits), np.array(d.above)
        chars, marks = np.array(d.chars, float), np.array(d.marks, float)
        group = np.array([_GROUP.get(t, len(_GROUPS)) for t in d.tag])
        chars[[t in _NEVER for t in d.tag]] = 0
        depth, last = np.zeros(n), np.arange(1, n + 1)
        for k in range(1, n):
            depth[k] = depth[d.parent[k]] + 1
        for k in range(n - 1, 0, -1):
            last[d.parent[k]] = max(last[d.parent[k]], last[k])
        total = lambda v: (c := np.concatenate([[0.0], np.cumsum(v)]))[last] - c[:n]
        size, linked, nodes = total(chars), total(chars * (group == 10)), last - np.arange(n)
        many = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
        place = np.zeros(n)
        seen = [0] * n
        for k in range(1, n):
            place[k] = seen[d.parent[k]]
            seen[d.parent[k]] += 1
        brothers = many[parent]
        like = np.bincount(parent * 32 + group, minlength=32 * n)[parent * 32 + group]
        flags = np.concatenate([bits[:, None] >> np.arange(_N_BITS) & 1, above[:, None] >> np.arange(_N_BITS) & 1, (group[:, None] == np.arange(len(_GROUPS)))], 1)
        rest = [depth, np.log1p(size), np.log1p(chars), linked / (size + 1), np.log1p(nodes), size / nodes, total(marks) / (size + 1), size / (size[0] + 1), size / (size[parent] + 1), place / np.maximum(brothers, 1), np.log1p(brothers), like / np.maximum(brothers, 1), total(group == 6) / nodes, np.arange(n) / n, total(bits > 0) / nodes]
        out.append(np.concatenate([flags, np.stack(rest, 1)], 1))
    return np.concatenate(out).astype(np.float32)


_OUTSIDE, _ARTICLE, _EXCLUDED = range(3)


def loose(d: Dom) -> bool:
    """Text stands outside every tag of a page without a frame."""
    return any(node == 0 and raw.strip(_BLANK) for node, raw in d.texts) and not {"html", "body"} & set(d.tag)


def decode(d: Dom, odds: np.ndarray) -> list[int]:
    """The labelling of most log-odds in which every path runs outside, article, excluded."""
    n = len(d.tag)
    take, skip = odds.tolist(), [0.0] * n  # best of a subtree whose top is article, or outside
    for k in range(n - 1, 0, -1):
        if d.tag[k] in _NEVER:
            take[k], skip[k] = -1e18, 0.0
        up = d.parent[k]
        take[up] += max(take[k], 0.0)  # what is excluded counts nothing, with all below
        skip[up] += max(take[k], skip[k])
    out = [_OUTSIDE] * n
    if loose(d) and take[0] > skip[0]:
        out[0] = _ARTICLE
    for k in range(1, n):
        above = out[d.parent[k]]
        if above == _EXCLUDED or d.tag[k] in _NEVER:
            out[k] = _EXCLUDED
        elif above == _ARTICLE:
            out[k] = _ARTICLE if take[k] > 0 else _EXCLUDED
        else:
            out[k] = _ARTICLE if take[k] > skip[k] else _OUTSIDE
    return out


class Model(NamedTuple):
    trees: boosting.Trees
    opaque: boosting.Trees  # for pages whose names say nothing, or that have none

    def log_odds(self, doms: list[Dom]) -> list[np.ndarray]:
        x, cut = features(doms), np.cumsum([0, *(len(d.tag) for d in doms)])
        out: list = [None] * len(doms)
        dark = [opaque(d) for d in doms]
        for trees, kind in ((self.trees, False), (self.opaque, True)):
            at = [k for k, o in enumerate(dark) if o == kind]
            if at:
                odds = trees.log_odds(np.concatenate([x[cut[k] : cut[k + 1]] for k in at]))
                for k, part in zip(at, np.split(odds, np.cumsum([len(doms[k].tag) for k in at])[:-1]), strict=True):
                    out[k] = part
        return out


def opaque(d: Dom) -> bool:
    """Of the elements with names fewer than one in ten has one that is known, or none has names."""
    return not d.named or 10 * sum(d.named) < len(d.named)


@functools.cache
def train(n_pages: int = 400, seed: int = 5) -> Model:
    """Trees trained on ``n_pages`` made-up pages of known names, and on as many of opaque names and of none."""
    made = []
    for drawn in (pages(n_pages, seed), pages(n_pages, seed, opaque=True) + pages(n_pages, seed, bare=True)):
        doms = [parse(p) for p, _ in drawn]
        made.append(boosting.fit(features(doms), np.concatenate([[loose(d), *labels] for d, (_, labels) in zip(doms, drawn, strict=True)]).astype(float)))
    return Model(*made)


def extract(d: Dom, odds: np.ndarray) -> str:
    label = decode(d, odds)
    parts = [" " if node < 0 else raw for node, raw in d.texts if node < 0 or label[node] == _ARTICLE]
    return " ".join("".join(parts).split())


def _run(model: Model):
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                raw = [x or "" for x in batch.column("html").to_pylist()]
                doms = [parse(x) for x in raw]
                texts = [extract(d, odds) for d, odds in zip(doms, model.log_odds(doms), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=kind)

    return run


def main_text(pages_: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages_``: id, url, text, n_chars.

    ``text`` is the article's text: character references decoded, blocks joined by
    one space, white space in them turned into one space. A null or empty page has
    an empty text; a text without a tag is a page, too. Null and repeated ids and null urls are kept as they are. Other
    columns are ignored, whatever their names; an empty table gives an empty one.
    """
    rows = pages_.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    out = rows.mapInArrow(_run(model or train()), "page_id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
