"""Made-up pages with known main text, to train the extraction on.

Every page draws its frame, its class names and what stands in and round the
article; elements that are not the article are marked in the list of labels by
the generator, not in the page. Class names may instead be letters and digits that
say nothing, as build tools make them, or there may be none at all, with the article
right in the body, in a plain container, in a cell of a layout table, or in a fragment
without a frame: what is left to go by then are tags, density of text and links, depth
and siblings.
"""

from __future__ import annotations

import html
import random

_CONTENT = ["content", "post-content", "entry-content", "article-body", "story", "main-content", "post", "text", "articleBody", "page-content"]
_BOXES = {
    "ad": ["ad", "ads", "advert", "ad-slot", "sponsored", "banner-ad", "advertisement", "promo"],
    "nav": ["nav", "menu", "navbar", "breadcrumbs", "main-menu", "topnav", "pagination"],
    "foot": ["footer", "site-footer", "foot", "copyright", "bottom"],
    "head": ["header", "site-header", "masthead", "top-bar", "branding"],
    "side": ["sidebar", "side", "widget", "related", "recommended", "popular", "tags", "rail"],
    "note": ["cookie-notice", "cookie-banner", "consent", "notice", "popup", "modal", "alert", "gdpr", "newsletter", "subscribe"],
    "talk": ["comments", "comment-list", "reader-comments", "discussion", "responses", "respond", "disqus"],
    "share": ["share", "social", "share-buttons", "byline-share", "follow"],
    "form": ["search", "login", "signup", "contact-form", "subscribe-form"],
}
_TAGS = {"ad": ["div", "aside", "section", "div"], "nav": ["nav", "div", "ul", "nav"], "foot": ["footer", "div", "footer"], "head": ["header", "div", "header"], "side": ["aside", "div", "section"], "note": ["div", "section", "aside"], "talk": ["section", "div", "ol"], "share": ["div", "ul", "span"], "form": ["form", "div", "form"]}
_OPAQUE = "bcdfghjkmnpqrtvwxz0123456789"
_SOUNDS = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve und der ein sch la que ción el aux eau".split()


class Page:
    """Writes HTML; an open element is content or not, and texts inherit it."""

    def __init__(self, rng: random.Random, opaque: bool = False, bare: bool = False) -> None:
        self.r, self.out = rng, []
        self.opaque, self.bare = opaque, bare
        #: For each start tag written: 1 in the article, 0 outside.
        self.labels: list[int] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        text = " ".join("".join(r.choices(_SOUNDS, k=r.randint(1, 4))) + r.choice(["", "", "", "", ",", "."]) for _ in range(r.randint(low, high)))
        style = r.random()
        if style < 0.06:
            return " ".join(w.upper() + "!!" for w in text.split())
        if style < 0.12:
            return " ".join(w + r.choice(["***", "&&&", "%%%", "###"]) for w in text.split())
        if style < 0.16:
            return text.replace(" ", " | ")
        return text.capitalize() + r.choice([".", ".", ".", "", "!"])

    def tag(self, name: str, label: int, attrs: str = "") -> None:
        self.out.append(f"<{name}{' ' + attrs if attrs else ''}>")
        self.labels.append(label)

    def end(self, name: str, always: bool = True) -> None:
        if always or self.r.random() < 0.8:
            self.out.append(f"</{name}>")

    def text(self, low: int, high: int) -> None:
        self.out.append(html.escape(self.words(low, high), quote=False))

    def attrs(self, names: list[str], chance: float = 0.85) -> str:
        r = self.r
        if self.bare or r.random() > chance:
            return ""
        name = r.choice(names) + r.choice(["", "", "", "-1", " box", " wide", "-inner"])
        if self.opaque:
            name = "".join(r.choices(_OPAQUE, k=6))
        return f'{r.choice(["class", "class", "id"])}="{name}"'

    def links(self, n: int, label: int, item: str | None) -> None:
        for _ in range(n):
            if item:
                self.tag(item, label)
            self.tag("a", label, f'href="/{self.r.choice(_SOUNDS)}"')
            self.text(1, 4)
            self.end("a")
            if item:
                self.end(item, False)

    def box(self, kind: str) -> None:
        """Something that is not the article."""
        r, name = self.r, self.r.choice(_TAGS[kind])
        plain = name in ("nav", "footer", "header", "aside", "form")
        self.tag(name, 0, self.attrs(_BOXES[kind], 0.4 if plain else 1))
        if kind in ("nav", "share") or kind in ("side", "head", "foot") and r.random() < 0.5:
            if name == "ul":
                self.links(r.randint(2, 9), 0, "li")
            elif r.random() < 0.7:
                self.tag("ul", 0)
                self.links(r.randint(2, 9), 0, "li")
                self.end("ul")
            else:
                self.links(r.randint(2, 7), 0, None)
        if kind == "form":
            for _ in range(r.randint(1, 3)):
                self.tag("label", 0)
                self.text(1, 3)
                self.end("label")
                self.tag("input", 0, 'type="text"')
            self.tag("button", 0)
            self.text(1, 2)
            self.end("button")
        elif kind == "talk":
            for _ in range(r.randint(1, 5)):
                own = r.choice(["div", "li", "article"]) if name != "ol" else "li"
                self.tag(own, 0, self.attrs(["comment", "reply", "response"]))
                for _ in range(r.randint(1, 3)):
                    self.tag("p", 0)
                    self.text(4, 60)
                    self.end("p")
                self.end(own)
        elif kind == "head":
            self.tag(r.choice(["h1", "div", "span", "a"]), 0)
            last = self.out[-1].strip("<>").split()[0]
            self.text(1, 4)
            self.end(last)
        elif kind in ("ad", "note", "foot", "side"):
            for _ in range(r.randint(1, 3)):
                if r.random() < 0.6:
                    self.text(3, 30)
                else:
                    self.tag("p", 0)
                    self.text(3, 30)
                    self.end("p")
        self.end(name)

    def article(self) -> None:
        r = self.r
        name, bare = r.choice(["article", "article", "article", "main", "div", "div", "section"]), r.random() < 0.5
        attrs = "" if name in ("article", "main") and bare else self.attrs(_CONTENT, 1)
        self.tag(name, 1, attrs)
        inner = r.random() < 0.3
        if r.random() < 0.85:
            wrap = r.random() < 0.15
            if wrap:
                self.tag("header", 1)
            self.tag(r.choice(["h1", "h1", "h2"]), 1)
            last = self.out[-1].strip("<>")
            self.text(2, 12)
            self.end(last)
            if wrap:
                self.end("header")
        if inner:
            self.tag("div", 1, self.attrs(["body", "text", "inner", *_CONTENT], 0.7))
        self.blocks()
        if inner:
            self.end("div")
        if r.random() < 0.12:
            self.box(r.choice(["talk", "share", "side"]))
        self.end(name)

    def blocks(self) -> None:
        """Paragraphs, lists and the like of the article, now and then with a box among them."""
        r = self.r
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.68:
                self.tag("p", 1)
                if r.random() < 0.15:
                    self.tag("b", 1)
                self.text(1, 120)
                if r.random() < 0.2:
                    self.tag(r.choice(["a", "em", "strong", "span"]), 1)
                    last = self.out[-1].strip("<>")
                    self.text(1, 6)
                    self.end(last)
                    self.text(2, 20)
                if r.random() < 0.15:
                    self.tag("br", 1)
                self.end("p", False)
            elif kind < 0.75:
                self.tag("h2", 1)
                self.text(1, 8)
                self.end("h2")
            elif kind < 0.82:
                self.tag("ul", 1)
                for _ in range(r.randint(1, 6)):
                    self.tag("li", 1)
                    self.text(1, 15)
                    self.end("li", False)
                self.end("ul")
            elif kind < 0.87:
                self.tag("blockquote", 1)
                self.tag("p", 1)
                self.text(5, 40)
                self.end("p")
                self.end("blockquote")
            elif kind < 0.9:
                self.tag("table", 1)
                for _ in range(r.randint(1, 4)):
                    self.tag("tr", 1)
                    for _ in range(3):
                        self.tag("td", 1)
                        self.text(1, 4)
                        self.end("td")
                    self.end("tr")
                self.end("table")
            elif kind < 0.93:
                self.tag("pre", 1)
                self.text(3, 20)
                self.end("pre")
            else:
                self.box(r.choice(["ad", "share", "side", "form", "note"]))

    def nameless(self) -> tuple[str, list[int]]:
        """A page without class names and ids."""
        r, kind = self.r, self.r.choice(["body", "body", "div", "div", "table", "table", "p", "p", "text", "text", "lines"])
        if kind in ("p", "text"):
            if kind == "text":  # outside every tag
                self.text(*r.choice([(1, 3), (5, 30), (20, 200)]))
                if r.random() < 0.6:
                    return "".join(self.out), self.labels
            self.blocks()
            return "".join(self.out), self.labels
        if r.random() < 0.7:
            self.tag("html", 0)
            self.tag("head", 0)
            self.tag("title", 0)
            self.text(2, 10)
            self.end("title")
            self.end("head")
        self.tag("body", int(kind == "lines"))
        for box in ("head", "nav", "form", "ad"):
            if r.random() < 0.3:
                self.box(box)
        if kind == "lines":  # right in the body
            for _ in range(r.randint(1, 8)):
                self.text(2, 40)
                self.tag("br", 1)
            if r.random() < 0.3:
                self.box("foot")
            return "".join(self.out), self.labels
        around = {"body": [], "div": [r.choice(["div", "div", "section", "center"])], "table": ["table", "tr", "td"]}[kind]
        for name in around:
            if name == "td" and r.random() < 0.7:
                self.tag("td", 0)
                self.links(r.randint(2, 9), 0, r.choice([None, "p"]))
                self.end("td")
            self.tag(name, int(name == around[-1]))
        if r.random() < 0.6:
            last = r.choice(["h1", "h2", "b"])
            self.tag(last, 1)
            self.text(2, 12)
            self.end(last)
        self.blocks()
        for name in reversed(around):
            self.end(name)
        for box in ("side", "foot", "share"):
            if r.random() < 0.3:
                self.box(box)
        if r.random() < 0.5:
            self.out.append("</body></html>")
        return "".join(self.out), self.labels

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.out.append("<!DOCTYPE html>")
        for name in ("html", "head"):
            self.tag(name, 0)
        self.tag("meta", 0, 'charset="utf-8"')
        self.tag("title", 0)
        self.text(2, 10)
        self.end("title")
        for name, body in (("style", "p{margin:0}"), ("script", 'var t="</p>";track(1);')):
            if r.random() < 0.8:
                self.tag(name, 0)
                self.out.append(body)
                self.end(name)
        if sum(map(len, self.out)) % 5:  # the end tag is optional; no draw, so that pages stay what they were
            self.end("head")
        self.tag("body", 0)
        wraps = r.choice([0, 0, 0, 1, 1, 2])
        for _ in range(wraps):
            self.tag("div", 0, self.attrs(["wrapper", "page", "container", "row", "layout", "site"], 0.8))
        for kind in ("head", "nav", "note", "ad", "form", "side"):
            if r.random() < {"head": 0.5, "nav": 0.8, "ad": 0.5}.get(kind, 0.25):
                self.box(kind)
        if r.random() < 0.5:
            self.out.append("<!-- ad 0 -->")
        self.article()
        for kind in ("talk", "side", "ad", "form", "share", "note"):
            if r.random() < 0.3:
                self.box(kind)
        if r.random() < 0.85:
            self.box("foot")
        for _ in range(wraps):
            self.end("div")
        if r.random() < 0.9:
            self.out.append("</body></html>")
        return "".join(self.out), self.labels


def pages(n: int, seed: int = 5, opaque: bool = False, bare: bool = False) -> list[tuple[str, list[int]]]:
    """Pages, and for each element in order whether it belongs to the article. ``opaque``: their names say nothing; ``bare``: they have none."""
    rng = random.Random(seed)
    made = (Page(rng, opaque, bare) for _ in range(n))
    return [p.nameless() if bare else p.page() for p in made]
