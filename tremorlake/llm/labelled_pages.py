"""Labelled pages for training: invented prose in layouts with and without telling names, marked by ``data-label``.

``data-label="1"`` on a block element says that its own text, or text inside it, is main text; ``0`` that none is.
"""

from __future__ import annotations

import random

_SYLLABLES = "an be co di el fa go hu in jo ka le mi no or pa que ra si to un va wo ya zi é ü ñ".split()
_MENU = ["nav", 'div class="menu"', 'ul class="navbar"', 'div id="topbar"', "nav", 'div class="breadcrumbs"', "menu", "div", "ul"]
_SIDE = ["aside", 'div class="sidebar"', 'div id="right-rail"', 'section class="related"', 'div class="widget popular"', "aside"]
_ADVERT = ['div class="ad"', 'div class="advert"', 'aside class="sponsored"', 'div id="ad-top"', 'section class="promo"', 'div class="banner"']
_NOTICE = ['div class="cookie-notice"', 'div id="consent"', 'div role="alert"', 'div class="newsletter popup"', "dialog", 'section class="paywall"']
_COMMENTS = ['section id="comments"', 'div class="comment-list"', 'div class="reader-replies"', 'ol class="commentlist"', 'div id="disqus_thread"']
_FOOT = ["footer", 'div class="footer"', 'div id="copyright"', "footer", 'div class="site-info legal"']
_HEAD = ["header", 'div class="header"', 'div id="masthead"', "header", 'div class="site-logo"']
_STORY = ["article", "article", 'div class="post"', 'div id="content"', "main", 'div class="entry-content"', "div", 'section class="story"', 'article class="post"', "td"]


class _Writer:
    def __init__(self, seed: int):
        self.rnd = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.rnd.choices(_SYLLABLES, k=self.rnd.randint(1, 4))) for _ in range(self.rnd.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 18).capitalize() + "." for _ in range(self.rnd.randint(low, high)))

    def box(self, kind: str, label: int, inner: str, close: bool = True) -> str:
        return f'<{kind} data-label="{label}">{inner}' + (f"</{kind.split()[0]}>" if close else "")

    def links(self, label: int = 0) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(self.rnd.randint(2, 9))]
        if self.rnd.random() < 0.7:
            return self.box("ul", label, "".join(self.box("li", label, x) for x in items))
        return " | ".join(items)

    def other(self, kinds: list[str]) -> str:
        """A box of no main text: links, short lines, or prose that looks like an article's."""
        kind, turn = self.rnd.choice(kinds), self.rnd.random()
        if kinds is _MENU or (kinds is _SIDE and turn < 0.5):
            return self.box(kind, 0, (self.box("h3", 0, self.words(1, 3)) if kinds is _SIDE else "") + self.links())
        if kinds is _COMMENTS:
            replies = [self.box("p", 0, self.sentences(1, 6)) + self.box("div", 0, f"<a>{self.words(1, 2)}</a>") for _ in range(self.rnd.randint(1, 6))]
            return self.box(kind, 0, self.box("h3", 0, self.words(1, 3)) + "".join(self.box("li" if kind.startswith("ol") else "div", 0, x) for x in replies))
        if kinds is _FOOT:
            return self.box(kind, 0, "&copy; " + self.sentences(1, 3) + (self.links() if turn < 0.4 else ""))
        if kinds is _HEAD:
            return self.box(kind, 0, self.rnd.choice([self.box("h1", 0, self.words(1, 3)), f"<a>{self.words(1, 2)}</a>", self.box("p", 0, self.sentences(1, 2))])
                            + (self.links() if turn < 0.5 else ""))
        text = self.sentences(1, 4)
        extra = '<input type="text"><button>ok</button>' if turn < 0.3 else ""
        return self.box(kind, 0, (self.box("p", 0, text) if self.rnd.random() < 0.5 else text) + extra)

    def form(self) -> str:
        return self.box(self.rnd.choice(["form", 'form class="search"', 'div class="login-form"']), 0,
                        self.box("p", 0, self.words(1, 6)) + '<label>' + self.words(1, 2) + '</label><input type="text"><button>go</button>')

    def story(self) -> str:
        parts = [self.box("h1", 1, self.words(2, 14))] if self.rnd.random() < 0.8 else []
        close = self.rnd.random() < 0.8
        for _ in range(self.rnd.choice([1, 1, 2, 3, 5, 9])):
            turn = self.rnd.random()
            if turn < 0.08:
                parts.append(self.box("ul", 1, "".join(self.box("li", 1, self.sentences(1, 2)) for _ in range(self.rnd.randint(2, 5)))))
            elif turn < 0.14:
                parts.append(self.box("blockquote", 1, self.box("p", 1, self.sentences(1, 3))))
            elif turn < 0.22:
                parts.append(self.box("h2", 1, self.words(1, 6)))
            elif turn < 0.27:
                parts.append(self.box("pre", 1, self.words(3, 20)))
            elif turn < 0.31:
                rows = "".join(self.box("tr", 1, "".join(self.box("td", 1, self.words(1, 3)) for _ in range(3))) for _ in range(2))
                parts.append(self.box("table", 1, rows))
            elif turn < 0.4:
                parts.append(self.other(self.rnd.choice([_ADVERT, _SIDE, _NOTICE])))
            text = self.rnd.choice([self.sentences(1, 8), self.sentences(2, 5), self.words(1, 5) + ".", f"<b>{self.sentences(1, 4)}<br>",
                                    f'{self.sentences(1, 2)} <a href="/x">{self.words(1, 4)}</a> {self.sentences(1, 2)}'])
            parts.append(self.box("p", 1, text, close))
        kind = self.rnd.choice(_STORY)
        if kind == "td":
            return self.box("table", 1, self.box("tr", 1, self.box("td", 1, "".join(parts))))
        if self.rnd.random() < 0.25:
            return self.box(kind, 1, self.box(self.rnd.choice(["div", "section", 'div class="text"']), 1, "".join(parts)))
        return self.box(kind, 1, "".join(parts) + (self.other(_SIDE) if self.rnd.random() < 0.1 else ""))

    def page(self) -> str:
        top = [self.other(k) for k in (_HEAD, _MENU, _NOTICE, _ADVERT) if self.rnd.random() < 0.55] + ([self.form()] if self.rnd.random() < 0.2 else [])
        end = [self.other(k) for k in (_SIDE, _COMMENTS, _NOTICE, _ADVERT) if self.rnd.random() < 0.45] + ([self.form()] if self.rnd.random() < 0.2 else [])
        side = [self.other(_SIDE)] if self.rnd.random() < 0.25 else []
        self.rnd.shuffle(top)
        foot = [self.other(_FOOT)] if self.rnd.random() < 0.85 else []
        body = "".join([*top, *side, self.story(), *end, *foot])
        if self.rnd.random() < 0.3:
            body = self.box(self.rnd.choice(["div", 'div id="wrapper"', 'div class="container"', "main"]), 1, body)
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body data-label="1">{body}</body></html>'


def labelled_pages(n: int = 250, seed: int = 11) -> list[str]:
    return [_Writer(seed * 1_000_003 + i).page() for i in range(n)]
