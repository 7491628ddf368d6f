"""Labelled pages to train on: made from a seed, with articles and all that surrounds them in many forms."""

from __future__ import annotations

import random

from barlume.llm.html_blocks import Block, blocks

#: Stands before each block of an article in the made page, and is taken out of the text again.
MARK = "\ue000"
_SYLLABLES = "ba co de fi gu la me no pi ra se ta un ver wi ost en ing or al th".split()


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(4, 22).capitalize() + self.rng.choice([".", ".", ".", "!", "?"])

    def prose(self, low: int = 1, high: int = 6) -> str:
        text = " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))
        if self.rng.random() < 0.15:
            text = text.replace(" ", self.rng.choice(["*** ", "%%% ", " | ", "!! ", "&amp;&amp; "]))
        return f'{text[:20]}<a href="/x">{text[20:40]}</a>{text[40:]}' if self.rng.random() < 0.2 and "&" not in text else text

    def paragraph(self) -> str:
        r = self.rng.random()
        if r < 0.12:
            return f"<p><b>{MARK}{self.prose(1, 2)}<br>"
        if r < 0.2:
            return f"<p>{MARK}{self.words(1, 3).capitalize()}.</p>"
        return f"<p>{MARK}{self.prose()}</p>"

    def article(self) -> str:
        r = self.rng
        out = [f"<h1>{MARK}{r.choice([self.words(2, 9).capitalize(), self.sentence(), self.prose(1, 1)])}</h1>"]
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14])):
            x = r.random()
            if x < 0.72:
                out.append(self.paragraph())
            elif x < 0.78:
                out.append(f"<h2>{MARK}{self.words(1, 6).capitalize()}</h2>")
            elif x < 0.84:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{MARK}{self.prose(1, 2)}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif x < 0.88:
                out.append(f"<blockquote><p>{MARK}{self.prose(1, 3)}</p></blockquote>")
            elif x < 0.91:
                out.append("<table><tr>" + "".join(f"<td>{MARK}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            elif x < 0.93:
                out.append(f"<pre>{MARK}{self.words(3, 12)}</pre>")
            else:
                out.append(self.noise(inside=True))
        return "".join(out)

    def boxed(self) -> str:
        """Some prose, in a paragraph or not."""
        return f"<p>{self.prose(1, 2)}</p>" if self.rng.random() < 0.5 else self.prose(1, 2)

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 2)}</a></li>' for i in range(n)) + "</ul>"

    def noise(self, inside: bool = False) -> str:
        r = self.rng
        kinds = {
            "advert": lambda: f'<div class="{r.choice(["ad", "ads", "advert", "sponsored", "promo box"])}">{self.boxed()}</div>',
            "scriptless": lambda: f"<noscript>{self.boxed()}</noscript>",
            "side": lambda: f"<aside><h3>{self.words(1, 3)}</h3><p>{self.prose(1, 2)}</p>{self.links(3)}</aside>",
            "widget": lambda: f'<div class="{r.choice(["sidebar", "widget", "related", "recommended"])}"><h3>{self.words(1, 3)}</h3><p>{self.prose(1, 2)}</p></div>',
            "notice": lambda: f'<div {r.choice(["class", "id"])}="{r.choice(["cookie-notice", "consent", "popup", "alert notice"])}"><p>{self.prose(1, 3)}</p></div>',
            "share": lambda: f'<div class="{r.choice(["share", "social"])}">{self.words(1, 4)}</div>',
            "form": lambda: f'<form action="/s"><label>{self.words(1, 3)}</label><p>{self.prose(1, 1)}</p><input name="q"></form>',
            "letter": lambda: f'<div class="newsletter subscribe"><p>{self.prose(1, 2)}</p></div>',
            "nav": lambda: f"<nav>{self.links(r.randint(3, 8))}</nav>",
        }
        after = {
            "comments": lambda: f'<{(t := r.choice(["section", "div"]))} {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "replies"])}"><h3>{self.words(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{self.prose(1, 3)}</p></div>' for _ in range(r.randint(1, 4))) + f"</{t}>",
        }
        pool = kinds if inside else kinds | after
        return pool[r.choice(list(pool))]()

    def page(self) -> str:
        r = self.rng
        out = ["<!DOCTYPE html><html><head><title>x</title><script>var t='</p>';</script></head><body>"]
        top = [
            lambda: f"<header><p>{self.words(1, 6)}</p><nav>{self.links(r.randint(3, 9))}</nav></header>",
            lambda: f"<nav>{self.links(r.randint(3, 9))}</nav>",
            lambda: f'<div class="header"><div>{self.words(1, 5)}</div></div><div id="menu">{self.links(5)}</div>',
            lambda: f'<div class="nav">{self.links(6)}</div>',
        ]
        out.append(r.choice(top)())
        out += [self.noise() for _ in range(r.choice([0, 1, 1, 2]))]
        inner = self.article()
        if r.random() < 0.25:
            inner += self.noise()
        opening, closing = r.choice([
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ('<main class="content">', "</main>"), ('<div id="content">', "</div>"),
            ('<div class="post entry">', "</div>"), ('<div class="wrap"><article class="story">', "</article></div>"), ('<section class="article-body">', "</section>"), ("<div>", "</div>"),
        ])
        out += [opening, inner, closing]
        out += [self.noise() for _ in range(r.choice([0, 1, 1, 2]))]
        foot = [
            lambda: f"<footer>&copy; {self.words(1, 3)} &middot; {self.prose(1, 1)}</footer>",
            lambda: f"<footer><p>{self.prose(1, 2)}</p>{self.links(3)}</footer>",
            lambda: f'<div class="footer"><p>&copy; {self.words(1, 5)}</p></div>',
        ]
        out.append(r.choice(foot)() + ("</body></html>" if r.random() < 0.8 else ""))
        return "".join(out)


def labelled(n: int, seed: int = 0) -> list[tuple[list[Block], list[bool]]]:
    """The blocks of n made pages, and which of them belong to the article."""
    maker = _Page(random.Random(seed))
    out = []
    for _ in range(n):
        found = blocks(maker.page())
        marks = [MARK in b.text for b in found]
        for b in found:
            b.text = b.text.replace(MARK, "").strip()
        out.append((found, marks))
    return out
