"""A forgiving HTML reader that yields the leaf blocks of a page.

A block is the text between two edges of block-level elements; inline elements
and line breaks inside it do not end it. Each block carries a bit mask of what
its ancestors are: their tags, and key words in their class, id and role.

Scripts, styles, titles, text areas and frames hold raw text up to their closing
tag, or to the page's end, as in browsers; a slash at a tag's end closes nothing
but an inline element, and what stands in a drawing. Controls are left out and
what stands in for media is marked as hidden where their own closing tag ends
them; without one, what follows is read as the page's.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: A tag's name; one attribute, or a slash, each read once; the end of a tag.
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"[\s/]*+(=?[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\"|\Z)|'([^']*+)('|\Z)|([^\s>\"'][^\s>]*+)))?+")
_END = re.compile(r"\s*+(/?)[\s/]*+>")
_COMMENT_END = re.compile(r"--!?>")
_SCRIPT = re.compile(r"<!--(?:-?>)?|-->|<(/?)script(?=[\s/>])", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_RAW_END = {}
#: A page is read beyond its length so many times for tags that never end; then tags end at the next bracket.
MOST_READ = 8

# Element kinds of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mpadded mphantom merror mspace semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_RAW_END |= {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}
CONTROLS = frozenset("select button".split())
STAND_INS = frozenset("noscript template svg canvas audio video".split())
CLOSES = {  # an opening tag ends an open element of these kinds
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("ul ol dl table tr tbody thead tfoot div article section main aside nav header footer form body".split())
# Tags and key words that tell what a part of a page is for.
TAGS = "nav header footer aside form article main section ul ol table blockquote figure dialog address details h1 h2 h3 h4 h5 h6 p li td pre dl figcaption fieldset menu".split()
WORDS = {
    "navigation": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs sitemap",
    "side": "sidebar side aside widget widgets related recommended popular trending tags tagcloud more",
    "foot": "footer foot copyright colophon legal imprint",
    "head": "header masthead banner topbar top logo branding",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog toast paywall warning announcement",
    "comment": "comment comments commentlist reply replies respond disqus discussion review reviews reaction",
    "form": "form subscribe subscription newsletter signup login search contact register input",
    "share": "share sharing social follow button buttons toolbar print",
    "meta": "byline author meta date timestamp caption credit",
    "content": "article post entry story content body main text articlebody maincontent prose page",
    "hidden": "hidden invisible",
}
ANCESTORS = [*TAGS, *WORDS]
_TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)}
_WORD_BIT = {w: 1 << len(TAGS) + i for i, words in enumerate(WORDS.values()) for w in words.split()}
_HIDDEN = 1 << len(TAGS) + list(WORDS).index("hidden")


@dataclass(slots=True)
class Block:
    text: str
    mask: int
    tag: str
    linked: int  # code points inside links


def _mask(tag: str, attributes: list[tuple[str, str]]) -> int:
    mask = _TAG_BIT.get(tag, 0)
    if attributes and tag not in INLINE:
        seen = set()
        for name, value in attributes:
            name, value = name.lower(), value.lower()
            if name in seen:  # of equal names the first counts
                continue
            seen.add(name)
            if name in ("hidden", "aria-hidden"):
                mask |= 0 if value == "false" else _HIDDEN
            elif name == "style":
                mask |= _HIDDEN if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else 0
            elif name in ("class", "id", "role", "itemprop"):
                for word in _SPLIT.split(value):
                    mask |= _WORD_BIT.get(word, 0)
    return mask


class _Scanner:
    """Finds the markup of a page from one position on, and never goes back further than ``MOST_READ`` page lengths in all."""

    def __init__(self, page: str) -> None:
        self.page, self.spent, self.gone = page, 0, False

    def tag(self, at: int) -> tuple[int, str, list[tuple[str, str]], bool] | None:
        """(end, name, attributes, whether a slash ends it) of the tag whose name begins here; None where it never ends."""
        page = self.page
        name = _NAME.match(page, at)[0]
        k, found = at + len(name), []
        if self.gone:
            return None
        if self.spent <= MOST_READ * len(page):
            while True:
                if end := _END.match(page, k):
                    return end.end(), name, found, bool(end[1])
                m = _ATTRIBUTE.match(page, k)
                if m.end() == k or m[3] == "" or m[5] == "" or m.end() >= len(page):
                    break
                if m[1]:
                    found.append((m[1], m[2] or m[4] or m[6] or ""))
                k = m.end()
            self.spent += len(page) - at
        k = page.find(">", at)
        if k < 0:
            self.gone = True
            return None
        inside = page[at + len(name) : k]
        return k + 1, name, [(m[1], m[2] or m[4] or m[6] or "") for m in _ATTRIBUTE.finditer(inside) if m[1]], inside.endswith("/")

    def past(self, mark: str, at: int) -> int:
        k = self.page.find(mark, at)
        return len(self.page) if k < 0 else k + len(mark)

    def comment(self, at: int) -> int:
        """The end of a comment whose dashes begin here."""
        for short in (">", "->"):
            if self.page.startswith(short, at + 2):
                return at + 2 + len(short)
        m = _COMMENT_END.search(self.page, at + 2)
        return m.end() if m else len(self.page)

    def script(self, at: int) -> int:
        """The end of a script: inside a comment, a script that opens there has to close first."""
        hidden = nested = False
        for m in _SCRIPT.finditer(self.page, at):
            mark = m[0].lower()
            if mark == "<!--":
                hidden = True
            elif mark == "-->" or mark.startswith("<!--"):
                hidden = nested = False
            elif not m[1]:
                nested = nested or hidden
            elif nested:
                nested = False
            else:
                return self.past(">", m.end())
        return len(self.page)


def blocks(page: str | None) -> list[Block]:
    """The blocks with text, in page order: references decoded, white space runs one space, trimmed."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, int, str]] = [("", 0, "")]  # tag, mask of it and its ancestors, nearest block-level tag
    places: dict[str, list[int]] = {}  # of each tag where it stands open, so that no search goes through the stack
    solid: list[int] = [0]  # where block-level elements stand
    walls: list[int] = [0]  # where elements stand beyond which an opening tag ends nothing
    parts: list[str] = []
    linked, links = 0, 0
    held: list[tuple[int, int, list[str], int]] = []  # open controls and stand-ins: place in the stack, blocks before, text before it and its length in links

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1][1], stack[-1][2], min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if stack[-1][0] in ("option", "optgroup") and places.get("select"):
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    def open_(tag: str, mask: int, block: str) -> None:
        k = len(stack)
        places.setdefault(tag, []).append(k)
        if tag not in INLINE:
            solid.append(k)
        if tag in SCOPE or tag in CONTROLS or tag in STAND_INS:
            walls.append(k)
        stack.append((tag, mask, block))

    def last(tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else 0

    def close(k: int) -> None:
        nonlocal links
        while held and held[-1][0] >= k:  # not ended by their own tags: what they hold stays
            own, before, kept, n = held.pop()
            text = " ".join("".join(kept).split())
            if text:
                out.insert(before, Block(text, stack[own][1], stack[own][2], min(n, len(text))))
        for tag, _, _ in stack[k:]:
            links -= tag == "a"
            places[tag].pop()
        for marks in (solid, walls):
            while marks[-1] >= k:
                marks.pop()
        del stack[k:]

    def release(k: int) -> None:
        nonlocal linked
        close(k + 1)
        tag, (_, before, kept, n) = stack[k][0], held.pop()
        if tag in CONTROLS:
            del out[before:]
        for b in out[before:]:
            b.mask |= _HIDDEN
        parts[:], linked = kept, n
        close(k)

    scan, at = _Scanner(page), 0
    while at < len(page):
        m = page.find("<", at)
        if m < 0:
            add(page[at:])
            break
        if m > at:
            add(page[at:m])
        at, follows = m + 1, page[m + 1 : m + 2]
        if follows in ("!", "?"):
            if page.startswith("--", m + 2) and follows == "!":
                at = scan.comment(m + 2)
            elif page.startswith("[CDATA[", m + 2) and places.get("math"):
                at = scan.past("]]>", m + 9)
                add(html.escape(page[m + 9 : at].removesuffix("]]>")))
            else:
                at = scan.past(">", at)
            continue
        closing = follows == "/"
        first = page[at + closing : at + closing + 1]
        if not (first.isascii() and first.isalpha()):
            if closing and first:
                at = scan.past(">", at)
            else:
                add("<" + follows * closing)
                at += closing
            continue
        read = scan.tag(at + closing)
        if read is None:  # no tag ends any more
            add(page[m:])
            break
        at, tag, attributes, empty = read
        tag = tag.lower()
        if closing:
            if tag == "br" or tag in VOID:
                continue
            k = last(tag)
            if tag not in INLINE:
                flush()
            if k and (tag in CONTROLS or tag in STAND_INS):
                release(k)
            elif k and not (tag in INLINE and solid[-1] > k):
                close(k)
            continue
        drawn = bool(places.get("svg"))
        if tag in RAW:
            if not (drawn and empty):
                if tag == "script":
                    at = scan.script(at)
                else:
                    end = _RAW_END[tag].search(page, at)
                    at = end.end() if end else len(page)
            if tag not in ("script", "style"):
                flush()
            continue
        if tag in CONTROLS or tag in STAND_INS:
            if tag in CONTROLS and last(tag):
                flush()
                close(places[tag][0])
            if tag not in ("button", "select", "svg", "canvas"):
                flush()
            if not (tag == "svg" and empty):
                held.append((len(stack), len(out), parts[:], linked))
                parts.clear()
                linked = 0
                open_(tag, stack[-1][1], stack[-1][2])
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag not in VOID and not empty:
                links += tag == "a"
                open_(tag, stack[-1][1], stack[-1][2])
            continue
        flush()
        ends = CLOSES.get(tag, ())
        k = max([last("p"), *map(last, ends), *(map(last, HEADINGS) if tag in HEADINGS else ())])
        if k and k >= walls[-1]:
            close(k)
        if tag == "body" and stack[-1][0] == "head":
            close(len(stack) - 1)
        if tag not in VOID and not (drawn and empty):
            open_(tag, stack[-1][1] | _mask(tag, attributes), tag)
    flush()
    close(1)
    return out
