"""Reading a page: tags and text runs in order, each with its place in the element tree and its role."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|svg|canvas|iframe|object|textarea|title"
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
# Elements, roles and class words that are not part of an article.
ASIDE_TAGS = frozenset("nav header footer aside form button select dialog menu head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu form".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "widget footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended comment comments commentlist reply replies respond disqus pagination pager skip toolbar copyright".split()
)
PAGE_ONLY_WORDS = frozenset("header masthead topbar".split())
# Words of elements that hold articles which are not the page's own.
OTHERS_WORDS = frozenset("sidebar widget related recommended comment comments commentlist reply replies respond disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_MARKUP = re.compile(
    rf"<!--(?:.*?-->|.*)|<(?P<raw>{RAW})\b(?P<raw_attributes>[^>]*)>(?:.*?</(?P=raw)\s*>|.*)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|$)|<[!?][^>]*(?:>|$)|</[^>]*(?:>|$)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?:^|\s)(hidden)(?=\s|/|$)")
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ARTICLE, MAIN = 2, 1


@dataclass(slots=True)
class Element:
    tag: str
    path: str
    aside: bool  # in something that is no part of an article
    level: int  # ARTICLE or MAIN if inside such an element
    link: bool
    heading: bool = False
    doubt: bool = False  # aside only by words that are a part of a name, which an article inside outweighs


@dataclass(slots=True)
class Event:
    """A tag (``text`` is None) or a text run, as it stands in the page."""

    name: str  # "<tag>" or "</tag>"; "" for a run
    text: str | None
    at: Element
    block: bool


def _role(tag: str, attributes: str, level: int) -> tuple[bool, bool, int, str]:
    """(aside, doubt, level, label) by the element's own name and attributes.

    A class word alone never takes a heading of an article, nor an article whose class only contains it (as tags and
    categories in classes do). What it says of other elements is in doubt where it is a part of a name.
    """
    words_aside = words_part = False
    aside, own, label = tag in ASIDE_TAGS and not (level and tag == "header"), ARTICLE if tag == "article" else MAIN if tag == "main" else 0, ""
    if attributes and ("=" in attributes or "hidden" in attributes):
        for m in _ATTRIBUTE.finditer(attributes):
            if m[5]:
                aside = True
                continue
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                value = value.strip().lower()
                aside |= value in ASIDE_ROLES
                own = max(own, {"main": MAIN, "article": ARTICLE}.get(value, 0))
            elif name == "itemprop" and value.strip().lower() == "articlebody":
                own = ARTICLE
            elif name in ("class", "id") and tag not in ("html", "body"):
                words = {w.lower() for w in _CLASS_WORD.findall(value)}
                known = ASIDE_WORDS if level else ASIDE_WORDS | PAGE_ONLY_WORDS
                whole = not known.isdisjoint(value.lower().split()) or not OTHERS_WORDS.isdisjoint(words)
                words_aside |= not known.isdisjoint(value.lower().split()) if own else whole
                words_part |= not known.isdisjoint(words)
                if name == "class":
                    label = "." + value.strip()
            elif name == "style" and re.search(r"display\s*:\s*none", value):
                aside = True
    if level and tag in HEADINGS:
        words_aside = words_part = False
    part = words_part and not words_aside and not own
    return aside or words_aside or part, part and not aside, own, label


_ROOT = Element("", "", False, 0, False)


def read(html: str) -> Iterator[Event]:
    """Events of a page in order. Comments, scripts, styles and their like give none."""
    stack = [_ROOT]
    at = 0
    for m in _MARKUP.finditer(html):
        if m.start() > at:
            yield Event("", html[at : m.start()], stack[-1], False)
        at = m.end()
        if m["raw"]:
            continue
        closing, tag, attributes = (m["close"], m["tag"], m["attributes"]) if m["tag"] else (m["close2"], m["tag2"], m["attributes2"])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    yield Event(f"</{tag}>", None, stack[k], tag in BLOCK)
                    del stack[k:]
                    break
            continue
        shut = CLOSES.get(tag, ()) + (("p",) if tag in CLOSES_P else ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in shut:
                del stack[k:]
                break
            if stack[k].tag in ("ul", "ol", "table", "dl", "article", "div", "section", "body"):
                break
        up = stack[-1]
        aside, doubt, level, label = _role(tag, attributes, up.level)
        held = up.aside and not (up.doubt and level == ARTICLE)
        own = Element(
            tag,
            f"{up.path}/{tag}{label}",
            held or aside,
            max(up.level, level),
            up.link or tag == "a",
            up.heading or tag in HEADINGS,
            (held or aside) and (up.doubt or not held) and (doubt or not aside),
        )
        yield Event(f"<{tag}>", None, own, tag in BLOCK)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(own)
    if at < len(html):
        yield Event("", html[at:], stack[-1], False)
