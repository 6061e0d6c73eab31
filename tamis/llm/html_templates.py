"""HTML extraction by template deduction over equivalence classes.

The tokens of a page are its tags and its text runs (whole runs between two tags), each told apart by its path in the
element tree. Over all pages of a host, tokens with the same occurrence vector (how often each page has them) form an
equivalence class; vectors are compared by a sum of hashes, which partial aggregation merges, so no host's pages meet
in one task. Classes of at least three tokens on at least half of the host's pages are large enough. The widest class
that each page has once is the host's backbone; a class is valid if its tokens keep one order, and nests in a backbone
slot if all its occurrences lie there. What lies between backbone tokens are slots. The runs of articles (or, for
pages without such elements, of slots with more plain than linked words) carry the main text. Template runs are left
out, in articles those that fill a whole block other than a heading, such as share lines, unless they have half of the article's words; so
is everything in menus, headers, footers, sidebars, notices, adverts, forms and comments.

Defined results: NULL and empty pages have the text "". If all runs of a page belong to the template,
as where a host has copies of one page only, they are its text. A host with fewer than three pages, or a page that lacks half
of its host's backbone, is one slot. A URL without a host belongs to the host "". Text without any tags is main text.
Repeated pages are extracted each. A page that ends within a tag or element is read as far as it goes. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import html as entities
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm import markup
from tamis.llm.common import inputs
from tamis.session import materialize

MIN_TOKENS, MIN_PAGES, MIN_SHARE = 3, 3, 0.5
BLOCK_CHARS = 4_000_000


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - 2**63


def _token(event: markup.Event) -> int | None:
    if event.text is None:
        return _hash(event.at.path, event.name)
    run = " ".join(event.text.split())
    return _hash(event.at.path, "", run) if run else None


def _pages(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, url, html (not NULL), host and a name of the page for occurrence vectors."""
    narrow = inputs(pages, key=key, url=url, html=html)
    return narrow.select(
        "key",
        "url",
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.xxhash64("key", "url", "html").alias("page"),
    )


def _vectors(pages: DataFrame) -> DataFrame:
    """(host, token, pages, vector, most, place): pages that have it, hash of its occurrence vector, most occurrences on a page, mean place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            for host, page, html in zip(*(batch.column(n) for n in ("host", "page", "html"))):
                host, page = host.as_py(), page.as_py()
                tokens = [t for t in map(_token, markup.read(html.as_py())) if t is not None]
                first = {}
                for place, t in enumerate(tokens):
                    first.setdefault(t, place)
                for t, n in Counter(tokens).items():
                    own = sums.setdefault((host, t), [0, 0, 0, 0.0])
                    own[0] += 1
                    own[1] = (own[1] + xxhash.xxh64_intdigest(f"{page} {n}")) % 2**62
                    own[2] = max(own[2], n)
                    own[3] += first[t] / len(tokens)
            columns = list(zip(*((h, t, *v) for (h, t), v in sums.items()))) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["host", "token", "pages", "part", "most", "places"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
    parts = pages.select("host", "page", "html").mapInArrow(scan, "host string, token bigint, pages bigint, part bigint, most int, places double")
    return parts.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"),
        # sums of 62 bits are taken as decimals, which cannot overflow, and folded back
        F.pmod(F.sum(F.col("part").cast("decimal(38,0)")), F.lit(2**62).cast("decimal(38,0)")).cast("bigint").alias("vector"),
        F.max("most").alias("most"),
        (F.sum("places") / F.sum("pages")).alias("place"),
    )


def _classes(pages: DataFrame) -> DataFrame:
    """Per host: backbone (tokens in order) and others (tokens of other large classes)."""
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).where(F.col("host_pages") >= MIN_PAGES)
    often = _vectors(pages).where(F.col("pages") >= MIN_PAGES).join(sizes, "host").where(F.col("pages") >= MIN_SHARE * F.col("host_pages"))
    often = materialize(often, "often")
    classes = often.groupBy("host", "pages", "vector").agg(F.count(F.lit(1)).alias("tokens"), F.max("most").alias("most")).where(F.col("tokens") >= MIN_TOKENS)
    ranked = classes.withColumn(
        "nth", F.row_number().over(Window.partitionBy("host").orderBy((F.col("most") > 1).cast("int"), F.desc("pages"), F.desc("tokens"), "vector"))
    )
    placed = often.join(ranked.select("host", "pages", "vector", "nth", F.col("most").alias("class_most")), ["host", "pages", "vector"])
    backbone = (F.col("nth") == 1) & (F.col("class_most") == 1)
    # a host's tokens on half of its pages are no more than twice a page's tokens
    return placed.groupBy("host").agg(
        F.transform(F.array_sort(F.collect_list(F.when(backbone, F.struct("place", "token")))), lambda x: x["token"]).alias("backbone"),
        F.collect_list(F.when(~backbone, F.col("token"))).alias("others"),
    )


def _slots(events: list[markup.Event], tokens: list[int | None], backbone: list[int]) -> list[int]:
    """Slot of each event: how many backbone tokens, in their order, stand before it. All 0 where the page lacks half of them."""
    order = {t: i + 1 for i, t in enumerate(backbone)}
    slot, met, out = 0, 0, []
    for t in tokens:
        place = order.get(t, 0)
        if place > slot:
            slot, met = place, met + 1
        out.append(slot)
    return out if 2 * met >= len(backbone) else [0] * len(events)


def _words(event: markup.Event) -> int:
    return len(event.text.split())


def _templates(pages: DataFrame) -> DataFrame:
    """Per host: backbone (valid tokens in order), nested (tokens of valid nested classes), plain (slots with more plain than linked words)."""
    classes = materialize(_classes(pages), "classes")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: dict[tuple[str, int], list[int]] = {}
            words: dict[tuple[str, int], list[int]] = {}
            for host, html, backbone, others in zip(*(batch.column(n) for n in ("host", "html", "backbone", "others"))):
                host, backbone = host.as_py(), backbone.as_py()
                known = {*backbone, *others.as_py()}
                events = list(markup.read(html.as_py()))
                tokens = [_token(e) for e in events]
                order = {t: i for i, t in enumerate(backbone)}
                before = 0  # backbone tokens met so far, in whatever order
                for e, t, slot in zip(events, tokens, _slots(events, tokens, backbone)):
                    if t in known:
                        span = spans.setdefault((host, t), [before, before])
                        span[0], span[1] = min(span[0], before), max(span[1], before)
                        before += t in order
                    if e.text is not None and not e.at.aside and t not in known:
                        own = words.setdefault((host, slot), [0, 0])
                        own[e.at.link] += _words(e)
            rows = [(h, 0, t, a, b) for (h, t), (a, b) in spans.items()] + [(h, 1, s, a, b) for (h, s), (a, b) in words.items()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), *[pa.int64()] * 3))], ["host", "kind", "id", "a", "b"])

    found = pages.select("host", "html").join(classes, "host").mapInArrow(scan, "host string, kind int, id bigint, a bigint, b bigint")
    merged = found.groupBy("host", "kind", "id").agg(F.min("a").alias("least"), F.max("b").alias("most"), F.sum("a").alias("plain"), F.sum("b").alias("linked"))
    facts = merged.groupBy("host").agg(
        F.collect_list(F.when((F.col("kind") == 0) & (F.col("least") == F.col("most")), F.col("id"))).alias("valid"),
        F.collect_list(F.when((F.col("kind") == 1) & (F.col("plain") > F.col("linked")), F.col("id"))).alias("plain"),
    )
    return facts.join(classes, "host").select(
        "host",
        F.filter("backbone", lambda t: F.array_contains("valid", t)).alias("backbone"),
        F.array_intersect("others", "valid").alias("nested"),
        F.when(F.size(F.array_intersect("backbone", "valid")) == F.size("backbone"), F.col("plain")).alias("plain"),
    )


def _main_text(html: str, backbone: list[int], nested: set[int], plain: set[int] | None) -> str:
    events = list(markup.read(html))
    tokens = [_token(e) for e in events] if backbone or nested else [None] * len(events)
    slots = _slots(events, tokens, backbone)
    template = {*backbone, *nested}
    data = [e.text is not None and not e.at.aside and not e.text.isspace() for e in events]
    level = max((e.at.level for e, d in zip(events, data) if d), default=0)
    # what stands beside the only article of a page in the same main element, such as its title, belongs to it
    single = level == markup.ARTICLE and sum(e.name == "<article>" and not e.at.aside for e in events) == 1
    levels = (markup.MAIN, level) if single else (level,)
    # articles rank first, whatever slot they lie in; pages without them have their plain slots
    inside = plain if not level and any(slots) else None
    framed = _frame(events, tokens, template, levels) if level else template
    found = ""
    # where all pages of a host are alike, nothing but template remains; then the page's own data are its text
    for strict in (True, False):
        out = []
        for i, (e, t, s) in enumerate(zip(events, tokens, slots)):
            if e.text is None:
                if e.block:
                    out.append(" ")
            elif e.at.aside or e.at.level not in levels:
                continue
            elif e.text.isspace():
                out.append(e.text)
            elif not strict or ((inside is None or s in inside) and (i if level else t) not in framed):
                out.append(entities.unescape(e.text))
        found = " ".join("".join(out).split())
        if found:
            break
    return found


def _frame(events: list[markup.Event], tokens: list[int | None], template: set[int], levels: tuple[int, ...]) -> set[int]:
    """Places of an article's template runs: those of blocks that hold nothing else, as a repeated run within a sentence is its part.

    None if they have half of the article's words or more; then the pages are copies of an article rather than framed.
    """
    blocks: list[list[int]] = [[]]
    for i, e in enumerate(events):
        if e.text is None:
            if e.block and e.name not in ("<br>", "</br>"):
                blocks.append([])
        elif not e.at.aside and e.at.level in levels and not e.text.isspace():
            blocks[-1].append(i)
    framed = [i for own in blocks if all(tokens[i] in template and not events[i].at.heading for i in own) for i in own]
    if 2 * sum(_words(events[i]) for i in framed) >= sum(_words(events[i]) for own in blocks for i in own):
        return set()
    return set(framed)


def main_texts(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text."""
    work = _pages(pages, key, url, html)
    templates = materialize(_templates(work), "templates")
    kinds = dict(work.dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, host, mine = [], None, ([], set(), None)
            for own, page, backbone, nested, plain in zip(*(batch.column(n) for n in ("host", "html", "backbone", "nested", "plain"))):
                if own.as_py() != host:
                    host = own.as_py()
                    mine = (backbone.as_py() or [], set(nested.as_py() or []), None if plain.as_py() is None else set(plain.as_py()))
                texts.append(_main_text(page.as_py(), *mine))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["key", "url", "text"])

    joined = work.drop("page").join(templates, "host", "left").select("key", "url", "html", "host", "backbone", "nested", "plain")
    return joined.mapInArrow(scan, f"key {kinds['key']}, url {kinds['url']}, text string")
