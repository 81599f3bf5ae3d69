"""Main text of web pages by differencing each page against its nearest neighbours by URL.

A page is cut into text lines (its blocks), each in one of three zones: the article (inside
article or main), furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments), or open. Pages are sorted by host and URL path; each is aligned with the page before
and the page after it in its host by the longest common subsequence of lines. Lines shared with
a neighbour are template text and are deleted.

A shared line inside the article element is restored unless every neighbour of the page shares
it and none of them is a copy: an article may be published under several paths, and a quoted line
is no template. Two pages are copies if a longest common subsequence of their article lines holds
at least half of the characters of either article. Furniture is always deleted. Where a page has
an article element, open lines outside it are furniture as well.

Pages are ordered by host, path and a hash of the row. The neighbours of a page are the last page
of the path before its own and the first page of the path after it. Bounds drawn from a sample of
that order cut it into ranges, so a host or a path with a large part of the pages is spread over
tasks. What a range needs of the ranges beside it, at most three pages for each bound, is shown to
it as well: where the bounds fall changes no result. Repeated lines match by occurrence, so
alignment takes n log n steps.

Defined cases: null html is an empty page; a null or odd URL has the empty host and itself as
path. Repeated rows are separate pages; equal paths are never aligned with each other. Empty
text is "". Unclosed elements end with the page, or with the article they stand in.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import tempfile
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

ARTICLE, OPEN, FURNITURE = 0, 1, 2
#: Sampled places in the order of pages, per range.
SAMPLED = 60

_MARKUP = re.compile(
    r"<!--.*?(?:-->|(?P<cut1>$))"
    r"|<!\[CDATA\[.*?(?:\]\]>|(?P<cut2>$))"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object|select)\b[^>]*+>(?:(?<=/>)|.*?(?:</(?P=raw)\s*>|(?P<cut3>$)))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPACES = re.compile(r"\s+")
# Elements, and words in a class, id or role, that mark furniture.
_FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog button label fieldset".split())
_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar menu nav navbar navigation navigate header footer banner "
    "cookie cookies consent notice notices comment comments comments-area reader-comments disqus reply replies share sharing social related "
    "recommended newsletter subscribe signup popup modal breadcrumb breadcrumbs pagination pager search login toolbar skip masthead complementary contentinfo".split()
)
_NOT_FURNITURE = frozenset("with has no without is".split())  # before a furniture word: the element is beside it
_ARTICLE_TAGS = frozenset({"article", "main"})
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)


def _furniture_name(word: str) -> bool:
    """Whether a class, id or role is a furniture word or a compound of one, such as 'site-header',
    but not 'with-sidebar'."""
    parts = re.split("[-_]", word)
    return word in _FURNITURE_WORDS or parts[0] not in _NOT_FURNITURE and not _FURNITURE_WORDS.isdisjoint(parts)


def _is_furniture(name: str, rest: str, in_article: bool) -> bool:
    """By the element's tag, or, for block elements, by its names. The body and the article itself are
    never furniture; an article within an article is, if its names say so (reader comments)."""
    if name in _FURNITURE_TAGS:
        return not (in_article and name in ("header", "label"))
    if name not in _BLOCKS or name in ("html", "body") or name in _ARTICLE_TAGS and not in_article or "=" not in (rest or ""):
        return False
    return any(_furniture_name(word) for value in _NAMED.findall(rest) for word in value.strip("\"'").lower().split())


def lines(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order, white space collapsed, empty ones left out.

    If all article elements of a page lie inside furniture that goes by its names, that furniture holds
    the article: an article then ends it.
    """
    out = _zoned(page, False)
    if any(zone == ARTICLE for zone, _ in out) or not re.search("<(?:article|main)\\b", page, re.I):
        return out
    inner = _zoned(page, True)
    return inner if any(zone == ARTICLE for zone, _ in inner) else out


def _zoned(page: str, articles_end_furniture: bool) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    words: list[str] = []
    articles = 0
    hidden, depth = "", 0  # the furniture element that is open, and how often its name is

    def end_block() -> None:
        if words:
            text = _SPACES.sub(" ", entities.unescape("".join(words))).strip()
            if text:
                out.append((FURNITURE if hidden else ARTICLE if articles else OPEN, text))
            words.clear()

    at = 0
    # No markup is complete beyond the last '>': without this bound, each '<' there is a scan to the end.
    for found in _MARKUP.finditer(page, 0, page.rfind(">") + 1):
        if found.start() > at:
            words.append(page[at : found.start()])
        at = found.end()
        if found["cut1"] is not None or found["cut2"] is not None or found["cut3"] is not None:
            at = len(page)  # never closed
        name = found["name"]
        if not name:
            continue
        name, closing = name.lower(), bool(found["close"])
        if name == "br":
            words.append(" ")
        if name in _BLOCKS or (hidden and name == hidden):
            end_block()
        if name in _VOID:
            continue
        if hidden:
            if name == hidden:
                depth += -1 if closing else 1
                if depth <= 0:
                    end_block()
                    hidden = ""
            elif name in _ARTICLE_TAGS and closing and articles:
                hidden, articles = "", articles - 1
            elif name in _ARTICLE_TAGS and not closing and articles_end_furniture and hidden not in _FURNITURE_TAGS:
                end_block()
                hidden, articles = "", articles + 1
            continue
        if not closing:
            if _is_furniture(name, found["rest"], articles > 0):
                end_block()
                hidden, depth = name, 1
            elif name in _ARTICLE_TAGS:
                articles += 1
        elif name in _ARTICLE_TAGS and articles:
            articles -= 1
    words.append(page[at:])
    end_block()
    return out


def shared_lines(own: list[str], other: list[str]) -> set[int]:
    """Places in ``own`` of a longest common subsequence with ``other``; the n-th occurrence of a
    line matches the n-th occurrence."""
    where: dict[tuple[str, int], int] = {}
    seen: dict[str, int] = {}
    for i, line in enumerate(other):
        seen[line] = n = seen.get(line, 0) + 1
        where[line, n] = i
    seen.clear()
    ends: list[int] = []
    places: list[int] = []
    before: dict[int, int] = {}
    for i, line in enumerate(own):
        seen[line] = n = seen.get(line, 0) + 1
        j = where.get((line, n))
        if j is None:
            continue
        k = bisect_left(ends, j)
        if k == len(ends):
            ends.append(j)
            places.append(i)
        else:
            ends[k], places[k] = j, i
        before[i] = places[k - 1] if k else -1
    found: set[int] = set()
    i = places[-1] if places else -1
    while i >= 0:
        found.add(i)
        i = before[i]
    return found


def _copies(own: list[str], other: list[str]) -> bool:
    """Whether two articles share lines with at least half of the characters of either."""
    shared = sum(len(own[i]) for i in shared_lines(own, other))
    return bool(own and other) and 2 * shared >= min(sum(map(len, own)), sum(map(len, other)))


def main_text(zones: list[int], texts: list[str], neighbours: list[tuple[list[int], list[str]]]) -> str:
    """Blocks that stay, joined by two line ends. Neighbours are (zones, texts)."""
    shared = [shared_lines(texts, other) for _, other in neighbours]
    if ARTICLE not in zones:
        gone = set().union(*shared)
        return "\n\n".join(t for i, (z, t) in enumerate(zip(zones, texts, strict=True)) if z == OPEN and i not in gone)
    gone = set.intersection(*shared) if shared else set()
    if any(zones[i] == ARTICLE for i in gone):
        own, *others = ([t for z, t in zip(*page, strict=True) if z == ARTICLE] for page in [(zones, texts), *neighbours])
        if any(_copies(own, other) for other in others):
            gone = set()
    return "\n\n".join(t for i, (z, t) in enumerate(zip(zones, texts, strict=True)) if z == ARTICLE and i not in gone)


def _bounds(sample: list[tuple], n: int) -> list[tuple]:
    """Lower bounds of the ranges after the first, from sampled places in the order."""
    places = sorted(set(sample))
    return sorted({places[i * len(places) // n] for i in range(1, n)}) if places else []


def _edges(keys: list[tuple[str, str]]):
    """First and last places of each interval between keys that bound ranges; ``inner`` ones leave
    out the key itself."""

    def scan(batches):
        low: dict[tuple[int, bool], tuple] = {}
        high: dict[int, tuple] = {}
        for batch in batches:
            for place in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "salt")), strict=True):
                at = bisect_right(keys, place[:2])
                high[at] = max(high.get(at, place), place)
                kind = at, not (at and keys[at - 1] == place[:2])
                low[kind] = min(low.get(kind, place), place)
        found = [(at, inner, *place) for (at, inner), place in low.items()] + [(at, None, *place) for at, place in high.items()]
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["at", "inner", "host", "path", "salt"])

    return scan


def _shown(places: DataFrame, bounds: list[tuple]) -> dict[tuple, list[int]]:
    """Places of the pages that are shown to ranges beside their own, with these ranges."""
    keys = sorted({bound[:2] for bound in bounds})
    place = F.struct("host", "path", "salt")
    ends = places.mapInArrow(_edges(keys), "at int, inner boolean, host string, path string, salt long")
    ends = ends.groupBy("at", "inner").agg(F.min(place).alias("low"), F.max(place).alias("high")).collect()
    last = {r["at"]: tuple(r["high"]) for r in ends if r["inner"] is None}
    own = {r["at"]: tuple(r["low"]) for r in ends if r["inner"] is False}
    inner = {r["at"]: tuple(r["low"]) for r in ends if r["inner"]}
    shown: dict[tuple, set[int]] = {}
    for i, bound in enumerate(bounds, 1):  # between the ranges i - 1 and i
        at = bisect_right(keys, bound[:2])
        beside = [(last.get(at - 1), i), (own[at], i - 1), (inner.get(at, own.get(at + 1)), i - 1)]
        for page, group in beside:
            if page is not None and bisect_right(bounds, page) != group:
                shown.setdefault(page, set()).add(group)
    return {page: sorted(groups) for page, groups in shown.items()}


_CUT = ("host", "path", "salt", "page_id", "url", "zones", "texts", "range", "shown")


def _cut(bounds: list[tuple], shown: dict[tuple, list[int]]):
    def scan(batches):
        given: set[tuple] = set()  # copies of repeated rows are shown once
        for batch in batches:
            pages = [lines(x.as_py() or "") for x in batch.column("html")]
            places = list(zip(*(batch.column(c).to_pylist() for c in ("host", "path", "salt")), strict=True))
            rows = list(range(len(places)))
            groups, copies = [bisect_right(bounds, p) for p in places], [False] * len(places)
            for i, place in enumerate(places):
                if place in given:
                    continue
                if place in shown:
                    given.add(place)
                for group in shown.get(place, ()):
                    rows.append(i)
                    groups.append(group)
                    copies.append(True)
            cut = [
                *(batch.column(c) for c in _CUT[:5]),
                pa.array([[z for z, _ in p] for p in pages], pa.list_(pa.int8())),
                pa.array([[t for _, t in p] for p in pages], pa.list_(pa.string())),
            ]
            cut = [column.take(pa.array(rows, pa.int64())) for column in cut]
            yield pa.RecordBatch.from_arrays([*cut, pa.array(groups, pa.int32()), pa.array(copies, pa.bool_())], list(_CUT))

    return scan


def _rows(batch) -> Iterator[dict]:
    columns = [batch.column(c) for c in _CUT]
    for i in range(batch.num_rows):
        yield {n: c[i].as_py() for n, c in zip(_CUT, columns, strict=True)}


def _difference(batches):
    """Pages of ranges in order. Held are the last page of the path before, and in a spool, which
    goes to disk when it grows, the pages of one path that wait for the path after it."""
    out: list[tuple] = []
    schema = key = last = before = None
    count = 0

    def flush():
        columns = list(zip(*out, strict=True)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_pydict(dict(zip(schema.names, columns, strict=True)), schema=schema)

    def settled(after):
        near = [page[1] for page in (before, after) if page is not None and page[0][:2] == key[:2]]
        waiting.seek(0)
        for _ in range(count):
            page_id, url, zones, texts = pickle.load(waiting)
            text = main_text(zones, texts, near)
            out.append((page_id, url, text, len(text)))
            if len(out) >= 512:
                yield flush()
        waiting.seek(0)
        waiting.truncate()

    with tempfile.SpooledTemporaryFile(max_size=1 << 24) as waiting:
        for batch in batches:
            if schema is None:
                fields = [batch.schema.field("page_id"), batch.schema.field("url"), pa.field("text", pa.string()), pa.field("n_chars", pa.int64())]
                schema = pa.schema(fields)
            for page in _rows(batch):
                own = page["range"], page["host"], page["path"]
                now = own, (page["zones"], page["texts"])
                if own != key:
                    if key is not None:
                        yield from settled(now)
                    key, before, count = own, last, 0
                last = now
                if not page["shown"]:
                    pickle.dump((page["page_id"], page["url"], *now[1]), waiting)
                    count += 1
        if schema is not None:
            yield from settled(None)
            yield flush()


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    ship(spark)
    url = F.coalesce("url", F.lit(""))
    parts = pages.select(
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "").alias("path"),
        F.xxhash64("page_id", "url", "html").alias("salt"),
        "page_id",
        "url",
        "html",
    )
    places = parts.select("host", "path", "salt")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = SAMPLED * n / max(1, pages.count())
    bounds = _bounds([tuple(r) for r in (places.sample(share, 1) if share < 1 else places).collect()], n)
    page_type = pages.schema["page_id"].dataType.simpleString()
    cut = parts.mapInArrow(
        _cut(bounds, _shown(places, bounds)),
        f"host string, path string, salt long, page_id {page_type}, url string, zones array<tinyint>, texts array<string>, range int, shown boolean",
    )
    ordered = cut.repartitionById(n, "range").sortWithinPartitions("range", "host", "path", "salt")
    return ordered.mapInArrow(_difference, f"page_id {page_type}, url string, text string, n_chars long")
