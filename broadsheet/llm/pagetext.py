"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines at block-level tags, furniture and article alike. Within a host, pages are ordered by
URL path, each is paired with the neighbour whose path shares the longer prefix, the lines of the two are aligned by
longest common subsequence, and the shared lines are deleted as template. A neighbour whose lines are all shared, or
that shares all the page's, is a copy and decides nothing; the next one does.

Differencing alone cannot give the right text: menus, adverts and footers that vary from page to page are shared with no
neighbour, and a paragraph that two articles of a host carry is. So the markup decides what differencing leaves: lines
in elements that name themselves furniture (menus, headers, footers, sidebars, forms, scripts, and those whose class
or id says advert, cookie notice, comments and the like; inside an article only those that say nothing else) are deleted too; lines in an article or main element stay
even where they are shared, and are the whole text where there are any; and a page whose other lines would all be
deleted as shared keeps them.

Pages are ordered by a distributed sort of (host, path), not grouped by host, so a host with a third of all
pages is spread over many tasks; only the hashes of lines travel to be aligned.

Defined results: null html counts as empty and gives an empty text; a null or unparsable url is a host of its own name
with an empty path; pages that repeat a page_id and html get the same text; an unclosed element ends with its
parent or the page; a tag or reference cut off at the end is text if it cannot be read; an empty table gives an
empty result; extra columns pass through, but one named like the result's is replaced.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.scratch import in_order, materialize, quoted, unused

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAME = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose content is no text, furniture elements, elements that hold the article, void elements.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button select fieldset head".split())
ARTICLE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A new element of the key closes an open one of the value.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id or role names that mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices gdpr popup modal nav navigation navbar "
    "menu breadcrumb breadcrumbs sidebar footer masthead share sharing social related recommended comment comments respond reply replies disqus newsletter "
    "subscribe subscription signup login search widget contentinfo complementary".split()
)
#: Words that mark furniture only outside an article.
OUTER_MARKS = frozenset("header topbar toolbar copyright logo brand login byline".split())
DROPPED, OPEN, KEPT = 0, 1, 2


#: Words that say nothing of what an element is.
NEUTRAL = frozenset(
    "area articles bar block bottom box button buttons container content form inner item items left links list posts right section slot stories top "
    "unit widget wrapper".split()
)


@lru_cache(maxsize=20_000)
def _marked(attributes: str, inside: bool) -> bool:
    """Outside an article any word that marks furniture decides; inside, all words must, so that ``search-result`` stays."""
    names = (a or b or c for a, b, c in _NAME.findall(attributes))
    words = {word for name in names for word in re.split(r"[^a-z]+", name.lower()) if word}
    return bool(words & MARKS) and words <= MARKS | NEUTRAL if inside else not words.isdisjoint(MARKS | OUTER_MARKS)


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(state, text) of each text line of ``page``, in page order: DROPPED (furniture), OPEN or KEPT (in an article)."""
    stack: list[tuple[str, int]] = []  # open elements and the state inside each
    blocks: list[tuple[int, str]] = []
    pieces: list[str] = []
    state, at = OPEN, 0

    def close_block() -> None:
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                blocks.append((state, text))
            pieces.clear()

    def leave(name: str) -> None:
        nonlocal state
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                del stack[k:]
                state = stack[-1][1] if stack else OPEN
                return

    while True:
        m = _TAG.search(page, at)
        pieces.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            close_block()
        elif name == "br":
            pieces.append(" ")
        if m[1]:
            leave(name)
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        for other in CLOSES.get(name, ()):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ("ul", "ol", "table", "div", "article", "section", "body"):
                    break
                if stack[k][0] == other:
                    leave(other)
                    break
        inside = state
        if state != DROPPED and (name in FURNITURE and not (state == KEPT and name == "header") or m[3] and name not in ("body", "html") and _marked(m[3], state == KEPT)):
            inside = DROPPED
        elif name in ARTICLE and state != DROPPED:
            inside = KEPT
        stack.append((name, inside))
        state = inside
    close_block()
    return blocks


def main_lines(blocks: list[tuple[int, str]], shared: set[int]) -> list[str]:
    """The lines of ``blocks`` that are the main text, given the places of those that a neighbour shares."""
    kept = [text for state, text in blocks if state == KEPT]
    if kept:
        return kept
    left = [text for at, (state, text) in enumerate(blocks) if state == OPEN and at not in shared]
    return left or [text for state, text in blocks if state == OPEN]


#: Lines times lines that are aligned by one table.
_TABLE = 4_096


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lengths of the longest common subsequences of ``a`` with each prefix of ``b``, in one row."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)), out=row[1:])
    return row


def _aligned(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` on a longest common subsequence with ``b``, by one table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below, x = table[i], table[i + 1], a[i]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else max(below[j], row[j + 1])
    i = j = 0
    found = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            found.append(i)
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Places in ``own`` on a longest common subsequence with ``other``, in memory linear in the two.

    Common ends and lines that one side lacks are set aside; what is left is halved where the lengths of both halves'
    subsequences add up to the most, until a small table will do.
    """
    low = 0
    while low < min(len(own), len(other)) and own[low] == other[low]:
        low += 1
    high = 0
    while high < min(len(own), len(other)) - low and own[-1 - high] == other[-1 - high]:
        high += 1
    a, b = own[low : len(own) - high], other[low : len(other) - high]
    common = set(a) & set(b)
    places = [i for i, x in enumerate(a) if x in common]
    number = {x: n for n, x in enumerate(sorted(common))}
    a, b = (np.array([number[x] for x in side if x in common], np.int32) for side in (a, b))
    found, waiting = [], [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        if (a1 - a0) * (b1 - b0) <= _TABLE or a1 - a0 == 1:
            found += [low + places[a0 + i] for i in _aligned(a[a0:a1].tolist(), b[b0:b1].tolist())]
            continue
        middle = (a0 + a1) // 2
        cut = b0 + int(np.argmax(_lengths(a[a0:middle], b[b0:b1]) + _lengths(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]))
        waiting += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
    return [*range(low), *sorted(found), *range(len(own) - high, len(own))]


def _page_lines(batches):
    for batch in batches:
        pages = batch.column(2)
        lines = [[xxhash.xxh64_intdigest(t) - (1 << 63) for _, t in page_blocks(p.as_py() or "")] for p in pages]
        names = ["_id", "_url", "_html_hash", "_lines"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(lines, pa.list_(pa.int64()))], names=names)


def template_lines(pages: DataFrame) -> DataFrame:
    """(_id, _html_hash, _shared array<int>): which lines of a page its nearest neighbour shares, where any."""
    found = pages.select(F.col("page_id").cast("long"), "url", "html", F.xxhash64("html")).mapInArrow(
        _page_lines, "_id long, _url string, _html_hash long, _lines array<long>"
    )
    url = F.coalesce("_url", F.lit(""))
    found = found.withColumn("_host", F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit("")))
    found = found.withColumn("_path", F.regexp_replace(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*", ""))
    # Copies of a page under one URL are one page here: a copy shares every line and tells nothing.
    found = materialize(found.withColumn("_key", F.xxhash64("_lines")), "lines")
    pages_once = found.groupBy("_host", "_path", "_key").agg(F.min("_lines").alias("_lines"))
    placed = in_order(pages_once, "_host", "_path", "_key", name="pages")
    near = F.struct("_host", "_path", "_lines")
    by_row = Window.partitionBy("_part").orderBy("_row")
    edges = placed.groupBy("_part").agg(F.min_by(near, "_row").alias("_head"), F.max_by(near, "_row").alias("_tail"))
    over_parts = Window.orderBy("_part")  # as many rows as the sort has partitions
    edges = edges.select("_part", F.lag("_tail").over(over_parts).alias("_edge_before"), F.lead("_head").over(over_parts).alias("_edge_after"))
    beside = placed.withColumn("_left", F.lag(near).over(by_row)).withColumn("_right", F.lead(near).over(by_row)).join(edges, "_part")
    beside = beside.select("_host", "_path", "_key", "_lines", F.coalesce("_left", "_edge_before").alias("_l"), F.coalesce("_right", "_edge_after").alias("_r"))

    schema = pa.schema([("_host", pa.string()), ("_path", pa.string()), ("_key", pa.int64()), ("_shared", pa.list_(pa.int32()))])

    def align(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pair = [n for n in (row["_l"], row["_r"]) if n is not None and n["_host"] == row["_host"]]
                shared = []
                for near in sorted(pair, key=lambda n: -len(commonprefix([n["_path"], row["_path"]]))):
                    shared = shared_lines(row["_lines"], near["_lines"])
                    if len(shared) < min(len(row["_lines"]), len(near["_lines"])):
                        break
                    shared = []  # one holds all of the other: it is the same text, not a template
                if shared:
                    out.append({"_host": row["_host"], "_path": row["_path"], "_key": row["_key"], "_shared": shared})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    aligned = beside.mapInArrow(align, "_host string, _path string, _key long, _shared array<int>")
    named = found.join(aligned, ["_host", "_path", "_key"])
    return named.groupBy("_id", "_html_hash").agg(F.min("_shared").alias("_shared"))


def extract_text(pages: DataFrame, text: str = "_text") -> DataFrame:
    """``pages`` (page_id, url, html, ...) with ``text``: the article's lines joined by an empty line."""
    key, own_id, own_hash, shared = unused([*pages.columns, text], "_html_key", "_id", "_html_hash", "_shared")
    found = materialize(template_lines(pages), "template").toDF(own_id, own_hash, shared)
    keyed = pages.drop(quoted(text)).withColumn(key, F.xxhash64("html"))
    same_page = keyed["page_id"].cast("long").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_hash))

    @F.arrow_udf("string")
    def text_of(htmls: pa.Array, lists: pa.Array) -> pa.Array:
        pairs = zip(htmls, lists, strict=True)
        return pa.array(["\n\n".join(main_lines(page_blocks(page.as_py() or ""), set(gone.as_py() or ()))) for page, gone in pairs], pa.string())

    joined = keyed.join(found, same_page, "left")
    kept = [F.col(quoted(c)) for c in pages.columns if c != text]
    return joined.select(*kept, text_of(F.col("html"), F.col(shared)).alias(text))
