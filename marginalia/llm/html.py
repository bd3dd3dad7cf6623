"""HTML extraction: structure first, then differencing against the nearest URLs.

A page becomes text lines, one per block, each marked as boilerplate by structure
(menus, headers, forms, ...), as part of an ``article`` or ``main`` element, or open.
Pages of a host are sorted by URL path and each one is paired with its neighbours on
both sides; their lines are aligned by longest common subsequence and shared lines
are deleted.  Lines inside ``article`` or ``main`` are the page's own by its markup
and stay even if a neighbour repeats them.  Where such elements hold text, an open
line outside them stays only if a neighbour was compared and lacks it; else the open
lines are the text.  A neighbour that shares more than half of the page's text
(boilerplate by structure aside) is a copy and deletes nothing.

Pairing is exact at any size: each of the sort's ranges reports its first and last
key (as many rows as there are shuffle partitions), pages are dealt to ranges with
these keys, and a page at an edge is also shown to the range beside it.  A hot host
is many ranges.

Defined results.  Null html and pages without text give the empty text; a null URL
has an empty host and path; null ids sort first; equal rows repeat.  Extra columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import urls

# Elements without text of the page, elements of its frame, elements that end a line, void elements.
SILENT = "script style noscript template iframe object svg math canvas audio video head title textarea select datalist".split()
FRAME = "nav header footer aside form dialog menu button fieldset".split()
BLOCKS = ("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
          "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul").split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
ROLES = "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
HINTS = ("ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
         "gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promotion "
         "recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget").split()
_SILENT, _FRAME, _BLOCKS, _VOID, _ROLES, _HINTS = map(frozenset, (SILENT, FRAME, BLOCKS, VOID, ROLES, HINTS))
# An open element of the first kind ends where one of the second starts, unless one of the third lies between.
_CLOSES = {"p": (_BLOCKS, frozenset()), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "td": ({"td", "th", "tr"}, {"table"}), "th": ({"td", "th", "tr"}, {"table"}), "tr": ({"tr", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_WORD = re.compile(r"[a-z0-9]+")

OPEN, OWN, BOILERPLATE = "N", "P", "S"


def _is_frame(tag: str, attributes: str) -> bool:
    if tag in _FRAME:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), (a or b or c).lower()
        if name in ("class", "id") and not _HINTS.isdisjoint(_WORD.findall(value)) and not (tag[0] == "h" and tag[1:].isdigit()):
            return True
        if name == "role" and value.strip() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def lines(page: str | None) -> list[tuple[str, str]]:
    """``mark, text`` of every block in page order; white space inside a block is one blank."""
    page = page or ""
    out: list[tuple[str, str]] = []
    words: list[tuple[str, str]] = []  # mark and text since the last line end
    stack: list[tuple[str, str]] = []  # open elements with the mark of their text
    mark = OPEN

    def flush() -> None:
        own = next((k for k, t in words if k != BOILERPLATE), BOILERPLATE)
        for kind in dict.fromkeys((own, BOILERPLATE)):  # an inline advert does not cut its block
            text = " ".join(entities.unescape("".join(t for k, t in words if (k == BOILERPLATE) == (kind == BOILERPLATE))).split())
            if text:
                out.append((kind, text))
        words.clear()

    def cut(to: int) -> None:
        nonlocal mark
        if any(t in _BLOCKS for t, _ in stack[to:]):
            flush()
        del stack[to:]
        mark = stack[-1][1] if stack else OPEN

    at, end = 0, len(page)
    while at < end:
        m = _PART.match(page, at)
        if m is None:  # a tag that never ends is text up to the next one
            nxt = page.find("<", at + 1)
            nxt = end if nxt < 0 else nxt
            words.append((mark, page[at:nxt]))
            at = nxt
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                words.append((mark, m[0]))
            continue
        tag = tag.lower()
        if m[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            # An inline end tag does not reach over the block around it.
            if place >= 0 and (tag in _BLOCKS or not any(t in _BLOCKS for t, _ in stack[place:])):
                cut(place)
            elif tag in _BLOCKS:
                flush()
            continue
        if tag in _SILENT:
            if m[3].endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if close is None and tag == "head":
                close = re.compile(r"(?=<body[\s>])", re.I).search(page, at)
            at = close.end() if close else end
            continue
        for i in range(len(stack) - 1, -1, -1):
            ends, guard = _CLOSES.get(stack[i][0], ((), ()))
            if tag in ends:
                cut(i)
            elif stack[i][0] in _BLOCKS and (stack[i][0] not in _CLOSES or tag in guard):
                break
        if tag in _BLOCKS:
            flush()
        if tag == "br":
            words.append((mark, " "))
        if tag in _VOID or m[3].endswith("/"):
            continue
        if mark != BOILERPLATE and _is_frame(tag, m[3]):
            mark = BOILERPLATE
        elif tag in ("article", "main") and mark == OPEN:
            mark = OWN
        stack.append((tag, mark))
    flush()
    return out


def _lengths(x: list[str], y: list[str]) -> list[int]:
    """Length of the longest common subsequence of ``x`` and every prefix of ``y``, by bit vectors."""
    where: dict[str, int] = {}
    for i, line in enumerate(y):
        where[line] = where.get(line, 0) | (1 << i)
    full = (1 << len(y)) - 1
    v = full
    for line in x:
        if m := where.get(line, 0):
            v = ((v + (v & m)) | (v & ~m)) & full
    out = [0]
    for bit in bin((full & ~v) | (1 << len(y)))[:2:-1]:
        out.append(out[-1] + (bit == "1"))
    return out


def _subsequence(a: list[str], y: list[str]) -> list[bool]:
    """Lines of ``a`` in one longest common subsequence with ``y``: divide and conquer in linear space."""
    if not a or not y:
        return [False] * len(a)
    if len(a) == 1:
        return [a[0] in y]
    middle = len(a) // 2
    first, last = _lengths(a[:middle], y), _lengths(a[middle:][::-1], y[::-1])[::-1]
    cut = max(range(len(y) + 1), key=lambda k: first[k] + last[k])
    return _subsequence(a[:middle], y[:cut]) + _subsequence(a[middle:], y[cut:])


def shared_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of ``a`` a longest common subsequence with ``b`` holds; equal ends are set aside first."""
    most = min(len(a), len(b))
    head = next((i for i in range(most) if a[i] != b[i]), most)
    tail = next((i for i in range(most - head) if a[-1 - i] != b[-1 - i]), most - head)
    rest, other = a[head : len(a) - tail], b[head : len(b) - tail]
    # Lines that the other side lacks are in no common subsequence.
    both = set(rest) & set(other)
    flags = iter(_subsequence([x for x in rest if x in both], [x for x in other if x in both]))
    return [True] * head + [next(flags) if x in both else False for x in rest] + [True] * tail


def main_text(page: list[tuple[str, str]], neighbours: list[list[tuple[str, str]]]) -> str:
    """Text of a page after differencing with its neighbours' lines."""
    own = any(mark == OWN for mark, _ in page)
    total = sum(len(text) for mark, text in page if mark != BOILERPLATE)
    gone, differed = [False] * len(page), False
    for other in neighbours:
        shared = shared_lines([t for _, t in page], [t for _, t in other])
        if 2 * sum(len(text) for (mark, text), s in zip(page, shared, strict=True) if s and mark != BOILERPLATE) <= total:
            gone, differed = [g or s for g, s in zip(gone, shared, strict=True)], True
    # Beside an article, an open line needs a neighbour that tells it from the frame.
    return "\n".join(text for (mark, text), g in zip(page, gone, strict=True) if mark == OWN or mark == OPEN and not g and (differed or not own))


def _keyed(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(
        urls.host(url).alias("host"), urls.path(url).alias("path"), F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("id"),
        F.xxhash64("url", "html").alias("sum"), F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


KEY = ["host", "path", "id", "sum"]


def _ranges(keys: DataFrame) -> list[tuple[tuple, tuple]]:
    """First and last key of every range of the sorted pages."""

    def edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for pdf in frames:
            if len(pdf):
                first = pdf.iloc[:1] if first is None else first
                last = pdf.iloc[-1:]
        if first is not None:
            yield pd.concat([first, last])

    # A given number of ranges is kept as it is, however small the keys are.
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys.repartitionByRange(n, *KEY).sortWithinPartitions(*KEY).mapInPandas(edges, "host string, path string, id long, sum long").collect()
    found = sorted(tuple(r) for r in rows)
    return list(zip(found[::2], found[1::2], strict=True))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars``."""
    keyed = _keyed(pages)
    ranges = _ranges(keyed.select(KEY))
    firsts = [a for a, _ in ranges]
    after, before = {b: i + 1 for i, (_, b) in enumerate(ranges[:-1])}, {a: i for i, (a, _) in enumerate(ranges[1:])}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        names = ["part", "shown", *KEY, "page_id", "url", "z"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for *key, page_id, url, page in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    key = tuple(key)
                    z = pack.compress("\n".join(mark + text for mark, text in lines(page)).encode("utf-8", "surrogatepass"))
                    out.append((max(0, bisect_right(firsts, key) - 1), False, *key, page_id, url, z))
                    for beside in (after.get(key), before.get(key)):
                        if beside is not None:
                            out.append((beside, True, *key, page_id, url, z))
                kinds = [pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "part int, shown boolean, host string, path string, id long, sum long, page_id long, url string, z binary"
    dealt = keyed.mapInArrow(parse, schema).repartition(max(1, len(ranges)), "part").sortWithinPartitions("part", *KEY)

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for part, shown, host, _, _, _, page_id, url, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held = unpack.decompress(z).decode("utf-8", "surrogatepass")
                    yield (part, host), shown, page_id, url, [(x[0], x[1:]) for x in held.split("\n")] if held else []

        def made() -> Iterator[tuple]:
            previous, current = None, None
            for following in chain(rows(), [None]):
                if current is not None and not current[1]:
                    near = [x[4] for x in (previous, following) if x is not None and x[0] == current[0]]
                    text = main_text(current[4], near)
                    yield current[2], current[3], text, len(text)
                previous, current = current, following

        out, size = [], 0
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
        for row in made():
            out.append(row)
            size += len(row[2])
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "url", "text", "n_chars"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "url", "text", "n_chars"])

    return dealt.mapInArrow(difference, "page_id long, url string, text string, n_chars long")

