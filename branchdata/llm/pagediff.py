"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines (blocks of text).  The markup settles most lines:
scripts, menus, forms, notices and the like are left out, and what stands in
an article is kept, be it shared or not (articles quote and copy each other).
Lines that the markup leaves open, those of pages without an article element
and doubtful blocks inside an article, are settled by differencing: within each host the pages are put in the order
of their URL paths, each is paired with the neighbour whose path is more
alike, their lines are aligned by longest common subsequence, and shared
lines are deleted.

Marks.  A name in class, id or role marks its element if all its words are
listed (``ad``, ``cookie-notice``).  If only some are (``with-sidebar``), the
block is in doubt: inside an article it is left to differencing, elsewhere it
is like any other block.  An article or main element inside a marked block or
a form stays (in doubt), but not inside navigation, asides, footers and
comments.  What marks a header inside an article marks its title, which stays.

Copies of one page don't count as its neighbours, and a pair that shares
nearly all lines of its texts (those not left out by the markup) is two
versions of one page: nothing is deleted for it.

The order is made by range-partitioned sorting and running numbers, so a host
with a third of all pages is many pieces; only hashes of lines are shuffled
for it.  The pieces overlap by one page, so no neighbour is missed.

Defined cases: null or empty html gives an empty text; a null or odd URL has
the empty host or path; each row gives a row, repeated rows included; other
columns are ignored; whole pages are read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from os.path import commonprefix
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchdata.llm.common import stored

PIECE = 512              # pages of the order paired by one group
COPY = 0.8               # share of common lines from which two pages are versions of one

# Elements and the words in class, id and role that mark what is not main text.
LEFT_OUT = frozenset("""head title script style noscript template svg math iframe object canvas audio video nav header
footer aside form button select option textarea label fieldset dialog menu""".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small
span strike strong sub sup time tt u var wbr""".split())
WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner
nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside cookie cookies
consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social
related recommended comment comments commentlist respond disqus replies widget toolbar contentinfo complementary
dialog form""".split())
# Of these, by element or word, what holds no page's article.
HARD = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer contentinfo sidebar aside
complementary related recommended comment comments commentlist respond disqus replies""".split())

# Words that say that a token names a block of its kind ("comment-list", "newsletter-box").
BLOCKS = frozenset("""list body area thread user users section box wrapper wrap container block panel inner holder unit
item items entry""".split())
MOST = 0.8                       # of a page's text: such a wrapper is the page's layout

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)>""", re.S)
_MARK = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")


KEPT, SOFT, FIRM = range(3)      # how far an element is left out; an article inside a SOFT one stays


def _marks(attributes: str, article: bool) -> tuple[int, bool]:
    """How far class, id and role leave an element out, and if they put it in doubt."""
    out, doubt = KEPT, False
    for m in _MARK.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _WORD.findall(name)}
            known = words & WORDS - ({"header"} if article else set())
            if known and words <= known | BLOCKS:
                out = max(out, FIRM if words & HARD else SOFT)
            elif known:
                doubt = True
    return out, doubt


def lines(page: str) -> list[tuple[str, str]]:
    """(kind, text) of a page's lines: ``out`` (left out), ``main`` (in an
    article), ``doubt`` (in a doubtful block of one) or ``open``.

    Where no line is in an article, a form or marked block that holds ``MOST``
    of the page's text is the page's layout and leaves nothing out."""
    found: list[tuple[str, str, tuple[int, ...]]] = []
    parts: list[str] = []
    # open elements: name, the reasons they are left out for (their numbers), how far, in an article, in doubt
    stack: list[tuple[str, tuple[int, ...], int, bool, bool]] = []
    layouts: dict[int, int] = {}                      # reasons that may be the layout: their text so far
    reasons = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, why, _, article, doubt = stack[-1] if stack else ("", (), KEPT, False, False)
            found.append(("open" if not article else "doubt" if doubt else "main", text, why))
            for r in why:
                if r in layouts:
                    layouts[r] += len(text)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at:m.start()])
        at = m.end()
        if not m[2]:                                  # a comment or declaration
            continue
        name = m[2].lower()
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        close()
        if name in VOID:
            continue
        if m[1]:                                      # an end tag closes what it names, if open
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in RAW:                               # nothing inside is markup
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name in LEFT_OUT:
                at = end.end() if end else n
                continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == name:
            stack.pop()                               # these close their like
        _, why, out, article, doubt = stack[-1] if stack else ("", (), KEPT, False, False)
        if name in ("article", "main"):
            if not article:
                doubt = False                         # a page's layout puts no article in doubt
            if out == SOFT:
                why, out, doubt = (), KEPT, True
        title = name == "header" and article          # an article's own header holds its title
        if name in LEFT_OUT and not title:
            reasons += 1
            why, out = (*why, reasons), max(out, FIRM if name in HARD else SOFT)
            if name not in HARD:
                layouts[reasons] = 0
        if name not in ("html", "body", "main"):
            marked, doubtful = _marks(m[3], article)
            doubt = doubt or doubtful
            if marked:
                reasons += 1
                why, out = (*why, reasons), max(out, marked)
                layouts[reasons] = 0
        stack.append((name, why, out, article or name in ("article", "main"), doubt))
    close()
    layout: set[int] = set()
    if not any(kind != "open" and not why for kind, _, why in found):
        total = sum(len(text) for _, text, _ in found)
        layout = {r for r, size in layouts.items() if size >= MOST * total}
    return [("out" if any(r not in layout for r in why) else kind, text) for kind, text, why in found]


def place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path
    except ValueError:
        return "", url or ""


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of both."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    # Bit-parallel: bit j of row i is 0 where the length grows at column j.
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows = [full]
    for v in x:
        same = rows[-1] & where.get(v, 0)
        rows.append((rows[-1] + same | rows[-1] - same) & full)
    picked, j = [], len(y)
    for i in range(len(x), 0, -1):
        # Walk back: keep row i where dropping it loses a common line.
        low = (1 << j) - 1
        if (rows[i] & low).bit_count() < (rows[i - 1] & low).bit_count():
            hits = where.get(x[i - 1], 0) & low
            picked.append(head + i - 1)
            j = hits.bit_length() - 1
    return [*range(head), *reversed(picked), *range(len(a) - tail, len(a))]


def _parsed(pages: DataFrame) -> DataFrame:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()),
                        ("digest", pa.binary()), ("main", pa.string()), ("open", pa.list_(pa.string())),
                        ("open_at", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64())),
                        ("text_at", pa.list_(pa.int32()))])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for page_id, url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = lines(page or "")
                hashes = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for _, t in got]
                inside = [i for i, (kind, _) in enumerate(got) if kind in ("main", "doubt")]
                text_at = inside or [i for i, (kind, _) in enumerate(got) if kind == "open"]
                settled = all(got[i][0] == "main" for i in text_at)
                text = [got[i][1] for i in text_at]
                open_at = [-1 if got[i][0] == "main" else i for i in text_at]     # -1: stays, be it shared or not
                host, path = place(url)
                for column, v in zip(out, (
                        page_id, url, host, path, hashlib.md5(repr(hashes).encode()).digest(),
                        "\n\n".join(text) if settled else None, [] if settled else text, [] if settled else open_at,
                        hashes, text_at), strict=True):
                    column.append(v)
            yield pa.record_batch([pa.array(v, type=f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
            .mapInArrow(parsed, "page_id long, url string, host string, path string, digest binary, main string, "
                                "open array<string>, open_at array<int>, hashes array<long>, text_at array<int>"))


def page_order(parsed: DataFrame) -> DataFrame:
    """Distinct pages of each host (host, path, digest, hashes, text_at) with
    ``n``, their running number in the order of host, path and content."""
    distinct = parsed.groupBy("host", "digest").agg(F.min(F.struct("path", "hashes", "text_at")).alias("first")).select(
        "host", "first.path", "digest", "first.hashes", "first.text_at")
    ranged = stored(distinct.repartitionByRange("host", "path", "digest").sortWithinPartitions("host", "path", "digest")
                    .withColumn("row", F.monotonically_increasing_id()), "order")
    # The row number is (partition << 33) + row in it: turn it into a running number.
    sizes = ranged.groupBy(F.shiftright("row", 33).alias("part")).count().collect()     # a row per partition
    before, at = [], 0
    for part, size in sorted((r["part"], r["count"]) for r in sizes):
        before.append((part, at))
        at += size
    offsets = F.broadcast(parsed.sparkSession.createDataFrame(before, "part long, before long"))
    return (ranged.withColumn("part", F.shiftright("row", 33)).join(offsets, "part")
            .select("host", "path", "digest", "hashes", "text_at",
                    (F.col("before") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).alias("n")))


def shared_lines(parsed: DataFrame, piece: int = PIECE, copy: float = COPY) -> DataFrame:
    """(host, digest, shared): the places of each distinct page's lines that
    its nearest page has too."""
    schema = pa.schema([("host", pa.string()), ("digest", pa.binary()), ("shared", pa.list_(pa.int32()))])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []                     # up to two pages before the one now read

        def versions(own: tuple, other: tuple) -> bool:
            a, b = ([page[4][i] for i in page[6]] for page in (own, other))
            return bool(a and b) and len(shared(a, b)) >= copy * min(len(a), len(b))

        def answer(own: tuple | None, others: list[tuple | None], out: list[list]) -> None:
            """Result of ``own`` unless another piece gives it."""
            if own is None or own[5] // piece != own[0]:
                return
            near = [o for o in others if o is not None and o[1] == own[1]]
            places: list[int] = []
            if near:
                nearest = max(near, key=lambda o: len(commonprefix([o[2], own[2]])))
                if not versions(own, nearest):
                    places = shared(own[4], nearest[4])
            for column, v in zip(out, (own[1], own[3], places), strict=True):
                column.append(v)

        def rows(out: list[list]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(v, type=f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

        for b in batches:
            out: list[list] = [[], [], []]
            for page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last and last[-1][0] != page[0]:              # another piece begins
                    answer(last[-1], [last[-2] if len(last) > 1 else None], out)
                    last = []
                if last:
                    answer(last[-1], [last[-2] if len(last) > 1 else None, page], out)
                last = [*last[-1:], page]
            yield rows(out)
        out = [[], [], []]
        if last:
            answer(last[-1], [last[-2] if len(last) > 1 else None], out)
        yield rows(out)

    n = F.col("n")
    pieces = F.explode(F.array_distinct(F.array(*(F.floor((n + d) / piece) for d in (-1, 0, 1)))))
    return (page_order(parsed).withColumn("piece", pieces)
            .select("piece", "host", "path", "digest", "hashes", "n", "text_at")
            .repartition("piece").sortWithinPartitions("piece", "n")
            .mapInArrow(paired, "host string, digest binary, shared array<int>"))


def main_text(pages: DataFrame, piece: int = PIECE, copy: float = COPY) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text,
    n_chars."""
    parsed = stored(_parsed(pages), "pages")
    found = shared_lines(parsed, piece, copy).select(F.col("host").alias("h"), F.col("digest").alias("d"), "shared")
    settled = parsed.where(F.col("main").isNotNull()).select("page_id", "url", F.col("main").alias("text"))
    kept = F.expr("transform(filter(arrays_zip(open, open_at), x -> not array_contains(shared, x.open_at)), x -> x.open)")
    left = (parsed.where(F.col("main").isNull())
            .join(found, (F.col("host") == F.col("h")) & (F.col("digest") == F.col("d")))
            .select("page_id", "url", F.array_join(kept, "\n\n").alias("text")))
    return settled.unionByName(left).withColumn("n_chars", F.length("text").cast("long"))
