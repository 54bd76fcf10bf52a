"""Main text of web pages by differencing with the page of the nearest URL.

A page becomes text lines, one for each block; scripts, styles and the like have none.
Pages are sorted by host and path, each is paired with the nearest page before or
behind it that isn't a copy, the one whose path shares the longer prefix; the lines of both
are aligned by longest common subsequence, and shared lines are deleted. Of lines that
are prose inside an ``article`` or ``main`` element shared ones stay: two articles may well quote
the same passage; of theirs only link lists go. What then is left beside the text, as adverts
and notices of one page only, goes by its markup: navigation, asides, forms, and blocks
whose class, id or role says so.
"""

from __future__ import annotations

import html
import math
import os.path
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import block_count, common_positions, materialize

#: Elements without lines, whatever is in them.
SILENT = frozenset("head script style noscript template iframe svg math canvas object select button textarea".split())
#: Elements beside the main text; of the second kind one that was never closed ends at an ``article`` or ``main``.
BESIDES, OPENING = frozenset("footer aside form dialog".split()), frozenset("nav menu header".split())
#: Ranges of sorted pages at most, so that the list of their bounds stays small at any size.
RANGES = 1 << 16
#: Elements that break no line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that, as a whole class, id or role, mark a block beside the main text.
_WORDS = (
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|masthead|menu|nav\w*|newsletter|"
    r"notices?|popup|promo\w*|related|repl(?:y|ies)|responses?|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)"
)
#: Words that may stand beside them in a compound such as site-footer or related_posts (fixed list).
_PLACES = (
    r"(?:site|page|main|top|bottom|left|right|global|primary|secondary|header|mobile|post|entry|article|blog|bar|box|list|links?|area|"
    r"container|wrapper|wrap|section|block|slot|unit|buttons?|icons?|posts?|articles?|stories|items?|form|body|widgets?|[0-9]+)"
)
BESIDE = re.compile(_WORDS, re.IGNORECASE)
COMPOUND = re.compile(rf"(?:{_PLACES}[_-]+)*{_WORDS}(?:[_-]+(?:{_WORDS}|{_PLACES}))*", re.IGNORECASE)
#: Quotes count behind an equals sign only; what isn't closed runs to the end, so that no page is read twice.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+(?:\"(?:[^\"]*+\"|[^>]*+)|'(?:[^']*+'|[^>]*+))?+|[^=>])*+)(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


def _beside(attributes: str) -> int:
    """2 where a whole class, id or role names a block beside the main text, 1 where only a compound does, else 0."""
    names = [name for found in _NAMES.findall(attributes) for name in "".join(found).split()]
    return 2 if any(map(BESIDE.fullmatch, names)) else int(any(map(COMPOUND.fullmatch, names)))


#: A line, whether it lies in an article or main element, whether most of it is link text, and whether its markup puts it beside the text.
Line = tuple[str, bool, bool, bool]
#: How an element's markup counts: as nothing, as beside unless an article or main is in it, as beside, as silent.
PLAIN, DOUBTFUL, ASIDE, MUTE = range(4)


def text_lines(page: str) -> list[Line]:
    """The lines of a page."""
    lines: list[Line] = []
    now: list[str] = []
    linked, in_link = 0, False
    depth: dict[str, int] = {}  # open elements by name
    stack: list[tuple[str, int, bool]] = []  # element, how it counts, own

    def state() -> tuple[int, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (PLAIN, False)

    def end_line() -> None:
        nonlocal linked
        if now:
            if line := " ".join(html.unescape("".join(now)).split()):
                zone, own = state()
                lines.append((line, own, 2 * linked >= sum(map(len, now)), zone > PLAIN))
            now.clear()
        linked = 0

    def leave() -> str:
        name = stack.pop()[0]
        depth[name] -= 1
        return name

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at and state()[0] < MUTE:
            now.append(page[at : m.start()])
            linked += in_link * (m.start() - at)
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            in_link = not m.group(2) if name == "a" else in_link
            continue
        end_line()
        zone, own = state()
        if name in VOID or m.group(4).endswith("/"):
            continue
        if m.group(2):
            if depth.get(name):
                while leave() != name:
                    pass
            continue
        if stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
            leave()
            zone, own = state()
        if name in ("article", "main"):
            if zone == DOUBTFUL:
                zone = PLAIN
            if name == "article" and m.group(4) and _beside(m.group(4)):
                zone = max(zone, ASIDE)
            own = True
        elif name in SILENT:
            zone = MUTE
        elif name in BESIDES:
            zone = max(zone, ASIDE)
        elif name in OPENING and (name != "header" or not own):
            zone = max(zone, ASIDE if own else DOUBTFUL)
        elif name not in ("html", "body", "p") and m.group(4):
            zone = max(zone, _beside(m.group(4)))
        stack.append((name, zone, own))
        depth[name] = depth.get(name, 0) + 1
    if at < len(page) and state()[0] < MUTE:
        now.append(page[at:])
    end_line()
    return lines


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of both."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    found = {*range(low), *range(len(a) - high, len(a))}
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    common = set(a) & set(b)
    places = [i for i, line in enumerate(a) if line in common]
    codes = {line: i for i, line in enumerate(common)}
    x, y = np.array([codes[a[i]] for i in places], int), np.array([codes[line] for line in b if line in common], int)
    return found | {low + places[i] for i, _ in common_positions(x, y)}


def main_text(lines: list[Line], neighbour: list[Line] | None) -> tuple[str, int]:
    """A page's text without the lines that it shares with its neighbour and those beside the text, and how many the first are."""
    shared = shared_lines([line for line, *_ in lines], [line for line, *_ in neighbour]) if neighbour else set()
    gone = {i for i in shared if not lines[i][1] or lines[i][2]}
    return " ".join(line for i, (line, _, _, beside) in enumerate(lines) if i not in gone and not beside), len(gone)


def extract_main_text(pages: DataFrame, partition_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text, n_chars (code points) and n_shared of every row of ``pages(page_id, url, html)``.

    Null or empty html gives an empty text. A null url counts as one of an empty host
    and path. n_shared counts the lines that differencing deleted. Pages are dealt by ranges of sorted URLs, each with the
    nearest other page before and behind it, so that the dealing changes no result. A
    page that is alone of its host, or all of whose neighbours are copies of it, is not compared.
    Columns beyond the three are ignored.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()
    read = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    address = F.coalesce(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?", ""), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[^/?#:]*", 0))
    path = F.regexp_extract(address, r"^[^/?#]*([^#]*)", 1)
    order = ["host", "path", "page_id", "draw"]  # draw orders different pages of one URL and id
    placed = read.withColumns({"host": host, "path": path, "draw": F.xxhash64("html")})
    key = F.struct(*order)
    blocks = min(block_count(read, "html", partition_bytes), RANGES)
    sorted_keys = placed.select(*order).repartitionByRange(blocks, *order).sortWithinPartitions(*order)

    def edged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = second = other = None  # the last two: the first that differs from the first, the last that differs from the last
        for frame in frames:
            for row in frame.itertuples(index=False):
                if first is None:
                    first = row
                if second is None and row.draw != first.draw:
                    second = row
                if last is not None and row.draw != last.draw:
                    other = last
                last = row
        if first is not None:
            kinds = {"first": first, "second": second, "other": other, "last": last}
            yield pd.DataFrame([(kind, *row) for kind, row in kinds.items() if row is not None], columns=["kind", *order])

    schema = f"kind string, host string, path string, page_id {id_type}, draw long"
    edges = materialize(sorted_keys.mapInPandas(edged, schema).select(F.spark_partition_id().alias("range"), "kind", key.alias("key")), "edges")
    ends = edges.where("kind = 'first'").select(F.col("key").alias("first"))
    # a page's range is the number of first keys up to its own, looked up in two steps
    count = max(1, ends.count())
    step = math.isqrt(count - 1) + 1
    firsts = ends.agg(F.array_sort(F.collect_list("first")).alias("firsts")).withColumn("every", F.expr(f"filter(firsts, (k, i) -> i % {step} = 0)"))
    looked = placed.withColumn("key", key).join(F.broadcast(firsts))
    looked = looked.withColumn("skipped", F.expr(f"(size(filter(every, k -> k <= key)) - 1) * {step}"))
    looked = looked.withColumn("range", F.expr(f"skipped + size(filter(slice(firsts, skipped + 1, {step}), k -> k <= key)) - 1"))
    columns = ["range", "page_id", "url", "html", *order[:2], "draw"]
    # at most RANGES ranges: in their order, the page before the run of copies that a range begins with, and the one behind its last run
    onward, back = (Window.partitionBy(F.lit(0)).orderBy(o) for o in ("key", F.desc("key")))
    number = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("range")) - 1

    def beyond(way: Window) -> Column:
        """The last row of another page that stands before a row's run of copies."""
        changed = F.lag("key.draw").over(way).isNull() | (F.lag("key.draw").over(way) != F.col("key.draw"))
        return F.when(changed, F.struct(F.lag("key").over(way).alias("key")))

    lent_keys = edges.withColumns({"range": number, "before": beyond(onward), "after": beyond(back)})
    lent_keys = lent_keys.withColumns({"before": F.last("before", ignorenulls=True).over(onward), "after": F.last("after", ignorenulls=True).over(back)})
    lent_key = F.when(F.col("kind") == "first", F.col("before.key")).when(F.col("kind") == "last", F.col("after.key"))
    beside = lent_keys.select("range", lent_key.alias("key")).where("key is not null")
    beside = beside.select("range", *[F.col(f"key.{k}").alias(f"_{k}") for k in order]).distinct()
    same = [placed[k].eqNullSafe(F.col(f"_{k}")) for k in order]
    lent = placed.join(F.broadcast(beside), same).select(*columns).dropDuplicates(["range", "draw", "host", "path", "page_id"])
    dealt = looked.select(*columns, F.lit(False).alias("lent")).unionByName(lent.withColumn("lent", F.lit(True)))
    dealt = dealt.repartitionById(count, F.col("range").cast("int"))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield row.page_id, row.url, row.host, row.path, text_lines(row.html), row.range, row.lent

    columns_out = ["page_id", "url", "text", "n_chars", "n_shared"]

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        before: tuple | None = None  # the last page that differs from the run
        run: list[tuple] = []  # pages with equal lines; of all but the first without the lines

        def finish(after: tuple | None) -> None:
            lines = run[0][4]
            sides = [p for p in (before, after) if p and p[2] == run[0][2] and p[5] == run[0][5]]
            texts: dict[int, tuple[str, int]] = {}
            for page in run:
                if not page[6]:
                    near = max(range(len(sides)), key=lambda i: len(os.path.commonprefix([sides[i][3], page[3]])), default=-1)
                    if near not in texts:
                        texts[near] = main_text(lines, sides[near][4] if sides else None)
                    text, shared = texts[near]
                    out.append((page[0], page[1], text, len(text), shared))

        for page in rows(frames):
            if run and (page[4], page[2], page[5]) == (run[0][4], run[0][2], run[0][5]):
                run.append((*page[:4], None, *page[5:]))
                continue
            if run:
                finish(page)
                before = run[0]
            run = [page]
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=columns_out)
                out.clear()
        if run:
            finish(None)
        if out:
            yield pd.DataFrame(out, columns=columns_out)

    ordered = dealt.sortWithinPartitions("range", *order)
    return ordered.mapInPandas(extract, f"page_id {id_type}, url string, text string, n_chars long, n_shared long")
