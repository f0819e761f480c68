"""Main text of web pages: differencing against the nearest URL, confirmed by markup.

Every page is compared with the page of its host whose path is nearest: their lines are
aligned by longest common subsequence, and lines that both have go. Markup confirms or
vetoes: lines inside an article or main element stay although another page shares them
(articles share licence lines and greetings), those inside navigation, footers, forms and
the like never count (menus differ from page to page). Of all other lines, beside a
content element or on a page without one, differencing decides.
"""

from __future__ import annotations

import html
import os.path
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._common import BROADCAST_IDS, materialize, slices

#: Pages with lines in one range of URLs; bits of a table of two pages' lines (8 MB).
PAGES_PER_RANGE, TABLE_BITS = 20_000, 1 << 26

RAW = "script|style|noscript|template|textarea|title|iframe|svg|select|option|object|canvas|audio|video|xmp"
_TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</\1\s*+>|.*\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:\s[^>\"']*+|\"[^\"]*+\"|'[^']*+'|[^>\"'\s])*+)>|<[!?/][^>]*+>|<(/?)([a-z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.I | re.S,
)
_XMP = re.compile(r"\A<[^>]*>|</xmp\s*>\Z", re.I)
_LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAMES = re.compile(r"[^\s\"']+").findall
_PARTS = re.compile(r"[a-z]+").findall

CONTENT = frozenset({"article", "main"})
ASIDE = frozenset({"nav", "footer", "aside", "form", "dialog", "menu", "head", "button", "label", "fieldset"})
#: Words of a class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer cookie cookies consent notice notices notification alert popup modal overlay comment comments reply replies disqus share sharing "
    "social related recommended newsletter subscribe subscription signup login search pagination widget toolbar masthead topbar".split()
)
#: Words that say nothing beside a mark. A name with any other word is not a mark: ad-hoc,
#: has-sidebar, comments-open and search-results are about the article.
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons col column container content div element footer fixed form global group header holder icons inner item items "
    "js left link links list main outer page panel primary region right secondary section site slot sticky top ul unit wrap wrapper".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not part words: everything else ends a block.
INLINE = frozenset(
    "a abbr acronym math mi mn mo ms mtext mrow msub msup mfrac msqrt b bdi bdo big br cite code data del dfn em font i img ins kbd mark meta link nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split()
)
#: An end tag of anything else does not reach beyond the nearest of these.
SECTIONS = frozenset("html body article main section div nav header footer aside form dialog menu table ul ol dl blockquote figure fieldset td th".split())


def _marked(attributes: str) -> bool:
    """Whether a class, id or role is made of marks and neutral words only."""
    for value in _LABEL.findall(attributes):
        for name in _NAMES(value.lower()):
            parts = _PARTS(name)
            if not MARKS.isdisjoint(parts) and all(x in MARKS or x in NEUTRAL for x in parts):
                return True
    return False


def blocks(page: str) -> tuple[list[str], list[str], bool]:
    """(content lines, undecided lines, whether there is a content element)."""
    lines, seen = marked_lines(page)
    return [x for x, inside in lines if inside], [x for x, inside in lines if not inside], seen


def marked_lines(page: str) -> tuple[list[tuple[str, bool]], bool]:
    """(lines in order, each with whether it is inside a content element; whether there is
    such an element)."""
    lines: list[tuple[str, bool]] = []
    stack: list[tuple[str, int]] = []  # name, and the role inside: 0 undecided, 1 content, 2 aside
    role, seen, here, at = 0, False, [], 0

    def flush():
        if here:
            if role != 2 and (line := " ".join(html.unescape("".join(here)).split())):
                lines.append((line, role == 1))
            here.clear()

    for m in _TOKEN.finditer(page):
        a, b = m.span()
        if a > at and role != 2:
            here.append(page[at:a])
        at = b
        name = m.group(3) or m.group(6)
        if name is None:
            if (m.group(1) or "").lower() == "xmp" and role != 2:  # its text is not markup
                flush()
                here.append(html.escape(_XMP.sub("", m.group(0))))
                flush()
            continue
        name = name.lower()
        if m.group(2) or m.group(5):
            if name not in INLINE:
                flush()
            deep = name in SECTIONS
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in INLINE or len(stack) - k < 64:
                        flushed = stack[k - 1][1] if k else 0
                        if flushed != role:
                            flush()
                        del stack[k:]
                        role = flushed
                    break
                if not deep and stack[k][0] in SECTIONS:
                    break
            continue
        if name == "br":
            here.append(" ")
            continue
        inside = role
        if role != 2:
            attrs = m.group(4) or m.group(7) or ""
            if name in ASIDE or (name == "header" and role != 1):
                inside = 2
            elif attrs and name not in ("body", "html") and _marked(attrs):
                inside = 2
            elif name in CONTENT:
                inside, seen = 1, True
        if name not in INLINE or inside != role:
            flush()
        if name not in VOID:
            stack.append((name, inside))
            role = inside
    if at < len(page) and role != 2:
        here.append(page[at:])
    flush()
    return lines, seen


def _growth(a: list, b: list) -> Iterator[int]:
    """For each beginning of ``a`` a bit for each line of ``b``: a zero says that the longest
    common subsequence grows there."""
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    v = full = (1 << len(b)) - 1
    for line in a:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """How long the longest common subsequence of ``a`` with each beginning of ``b`` is."""
    v = (1 << len(b)) - 1
    for v in _growth(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared_lines(a: list, b: list) -> set[int]:
    """Positions in ``a`` of one longest common subsequence. Pages whose table would take
    more than TABLE_BITS are halved first, at a line where the halves' lengths add up."""
    common = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in common]
    a, b = [a[i] for i in at], [x for x in b if x in common]
    if len(a) * len(b) <= TABLE_BITS or len(a) < 2:
        return {at[i] for i in _traced(a, b)}
    half = len(a) // 2
    cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    return {at[i] for i in shared_lines(a[:half], b[:cut])} | {at[half + i] for i in shared_lines(a[half:], b[cut:])}


def _traced(a: list, b: list) -> set[int]:
    rows = list(_growth(a, b))
    out, i, j = set(), len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.add(i)
            i, j = i - 1, j - 1
    return out


def lost_lines(lines: list, content: str, other: list) -> list[int]:
    """Positions of the lines that the nearest page shares and that are not ("1" in
    ``content``) inside a content element; none if no line would be left."""
    gone = [i for i in sorted(shared_lines(lines, other)) if content[i] != "1"]
    return gone if len(gone) < len(lines) else []


def _nearest(this: dict, before: dict | None, after: dict | None) -> dict | None:
    """Of the pages next to it in the order of paths on its host, the one whose path
    agrees with its own for longer; the one before, if both do alike."""
    near = [x for x in (before, after) if x and (x["bucket"], x["host"]) == (this["bucket"], this["host"])]
    return max(near, key=lambda x: len(os.path.commonprefix((x["path"], this["path"]))), default=None)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from its whole html.

    Blocks are trimmed, white space in them is one space, and they are joined by a line
    break. Null or empty html: empty text. A null url stands alone; a page alone on its
    host loses nothing. Repeated rows are each extracted, and a page all of whose lines
    would go keeps them (a copy of another page is still an article). Of neighbours whose
    paths agree alike the one before is the nearest. Lines are compared by 64 bits of their
    hash; very long pages are read and aligned whole, in memory linear in their lines.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    bare = F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    pages = pages.select("page_id", "url", F.lower(F.regexp_extract(bare, r"^[^/?#]*", 0)).alias("host"), F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1).alias("path"), "html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [marked_lines(h)[0] for h in batch.column(4).to_pylist()]
            texts = pa.array(["\n".join(x for x, _ in f) for f in found], pa.string())
            hashes = pa.array([[xxhash.xxh64_intdigest(x) - 2**63 for x, _ in f] for f in found], pa.list_(pa.int64()))
            content = pa.array(["".join("1" if inside else "0" for _, inside in f) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], texts, hashes, content], ["page_id", "url", "host", "path", "joined", "lines", "content"])

    parsed = pages.mapInArrow(parse, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, path string, joined string, lines array<long>, content string")
    parsed = materialize(parsed.withColumn("row", F.monotonically_increasing_id()), "parsed")
    gone = F.broadcast(lost) if (lost := materialize(_lost(parsed), "lost")).count() <= BROADCAST_IDS else lost
    left = F.array_join(F.filter(F.split("joined", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = parsed.select("row", "page_id", "url", "joined").join(gone, "row", "left")
    out = out.select("page_id", "url", F.when(F.col("gone").isNull(), F.col("joined")).otherwise(left).alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def _lost(parsed: DataFrame) -> DataFrame:
    """(row, gone): positions of the lines that a page loses, of pages that lose any."""
    # ranges of URLs, so that a host with many pages is shared out; each range also gets
    # the last page of the range before and the first of the one after
    order = ["host", "path", "page_id", "same"]
    lined = parsed.where("content <> ''").select("host", "path", "page_id", F.xxhash64("joined").alias("same"), "row", "lines", "content", F.lit(False).alias("extra"))
    n = lined.count()
    ranged = materialize(lined.repartitionByRange(max(1, -(-n // PAGES_PER_RANGE)), *order).withColumn("bucket", F.spark_partition_id()), "ranged")
    used = sorted(r.bucket for r in ranged.select("bucket").distinct().toLocalIterator())
    following = dict(zip(used, used[1:]))
    ends = ranged.groupBy("bucket").agg(*[f(F.struct(*ranged.columns), F.struct(*order)).alias(k) for k, f in (("first", F.min_by), ("last", F.max_by))])
    links = ranged.sparkSession.createDataFrame(list(following.items()), "one int, two int")
    nexts = ends.join(links, F.col("bucket") == F.col("one")).select(F.col("last.*"), F.col("two").alias("to"))
    backs = ends.join(links, F.col("bucket") == F.col("two")).select(F.col("first.*"), F.col("one").alias("to"))
    more = nexts.unionByName(backs).drop("bucket").withColumnRenamed("to", "bucket").withColumn("extra", F.lit(True))
    alike = ranged.unionByName(more).repartition("bucket").sortWithinPartitions("bucket", *order)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.list_(pa.int32()))], ["row", "gone"])
            done.clear()
            return made

        before = this = None
        for after in chain((row for b in batches for row in b.to_pylist()), (None,)):
            if this is not None and not this["extra"] and (gone := _differed(this, before, after)):
                done.append((this["row"], gone))
                if len(done) >= 10_000:
                    yield batch()
            before, this = this, after
        if done:
            yield batch()

    return alike.mapInArrow(differ, "row long, gone array<int>")


def _differed(this: dict, before: dict | None, after: dict | None) -> list[int]:
    if this["host"] is None or "0" not in this["content"] or not (other := _nearest(this, before, after)):
        return []
    return lost_lines(this["lines"], this["content"], other["lines"])
