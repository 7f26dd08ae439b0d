"""Main text of web pages: lines of text blocks, compared with the page of the nearest URL on the same host."""

from __future__ import annotations

import bisect
import html as entities
import os
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import bounded_batches

#: Pages of one range of URLs, and the most ranges. Both bear on speed alone: pages at the ends of a range are told to both.
PER_RANGE, MOST_RANGES, SEEN = 500, 32_768, 10
#: A line of so many words is prose; a page that shares so much of its prose with another is a copy of it.
PROSE_WORDS, COPY = 12, 0.75
#: A line outside an article whose letters are links to this share is a menu.
LINKED = 0.8
#: Bits of one comparison held at once; longer pages are halved first.
BITS = 200_000_000

COMMENT = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
TAG = r"""<(/?)([A-Za-z][^\s/>]*+)((?:"[^"<]*+"|'[^'<]*+'|[^>"'<]++)*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>"""
CUT_TAG = re.compile(r"</?[A-Za-z]")
TOKEN = re.compile(f"{COMMENT}|{TAG}", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
MARKS = frozenset(("class", "id", "role", "itemprop", "hidden", "style", "aria-hidden"))
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, or no text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption summary address".split())
#: Elements that hold no main text, wherever they stand.
CHROME = frozenset("nav aside footer form menu button select fieldset dialog noscript template svg canvas object audio video map datalist applet head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class names and ids that say the same; the second set does so outside an article alone.
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification notifications alert disclaimer newsletter subscribe subscription signup login signin popup modal overlay "
    "menu menus nav navbar navigation navi breadcrumb breadcrumbs sidebar sidebars widget widgets related recommended recommendations recirculation share sharing sharer social comment comments commentlist respond reply replies disqus footer pagination pager paywall toolbar skip discussion rail aside toc cta outbrain taboola".split()
)
OUTER_NAMES = frozenset("header masthead topbar search tags tagcloud copyright legal colophon logo".split())
#: With one of these a name tells of a page's layout instead.
LAYOUT_NAMES = frozenset("layout has with without no page".split())
BODY_NAMES = frozenset(("articlebody", "article-body", "article_body", "article-content", "article-text", "post-content", "post-body", "entry-content", "story-body"))
IN_BODY, BURIED, IN_MAIN, PLAIN, OUT = range(5)


def _named(marks: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """Whether an element's attributes say that it is no main text, and whether they say that it is the article."""
    if "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" or HIDDEN_STYLE.search(marks.get("style", "")):
        return True, False
    if marks.get("role", "").lower() in ROLES:
        return True, False
    names = f"{marks.get('class', '')} {marks.get('id', '')}".split()
    body = marks.get("itemprop", "").lower() == "articlebody" or any(n.lower() in BODY_NAMES for n in names)
    for name in names:
        parts = {p.lower() for p in NAME_PARTS.findall(name)}
        if not parts & LAYOUT_NAMES and (parts & CHROME_NAMES or (not inside and parts & OUTER_NAMES)):
            return True, False
    return False, body


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, zone, prose, menu) of a page's text blocks, in page order: without markup, with white space as one space.

    Character references are read after the markup. A page may be cut off anywhere, and elements may stay open: blocks end
    an open paragraph, an end tag closes what it finds open and is ignored if there is none.
    """
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, int]] = []  # (tag, what it is: 1 chrome by its tag, 2 chrome by its name, 4 body, 8 main, 16 prose, 32 link)
    count = [0] * 6
    opened: dict[str, int] = {}
    words: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal words, linked
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                by_tag, by_name, body, main, prose, _ = count
                zone = OUT if by_tag or (by_name and not body) else IN_BODY if body and not by_name else BURIED if body else IN_MAIN if main else PLAIN
                out.append((text, zone, prose > 0, linked >= LINKED * len("".join(words))))
            words, linked = [], 0

    def shift(kind: int, by: int) -> None:
        for i in range(6):
            if kind >> i & 1:
                count[i] += by

    def close(i: int) -> None:
        for tag, kind in stack[i:]:
            opened[tag] -= 1
            if kind:
                shift(kind, -1)
        del stack[i:]

    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            words.append(page[at : m.start()])
            if count[5]:
                linked += m.start() - at
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag = name.lower()
        inline = tag in INLINE
        if not inline:
            flush()
        if m[1] or m[4]:
            if opened.get(tag, 0):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                if inline:
                    opened[tag] -= 1
                    shift(stack[i][1], -1)
                    del stack[i]
                else:
                    close(i)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*+>?", re.I).search(page, at)
            if end or tag in ("script", "style"):
                at = end.end() if end else len(page)
            continue
        if not inline:
            # a block ends an open paragraph and unmarked inline elements in it
            i = len(stack)
            while i and stack[i - 1][0] in INLINE and not stack[i - 1][1] & ~32:
                i -= 1
            if i and stack[i - 1][0] == "p":
                close(i - 1)
        attributes = m[3] or m[6] or ""
        marks = {n: v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes) if (n := k.lower()) in MARKS} if attributes.strip() else {}
        inside = count[2] > 0
        kind = 16 * (tag in PROSE) + 32 * (tag == "a")
        chrome, body = _named(marks, inside or tag in ("article", "main")) if marks and tag not in ("html", "body") else (False, False)
        if tag in CHROME or (tag == "header" and not inside):
            kind |= 1
        elif chrome:
            kind |= 1 if inside or tag == "article" else 2
        if tag == "article" or body:
            kind |= 4
        if tag == "main" or marks.get("role", "").lower() == "main" or marks.get("id", "").lower() in ("main", "content", "main-content"):
            kind |= 8
        if not attributes.endswith("/") or tag not in ("path", "rect", "circle", "use", "g"):
            stack.append((tag, kind))
            opened[tag] = opened.get(tag, 0) + 1
            if kind:
                shift(kind, 1)
    if at < len(page):
        # a tag that the end cuts off is none, and no text
        words.append(CUT_TAG.split(page[at:], maxsplit=1)[0])
    flush()
    return out


def chosen(lines: list[tuple[str, int, bool, bool]]) -> list[bool]:
    """Which lines may be main text, by markup alone: those of the article if there is one, else of the main part, else all."""
    size = [0] * 5
    for text, zone, _, menu in lines:
        size[zone] += len(text) * (zone < IN_MAIN or not menu)
    zone = IN_BODY if size[IN_BODY] else IN_MAIN if size[IN_MAIN] else BURIED if size[BURIED] > size[PLAIN] else PLAIN
    return [z == zone and (zone < IN_MAIN or not menu) for _, z, _, menu in lines]


def _rows(masks: dict, b: list, full: int) -> list[int]:
    rows, v = [], full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _masks(a: list) -> dict:
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def common(a: list, b: list, bits: int = BITS) -> list[int]:
    """Places in a of a longest common subsequence with b, ascending. Memory is bound by ``bits``, whatever their lengths."""
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < end - lo and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    known = set(b[lo : len(b) - tail])
    places = [i for i in range(lo, len(a) - tail) if a[i] in known]
    mine = [a[i] for i in places]
    known = set(mine)
    other = [y for y in b[lo : len(b) - tail] if y in known]
    return [*range(lo), *(places[i] for i in _common(mine, other, bits)), *range(len(a) - tail, len(a))]


def _common(a: list, b: list, bits: int) -> list[int]:
    if not a or not b:
        return []
    full = (1 << len(a)) - 1
    if len(a) * len(b) > bits and len(b) > 1:
        half = len(b) // 2

        def lengths(x: list, y: list) -> list[int]:
            v = full
            masks = _masks(x)
            for c in y:
                u = v & masks.get(c, 0)
                v = ((v + u) | (v - u)) & full
            out = [0]
            for bit in reversed(f"{v:0{len(x)}b}"):
                out.append(out[-1] + (bit == "0"))
            return out

        front, back = lengths(a, b[:half]), lengths(a[::-1], b[half:][::-1])
        cut = max(range(len(a) + 1), key=lambda i: front[i] + back[len(a) - i])
        return _common(a[:cut], b[:half], bits) + [cut + i for i in _common(a[cut:], b[half:], bits)]
    rows = _rows(_masks(a), b, full)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                out.append(i)
    return out[::-1]


class Page:
    """What a comparison needs of a page: hashes of its lines; of those that may be main text also text, prose, and doubt."""

    __slots__ = ("host", "path", "hashes", "texts", "take", "sure", "long")

    def __init__(self, key: str, hashes: list[int], texts: list[str], take: list[bool], sure: list[bool]):
        self.host, self.path = key.split("\0", 2)[:2]
        self.hashes, self.texts, self.take, self.sure = hashes, texts, take, sure
        self.long = [t and x.count(" ") + 1 >= PROSE_WORDS for t, x in zip(take, texts, strict=True)] if texts else []

    def without(self, other: Page) -> list[bool] | None:
        """The lines that stay when those shared with the other page go; None if the other is a copy and says nothing."""
        shared = set(common(self.hashes, other.hashes))
        mine = [i for i, t in enumerate(self.take) if t]
        prose = [i for i in mine if self.long[i]]
        if prose:
            copied = sum(len(self.texts[i]) for i in prose if i in shared) >= COPY * sum(len(self.texts[i]) for i in prose)
        else:
            copied = all(i in shared for i in mine)
        return None if copied else [t and (s or i not in shared) for i, (t, s) in enumerate(zip(self.take, self.sure, strict=True))]


def main_text(page: Page, before: Page | None, after: Page | None) -> tuple[str, int]:
    """The main text, and how many lines went since the page of the nearest URL has them too (the earlier one on ties)."""
    kept = page.take
    if any(t and not s for t, s in zip(page.take, page.sure, strict=True)):
        near = [x for x in (before, after) if x is not None and x.host == page.host]
        near.sort(key=lambda x: -len(os.path.commonprefix([x.path, page.path])))
        kept = next((k for x in near if (k := page.without(x)) is not None), page.take)
    return " ".join(t for t, k in zip(page.texts, kept, strict=True) if k), sum(page.take) - sum(kept)


def url_key(url: Column, page_id: Column) -> Column:
    """Host (lower case, without user and port), path and the rest, so that URLs near each other are sorted together."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(u, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    clean = lambda c: F.translate(c, "\0", " ")
    return F.concat_ws("\0", clean(host), clean(path), clean(u), F.coalesce(page_id.cast("string"), F.lit("")))


def _in_range(splits: list[str]):
    def run(batches):
        for batch in batches:
            keys = batch.column("key")
            yield pa.RecordBatch.from_arrays([pa.array([bisect.bisect_right(splits, k) for k in keys.to_pylist()], pa.int32()), keys], names=["part", "key"])

    return run


FIELDS = "part int, key string, told boolean, id long, url string, hashes array<long>, texts array<string>, take array<boolean>, sure array<boolean>"


def _parsed(splits, tell: dict[str, list[int]]):
    """Pages as lines, in the range of their key; those at the end of a range are told to the next one too, by hashes alone."""

    def run(batches):
        for batch in batches:
            out = []
            for key, i, url, page in zip(*[batch.column(c).to_pylist() for c in ("key", "id", "url", "html")], strict=True):
                lines = lines_of(page or "")
                take = chosen(lines)
                hashes = [xxhash.xxh64_intdigest(t) - (1 << 63) for t, *_ in lines]
                texts = [t if k else "" for (t, *_), k in zip(lines, take, strict=True)]
                sure = [zone < IN_MAIN and prose for _, zone, prose, _ in lines]
                out.append((bisect.bisect_right(splits, key), key, False, i, url, hashes, texts, take, sure))
                out += [(p, key, True, None, None, hashes, [], [], []) for p in tell.get(key, ())]
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in FIELDS.split(", ")])

    return run


def _compared(batches):
    """Pages in the order of their keys, range by range, each with the one before and the one after it in hand."""
    before = now = None

    def done(after):
        if now is None or now[2]:
            return []
        part, page = now[0], now[5]
        text, gone = main_text(page, before[5] if before and before[0] == part else None, after[5] if after and after[0] == part else None)
        return [(now[3], now[4], text, len(text), gone)]

    def rows(out):
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["id", "url", "text", "n_chars", "n_shared"])

    names = [f.split()[0] for f in FIELDS.split(", ")]
    for batch in batches:
        out = []
        for part, key, told, i, url, hashes, texts, take, sure in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            row = (part, key, told, i, url, Page(key, hashes, texts, take, sure))
            out += done(row)
            before, now = now, row
        yield rows(out)
    yield rows(done(None))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_range: int = PER_RANGE) -> DataFrame:
    """(id, url, text, n_chars, n_shared) of every page: its main text, and how many lines a neighbour's page took from it.

    Pages of a host are paired by URL path: in the order of host, path, URL and id, a page's partner is the one before or
    after it, whichever path begins with more of its own; the other, if that one is a copy (it shares three quarters of the prose).
    The lines of both are aligned by a longest common subsequence, and shared lines go, but for prose inside an article:
    markup proves that to be main text even where a page was copied. What markup proves not to be main text goes in any
    case. A page alone on its host, or between copies, is judged by markup alone.

    Null and empty pages have empty text; a null URL is a host of its own; rows that repeat are each reported; ids may be
    null; an empty table gives no rows; other columns may have any name and play no part. A task reads one range of URLs
    in order and holds two pages; a host of any size is many ranges, and which lines go doesn't depend on them.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(url_key(F.col(url_col), F.col(id_col)).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    keys = rows.select("key")
    n = keys.count()
    ranges = max(1, min(MOST_RANGES, n // per_range))
    splits: list[str] = []
    if ranges > 1:
        share = min(1.0, ranges * SEEN / n)
        seen = sorted(r[0] for r in keys.where(F.shiftrightunsigned(F.xxhash64("key"), 32) <= int(share * 0xFFFFFFFF)).collect())
        splits = sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []
    ends = sorted(tuple(r) for r in keys.mapInArrow(_in_range(splits), "part int, key string").groupBy("part").agg(F.min("key"), F.max("key")).collect()) if splits else []
    tell: dict[str, list[int]] = {}
    for (p, _, last), (q, first, _) in zip(ends, ends[1:], strict=False):
        if last.split("\0", 1)[0] == first.split("\0", 1)[0]:
            tell.setdefault(last, []).append(q)
            tell.setdefault(first, []).append(p)
    parsed = rows.mapInArrow(_parsed(splits, tell), FIELDS)
    dealt = parsed.repartitionById(len(splits) + 1, "part").sortWithinPartitions("part", "key", F.xxhash64("hashes"))
    return dealt.mapInArrow(_compared, "id long, url string, text string, n_chars long, n_shared long")


def extract_report(pages: DataFrame) -> DataFrame:
    """The digest of op13: page_id, url, text, n_chars, n_shared."""
    return extract_text(pages.select("page_id", "url", "html")).withColumnRenamed("id", "page_id")
