"""HTML extraction by differencing pages of near URLs.

Pages are dealt out and sorted by host and URL path, so that the pages nearest by path stand next to one another. Each page
is compared with its neighbours of the same host, the one whose path has the longer common start first. Pages become lists of text
lines, one a block, of all that is shown, menus and footers too; a longest common subsequence aligns two lists, and the lines that they share are template text and
go. The nearest neighbour is asked that is no copy of the page (a copy shares half of the article, or four fifths of all lines where there is none), and a copy only if there is no other.
Lines inside an article or main element are exempt: pages of a host repeat passages there, headings and closing lines among them, and copies of an article would delete each other.

Markup is the second witness: of what is left, elements that never hold main text (nav, aside, form and so on) and those named as menus, notices,
adverts or comments go whole, and where there is an article or main element, what is outside of it. Inside such an element a name that parts of articles have too (related,
discussion, share, alert: PROSE) is not enough for a block: it goes if half of its text or more are links, and else its lines go that the neighbour (no copy) shares; ids of headings say nothing there. A page without one keeps all of its lines if
differencing would delete every one.

White space inside a block (br included) becomes one space. Null html gives no text; a page alone in its host is judged by its
markup. Pages with equal URLs are neighbours. Repeated rows keep a row each; other columns are ignored; an empty table gives no rows; broken markup is read as
far as it goes (a quote opens a value only after an equals sign). Very long pages are read whole; two pages with very many equal lines are aligned in halves, in memory that grows with their lengths.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import bounded, partitions, slices, table

#: Elements whose text is not shown as text of the page.
UNSEEN = frozenset("script style noscript template head title select textarea option iframe object svg canvas video audio map".split())
#: Elements whose text is never main text.
DROPPED = frozenset("nav aside footer form button dialog menu".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag of the key ends an open element of these kinds.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    **{b: ("p",) for b in BLOCKS if b not in ("body", "html", "head", "td", "th", "tr", "li", "dt", "dd", "option", "tbody", "thead", "tfoot", "caption", "legend", "summary", "title")},
}
#: Words in class, id and role that name what isn't main text.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion menu nav navbar navigation topnav sidenav sidebar aside footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations comment comments discussion respond replies disqus pagination pager toolbar widget complementary contentinfo skip".split()
)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*"|'[^']*')|[^>])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
#: Words that make a name say something about another part (has-sidebar, comments-open).
ABOUT = frozenset("has no not with without is open opened closed on off enabled disabled".split())

#: Words before "header" that make it the site's, not the article's.
SITE = frozenset("site top global main web".split())


SHOWN, RULED_OUT, SUSPECT, HIDDEN = range(4)
#: Those of NAMES by which parts of articles are named too.
PROSE = frozenset("alert notice menu promotion share sharing social related recommended recommendations discussion consent".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def named_as(attributes: str, ids: bool = True) -> int:
    """RULED_OUT if a name of the element starts or ends with a word for what isn't main text, or it is hidden; SUSPECT if only such words do that prose has too. ids: whether the id counts."""
    out = SHOWN
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden") or name == "id" and not ids:
            continue
        if name == "hidden" or name == "aria-hidden" and "true" in value.lower():
            return RULED_OUT
        for part in value.strip("\"'").split():
            words = [w.lower() for w in WORD.findall(part)]
            said = {words[0], words[-1]} & NAMES if words else set()
            if said and ABOUT.isdisjoint((words[0], words[-1])):
                if said - PROSE:
                    return RULED_OUT
                out = SUSPECT
            if words and words[-1] == "header" and (len(words) == 1 or words[0] in SITE):
                return RULED_OUT
    return out


def is_named(attributes: str) -> bool:
    return named_as(attributes) != SHOWN


def lines_of(page: str) -> list[tuple[str, bool, int]]:
    """Blocks of a page that are shown, in order, whether each is inside an article or main element, and whether markup rules it out (SHOWN, RULED_OUT or SUSPECT)."""
    out: list[tuple[str, bool, int]] = []
    held: tuple[list[str], ...] = ([], [], [])  # of the block so far, what is shown, ruled out and suspect
    stack: list[tuple[str, int, bool]] = []  # element, how much it is shown, in main
    suspect: tuple[int, int] | None = None  # the outermost suspect element: its depth, and lines before it
    letters = [0, 0]  # of it, in all and in links
    links = 0  # open ones
    shown, main = SHOWN, False
    at = 0

    def end_block() -> None:
        for ruled_out, parts in enumerate(held):
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    out.append((text, main, ruled_out))
                parts.clear()

    def hold(text: str, how: int) -> None:
        held[how].append(text)
        if how == SUSPECT:
            n = len("".join(text.split()))
            letters[0] += n
            letters[1] += n if links else 0

    def pop_to(k: int) -> None:
        nonlocal shown, main, suspect, links
        while len(stack) > k:
            name, _, _ = stack.pop()
            if name in BLOCKS:
                end_block()
            links -= name == "a"
            if suspect and suspect[0] == len(stack):
                if 2 * letters[1] >= letters[0]:
                    out[suspect[1] :] = [(text, inside, RULED_OUT if how == SUSPECT else how) for text, inside, how in out[suspect[1] :]]
                suspect, letters[:] = None, (0, 0)
            shown, main = stack[-1][1:] if stack else (SHOWN, False)

    while m := TAG.search(page, at):
        if shown != HIDDEN and m.start() > at:
            hold(page[at : m.start()], shown)
        at = m.end()
        closing, name, attributes = m.group(1), m.group(2), m.group(3)
        if name is None:
            continue
        name = name.lower()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if stack[k][0] in ("article", "main", "td", "th", "table", "body") and name not in BLOCKS:
                    break  # a stray inline end tag stays in its container
            else:
                if name in BLOCKS:
                    end_block()
            continue
        if name == "br":
            for parts in held:
                parts.append(" ")
            continue
        for kind in CLOSES.get(name, ()):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == kind:
                    pop_to(k)
                    break
                if stack[k][0] in ("article", "main", "section", "div", "table", "ul", "ol", "dl", "body", "blockquote"):
                    break
        if name in BLOCKS:
            end_block()
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCKS:
            continue
        now = HIDDEN if shown == HIDDEN or name in UNSEEN else shown
        if now in (SHOWN, SUSPECT):
            named = named_as(attributes, not (main and name in HEADINGS)) if name not in ("html", "body", "main") else SHOWN
            if name in DROPPED or name == "header" and not main or named == RULED_OUT or named == SUSPECT and not (main and name in BLOCKS):
                now = RULED_OUT
            elif named == SUSPECT:
                now = SUSPECT
        inside = main or name in ("article", "main")
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if now != HIDDEN:
                hold(page[at : end.start() if end else len(page)], now)
            at = end.end() if end else len(page)
            continue
        if now == SUSPECT and suspect is None:
            suspect = (len(stack), len(out))
        links += name == "a"
        stack.append((name, now, inside))
        shown, main = now, inside
    if shown != HIDDEN:
        hold(page[at:], shown)
    end_block()
    pop_to(0)
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Indexes in a of a longest common subsequence with b (Hunt and Szymanski: by pairs of equal lines)."""
    begin = 0
    while begin < len(a) and begin < len(b) and a[begin] == b[begin]:
        begin += 1
    stop = 0
    while stop < len(a) - begin and stop < len(b) - begin and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    found = {*range(begin), *range(len(a) - stop, len(a))}
    where: dict[str, list[int]] = {}
    for j in range(begin, len(b) - stop):
        where.setdefault(b[j], []).append(j)
    if sum(len(where.get(line, ())) for line in a[begin : len(a) - stop]) > MOST_PAIRS:
        by_halves(a[begin : len(a) - stop], b[begin : len(b) - stop], begin, found)
        return found
    ends: list[int] = []
    links: list[tuple | None] = []
    for i in range(begin, len(a) - stop):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


#: Pairs of equal lines beyond which two pages are aligned in halves.
MOST_PAIRS = 1_000_000


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences of a and the first 0, 1, 2, ... of b, by bit-parallel rows."""
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for line in a:
        same = row & where.get(line, 0)
        row = (row + same | row - same) & every
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def by_halves(a: list[str], b: list[str], begin: int, found: set[int]) -> None:
    """Adds begin and the indexes in a of a longest common subsequence with b, in memory that grows with the lengths alone."""
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            found.add(begin)
        return
    half = len(a) // 2
    k = int((common_lengths(a[:half], b) + common_lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    by_halves(a[:half], b[:k], begin, found)
    by_halves(a[half:], b[k:], begin + half, found)


def template(lines: list[tuple[str, bool, int]], near: list[list[tuple[str, bool, int]]]) -> set[int]:
    """Indexes of the lines that differencing deletes. near: the neighbours' lines, the nearest page first."""
    texts = [line[0] for line in lines]
    inside = [i for i, line in enumerate(lines) if line[1]]
    aligned = [shared(texts, [line[0] for line in other]) for other in near]
    own = inside or range(len(lines))
    copies = [sum(i in same for i in own) >= (0.5 if inside else 0.8) * len(own) for same in aligned]
    gone: set[int] = set()
    if aligned:
        witness = copies.index(False) if False in copies else 0
        gone = {i for i in aligned[witness] if not lines[i][1] or lines[i][2] == SUSPECT and not copies[witness]}
    return gone


def main_text(lines: list[tuple[str, bool, int]], near: list[list[tuple[str, bool, int]]]) -> str:
    gone = template(lines, near)
    there = any(inside and how != RULED_OUT for _, inside, how in lines)
    kept = [i for i, (_, inside, how) in enumerate(lines) if how != RULED_OUT and (inside or not there)]
    left = [i for i in kept if i not in gone]
    return "\n".join(lines[i][0] for i in left or kept)


def split_url(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?(?://)?([^/?#]*)([^?#]*)", url or "")
    return m.group(1).rpartition("@")[2].lower(), m.group(2)


def common_start(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        k += 1
    return k


def beside_neighbours(pages: DataFrame, n: int) -> DataFrame:
    """(page_id, url, html) dealt into ranges of (host, path), sorted; the last row before each range and the first one after
    it stand at its ends, marked ghost. Cuts come from a sample of about 100 keys a range."""
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.-]*:)?(?://)?[^/?#]*([^?#]*)", 1)
    keyed = pages.withColumn("key", F.concat_ws("\x01", F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")), F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0")))
    total = pages.count()
    share = min(1.0, 100.0 * n / max(1, total))
    drawn = keyed.select("key").where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = sorted(k for (k,) in drawn.collect())  # about 100 n keys
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, k) for k in keys], dtype="int32")

    ends = {b: (low, high) for b, low, high in keyed.select("key").groupBy(place("key").alias("range")).agg(F.min("key"), F.max("key")).collect()}  # a row a range
    there = sorted(ends)
    befores = {ends[a][1]: b for a, b in zip(there, there[1:], strict=False)}
    afters = {ends[b][0]: a for a, b in zip(there, there[1:], strict=False)}

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        """The range, and those where the row is a ghost."""
        return pd.Series([[bisect_right(cuts, k), *([befores[k]] if k in befores else []), *([afters[k]] if k in afters else [])] for k in keys])

    dealt = keyed.withColumn("places", places("key")).select("*", F.posexplode("places").alias("ghost", "range"))
    dealt = dealt.select("page_id", "url", "html", "key", "range", (F.col("ghost") > 0).alias("ghost"))
    return dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", "key", "html")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in slices(batches):
            for page_id, url, text, where, ghost in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "range", "ghost")], strict=True):
                yield page_id, url, where, ghost, *split_url(url), lines_of(text or "")

    def texts() -> Iterator[tuple]:
        before = now = None
        for after in rows():
            if now and not now[3]:
                yield result(before, now, after)
            before, now = now, after
        if now and not now[3]:
            yield result(before, now, None)

    def result(before: tuple | None, now: tuple, after: tuple | None) -> tuple:
        near = [x for x in (before, after) if x and x[2] == now[2] and x[4] == now[4]]
        near.sort(key=lambda x: -common_start(x[5], now[5]))
        text = main_text(now[6], [x[6] for x in near])
        return now[0], now[1], text, len(text)

    held: list[tuple] = []

    def batch_of(part: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], ["page_id", "url", "text", "n_chars"])

    for row in texts():
        held.append(row)
        if len(held) == 1000:
            yield batch_of(held)
            held = []
    if held:
        yield batch_of(held)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    rows = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return beside_neighbours(rows, partitions(pages.sparkSession)).mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
