"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines, one for each block, with the kind of place they stand in.  Lines in
places that HTML names as no part of an article go.  The others are aligned, by longest common
subsequences, with those of the pages nearest by URL path on the same host whose text differs, and
with those of a few pages from anywhere on the host.  What differing pages share is template text
and goes; what a copy of the page shares says nothing about the template.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm.registry import register
from signalbox.llm.storage import stored, with_next

# Element names of HTML
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
APART = {"nav", "footer", "aside", "form", "menu", "head", "select", "button", "dialog", "svg", "object", "canvas"}
CORE = {"article", "main"}
# Words in class, id or role that name a place outside the article
PLACES = (
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup "
    "modal overlay sidebar aside widget menu nav navbar navigation navigations breadcrumb breadcrumbs pagination footer masthead header comment "
    "comments respond disqus replies share sharing social related recommended newsletter subscribe signup login search complementary contentinfo"
).split()
# Words that may stand beside them in one name, as in site-footer or ad-slot-2; with any other one, as in has-sidebar
# or comments-open, the name tells of a state or of something else
BESIDE = (
    "site page post entry article blog main top bottom left right side upper lower primary secondary global local inner outer container wrapper "
    "wrap block box list section area bar slot unit panel row col column group item items link links button buttons btn icon icons text message "
    "form field title heading content body posts articles stories news js the"
).split()
HEADERS = {"header", "masthead"}
_PLACE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|<[/!?a-zA-Z][^>]*\Z""", re.S)
_SPLIT = re.compile(r"[^a-z0-9]+")
_PLACES, _BESIDE = frozenset(PLACES), frozenset(BESIDE)
OUTSIDE, APART_KIND, INSIDE, MAIN = 0, 1, 2, 3
COPY = 0.5
"""A page that shares this much of the text that not all compared pages share is a copy, and no evidence of a template."""
MOST = 0.5
"""A place told by its name is none if it holds more than this share of the page's text."""
CELLS = 4_000_000
FAR, DRAWN = 3, 256
"""Pages compared from anywhere on the host, and the hash groups they are drawn from."""


def _named_apart(name: str, attributes: str, core: bool) -> bool:
    """Whether a class, id or role is the name of a place; headers inside an article are part of it."""
    if not attributes or "=" not in attributes or name in ("body", "html", "main"):
        return False
    for m in _PLACE.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in _SPLIT.split(token) if w and not w.isdigit()]
            named = [w for w in words if w in _PLACES and not (core and w in HEADERS)]
            if named and all(w in _PLACES or w in _BESIDE for w in words):
                return True
    return False


def page_lines(page: str) -> tuple[list[str], list[int]]:
    """Lines of a page with their kinds: apart from the text by their place, inside the main element, inside an article, or outside.

    Text of inline elements that are apart, as buttons in a paragraph, is left out of its line.  An element that only its name
    sets apart is not if it holds an article, the main element or most of the page's text, unless there is an article or main element outside of such places.  Unclosed
    elements end with the element around them; an unclosed one without end ends with the page.
    """
    lines, kinds, parts = [], [], []
    # open elements that count: name, and whether it is apart (1), an article (2), main (3), apart by name (4) or apart inline (5)
    stack: list[tuple[str, int]] = []
    apart = core = main = muted = 0
    # places by name: those that are open, the numbers of them around each line, their sizes, and those that hold a core
    named: list[int] = []
    around: list[tuple[int, ...]] = []
    sizes: list[int] = []
    holding: set[int] = set()
    at = 0

    def end_line() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append(text)
                kinds.append(APART_KIND if apart else MAIN if main else INSIDE if core else OUTSIDE)
                around.append(tuple(named))
                for place in named:
                    sizes[place] += len(text)

    def leave(kind: int) -> None:
        nonlocal apart, core, main, muted
        apart -= kind == 1
        core -= kind in (2, 3)
        main -= kind == 3
        muted -= kind == 5
        if kind == 4:
            named.pop()

    while True:
        m = _TAG.search(page, at)
        text = page[at:] if m is None else page[at : m.start()]
        if text and not muted:
            parts.append(text)
        if m is None:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[1] or m[4])
        if name in RAW and not closing:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCK and not (muted and name == "option"):
            end_line()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(kind not in (0, 5) for _, kind in stack[i:]):
                        # what waits lies in the places that end here
                        end_line()
                    for _, kind in reversed(stack[i:]):
                        leave(kind)
                    del stack[i:]
                    break
            continue
        attributes = m[3] or m[6] or ""
        if name in VOID or attributes.endswith("/"):
            continue
        kind = 0
        if name in APART or (name == "header" and not core):
            kind = 1 if name in BLOCK or name in ("head", "nav", "dialog") else 5
        elif _named_apart(name, attributes, core > 0):
            kind = 4 if name in BLOCK else 5
        elif name in CORE:
            kind = 3 if name == "main" else 2
            holding.update(named)
        if kind not in (0, 5):
            end_line()
        if kind or name in BLOCK:
            if name == "p" and stack and stack[-1][0] == "p":
                # a paragraph ends at the next one
                leave(stack.pop()[1])
            stack.append((name, kind))
            apart += kind == 1
            core += kind in (2, 3)
            main += kind == 3
            muted += kind == 5
            if kind == 4:
                named.append(len(sizes))
                sizes.append(0)
    end_line()
    total = sum(len(x) for x, kind in zip(lines, kinds) if kind != APART_KIND)
    # the article lies outside of all places, or maybe in one
    clear = any(kind in (INSIDE, MAIN) and not own for kind, own in zip(kinds, around))
    places = {i for i, n in enumerate(sizes) if clear or (i not in holding and n <= MOST * total)}
    return lines, [APART_KIND if not places.isdisjoint(own) else kind for kind, own in zip(kinds, around)]


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of ``a`` are in the longest common subsequence with ``b``.

    Equal ends and lines that only one side has are taken off first.  Above ``CELLS`` the inputs are
    halved where the lengths of the halves' subsequences add up to the most (Hirschberg), so memory
    is linear in them.
    """
    out = np.zeros(len(a), dtype=bool)
    m = min(len(a), len(b))
    same = a[:m] == b[:m]
    head = m if same.all() else int(np.argmin(same))
    out[:head] = True
    m -= head
    same = a[len(a) - m :][::-1] == b[len(b) - m :][::-1]
    tail = m if same.all() else int(np.argmin(same))
    out[len(a) - tail :] = True
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    at = head + np.flatnonzero(np.isin(x, y))
    x, y = a[at], y[np.isin(y, x)]
    if not len(x):
        return out
    if len(x) * len(y) > CELLS and len(x) > 1:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        out[at[:half]] = common(x[:half], y[:cut])
        out[at[half:]] = common(x[half:], y[cut:])
        return out
    table = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)
    for i in range(len(x)):
        np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (y == x[i])), out=table[i + 1, 1:])
    i, j = len(x), len(y)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out[at[i]] = True
    return out


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` with every beginning of ``y``."""
    row = np.zeros(len(y) + 1, dtype=np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
    return row


def standing(kinds: np.ndarray) -> np.ndarray:
    """Which lines stay by their places alone: those in the main element; without it all that are not apart.

    An article element can be a teaser or a comment, so it says nothing of the lines outside it.
    """
    return kinds == MAIN if (kinds == MAIN).any() else kinds != APART_KIND


def template(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which lines of a page are template text, judged by other pages of its host with differing lines.

    Pages are given as lines (``_LINE``).  A line that one differing page shares is template text;
    inside an article or the main element it may be a quotation, so two pages and most of the
    compared ones must share it.  Copies, of the page or of each other, are told by what is left
    without the lines that all share, so at least two other pages are needed; a line shared with
    copies alone stays.  With one other page a page that has no line of its own keeps all.
    """
    inside = own["kind"] != OUTSIDE
    shares = np.array([common(own["hash"], x["hash"]) for x in others], dtype=bool).reshape(len(others), len(own))
    if len(shares) < 2:
        found = shares.any(axis=0) & ~inside
        return found & ~found.all()
    everywhere = own["hash"][shares.all(axis=0)]
    rest = np.where(shares.all(axis=0), 0, own["size"].astype(np.int64))
    if rest.any():
        stay = shares @ rest < COPY * rest.sum()
        shares, others = shares[stay], [x for x, s in zip(others, stay) if s]
    votes = shares.any(axis=0) & ~inside
    if (shares.sum(axis=0) >= 2)[inside].any():
        others = [x[~np.isin(x["hash"], everywhere)] for x in others]
        first = [i for i, x in enumerate(others) if not any(_copies(x, y) for y in others[:i])]
        count = shares[first].sum(axis=0)
        votes |= (count >= 2) & (2 * count > len(first))
    return votes


def _copies(x: np.ndarray, y: np.ndarray) -> bool:
    size = x["size"].astype(np.int64)
    return len(x) > 0 and size[np.isin(x["hash"], y["hash"])].sum() >= COPY * size.sum()


def main_text(lines: list[str], kinds: np.ndarray, shared: np.ndarray) -> str:
    """Join the lines that stay: those in their places without the shared ones."""
    return "\n".join(lines[i] for i in np.flatnonzero(standing(kinds) & ~shared))


_PAGE = "page_id long, url string, host string, key string, digest binary, lines array<string>, body binary"
_URL = r"^(?:[a-zA-Z][\w+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?"
_LINE = np.dtype([("hash", "<u8"), ("size", "<u4"), ("kind", "u1")])


def placed(pages: DataFrame) -> DataFrame:
    """Add the page's host and its place among the host's paths, null without a host."""
    host = F.lower(F.regexp_extract("url", _URL, 1))
    key = F.concat_ws("\x01", "host", F.regexp_extract("url", _URL, 2), F.regexp_extract("url", _URL, 3))
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return out.withColumn("host", F.when(host != "", host)).withColumn("key", F.when(F.col("host").isNotNull(), key))


def split_pages(pages: DataFrame, texts: bool) -> DataFrame:
    """Parse every placed page: the lines that stand in their places and a digest of their hashes, sizes and kinds.

    With ``texts`` the body has the lines' kinds alone; without, all three and no texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for page_id, url, host, key, page in zip(*(c.to_pylist() for c in batch.columns)):
                lines, kinds = page_lines(page or "")
                stay = np.flatnonzero(standing(np.array(kinds, dtype=np.uint8))).tolist()
                lines = [lines[i] for i in stay]
                body = np.array([(xxhash.xxh64_intdigest(x), len(x), kinds[i]) for i, x in zip(stay, lines)], dtype=_LINE).tobytes()
                digest = xxhash.xxh3_128_digest(body)
                rows.append((page_id, url, host, key, digest, lines, bytes(kinds[i] for i in stay)) if texts else (page_id, url, host, key, digest, [], body))
                held += len(page or "")
                if held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    return pages.select("page_id", "url", "host", "key", "html").mapInArrow(run, _PAGE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.binary()]
    names = [x.split(" ")[0] for x in _PAGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def templates(pages: DataFrame) -> DataFrame:
    """(host, digest, shared): packed flags of the template lines of every differing text of a host.

    Equal texts of a host are one entry with the first place of them, and a place is compared as one
    of its texts, so a page's neighbours are the next texts at other places, however often it was
    copied or fetched.  Only hashes move.
    """
    split = split_pages(pages.where("host IS NOT NULL"), texts=False).where(F.length("body") > 0)
    contents = stored(split.groupBy("host", "digest").agg(F.min("key").alias("key"), F.min("body").alias("body")), "contents")
    places = contents.groupBy("host", "key").agg(F.min("body").alias("body"), F.count(F.lit(1)).alias("texts"))
    draw = F.xxhash64("key")
    drawn = places.groupBy("host", F.pmod(draw, F.lit(DRAWN)).alias("slot")).agg(F.min(F.struct(draw.alias("draw"), "key", "body")).alias("page"))
    far = drawn.groupBy("host").agg(F.slice(F.sort_array(F.collect_list("page")), 1, FAR)["body"].alias("far")).where(F.size("far") > 1)
    # keys of a host begin with it and a \x01
    far = far.select("host", F.concat("host", F.lit("\x01")).alias("low"), F.concat("host", F.lit("\x02")).alias("high"), "far")
    near = with_next(places, "key", ["host", "body"], wrap=False, before=["host", "body"], keys=contents.select("key"), groups=far)
    beside = [F.when(F.col(f"{x}_host") == F.col("host"), F.col(f"{x}_body")).alias(x) for x in ("last", "next")]
    near = near.select("host", "key", "body", "texts", *beside, "far")
    # a place's other texts meet the neighbours of the place
    several = near.where("texts > 1").drop("body", "texts", "host").join(contents.select("host", "key", "body"), "key")
    entries = near.where("texts = 1").select("host", "body", "last", "next", "far").unionByName(several.select("host", "body", "last", "next", "far"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, flags = [], []
            for body, last, after, far in zip(*(c.to_pylist() for c in batch.columns[1:])):
                own = np.frombuffer(body, dtype=_LINE)
                others = {x["hash"].tobytes(): x for x in (np.frombuffer(x, dtype=_LINE) for x in (last, after, *(far or [])) if x)}
                others.pop(own["hash"].tobytes(), None)
                shared = template(own, [others[k] for k in sorted(others)])
                digests.append(xxhash.xxh3_128_digest(body))
                flags.append(np.packbits(shared).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(flags, pa.binary())], ["host", "digest", "shared"])

    return entries.mapInArrow(run, "host string, digest binary, shared binary")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A page is compared with the nearest places before and after it by path and query on its host whose
    text differs, and with ``FAR`` places of the host.  Pages without another page on the host, a url
    or a host are judged by their places alone.  Null html is empty and gives an empty text; equal rows each get a row.
    Pages are parsed twice, so that lines move once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for lines, body, shared in zip(*(c.to_pylist() for c in batch.columns[2:])):
                kinds = np.frombuffer(body, dtype=np.uint8)
                flags = np.unpackbits(np.frombuffer(shared or bytes(len(kinds)), dtype=np.uint8), count=len(kinds)).astype(bool)
                texts.append(main_text(lines, kinds, flags))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    pages = placed(pages)
    split = split_pages(pages, texts=True).drop("key")
    out = split.join(templates(pages), ["host", "digest"], "left").select("page_id", "url", "lines", "body", "shared")
    return out.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


@register("op6_html_text")
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
