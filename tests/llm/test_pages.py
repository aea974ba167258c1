"""Operators on pages and vectors against plain Python."""

import gzip
import hashlib
import html
import io
import re

import numpy as np
import pyarrow.fs
import pytest
from corpus_cases import run  # noqa: F401

from signalbox.llm import graph_index, html_text, huffman, storage, warc


def article(page):
    found = re.search(r"<article>(.*?)</article>", page or "", re.S)
    if not found:
        return ""
    text = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\x00", found[1])))
    return "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in text.split("\x00")) if x)


def test_text_is_the_article(run, spark, sf):
    got = run("op6_html_text").sort_values("page_id")
    pages = spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").toPandas()
    assert got.text.tolist() == [article(x) for x in pages.html]
    assert got.n_chars.tolist() == [len(x) for x in got.text] and got.url.tolist() == pages.url.tolist()


def test_places_and_references():
    page = """<!doctype html><html><head><title>T</title><script>var a = "<p>x</p>";</script></head><body><header>Site</header>
    <nav><a>Menu</a></nav><div class="cookie-notice">Accept</div><main><h1>Big &amp; small</h1><p>One
      two&nbsp;three<br>four<p>Five &lt;b&gt; <b>six</b><!-- no --><form><input>Name</form><div id='comments'>me too</div>
    <ul><li>a<li>b</ul><aside>See also</aside></main><footer>F</footer></body>"""
    lines, kinds = html_text.page_lines(page)
    text = html_text.main_text(lines, np.array(kinds, dtype=np.uint8), np.zeros(len(lines), dtype=bool))
    assert text == "Big & small\nOne two three four\nFive <b> six\na\nb"


def test_pages_without_article_lose_what_their_neighbours_share(spark):
    page = lambda body: f"<div>Top of site</div><p>Search here</p><p>{body}</p><div>All rights reserved</div>"
    rows = [(i, f"http://h.example/a/{i}", page(f"own text {i}")) for i in range(5)]
    rows += [(9, "http://alone.example/x", page("single")), (10, None, page("no url")), (11, "http://h.example/a/2", None), (None, "http://z/", "<p>q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", storage.F.lit("k")).repartition(3)
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert [got[i] for i in (0, 1, 3, 4)] == [f"own text {i}" for i in (0, 1, 3, 4)]
    assert got[11] == "" and got[None] == "q" and got[9].startswith("Top of site\nSearch here\nsingle") and "no url" in got[10]
    assert html_text.extract(df.where("false")).count() == 0


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in html_text.extract(df).collect()}


def test_short_pages_and_fetched_again_pages_lose_the_template(spark):
    frame = lambda body: "".join(f"<div>Menu line {i} of this site</div>" for i in range(40)) + body + "<div>All rights reserved</div>"
    rows = [(i, f"http://h.example/a/{i}", frame(f"<p>own text {i}</p>")) for i in range(6)]
    # the same page again, as it was and with another date, and copies of it at other places
    rows += [(10 + i, "http://h.example/a/3", rows[3][2]) for i in range(4)]
    rows += [(20 + i, "http://h.example/a/4#x", frame(f"<p>own text 4</p><p>on day {i}</p>")) for i in range(3)]
    rows += [(30 + i, f"http://h.example/a/5{i}", rows[5][2]) for i in range(4)]
    got = texts(spark, rows)
    assert [got[i] for i in range(6)] == [f"own text {i}" for i in range(6)]
    assert {got[10 + i] for i in range(4)} == {"own text 3"} and {got[30 + i] for i in range(4)} == {"own text 5"}
    assert [got[20 + i] for i in range(3)] == [f"own text 4\non day {i}" for i in range(3)]


def test_template_inside_articles_goes_and_copies_and_quotations_stay(spark):
    page = lambda tag, body: f"<body><{tag}><p>Print this page</p><p>{body}</p><div>Was this useful?</div></{tag}></body>"
    rows = [(i, f"http://m.example/{i}", page("main", f"main text {i}")) for i in range(5)]
    rows += [(10 + i, f"http://a.example/{i}", page("article", f"article {i}</p><p>{'quoted' if i in (2, 3) else f'more {i}'}")) for i in range(5)]
    rows += [(15, "http://a.example/25", page("article", "article 2</p><p>quoted</p><p>copied"))]
    got = texts(spark, rows)
    assert [got[i] for i in range(5)] == [f"main text {i}" for i in range(5)]
    assert [got[10 + i] for i in range(5)] == [f"article {i}\n{'quoted' if i in (2, 3) else f'more {i}'}" for i in range(5)]
    assert got[15] == "article 2\nquoted\ncopied"


def kept(page):
    lines, kinds = html_text.page_lines(page)
    return html_text.main_text(lines, np.array(kinds, dtype=np.uint8), np.zeros(len(lines), dtype=bool))


@pytest.mark.parametrize("page", [
    '<div class="layout has-sidebar"><p>the whole text</p></div>', '<article class="post comments-open"><p>the whole text</p></article>',
    '<div class="page-with-banner"><article><p>the whole text</p></article></div>', '<p id="related-work">the whole text</p>',
    '<article><div class="entry-header"><h1>the whole text</h1></div></article>', '<div class="share"><main>the whole text</main></div>',
    '<div class="widget">the whole text</div><div>or</div>'[:45], '<body class="has-ads no-sidebar"><p>the whole text</p></body>',
])
def test_names_of_layouts_take_no_text_away(page):
    assert kept(page) == "the whole text"


@pytest.mark.parametrize("inside", [
    "<button>Share this</button>", '<a class="advert">Buy now</a>', '<span class="share">Share</span>', "<svg><text>k</text></svg>", "<select><option>x</option></select>",
    '<span class="social-share">a <b>b</b></span>',
])
def test_inline_parts_that_are_apart_leave_the_block_whole(inside):
    assert kept(f"<article><p>one {inside} two</p><p>three</p>{inside}</article>") == "one two\nthree"
    assert kept(f"<article><div>{inside}</div><p>three and more</p></article>") == "three and more"


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "ad-slot-2", "cookie_banner", "post-comments", "related", "left sidebar", "newsletter-form"])
def test_names_of_places_set_short_parts_apart(name):
    assert kept(f'<div><p>a text that is long enough</p></div><div class="{name}">menu <p>and more</p></div><p>the end</p>') == "a text that is long enough\nthe end"


def test_text_beside_article_elements_stays(spark):
    page = "<div>{0} long text in a div</div><article><p>Teaser {0}</p></article><article class='comment'><p>Reader {0}</p></article>"
    got = texts(spark, [(i, f"http://c.example/{i}", page.format(i)) for i in range(3)])
    assert [got[i] for i in range(3)] == [f"{i} long text in a div\nTeaser {i}" for i in range(3)]


def test_common_is_a_longest_common_subsequence():
    def longest(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 14)).astype(np.uint64) for _ in range(2))
        kept = a[html_text.common(a, b)]
        it = iter(b.tolist())
        assert len(kept) == longest(a, b) and all(x in it for x in kept.tolist())
    long = np.arange(3000, dtype=np.uint64)
    other = np.concatenate([long[:1000], long[1000:2000] + np.uint64(9000), long[2000:]])
    assert html_text.common(long, other).sum() == 2000
    mixed = np.concatenate([[np.uint64(1)], long[5:2500], rng.integers(0, 5, 400).astype(np.uint64), [np.uint64(7777)]])
    assert html_text.common(mixed, long).sum() >= 2495


def test_common_is_longest_above_the_table_size(monkeypatch):
    rng = np.random.default_rng(3)
    pairs = [[rng.integers(0, 6, n).astype(np.uint64) for n in (60, 45)] for _ in range(20)]
    want = [html_text.common(a, b).sum() for a, b in pairs]
    monkeypatch.setattr(html_text, "CELLS", 50)
    for (a, b), n in zip(pairs, want):
        kept = a[html_text.common(a, b)]
        it = iter(b.tolist())
        assert len(kept) == n and all(x in it for x in kept.tolist())


def test_both_neighbours_are_seen_across_ranges(spark):
    df = spark.range(2000).select(storage.F.format_string("%05d", "id").alias("k"), storage.F.col("id").alias("v"))
    got = storage.with_next(df, "k", ["v"], wrap=False, before=["v"]).orderBy("v").collect()
    assert [(r.last_v, r.next_v) for r in got] == [(i - 1 if i else None, i + 1 if i < 1999 else None) for i in range(2000)]


def test_archives(spark):
    big = "x" * 200
    rows = [(i, f"http://a/{i}?q=ü%20 &b", big) for i in range(30, 0, -1)]
    rows += [(100, None, None), (101, "http://b/", "small"), (102, "http://b/", "small"), (None, "http://c", big), (None, None, "z" * 300), (103, "u", "z" * 300)]
    rows += [(104, "same id", big + "1"), (104, "same id", big), (105, "repeated", "w" * 150), (105, "repeated", "w" * 150), (106, "nl", "a\r\n\r\nb" + "é" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", storage.F.lit(1)).repartition(4)
    out, folder = warc.round_trip(df, file_bytes=1500, shard_rows=10)
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id not in (None, 104, 105)}
    assert by[1].record_type == "response" and all(by[i].record_type == "revisit" and by[i].refers_to == 1 for i in range(2, 31))
    assert by[102].record_type == by[101].record_type == by[100].record_type == by[103].record_type == "response" and by[100].payload_bytes == 0
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id == 104) == [("response", None), ("revisit", 1)]
    assert {r.record_type for r in got if r.page_id in (None, 105)} == {"response"}
    for page, url, text in rows:
        data = (text or "").encode()
        mine = [r for r in got if r.page_id == page and r.payload_digest == hashlib.sha256(data).hexdigest()]
        assert mine and all(r.payload_bytes == len(data) and (r.html is None or r.html == (text or "")) for r in mine)
    where, path = storage.filesystem(folder)
    files = [f.path for f in where.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".warc.gz")]
    assert len(files) > 1 and not [f for f in where.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".tmp")]
    for f in files:
        with gzip.open(f) as file:
            assert file.read().startswith(b"WARC/1.0\r\n")
    digest = lambda p: {f.rpartition("/")[2]: hashlib.sha256(open(f, "rb").read()).hexdigest() for f in p}
    again, other = warc.round_trip(df.repartition(2), file_bytes=1500, shard_rows=10)
    again.count()
    files2 = [f.path for f in where.get_file_info(pyarrow.fs.FileSelector(storage.filesystem(other)[1])) if f.path.endswith(".warc.gz")]
    assert digest(files) == digest(files2)
    assert warc.round_trip(df.where("false"))[0].count() == 0


def test_members_across_reads():
    data = b"".join(gzip.compress(bytes([i]) * 3000) for i in range(5))

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(7)

    assert list(warc.members(Slow(data))) == [bytes([i]) * 3000 for i in range(5)]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-5])))


def test_huffman_codes_are_optimal_when_not_limited_and_round_trip():
    import heapq

    rng = np.random.default_rng(0)
    for n, limit in ((1, 20), (2, 20), (37, 20), (500, 20), (500, 10), (1 << 10, 10), (3000, 20)):
        counts = np.zeros(5000, dtype=np.int64)
        used = rng.choice(5000, n, replace=False)
        counts[used] = (1e6 / (1 + np.arange(n)) ** 1.3).astype(np.int64) + 1
        lengths = huffman.code_lengths(counts, limit)
        assert (lengths[used] > 0).all() and lengths.max() <= limit and (0.5 ** lengths[used].astype(float)).sum() <= 1
        if limit == 20 and n > 1:
            heap, total = sorted(counts[used].tolist()), 0
            heapq.heapify(heap)
            while len(heap) > 1:
                merged = heapq.heappop(heap) + heapq.heappop(heap)
                total += merged
                heapq.heappush(heap, merged)
            assert (counts * lengths).sum() == total
        sizes = rng.integers(1, 900, 40)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids = rng.choice(used, bounds[-1]).astype(np.uint16)
        data, at, marks, mark_at = huffman.encode(ids, bounds, lengths, huffman.codes(lengths))
        runs = np.diff(mark_at)
        of = np.full(len(marks), huffman.STEP)
        of[np.cumsum(runs) - 1] = sizes - (runs - 1) * huffman.STEP
        got = huffman.decode(data, marks.astype(np.int64) + np.repeat(at[:-1] * 8, runs), of, huffman.table(lengths))
        assert (got == ids).all()
        # a document alone, from its second checkpoint
        i = int(np.argmax(sizes))
        own = data[at[i] : at[i + 1]]
        rest = min(huffman.STEP, sizes[i] - huffman.STEP)
        part = huffman.decode(own, marks[mark_at[i] + 1 : mark_at[i] + 2].astype(np.int64), np.array([rest]), huffman.table(lengths))
        assert (part == ids[bounds[i] + huffman.STEP : bounds[i] + huffman.STEP + rest]).all()


def exact(ids, vectors, queries, k):
    out = {}
    for q in queries:
        scores = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -np.round(scores, 12))) if ids[i] != ids[q]][:k]
        out[ids[q]] = [(int(ids[i]), scores[i]) for i in order]
    return out


def recall_of(got, want):
    found = {}
    for r in got.sort_values(["query_id", "rank"]).itertuples():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(want) and all(len(found[q]) == len(want[q]) for q in want)
    for q, rows in found.items():
        assert rows == sorted(rows, key=lambda x: (-x[1], x[0]))
    return sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_search_finds_the_nearest(spark):
    d = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    rows = df.orderBy("vec_id").toPandas()
    vectors, ids = np.stack(rows.embedding).astype(float), rows.vec_id.values
    want = exact(ids, vectors, np.flatnonzero(ids % 20 == 0), 20)
    settings = graph_index.Settings(shard=700)
    assert recall_of(graph_index.nearest(df, df.where("vec_id % 20 = 0"), settings=settings).toPandas(), want) >= 0.97


def test_search_with_unequal_norms_and_hot_copies(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(900, 12)) * rng.lognormal(0, 0.5, (900, 1))
    vectors[300:600] = vectors[0]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    want = exact(np.arange(900), vectors, range(0, 900, 20), 20)
    got = graph_index.nearest(df, df.where("vec_id % 20 = 0")).toPandas()
    assert recall_of(got, want) >= 0.97
    hot = got[got.query_id == 400].sort_values("rank")
    best = max(v @ vectors[0] for v in vectors)
    if np.isclose(best, vectors[0] @ vectors[0]):
        assert hot.vec_id.tolist() == [0, *range(300, 319)]


def test_search_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]),
            (8, [1.0, 0.0]), (8, [1.0, 0.0]), (20, [1.0, 2.0, 3.0]), (40, [-1.0, 0.0]), (60, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", storage.F.lit(9))
    got = [tuple(r) for r in graph_index.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 1.0), (0, 2, 1, 0.5), (0, 3, 40, -1.0), (40, 1, 1, -0.5), (40, 2, 0, -1.0), (40, 3, 8, -1.0)]
    assert graph_index.nearest(df.where("false"), df.where("false")).count() == 0
