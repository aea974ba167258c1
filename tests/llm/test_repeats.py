"""Periodic runs, collocations and repeated substrings against plain Python."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from corpus_cases import LONG, TEXTS, documents, edge_docs, no_docs, run, words  # noqa: F401
from pyspark.sql import functions as F

from signalbox.llm import bwt_dedup, collocations, periodic


def runs_of(w, least=24, times=3):
    """(start, length, period) by trying all periods."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, times * q) and (start, length) not in found:
                found[start, length] = q
    return sorted((s, n, q) for (s, n), q in found.items())


def runs_digest(doc_id, text):
    w = words(text, False)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    # runs with the same start are listed by period
    runs = sorted(runs_of(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha(lines), sha(kept))


def test_runs_are_those_of_all_periods(run, documents):
    got = run("op13_periodic_runs").sort_values("doc_id")
    rows, _ = documents
    none = lambda r: tuple(None if x != x else x for x in r)
    assert [none(r) for r in got.itertuples(index=False, name=None)] == [runs_digest(i, t) for i, t in zip(rows.doc_id, rows.text)]
    assert got.n_runs.gt(0).sum() > 5


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (9, 4), (2, 2)])
def test_runs_of_random_words(least, times):
    rng = np.random.default_rng(least)
    texts = []
    for k in range(120):
        part = [rng.integers(0, 2 + k % 3, rng.integers(1, 9)) for _ in range(6)]
        texts.append(np.concatenate([np.tile(p, rng.integers(1, 14)) for p in part])[: rng.integers(0, 150)])
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    names = rng.integers(1, 2**63, 8).astype(np.uint64)
    got = list(zip(*(x.tolist() for x in periodic.find_runs(names[np.concatenate(texts)], bounds, least, times))))
    want = [(i, s, n, q) for i, t in enumerate(texts) for s, n, q in sorted(runs_of(t.tolist(), least, times), key=lambda r: (r[0], r[2]))]
    assert got == want and got


def test_runs_of_long_repetitions_take_no_quadratic_time():
    one, two = np.full(60_000, 5, dtype=np.uint64), np.tile(np.arange(7, dtype=np.uint64), 9_000)
    far = np.concatenate([np.concatenate([np.arange(40, dtype=np.uint64), [np.uint64(1000 + k)]]) for k in range(2_000)])
    bounds = np.cumsum([0, len(one), len(two), len(far)])
    text, start, length, period = periodic.find_runs(np.concatenate([one, two, far]), bounds)
    assert list(zip(text, start, length, period)) == [(0, 0, 60_000, 1), (1, 0, 63_000, 7)]


def test_runs_edge_cases(edge_docs, no_docs):
    got = {(r.doc_id, r.words, len(r.runs), r.collapsed) for r in periodic.with_runs(edge_docs).collect()}
    want = {(i, len(words(t)), len(runs_of(words(t, False))) if t is None or len(t) < 10_000 else 0, " ".join(words(t, False))) for i, t in TEXTS if not t or len(t) < 10_000}
    assert want <= got and len([i for i, t in TEXTS]) == edge_docs.count()
    long = [r for r in got if r[1] > 100_000]
    assert {r[1] for r in long} == {300_000, 300_001} and all(r[2] for r in long)
    assert periodic.with_runs(no_docs).count() == 0


def collocated(rows, least, longest, contained, first):
    """(lang, rank, phrase, a, l, r, n, score) by counting all phrases."""
    counts, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            total[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {g: a for g, a in counts.items() if len(g[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            gone |= {(lang, w[i : i + k]) for i in range(len(w) - k + 1) if 100 * a >= contained * counts[lang, w[i : i + k]]}
    out = collections.defaultdict(list)
    for (lang, w), a in often.items():
        if (lang, w) not in gone:
            cuts = [(1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
            score, _, l, r = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:first]))


def test_collocations_are_those_of_all_phrases(run, documents):
    rows, _ = documents
    got = run("op11_collocations")
    want = collocated(list(zip(rows.lang, rows.text)), 10, 3, 50, 2000)
    assert sorted(got.itertuples(index=False, name=None)) == want and len(want) > 100


@pytest.mark.parametrize("least,longest,contained,first", [(3, 4, 50, 40), (2, 2, 100, 1000), (5, 5, 20, 7)])
def test_collocations_of_random_words(spark, least, longest, contained, first, monkeypatch):
    rng = np.random.default_rng(longest)
    names = ["a", "B", "ab", "é", "\u2003", "x" * 300, "a-b", "ÉT"]
    pieces = [" ".join(names[k] for k in rng.integers(0, 2 + i % 7, rng.integers(0, 40))) for i in range(60)]
    pieces += ["long " * 500, " \t a  a\tb ", "a.b,c\n\rd;;e!?", None, ""]
    rows = [((None, "und", "en", "english")[k % 4], t + "." + t if t and k % 3 else t) for k, t in enumerate(pieces)]
    # few sums fit at once, so tasks send several parts
    monkeypatch.setattr(collocations, "_FLUSH", 200)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "lang string, text string, phrase string, f string").repartition(3)
    got = collocations.collocations(df, least, longest, contained, first).collect()
    assert sorted(map(tuple, got)) == collocated(rows, least, longest, contained, first)


def test_collocations_edge_cases(edge_docs, no_docs):
    df = edge_docs.withColumn("lang", F.col("source"))
    want = collocated([(None if k % 5 == 0 else f"s{k % 3}", t) for k, (_, t) in enumerate(TEXTS)], 10, 3, 50, 2000)
    assert sorted(map(tuple, collocations.collocations(df).collect())) == want
    assert collocations.collocations(no_docs.withColumn("lang", F.lit("en"))).count() == 0


def without(rows, length):
    """(doc_id, n_bytes, spans, kept) by a set of all strings, rows in order."""
    seen, out = set(), []
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for at in range(len(raw) - length + 1):
            if raw[at : at + length] in seen:
                gone[at : at + length] = True
            seen.add(raw[at : at + length])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(raw), [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])], bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


def test_repeated_bytes_are_those_of_a_set_of_all_strings(run, documents):
    rows, _ = documents
    got = run("op12_repeated_bytes").sort_values("doc_id")
    want = [(i, n, sum(b for _, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in without(list(zip(rows.doc_id, rows.text)), 100)]
    assert list(got.itertuples(index=False, name=None)) == want
    assert got.n_removed.gt(0).sum() > 10


@pytest.mark.parametrize("length,sample,often", [(16, 64, 24), (40, 1, 3), (100, 1, 2), (131, 1, 10_000)])
def test_repeated_bytes_of_cut_and_joined_texts(spark, length, sample, often):
    """Texts put together from parts of others, with passages at all ends, by either way of dealing contexts."""
    rng = np.random.default_rng(length)
    letters = np.array(list("abcdeéß \u2003.")), np.array(["a"]), np.array(["a", "b"])
    texts = []
    for k in range(90):
        parts = []
        for _ in range(rng.integers(1, 6)):
            if texts and rng.random() < 0.6:
                old = texts[rng.integers(len(texts))]
                low = rng.integers(0, max(1, len(old)))
                parts.append(old[low : low + rng.integers(1, 400)])
            else:
                parts.append("".join(rng.choice(letters[rng.integers(3) if k % 4 == 0 else 0], rng.integers(0, 300))))
        texts.append("".join(parts))
    ids = sorted(rng.choice(10_000, len(texts), replace=False).tolist())
    rows = list(zip(ids, texts))
    df = spark.createDataFrame(rng.permutation(np.array(rows, dtype=object)).tolist(), "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in bwt_dedup.without_repeats(df, length, sample, often).collect())
    assert got == without(rows, length)


def test_merged_transforms_give_the_repeated_intervals():
    """Against sorting all suffixes, with one string a shard and several."""
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, rng.integers(1, 60)).astype(np.uint8)) for _ in range(30)]
    for length in (9, 16, 21):
        for size in (1, 7, 30):
            shards, base = [], 0
            for low in range(0, 30, size):
                shards.append(bwt_dedup.Shard(strings[low : low + size], length, base))
                base += len(shards[-1].last)
            suffix, block = bwt_dedup.merged(shards, length)
            string = np.concatenate([s.string + low for s, low in zip(shards, range(0, 30, size))])[suffix]
            place = np.concatenate([s.place for s in shards])[suffix]
            ring = lambda i, p: ((strings[i] + b"\xff") * 30)[p : p + length]
            got = [ring(i, p) for i, p in zip(string, place)]
            every = collections.Counter(ring(i, p) for i, s in enumerate(strings) for p in range(len(s) + 1))
            assert got == sorted(x for x, n in every.items() for _ in range(n) if n > 1)
            assert [a == b for a, b in zip(got, got[1:])] == (block[1:] == block[:-1]).tolist()


def test_repeated_bytes_edge_cases(edge_docs, no_docs):
    got = collections.Counter((r.doc_id, r.n_bytes, sum(s.length for s in r.spans), bytes(r.kept)) for r in bwt_dedup.without_repeats(edge_docs).collect())
    rows = sorted({(i, t) for i, t in TEXTS if i is not None and t and len(t) < 10_000})
    want = {(i, n, sum(b for _, b in s), k) for i, n, s, k in without(rows, 100)}
    assert want <= set(got) and sum(got.values()) == len(TEXTS) and got[(None, 0, 0, b"")] == 1
    # the upper-case text comes twice under one id: one document
    assert sum(n for (i, *_), n in got.items() if i == 3) == 2 and len([g for g in got if g[0] == 3]) == 1
    # the long text repeats itself, and with it the space after its last word
    assert {n for i, _, n, _ in got if i == 10} == {len(LONG) + 1} and bwt_dedup.without_repeats(no_docs).count() == 0
