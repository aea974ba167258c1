"""Text rules, label parsing, n-grams and TF-IDF against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbox.functions.scalars import is_id_only, parse_label, truncate_text
from signalbox.functions.tasks import task_label, with_task_profile
from signalbox.functions.terms import terms
from signalbox.operators import tfidf as TF

TASKS = {
    "Please fix the traceback": "coding", "Solve x": "math", "你好": "multilingual", "A protein folds": "science",
    "  Who is it": "factual_qa", "Compose a haiku": "creative_language", "Track my booking": "agentic",
    "A riddle for you": "reasoning", "Do it step by step": "reasoning", "Explain it step by step": "general", "hello": "general",
    "the classy cell": "science", "classical music": "general",
}
PROFILES = {
    "ARC-AGI Task 12ab": "arc_agi/grid_abstraction", "a GitHub issue": "coding/repository_issue",
    "Sample Input 3": "coding/competitive_programming", "def f(x):": "coding/code_generation",
    "俳句 haiku": "creative_language/multilingual_writing", "中文": "multilingual/non_english",
    "Let x be": "math/symbolic_reasoning", "genetics": "science/science_qa", " Who is it": "factual_qa/short_answer",
    "The thing is called so": "factual_qa/short_answer", "an article": "creative_language/writing_summarization",
    "refund me": "agentic/instruction_following", "hint: look": "reasoning/puzzle", "hello": "general/general",
}


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, query string")
    return [r.out for r in df.select("id", fn(F.col("query")).alias("out")).orderBy("id").collect()]


def test_task_labels(spark):
    assert column(spark, TASKS, task_label) == list(TASKS.values())


def test_task_profiles(spark):
    df = spark.createDataFrame([(k,) for k in PROFILES], "query string")
    got = {r.query: r.task_subtask_key for r in with_task_profile(df).collect()}
    assert got == PROFILES
    sizes = spark.createDataFrame([("a" * n,) for n in (699, 700, 2499, 2500)], "query string")
    assert [r.task_difficulty for r in with_task_profile(sizes).collect()] == ["easy", "medium", "medium", "hard"]


def test_accented_words_match_case_insensitively(spark):
    assert column(spark, ["É cell", "écell"], task_label) == ["science", "general"]


def test_id_only(spark):
    values = ["ARC-AGI Task 0aF", " ARC-AGI Task 1\n", "ARC-AGI Task 1 x", "ARC-AGI Task", "see ARC-AGI Task 1", "ARC-AGI Task 1\nARC-AGI Task 2"]
    assert column(spark, values, is_id_only) == [True, True, False, False, False, False]


def test_truncate(spark):
    assert column(spark, ["abcdef", "abc  def", "ab"], lambda c: truncate_text(c, 5)) == ["abcde\n[truncated]", "abc\n[truncated]", "ab"]
    assert column(spark, ["abcdef"], lambda c: truncate_text(c, 0)) == ["abcdef"]


def test_parse_label(spark):
    cases = {
        "Model_A": "Model_A", " `Model_B` ": "Model_B", '"Model_A"': "Model_A", '{"pred_model": "Model_B"}': "Model_B",
        '{"label": " Model_A "}': "Model_A", '{"model": "Model_Z", "answer": "Model_B"}': "Model_B", '{"model": 3}': None,
        "I choose Model_Z, else Model_B.": "Model_B", "xModel_A": None, "Model_AB": None, "": None, "none of them": None,
        "```Model_A```": "Model_A", '{"label": ["Model_A"]}': "Model_A",
    }
    assert column(spark, cases, lambda c: parse_label(c, ["Model_A", "Model_B"])) == list(cases.values())


def py_words(text, low, high):
    tokens = re.findall(r"\w\w+", text.lower())
    return [" ".join(tokens[i : i + n]) for n in range(low, high + 1) for i in range(len(tokens) - n + 1)]


def py_chars(text, low, high):
    text = re.sub(r"\s\s+", " ", text.lower())
    return [text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)]


def py_char_wb(text, low, high):
    out = []
    for word in text.lower().split():
        padded = f" {word} "
        out += [padded[i : i + n] for n in range(low, high + 1) for i in range(len(padded) - n + 1)]
    return out


SAMPLES = ["The cat  sat on\n\n a mat.", "a", "", "x y z", "emoji \U0001f600\U0001f600 here", "snake_case and 42 words", "  padded  "]


@pytest.mark.parametrize("analyzer,reference", [("word", py_words), ("char", py_chars), ("char_wb", py_char_wb)])
def test_ngrams(spark, analyzer, reference):
    low, high = (1, 3) if analyzer == "word" else (3, 5)
    got = column(spark, SAMPLES, lambda c: terms(c, analyzer, low, high, False))
    assert [sorted(g) for g in got] == [sorted(reference(s, low, high)) for s in SAMPLES]


def test_accents_are_folded(spark):
    assert column(spark, ["Éàñ Über ﬁ"], lambda c: terms(c, "word", 1, 1, True))[0][:2] == ["ean", "uber"]


@pytest.mark.parametrize("sublinear", [True, False])
def test_tfidf_weights(spark, sublinear):
    docs = ["red red blue", "blue green", "green green red sky", "unseen"]
    train = spark.createDataFrame([(i, d) for i, d in enumerate(docs[:3])], "id long, query string")
    every = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, query string")
    spec = TF.TfidfSpec("word", 1, 1, sublinear=sublinear)
    model = TF.fit(train, spec)
    got = {}
    for r in TF.weight_rows(TF.transform(every, model), model).collect():
        got.setdefault(r.id, {})[r.term] = r.w
    df = Counter(t for d in docs[:3] for t in set(d.split()))
    for i, d in enumerate(docs[:3]):
        tf = Counter(d.split())
        w = {t: ((1 + math.log(c)) if sublinear else c) * (math.log(4 / (1 + df[t])) + 1) for t, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        assert got[i] == pytest.approx({t: v / norm for t, v in w.items()})
    assert 3 not in got


def test_vocabulary_bounds(spark):
    docs = spark.createDataFrame([(0, "aa bb cc"), (1, "aa bb"), (2, "aa dd dd dd")], "id long, query string")
    names = lambda **k: TF.fit(docs, TF.TfidfSpec("word", 1, 1, **k)).terms
    assert names() == ["aa", "bb", "cc", "dd"]
    assert names(min_df=2) == ["aa", "bb"]
    assert names(max_df=0.9) == ["bb", "cc", "dd"]
    assert names(max_features=2) == ["aa", "dd"]
    with pytest.raises(ValueError):
        names(min_df=9)
    assert TF.fit(docs, TF.TfidfSpec("word", 1, 1, min_df=9), retry_min_df=True).size == 4


def test_vector_form_has_the_same_weights(spark):
    docs = spark.createDataFrame([(0, "aa bb cc"), (1, "aa bb"), (2, "")], "id long, query string")
    model = TF.fit(docs, TF.TfidfSpec("word", 1, 2))
    flat = {r.id: dict(zip(r.idx, r.w)) for r in TF.transform(docs, model).collect()}
    vec = {r.id: dict(zip(map(int, r.features.indices), r.features.values)) for r in TF.transform(docs, model, as_vector=True).collect()}
    assert flat == vec and flat[2] == {}
    assert np.isclose(sum(w * w for w in flat[0].values()), 1.0)


def test_most_frequent_terms_cut_ties_by_term(spark, monkeypatch):
    from signalbox.operators import tfidf as TF

    monkeypatch.setattr(TF, "TIES", 3)
    rows = [(f"t{i:03d}", 5 - i // 30) for i in range(120)] + [("t", 3), ("t0", 3), ("é", 3), ("z", 9)]
    df = spark.createDataFrame(rows, "term string, tf long")
    order = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
    for limit in (1, 2, 31, 32, 62, 64, 70, 92, 95, 124, 500):
        assert sorted(tuple(r) for r in TF.most_frequent(df, limit).collect()) == sorted(order[:limit])


def test_accents_above_the_basic_plane_are_folded(spark):
    from signalbox.functions.terms import fold

    df = spark.createDataFrame([("\U0001D400\U0001D401 \u00e9",)], "t string")
    assert df.select(fold(F.col("t")).alias("x")).first().x == "AB e"


def test_terms_are_counted_in_bounded_stretches(spark, monkeypatch):
    """A batch is counted and weighed in stretches of its rows; the figures are those of the whole."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j % (i + 1)}" for j in range(3 * i))) for i in range(30)], "id long, query string")
    spec = TF.TfidfSpec("word", 1, 2, 50)
    counts = lambda: sorted(map(tuple, TF.term_statistics(docs, spec).collect()))
    whole, model = counts(), TF.fit(docs, spec)
    weights = sorted((r.id, r.idx, r.w) for r in TF.transform(docs, model).collect())
    batch = TF.with_terms(docs, spec).select("_terms").toArrow().to_batches()[0]
    monkeypatch.setattr(TF, "SLICE", 40)
    parts = list(TF._slices(batch))
    assert sum(p.num_rows for p in parts) == batch.num_rows
    assert all(p.num_rows == 1 or len(p.column("_terms").flatten()) <= 40 for p in parts)
    assert len(list(TF._partial_counts(iter([batch])))) > 1
    assert counts() == whole
    assert sorted((r.id, r.idx, r.w) for r in TF.transform(docs, model).collect()) == weights


@pytest.mark.parametrize("slice_", [500_000, 40])
def test_term_statistics_count_units_without_making_all_terms(spark, monkeypatch, slice_):
    """All analyzers against the terms themselves, on texts with blanks, marks, zeros, wide alphabets and nulls."""
    monkeypatch.setattr(TF, "SLICE", slice_)
    wide = "".join(chr(0x4E00 + 37 * i % 20_000) for i in range(6000))
    texts = ["", None, " ", "a", "Ab  cd\t\n e ab", "x\x00y\x00\x00 z", "𝒳𝒴 😀😀 b", "éÀ\u0301x ﬁ", "aaa aaaa", wide, " one two two  three "]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, query string")
    for analyzer, low, high in (("word", 1, 2), ("word", 2, 3), ("char", 3, 5), ("char", 1, 2), ("char_wb", 3, 5)):
        spec = TF.TfidfSpec(analyzer, low, high)
        rows = TF.with_terms(docs, spec).select("id", F.explode("_terms").alias("term"))
        want = rows.groupBy("term").agg(F.count(F.lit(1)), F.countDistinct("id")).collect()
        found = TF.term_statistics(docs, spec)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want))
        # n-grams are neither cut out nor joined by column functions
        assert "?=" not in found._jdf.queryExecution().toString() and "zip_with" not in found._jdf.queryExecution().toString()
