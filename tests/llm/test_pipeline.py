"""The pipeline's stages on the small tables and on odd rows."""

import collections

import corpus_pipeline
import numpy as np
from corpus_cases import documents, edge_docs, shingles, words  # noqa: F401
from pyspark.sql import functions as F

from signalbox.llm import mixing, registry, toxicity


def test_stages_follow_their_decisions(spark, sf, documents):
    rows, docs = documents
    columns, texts = docs.columns, dict(zip(rows.doc_id, rows.text))
    harmless = corpus_pipeline.harmless(spark, docs, sf)
    model = toxicity.fit(docs, toxicity.toxic_grades(spark.read.parquet(f"{sf}/labels.parquet")))
    rejected = {r.doc_id for r in toxicity.judged(docs, model).where("grade > 0").select("row.doc_id").collect()}
    kept = sorted(r.doc_id for r in harmless.collect())
    assert harmless.columns == columns and kept == sorted(set(texts) - rejected) and rejected
    # one document of each group of links stays: the smallest id
    sets, group = {i: shingles(texts[i]) for i in kept}, {}
    parent = {i: i for i in kept}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in kept:
        for b in kept:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = sorted(i for i in kept if find(i) == i)
    single = corpus_pipeline.distinct(spark, harmless, sf)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == want
    mixed = corpus_pipeline.mixed(spark, single, sf)
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(times) <= set(want) and max(times.values()) <= 2
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(single, mixing.word_count(F.col("text"))).collect()}
    assert all(abs(times[i] * size - got) <= size / 2 for i, (size, got) in taken.items())
    packed = corpus_pipeline.packed(spark, mixed, sf).toPandas()
    assert set(packed.doc_id) == set(times) and (packed.groupby("doc_id").length.sum() >= [len(words(texts[i])) for i in sorted(times)]).all()


def test_run_and_registration(spark, sf):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, sf).toPandas()
    for _, own in out.groupby("sequence_id"):
        assert np.array_equal(np.sort(own.offset), np.cumsum(own.sort_values("offset").length) - own.sort_values("offset").length)


def test_stages_take_odd_rows(spark, sf, edge_docs):
    for docs in (edge_docs, edge_docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == edge_docs.columns
        corpus_pipeline.packed(spark, docs, sf).count()


def test_every_operator_has_a_query():
    registry.load()
    assert {q.split("_")[0] for q in registry.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(registry.ORACLES) <= set(registry.QUERIES)
