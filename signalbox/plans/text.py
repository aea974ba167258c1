"""Registered queries: TF-IDF, nearest neighbours, embeddings and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.functions.tasks import task_label
from signalbox.operators import decide as D
from signalbox.operators import factor as K
from signalbox.operators import neighbors as NB
from signalbox.operators import priors as P
from signalbox.operators import rewards as R
from signalbox.operators import splits as J
from signalbox.operators import tfidf as TF
from signalbox.plans import fixtures as X
from signalbox.plans.fixtures import HELD, MODELS, SPLIT_SEED, sql
from signalbox.plans.registry import register
from signalbox.plans.scoring import TASK_SQL, _r


def rewarded_texts(spark, sf) -> DataFrame:
    return R.add_reward(X.text_panel(spark, sf), "mean-row-max")


def text_split(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Training panel with rewards and held-out queries; rewards are fit on all rows."""
    return J.train_and_held(rewarded_texts(spark, sf), HELD, SPLIT_SEED)


# --- TF-IDF in SQL ---------------------------------------------------------------------

WORDS = r"'[\p{L}\p{N}_]{2,}'"


def word_terms_sql(source: str, fold: str = "strip_accents(lower(query))", keep: str = "id, held_out") -> str:
    return f"""tok AS (SELECT {keep}, regexp_extract_all({fold}, {WORDS}) AS t FROM {source}),
    terms AS (SELECT {keep}, unnest(t) AS term FROM tok
      UNION ALL SELECT {keep}, unnest([t[i]||' '||t[i+1] for i in range(1, len(t))]) FROM tok),
    tf AS (SELECT {keep}, term, count(*) AS c FROM terms GROUP BY ALL)"""


def weights_sql(max_features: int, sublinear: bool = True, min_df: int = 1, max_df: float = 1.0) -> str:
    weight = "(1+ln(c))" if sublinear else "c"
    return f"""n AS (SELECT count(*) AS n FROM tok WHERE NOT held_out),
    vocab AS (SELECT term, sum(c) AS total, count(*) AS df FROM tf WHERE NOT held_out GROUP BY term
      HAVING count(*)>={min_df} AND count(*)<={max_df}*(SELECT n FROM n) ORDER BY total DESC, term LIMIT {max_features}),
    w0 AS (SELECT tf.id, held_out, tf.term, {weight}*(ln((1.0::DOUBLE+n)/(1+df))+1) AS w FROM tf JOIN vocab ON vocab.term=tf.term, n),
    w AS (SELECT id, held_out, term, w/sqrt(sum(w*w) OVER (PARTITION BY id)) AS w FROM w0)"""


def neighbors_sql(k: int) -> str:
    return f"""sim AS (SELECT q.id, t.id AS neighbor_id, round(sum(q.w*t.w),9) AS similarity FROM w q JOIN w t ON q.term=t.term
      WHERE q.held_out AND NOT t.held_out GROUP BY q.id, t.id),
    nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbor_id) AS rank FROM sim QUALIFY rank<={k})"""


KNN_SCORES = """gm AS (SELECT r.model, avg(reward) AS g FROM rw r JOIN split s ON s.id=r.id AND NOT s.held_out GROUP BY r.model),
    knn AS (SELECT nn.id, r.model, sum(similarity*reward)/sum(similarity) AS score FROM nn JOIN rw r ON r.id=nn.neighbor_id GROUP BY nn.id, r.model),
    knn_all AS (SELECT s.id, gm.model, coalesce(knn.score, gm.g) AS score FROM split s CROSS JOIN gm
      LEFT JOIN knn ON knn.id=s.id AND knn.model=gm.model WHERE s.held_out)"""


@register(
    "f1_word_vocabulary",
    sql(word_terms_sql("(SELECT doc_id AS id, text AS query FROM documents)", keep="id"), body="""SELECT term, CAST(sum(c) AS BIGINT) AS tf, count(*) AS df,
        round(ln((1.0::DOUBLE+(SELECT count(*) FROM documents))/(1+count(*)))+1,8) AS idf FROM tf GROUP BY term ORDER BY tf DESC, term LIMIT 200000"""),
)
def f1(spark, sf):
    docs = rewarded_texts(spark, sf).select("id", "query")
    return _r(TF.vocabulary(docs, TF.SPECS["knn_router"]), "idf")


@register(
    "f1_word_weights",
    sql("split", word_terms_sql("split"), weights_sql(40000, False, 2), body="""SELECT split.id, count(w.w) AS n_terms, coalesce(round(sum(w.w),5),0) AS total, round(max(w.w),8) AS top
        FROM split LEFT JOIN w ON w.id=split.id GROUP BY split.id"""),
)
def f1_weights(spark, sf):
    train, held = J.train_and_held(rewarded_texts(spark, sf).select("id", "query"), HELD, SPLIT_SEED)
    model = TF.fit(train, TF.SPECS["retrieval"])
    weighted = TF.transform(train.unionByName(held), model)
    stats = weighted.select("id", F.size("idx").alias("n_terms"), C.total(F.col("w")).alias("total"), F.array_max("w").alias("top"))
    return stats.select("id", "n_terms", F.round("total", 5).alias("total"), F.round("top", 8).alias("top"))


_CHARS = "strip_accents(lower(text))"


@register(
    "f2_char_vocabulary",
    rf"""WITH sq AS (SELECT doc_id, regexp_replace({_CHARS}, '\s\s+', ' ', 'g') AS s FROM documents),
        grams AS (SELECT doc_id, unnest(list_transform(range(1, length(s)-n+2), lambda i: substr(s, CAST(i AS INTEGER), CAST(n AS INTEGER)))) AS term FROM sq, (SELECT unnest([3,4,5]) AS n)),
        tf AS (SELECT doc_id, term, count(*) AS c FROM grams GROUP BY ALL)
        SELECT term, CAST(sum(c) AS BIGINT) AS tf, count(*) AS df FROM tf GROUP BY term HAVING count(*)<=0.98*(SELECT count(*) FROM documents) ORDER BY tf DESC, term LIMIT 50000""",
)
def f2_char(spark, sf):
    docs = rewarded_texts(spark, sf).select("id", "query")
    return TF.vocabulary(docs, TF.SPECS["char35"]).select("term", "tf", "df")


@register(
    "f2_char_wb_vocabulary",
    rf"""WITH words AS (SELECT doc_id, ' '||unnest(string_split_regex(trim({_CHARS}, chr(32)||chr(9)||chr(10)||chr(13)), '\s+'))||' ' AS s FROM documents),
        grams AS (SELECT doc_id, unnest(list_transform(range(1, length(s)-n+2), lambda i: substr(s, CAST(i AS INTEGER), CAST(n AS INTEGER)))) AS term FROM words, (SELECT unnest([3,4,5]) AS n) WHERE length(s)>2),
        tf AS (SELECT doc_id, term, count(*) AS c FROM grams GROUP BY ALL)
        SELECT term, CAST(sum(c) AS BIGINT) AS tf, count(*) AS df FROM tf GROUP BY term HAVING count(*)<=0.98*(SELECT count(*) FROM documents) ORDER BY tf DESC, term LIMIT 50000""",
)
def f2_char_wb(spark, sf):
    docs = rewarded_texts(spark, sf).select("id", "query")
    return TF.vocabulary(docs, TF.SPECS["charwb35"]).select("term", "tf", "df")


@register(
    "f3_tfidf_knn",
    sql("split", "panel", "den", "rw", word_terms_sql("split"), weights_sql(200000), neighbors_sql(100), KNN_SCORES,
        body="SELECT id, model, round(score,8) AS score FROM knn_all"),
)
def f3(spark, sf):
    train, held = text_split(spark, sf)
    return _r(C.to_long(NB.knn_scores(train, held, MODELS)[100], "score"), "score")


SPLIT_PRIORS = f"""tasks AS (SELECT id, {TASK_SQL} AS task FROM split),
    tp AS (SELECT t.task, r.model, (sum(reward)+20*max(gm.g))/(count(*)+20) AS prior FROM rw r JOIN split s ON s.id=r.id AND NOT s.held_out
      JOIN tasks t ON t.id=r.id JOIN gm ON gm.model=r.model GROUP BY t.task, r.model),
    mixed AS (SELECT k.id, k.model, CAST(0.7 AS DOUBLE)*k.score+(1-CAST(0.7 AS DOUBLE))*coalesce(tp.prior, gm.g) AS score
      FROM knn_all k JOIN tasks t ON t.id=k.id JOIN gm ON gm.model=k.model LEFT JOIN tp ON tp.task=t.task AND tp.model=k.model)"""


@register(
    "f4_task_knn_router",
    sql("split", "panel", "den", "rw", word_terms_sql("split"), weights_sql(200000), neighbors_sql(100), KNN_SCORES, SPLIT_PRIORS,
        body="""SELECT id, model AS pred_model, round(score,8) AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, model) AS rk FROM mixed) WHERE rk=1"""),
)
def f4(spark, sf):
    tagged = rewarded_texts(spark, sf).withColumn("task", task_label(F.col("query")))
    train, held = J.train_and_held(tagged, HELD, SPLIT_SEED)
    return _r(D.decide(NB.task_knn_scores(train, held, MODELS)), "score")


@register(
    "f5_similar_examples",
    sql("split", "panel", "den", "rw", "ranked", word_terms_sql("split"), weights_sql(40000, False, 2), neighbors_sql(5), body="""SELECT nn.id, neighbor_id, rank,
        round(similarity,6) AS similarity, label, round(margin,8) AS margin FROM nn JOIN (SELECT id, max(CASE WHEN rk=1 THEN model END) AS label,
        max(CASE WHEN rk=1 THEN reward END)-max(CASE WHEN rk=2 THEN reward END) AS margin FROM ranked GROUP BY id) l ON l.id=nn.neighbor_id"""),
)
def f5(spark, sf):
    labelled = D.labelled_margins(rewarded_texts(spark, sf))
    train, held = J.train_and_held(labelled, HELD, SPLIT_SEED)
    out = _r(NB.similar_examples(train, held, 5).drop("example"), "margin")
    # The similarity is rounded already; eight of its nine digits would often be a tie.
    return _r(out, "similarity", digits=6)


# --- dense vectors -----------------------------------------------------------------------

VECTORS = f"""ev AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label,
      row_number() OVER (ORDER BY md5('{SPLIT_SEED}:'||vec_id), vec_id) <= greatest(1, round_even(count(*) OVER ()*CAST({HELD} AS DOUBLE),0)) AS held_out FROM embeddings),
    res AS (SELECT vec_id AS id, 'Model_'||chr(CAST(65+m AS INTEGER)) AS model, CAST((vec_id*7+label*13+m*m*5)%41 AS DOUBLE)/40-CAST(0.5 AS DOUBLE) AS residual
      FROM embeddings CROSS JOIN (SELECT CAST(range AS BIGINT) AS m FROM range(11)) ms)"""


def dense_neighbors_sql(k: int, a: str = "vec", b: str = "vec") -> str:
    return f"""dsim AS (SELECT q.id, t.id AS neighbor_id, round(list_dot_product(q.{a}, t.{b}),9) AS similarity FROM ev q, ev t WHERE q.held_out AND NOT t.held_out),
    dn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbor_id) AS rank FROM dsim QUALIFY rank<={k})"""


def vector_split(spark, sf) -> tuple[DataFrame, DataFrame]:
    return J.train_and_held(X.vectors(spark, sf), HELD, SPLIT_SEED)


@register(
    "f6_dense_knn_residual",
    sql(VECTORS, dense_neighbors_sql(50), body="""SELECT dn.id, model, round(sum(greatest(similarity,0)*residual)/sum(greatest(similarity,0)),8) AS score
        FROM dn JOIN res ON res.id=neighbor_id GROUP BY dn.id, model"""),
)
def f6(spark, sf):
    train, held = vector_split(spark, sf)
    return _r(C.to_long(NB.residual_scores(train, held, MODELS), "score"), "score")


@register(
    "f6_corrected_decisions",
    sql(VECTORS, dense_neighbors_sql(50), body="""SELECT id, model AS pred_model, round(s,8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, model) AS rk FROM
        (SELECT c.id, c.model, r.residual+CAST(0.15 AS DOUBLE)*c.score AS s FROM
         (SELECT dn.id, model, sum(greatest(similarity,0)*residual)/sum(greatest(similarity,0)) AS score FROM dn JOIN res ON res.id=neighbor_id GROUP BY dn.id, model) c
         JOIN res r ON r.id=c.id AND r.model=c.model)) WHERE rk=1"""),
)
def f6_decisions(spark, sf):
    train, held = vector_split(spark, sf)
    cell = lambda i, m: F.struct(F.lit(m).alias("model"), F.get(F.col("residuals"), F.lit(i)).alias("score"))
    scored = held.select("id", F.array(*[cell(i, m) for i, m in enumerate(MODELS)]).alias("cells"))
    corrected = NB.apply_residuals(scored, NB.residual_scores(train, held, MODELS), 0.15)
    return _r(D.decide(corrected), "score")


@register(
    "f7_embedding_warm_up",
    sql(
        VECTORS,
        "un AS (SELECT id, held_out, vec, list_transform(vec, lambda x: x/sqrt(list_dot_product(vec,vec))) AS u FROM ev)",
        dense_neighbors_sql(5, "u", "u").replace("ev q, ev t", "un q, un t"),
        """near AS (SELECT id, pos, avg(v) AS m FROM (SELECT dn.id, generate_subscripts(e.vec,1) AS pos, unnest(e.vec) AS v FROM dn JOIN ev e ON e.id=dn.neighbor_id) GROUP BY id, pos),
        own AS (SELECT id, generate_subscripts(vec,1) AS pos, unnest(vec) AS v FROM ev WHERE held_out),
        mix AS (SELECT o.id, o.pos, (1-CAST(0.2 AS DOUBLE))*v+CAST(0.2 AS DOUBLE)*m AS x FROM own o JOIN near n ON n.id=o.id AND n.pos=o.pos)""",
        body="SELECT id, CAST(pos-1 AS INTEGER) AS pos, round(x/sqrt(sum(x*x) OVER (PARTITION BY id)),8) AS x FROM mix",
    ),
)
def f7(spark, sf):
    train, held = vector_split(spark, sf)
    warmed = NB.warm_up(train, held, 64)
    return _r(warmed.select("id", F.posexplode_outer("vec").alias("pos", "x")), "x")


@register("f8_svd_embedding")
def f8(spark, sf):
    train, held = text_split(spark, sf)
    embedder = K.fit_embedder(train.select("id", "query"))
    return K.embed(held.select("id", "query"), embedder).select("id", F.posexplode_outer("vec").alias("pos", "x"))


@register("f9_cluster_prior")
def f9(spark, sf):
    train, held = text_split(spark, sf)
    model = TF.fit(train, TF.SPECS["word12"])
    rows = TF.transform(NB.dense_rewards(train, MODELS), model, keep=("id", "rewards"))
    fallback = P.global_cells(P.global_prior(train))
    return C.to_long(K.cluster_scores(rows, TF.transform(held, model), MODELS, fallback, model.size), "score")
