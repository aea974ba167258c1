"""Registered queries: bias calibration, blending, voting, overrides and candidate grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.operators import audit as A
from signalbox.operators import calibrate as B
from signalbox.operators import ensemble as E
from signalbox.plans import fixtures as X
from signalbox.plans.evaluation import rewarded
from signalbox.plans.fixtures import MODELS, sql
from signalbox.plans.registry import register
from signalbox.plans.scoring import VERSUS_SQL, _method_rewards, _r

# --- calibration ---------------------------------------------------------------------------

BIASES = {m: round(0.01 * (i - 5), 2) for i, m in enumerate(MODELS)}
BIAS_SQL = "bias AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', CAST({b} AS DOUBLE))" for m, b in BIASES.items()) + ") t(model, bias))"


def _search_rows(spark, found: B.BiasSearch) -> DataFrame:
    return found.table(spark).withColumns(
        {
            "reward_initial": F.lit(found.reward_initial),
            "reward_searched": F.lit(found.reward_searched),
            "reward_shrunk": F.lit(found.reward_shrunk),
        }
    )


@register("h1_fit_biases")
def h1(spark, sf):
    return _search_rows(spark, B.fit_biases(rewarded(spark, sf), MODELS))


@register("h2_fit_biases_coarse_to_fine")
def h2(spark, sf):
    return _search_rows(spark, B.fit_biases_coarse_to_fine(rewarded(spark, sf), MODELS, enable=True))


@register(
    "h3_apply_biases",
    sql("panel", "den", "rw", "alpha", BIAS_SQL, body="""SELECT id, model AS pred_model, round(s,8) AS score, round(reward,8) AS reward FROM
        (SELECT a.id, a.model, a.score+b.bias AS s, r.reward, row_number() OVER (PARTITION BY a.id ORDER BY a.score+b.bias DESC, a.model) AS rk
         FROM alpha a JOIN bias b ON b.model=a.model JOIN rw r ON r.id=a.id AND r.model=a.model) WHERE rk=1"""),
)
def h3(spark, sf):
    biases = spark.createDataFrame(list(BIASES.items()), "model STRING, bias DOUBLE")
    biased = B.apply_biases(rewarded(spark, sf), biases)
    best = C.best(F.col("cells"), "score")
    picked = biased.select("id", best["model"].alias("pred_model"), best["value"].alias("score"), "cells")
    out = picked.withColumn("reward", C.value_of(F.col("cells"), F.col("pred_model"), "reward")).drop("cells")
    return _r(out, "score", "reward")


@register(
    "h3_reward_before_after",
    sql("panel", "den", "rw", "alpha", BIAS_SQL, body="""SELECT round(avg(reward) FILTER (WHERE k0=1),8) AS reward_before, round(avg(reward) FILTER (WHERE k1=1),8) AS reward_after FROM
        (SELECT r.reward, row_number() OVER (PARTITION BY a.id ORDER BY a.score DESC, a.model) AS k0,
         row_number() OVER (PARTITION BY a.id ORDER BY a.score+b.bias DESC, a.model) AS k1
         FROM alpha a JOIN bias b ON b.model=a.model JOIN rw r ON r.id=a.id AND r.model=a.model)"""),
)
def h3_rewards(spark, sf):
    biases = spark.createDataFrame(list(BIASES.items()), "model STRING, bias DOUBLE")
    panel = C.add_field(rewarded(spark, sf), "plain", lambda c: c["score"])
    biased = B.apply_biases(panel, biases)
    pick = lambda field: C.best(F.col("cells"), field)["model"]
    rows = biased.select("cells", pick("plain").alias("a"), pick("score").alias("b"))
    value = lambda name: C.value_of(F.col("cells"), F.col(name), "reward")
    out = rows.agg(F.avg(value("a")).alias("reward_before"), F.avg(value("b")).alias("reward_after"))
    return _r(out, "reward_before", "reward_after")


# --- blending ---------------------------------------------------------------------------------

def _scaled_sql(name: str) -> str:
    return f"(SELECT id, model, (score-min(score) OVER (PARTITION BY model))/(max(score) OVER (PARTITION BY model)-min(score) OVER (PARTITION BY model)) AS score FROM {name})"


def sources(spark, sf) -> list[DataFrame]:
    return [X.scores(spark, sf, name) for name in X.SOURCES]


def blocks(spark, sf) -> DataFrame:
    parts = [X.scores(spark, sf, name).withColumn("method", F.lit(name)) for name in X.SOURCES]
    return reduce(DataFrame.unionByName, parts)


@register(
    "i1_weighted_blend",
    sql(*X.SOURCES, body=f"""SELECT a.id, a.model, round(CAST(0.5 AS DOUBLE)*a.score+CAST(0.3 AS DOUBLE)*b.score+CAST(0.2 AS DOUBLE)*g.score,8) AS score
        FROM {_scaled_sql('alpha')} a JOIN {_scaled_sql('beta')} b ON a.id=b.id AND a.model=b.model JOIN {_scaled_sql('gamma')} g ON a.id=g.id AND a.model=g.model"""),
)
def i1(spark, sf):
    return _r(C.to_long(E.blend(sources(spark, sf), [5, 3, 2]), "score"), "score")


@register(
    "i1_equal_unscaled_blend",
    sql(*X.SOURCES, body="""SELECT id, model, round(sum(score)/3,8) AS score FROM (SELECT * FROM alpha UNION ALL SELECT * FROM beta UNION ALL SELECT * FROM gamma) GROUP BY id, model"""),
)
def i1_equal(spark, sf):
    return _r(C.to_long(E.blend(sources(spark, sf), scale="none"), "score"), "score")


def _row_scaled_sql(name: str) -> str:
    return f"""SELECT '{name}' AS method, id, model, (score-min(score) OVER (PARTITION BY id))/CASE WHEN max(score) OVER (PARTITION BY id)-min(score) OVER (PARTITION BY id)>1e-8
        THEN max(score) OVER (PARTITION BY id)-min(score) OVER (PARTITION BY id) ELSE 1 END AS score FROM {name}"""


ROW_SCALED = "rs AS (" + " UNION ALL ".join(_row_scaled_sql(n) for n in X.SOURCES) + ")"


@register("i2_block_average", sql(*X.SOURCES, ROW_SCALED, body="SELECT id, model, round(avg(score),8) AS score FROM rs WHERE method IN ('alpha','gamma') GROUP BY id, model"))
def i2(spark, sf):
    return _r(C.to_long(E.average_blocks(blocks(spark, sf), ["alpha", "gamma"]), "score"), "score")


# --- votes ---------------------------------------------------------------------------------------

# A history of submissions made from suppliers: file name, status and public score.
# Even suppliers share names, odd ones have their own.
HISTORY_SQL = """history AS (SELECT 'file_'||(CASE WHEN s_suppkey%2=0 THEN s_suppkey%23 ELSE 23+s_suppkey END) AS file_name, CASE WHEN s_suppkey%7=3 THEN 'Error' ELSE 'Complete' END AS status,
    CASE WHEN s_suppkey%11=4 THEN NULL ELSE CAST(400+(s_suppkey*37)%100 AS DOUBLE)/1000 END AS public_score FROM supplier)"""


def history(spark, sf) -> DataFrame:
    key = F.col("s_suppkey")
    rows = X.table(spark, sf, "supplier")
    number = F.when(key % 2 == 0, key % 23).otherwise(key + 23)
    return rows.select(
        F.concat(F.lit("file_"), number.cast("string")).alias("file_name"),
        F.when(key % 7 == 3, "Error").otherwise("Complete").alias("status"),
        F.when(key % 11 != 4, (400 + (key * 37) % 100).cast("double") / 1000).alias("public_score"),
    )


_GOOD = "SELECT file_name, public_score FROM history WHERE status='Complete' AND public_score IS NOT NULL AND public_score>=0.42"
_USABLE = {
    "exclude": f"SELECT file_name, max(public_score) AS public_score FROM ({_GOOD}) GROUP BY file_name HAVING count(*)=1",
    "max": f"SELECT file_name, max(public_score) AS public_score FROM ({_GOOD}) GROUP BY file_name",
    "all": _GOOD,
}


def _register_history(policy: str, top_n: int) -> None:
    limit = f"ORDER BY public_score DESC, file_name LIMIT {top_n}" if top_n else ""

    @register(
        f"i3_vote_weights_{policy}",
        sql(HISTORY_SQL, f"u AS ({_USABLE[policy]} {limit})", body="""SELECT file_name, public_score, round(e/sum(e) OVER (),8) AS weight FROM
            (SELECT *, exp((public_score-max(public_score) OVER ())/CAST(0.01 AS DOUBLE)) AS e FROM u)"""),
    )
    def run(spark, sf):
        return _r(E.vote_weights(E.usable_history(history(spark, sf), 0.42, policy, top_n)), "weight")


for _policy, _n in (("exclude", 5), ("max", 5), ("all", 0)):
    _register_history(_policy, _n)


def submissions(spark, sf, files: DataFrame) -> DataFrame:
    """A decision per document and file that votes, shifted by the file number."""
    number = F.split_part("file_name", F.lit("_"), F.lit(2)).cast("long")
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    # The voting files are a few rows, exploded per document from a scalar array.
    names = files.agg(F.array_sort(F.collect_set("file_name")).alias("f")).scalar()
    rows = docs.withColumn("file_name", F.explode(names))
    letter = F.char(65 + (F.col("id") * (number + 1) + F.col("n_chars")) % 9)
    return rows.select("file_name", "id", F.concat(F.lit("Model_"), letter).alias("pred_model"))


VOTES_SQL = f"""u AS ({_USABLE['max']} ORDER BY public_score DESC, file_name LIMIT 5),
    vw AS (SELECT file_name, e/sum(e) OVER () AS weight FROM (SELECT *, exp((public_score-max(public_score) OVER ())/CAST(0.01 AS DOUBLE)) AS e FROM u)),
    votes AS (SELECT doc_id AS id, 'Model_'||chr(CAST(65+(doc_id*(CAST(split_part(file_name,'_',2) AS BIGINT)+1)+n_chars)%9 AS INTEGER)) AS model, sum(weight) AS score
      FROM documents CROSS JOIN vw GROUP BY 1, 2)"""


def votes(spark, sf) -> DataFrame:
    usable = E.usable_history(history(spark, sf), 0.42, "max", 5)
    weights = E.vote_weights(usable)
    return E.vote_scores(submissions(spark, sf, weights), weights)


@register("i3_vote_scores", sql(HISTORY_SQL, VOTES_SQL, body="SELECT id, model, round(score,8) AS score FROM votes"))
def i3(spark, sf):
    return _r(C.to_long(votes(spark, sf), "score"), "score")


@register(
    "i4_base_vote",
    sql(HISTORY_SQL, VOTES_SQL, "base", body="""SELECT id, model, round(sum(s),8) AS score FROM (SELECT id, model, (1-CAST(0.25 AS DOUBLE))*score AS s FROM votes
        UNION ALL SELECT id, pred_model, CAST(0.25 AS DOUBLE) FROM base) GROUP BY id, model"""),
)
def i4(spark, sf):
    return _r(C.to_long(E.add_base_vote(votes(spark, sf), X.base_decisions(spark, sf), 0.25), "score"), "score")


# --- overrides -----------------------------------------------------------------------------------

_GUARDED = """SELECT id, base_pred, score_pred, round(margin,8) AS margin_vs_base, round(gap,8) AS top_gap, coalesce(o,false) AS override,
    CASE WHEN o THEN score_pred ELSE base_pred END AS final_pred FROM """


@register(
    "i5_guarded_overrides",
    sql("alpha", "base", VERSUS_SQL, body=_GUARDED + "(SELECT *, base_pred<>score_pred AND margin>=CAST(0.2 AS DOUBLE) AND gap>=CAST(0.02 AS DOUBLE) AS o FROM versus)"),
)
def i5(spark, sf):
    return _r(E.guarded_overrides(X.scores(spark, sf), X.base_decisions(spark, sf), 0.2, 0.02), "margin_vs_base", "top_gap")


@register(
    "i5_capped_overrides",
    sql("alpha", "base", VERSUS_SQL, body=_GUARDED + """(SELECT v.*, t.id IS NOT NULL AS o FROM versus v LEFT JOIN
        (SELECT id FROM versus WHERE base_pred<>score_pred AND margin>=0 AND gap>=0 ORDER BY margin DESC, gap DESC, id LIMIT 30) t ON t.id=v.id)"""),
)
def i5_capped(spark, sf):
    out = E.guarded_overrides(X.scores(spark, sf), X.base_decisions(spark, sf), max_overrides=30)
    return _r(out, "margin_vs_base", "top_gap")


COUNTS = [5, 10, 20, 40]
CANDIDATES_SQL = "cand AS (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS source, * FROM (SELECT *, row_number() OVER (ORDER BY margin DESC, gap DESC, id) AS rank FROM (SELECT b.id, b.pred_model AS base_pred,
      max(CASE WHEN rk=1 THEN model END) AS score_pred, max(CASE WHEN rk=1 THEN score END)-max(CASE WHEN model=b.pred_model THEN score END) AS margin,
      max(CASE WHEN rk=1 THEN score END)-max(CASE WHEN rk=2 THEN score END) AS gap
      FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, model) AS rk FROM {n}) s JOIN base b ON b.id=s.id GROUP BY b.id, b.pred_model)
      WHERE base_pred<>score_pred)"""
    for n in ("alpha", "beta")
) + f"), sized AS (SELECT * FROM cand CROSS JOIN (SELECT unnest({COUNTS}) AS requested) WHERE rank<=requested)"


def candidates(spark, sf) -> DataFrame:
    two = blocks(spark, sf).where("method <> 'gamma'").withColumnRenamed("method", "source")
    return E.candidate_sets(two, X.base_decisions(spark, sf), COUNTS)


@register(
    "i6_candidate_summary",
    sql("alpha", "beta", "base", CANDIDATES_SQL, body="""SELECT source, CAST(requested AS INTEGER) AS requested, CAST(sum(n) AS BIGINT) AS actual,
        string_agg(base_pred||'->'||score_pred||':'||n, '; ' ORDER BY base_pred, score_pred) AS transitions
        FROM (SELECT source, requested, base_pred, score_pred, count(*) AS n FROM sized GROUP BY ALL) GROUP BY source, requested"""),
)
def i6(spark, sf):
    return E.candidate_summary(candidates(spark, sf))


@register(
    "i6_candidate_decisions",
    sql("alpha", "beta", "base", CANDIDATES_SQL, body="""SELECT s.source, CAST(s.requested AS INTEGER) AS requested, b.id, coalesce(c.score_pred, b.pred_model) AS pred_model
        FROM base b CROSS JOIN (SELECT DISTINCT source, requested FROM sized) s LEFT JOIN sized c ON c.source=s.source AND c.requested=s.requested AND c.id=b.id"""),
)
def i6_decisions(spark, sf):
    return E.apply_candidates(X.base_decisions(spark, sf), candidates(spark, sf))


# --- methods and grid --------------------------------------------------------------------------

@register(
    "i7_final_methods",
    sql("panel", "den", "rw", *X.SOURCES, """mboard AS (""" + " UNION ALL ".join(
        f"""SELECT '{n}' AS method, avg(reward) AS mean FROM rw r JOIN (SELECT id, model, row_number() OVER (PARTITION BY id ORDER BY score DESC, model) AS rk FROM {n}) s
        ON s.id=r.id AND s.model=r.model AND s.rk=1""" for n in X.SOURCES) + ")",
        body="SELECT CAST(row_number() OVER (ORDER BY mean DESC, method) AS INTEGER) AS rank, method FROM mboard ORDER BY mean DESC LIMIT 2"),
)
def i7(spark, sf):
    board = A.cv_summary(_method_rewards(spark, sf))
    names = E.final_methods(list(X.SOURCES), 2, board)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "rank INT, method STRING")


GRID_METHODS = ["gamma", "alpha", "beta"]
GRID_SQL = """place AS (SELECT * FROM (VALUES ('gamma',0),('alpha',1),('beta',2)) t(method, place)),
    av AS (SELECT top_n, id, model, avg(score) AS score FROM rs JOIN place p ON p.method=rs.method CROSS JOIN (SELECT unnest([1,3]) AS top_n) WHERE place<top_n GROUP BY top_n, id, model),
    sm AS (SELECT top_n, id, model, score, e/sum(e) OVER (PARTITION BY top_n, id) AS p FROM (SELECT *, exp((score-max(score) OVER (PARTITION BY top_n, id))/CAST(0.08 AS DOUBLE)) AS e FROM av)),
    mx AS (SELECT top_n, bw AS base_weight, sm.id, model, pred_model AS base_pred, CASE WHEN bw=0 THEN score ELSE (1-bw)*p+CASE WHEN model=pred_model THEN bw ELSE 0 END END AS s
      FROM sm JOIN base ON base.id=sm.id CROSS JOIN (SELECT unnest([0.0::DOUBLE,0.15,0.25,0.35,0.45]) AS bw)),
    grid AS (SELECT * FROM mx QUALIFY row_number() OVER (PARTITION BY top_n, base_weight, id ORDER BY round(s,12) DESC, model)=1)"""


def grid(spark, sf) -> DataFrame:
    return E.candidate_grid(blocks(spark, sf), GRID_METHODS, X.base_decisions(spark, sf))


@register(
    "i8_candidate_grid",
    sql(*X.SOURCES, "base", ROW_SCALED, GRID_SQL, body="SELECT CAST(top_n AS INTEGER) AS top_n, base_weight, id, model AS pred_model, round(s,8) AS score FROM grid"),
)
def i8(spark, sf):
    return _r(grid(spark, sf).drop("_base"), "score")


@register(
    "i8_grid_summary",
    sql(*X.SOURCES, "base", ROW_SCALED, GRID_SQL, body="""SELECT CAST(top_n AS INTEGER) AS top_n, base_weight, count(*) FILTER (WHERE model<>base_pred) AS changed_vs_base, count(*) AS n
        FROM grid GROUP BY top_n, base_weight"""),
)
def i8_summary(spark, sf):
    return E.grid_summary(grid(spark, sf))
