"""Registered queries: sources, rewards, normalisations, argmax and ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.functions import cells as C
from signalbox.functions.scalars import is_id_only, parse_label, sigmoid, truncate_text
from signalbox.functions.tasks import with_task_profile, task_label
from signalbox.operators import decide as D
from signalbox.operators import normalize as N
from signalbox.operators import rewards as R
from signalbox.plans import fixtures as X
from signalbox.plans.fixtures import MODELS, sql
from signalbox.plans.registry import register
from signalbox.session import ensure_checkpoint_dir
from signalbox.sources import tables as S


def _r(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    """Round for the comparison with SQL.

    Means of the derived rewards can end exactly at the seventh decimal, so fewer digits would
    leave the rounding to the order of the sum.
    """
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def scratch(spark, name: str) -> str:
    """A new folder name below the checkpoints for a query that writes and reads back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ---------------------------------------------------------------

@register(
    "a1_csv_round_trip",
    sql("panel", body="""SELECT id, query, round(sum(performance),8) AS performance, round(sum(cost),8) AS cost
        FROM panel GROUP BY id, query"""),
)
def a1(spark, sf):
    folder = scratch(spark, "frame")
    X.wide(spark, sf).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)
    frame = S.read_frame(spark, folder, S.frame_schema(MODELS))
    total = lambda suffix: sum((F.col(m + suffix) for m in MODELS[1:]), F.col(MODELS[0] + suffix))
    out = frame.select(
        F.col("ID").alias("id"), "query", total("_performance").alias("performance"), total("_cost").alias("cost")
    )
    return _r(out, "performance", "cost")


@register(
    "a1_deterministic_head",
    "SELECT doc_id AS id, n_chars FROM documents ORDER BY doc_id LIMIT 25",
)
def a1_head(spark, sf):
    return S.read_frame(spark, f"{sf}/documents.parquet", limit=25, id_column="doc_id").select(
        F.col("doc_id").alias("id"), "n_chars"
    )


@register("a2_wide_to_long", sql("panel", body="SELECT id, query, model, performance, cost FROM panel"))
def a2(spark, sf):
    return C.to_long(X.panel(spark, sf), "performance", "cost", keep=("id", "query"))


@register(
    "a2_dropped_cells",
    sql("panel", body="SELECT model, CAST(count(*) FILTER (WHERE performance < 0.02) AS BIGINT) AS dropped FROM panel GROUP BY model"),
)
def a2_dropped(spark, sf):
    wide = X.wide(spark, sf)
    holes = {f"{m}_performance": F.when(F.col(f"{m}_performance") >= 0.02, F.col(f"{m}_performance")) for m in MODELS}
    return S.dropped_cells(wide.withColumns(holes))


@register(
    "a3_decision_sink",
    sql("panel", "den", "rw", "ranked", body='SELECT id, model AS pred_model FROM ranked WHERE rk=1'),
)
def a3(spark, sf):
    folder = scratch(spark, "decisions")
    S.write_decisions(D.decide(R.add_reward(X.panel(spark, sf), "mean-row-max"), "reward"), folder)
    return S.read_decisions(spark, folder)


@register(
    "a4_score_store",
    sql("alpha", "beta", body="SELECT id, model, score FROM alpha UNION ALL SELECT id, model, score FROM beta"),
)
def a4(spark, sf):
    folder = scratch(spark, "scores")
    both = None
    for name in ("alpha", "beta"):
        part = C.to_long(X.scores(spark, sf, name), "score").withColumn("method", F.lit(name))
        both = part if both is None else both.unionByName(part)
    S.write_scores(both, folder)
    return S.read_scores(spark, folder, MODELS, "alpha").drop("method").unionByName(
        S.read_scores(spark, folder, MODELS, "beta").drop("method")
    )


@register("a4_wide_score_columns", sql("alpha", body="SELECT id, model, score FROM alpha"))
def a4_wide(spark, sf):
    export = S.wide_export(X.scores(spark, sf), MODELS, {"score": "_reward"}).withColumnRenamed("id", "ID")
    return C.to_long(S.wide_scores_to_cells(export, MODELS), "score")


_WIDE = ", ".join(
    f"round(max(CASE WHEN model='{m}' THEN {f} END),8) AS {m}{suffix}"
    for m in MODELS
    for f, suffix in (("performance", "_pred_performance"), ("cost", "_pred_cost"), ("reward", "_score"))
)


@register("a5_wide_export", sql("panel", "den", "rw", body=f"SELECT id, {_WIDE} FROM rw GROUP BY id"))
def a5(spark, sf):
    fields = {"performance": "_pred_performance", "cost": "_pred_cost", "reward": "_score"}
    out = S.wide_export(R.add_reward(X.panel(spark, sf), "mean-row-max"), MODELS, fields)
    return _r(out, *[c for c in out.columns if c != "id"])


@register(
    "a6_router_parameters",
    sql("panel", body="""SELECT model, round(avg(cost),8) AS cost_mean, round(stddev_pop(cost),8) AS cost_std,
        CAST(0 AS DOUBLE) AS score_bias, CAST(1 AS DOUBLE) AS ranking_loss_weight FROM panel GROUP BY model"""),
)
def a6(spark, sf):
    folder = scratch(spark, "parameters")
    S.save_parameters(R.fit_cost_scaler(X.panel(spark, sf)), folder)
    out = S.load_parameters(spark, folder, MODELS)
    return _r(out.select("model", "cost_mean", "cost_std", "score_bias", "ranking_loss_weight"), "cost_mean", "cost_std")


@register(
    "a7_resume_decisions",
    sql("panel", "den", "rw", "ranked", "base", body="""
        SELECT d.doc_id AS id, CASE WHEN e.id IS NOT NULL THEN e.pred_model ELSE f.model END AS pred_model,
          CASE WHEN e.id IS NOT NULL THEN 'earlier' ELSE 'fresh' END AS decision_source
        FROM documents d
        LEFT JOIN (SELECT * FROM base WHERE pred_model NOT IN ('Model_J','Model_K')) e ON e.id=d.doc_id
        JOIN ranked f ON f.id=d.doc_id AND f.rk=1"""),
)
def a7(spark, sf):
    allowed = MODELS[:9]
    fresh = D.decide(R.add_reward(X.panel(spark, sf), "mean-row-max"), "reward")
    queries = X.panel(spark, sf).select("id")
    resumed = S.resume_decisions(queries, X.base_decisions(spark, sf), fresh, allowed)
    folder = scratch(spark, "log") + "/decisions"
    S.append_decision_log(resumed.where("decision_source = 'earlier'"), folder)
    S.append_decision_log(resumed.where("decision_source = 'fresh'"), folder)
    return spark.read.schema("id BIGINT, pred_model STRING, decision_source STRING").json(folder)


# --- rewards and cost norms -----------------------------------------------------------

@register("b1_reward", sql("panel", "den", "rwg", body="SELECT id, model, round(norm_cost,8) AS norm_cost, round(reward,8) AS reward FROM rwg"))
def b1(spark, sf):
    return _r(C.to_long(R.add_reward(X.panel(spark, sf)), "norm_cost", "reward"), "norm_cost", "reward")


_NORMS = {
    "mean_row_max": ("mean-row-max", "cost/(SELECT r FROM den)"),
    "row_max": ("row-max", "cost/max(cost) OVER (PARTITION BY id)"),
    "none": ("none", "cost"),
    "minmax_global": ("minmax-global", "(cost-min(cost) OVER ())/(max(cost) OVER ()-min(cost) OVER ())"),
    "minmax_per_model": (
        "minmax-per-model",
        "(cost-min(cost) OVER (PARTITION BY model))/(max(cost) OVER (PARTITION BY model)-min(cost) OVER (PARTITION BY model))",
    ),
    "zscore_global": (
        "zscore-global",
        "(cost-(SELECT avg(cost) FROM panel))/(SELECT stddev_samp(cost) FROM panel)",
    ),
}


def _register_norm(name: str, method: str, expression: str) -> None:
    @register(f"b2_cost_norm_{name}", sql("panel", "den", body=f"SELECT id, model, round({expression},8) AS norm_cost FROM panel"))
    def run(spark, sf):
        return _r(C.to_long(R.normalize_cost(X.panel(spark, sf), method), "norm_cost"), "norm_cost")


for _name, (_method, _expression) in _NORMS.items():
    _register_norm(_name, _method, _expression)


@register(
    "b2_sparse_panel_reward",
    sql("sparse", body="""SELECT id, model, round(CAST(0.85 AS DOUBLE)*performance-(1-CAST(0.85 AS DOUBLE))*cost/
        (SELECT avg(mx) FROM (SELECT max(cost) AS mx FROM sparse GROUP BY id)),6) AS reward FROM sparse"""),
)
def b2_sparse(spark, sf):
    return _r(C.to_long(R.add_reward(X.sparse_panel(spark, sf), "mean-row-max"), "reward"), "reward", digits=6)


@register(
    "b3_cost_scaler",
    sql("panel", body="""SELECT id, p.model, round((cost-m)/s,8) AS z_cost, round(greatest(0, m+s*((cost-m)/s)),8) AS pred_cost
        FROM panel p JOIN (SELECT model, avg(cost) AS m, stddev_pop(cost) AS s FROM panel GROUP BY model) q ON p.model=q.model"""),
)
def b3(spark, sf):
    panel = X.panel(spark, sf)
    scaler = R.fit_cost_scaler(panel)
    return _r(C.to_long(R.restore_cost(R.standardize_cost(panel, scaler), scaler), "z_cost", "pred_cost"), "z_cost", "pred_cost")


@register(
    "b4_plug_in_score",
    sql("panel", "den", body="""SELECT id, model, round((1-CAST(0.4 AS DOUBLE))*performance
        -CAST(0.4 AS DOUBLE)*(cost/(SELECT g FROM den)),8) AS score FROM panel"""),
)
def b4(spark, sf):
    panel = X.panel(spark, sf)
    scaler = R.fit_cost_scaler(panel)
    out = R.plug_in_scores(R.standardize_cost(panel, scaler), scaler, R.denominator(panel, "global-max", "eps"), 0.4)
    return _r(C.to_long(out, "score"), "score")


@register(
    "b5_clipped_score",
    sql("panel", "alpha", body="""SELECT p.id, p.model, round(CAST(0.85 AS DOUBLE)*least(1, greatest(0, a.score*2-CAST(0.5 AS DOUBLE)))
        -(1-CAST(0.85 AS DOUBLE))*greatest(0, p.performance-CAST(0.5 AS DOUBLE)),8) AS score
        FROM panel p JOIN alpha a ON p.id=a.id AND p.model=a.model"""),
)
def b5(spark, sf):
    panel = X.scored_panel(spark, sf)
    raw = C.add_field(panel, "p", lambda c: c["score"] * 2 - F.lit(0.5))
    raw = C.add_field(raw, "k", lambda c: c["performance"] - F.lit(0.5))
    return _r(C.to_long(R.router_scores(raw, "p", "k"), "score"), "score")


@register(
    "b6_rescore_changed",
    sql("panel", "den", body="""SELECT CAST(count(*) FILTER (WHERE a.model<>b.model) AS BIGINT) AS changed, count(*) AS compared,
          round((SELECT q/(1+q) FROM (SELECT (1-CAST(0.85 AS DOUBLE))/CAST(0.85 AS DOUBLE)*(g/r) AS q FROM den)),8) AS cost_weight
        FROM (SELECT id, model, row_number() OVER (PARTITION BY id ORDER BY
                CAST(0.85 AS DOUBLE)*performance-(1-CAST(0.85 AS DOUBLE))*(cost/(SELECT g FROM den)) DESC, model) AS rk FROM panel) a
        JOIN (SELECT id, model, row_number() OVER (PARTITION BY id ORDER BY
                (1-(SELECT q/(1+q) FROM (SELECT (1-CAST(0.85 AS DOUBLE))/CAST(0.85 AS DOUBLE)*(g/r) AS q FROM den)))*performance
                -(SELECT q/(1+q) FROM (SELECT (1-CAST(0.85 AS DOUBLE))/CAST(0.85 AS DOUBLE)*(g/r) AS q FROM den))*(cost/(SELECT g FROM den)) DESC, model) AS rk FROM panel) b
          ON a.id=b.id AND a.rk=1 AND b.rk=1"""),
)
def b6(spark, sf):
    panel = X.panel(spark, sf)
    old, new = R.denominator(panel, "global-max"), R.denominator(panel, "mean-row-max")
    # Both decisions come from the same row, so the comparison needs no join.
    both = R.rescore(R.add_reward(panel, "global-max"), "cost", old, new)
    cells = F.col("cells")
    picks = both.select(C.best(cells, "reward")["model"].alias("a"), C.best(cells, "score")["model"].alias("b"))
    out = picks.agg(F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count(F.lit(1)).alias("compared"))
    return _r(out.withColumn("cost_weight", R.equivalent_cost_weight(old, new)), "cost_weight")


@register(
    "b7_row_softmax",
    sql("panel", "den", "rw", body="""SELECT id, model, round(e/sum(e) OVER (PARTITION BY id),8) AS probability FROM
        (SELECT id, model, exp((reward-max(reward) OVER (PARTITION BY id))/CAST(0.05 AS DOUBLE)) AS e FROM rw)"""),
)
def b7(spark, sf):
    out = N.row_softmax(R.add_reward(X.panel(spark, sf), "mean-row-max"), "reward", 0.05)
    return _r(C.to_long(out, "probability"), "probability")


@register(
    "b8_clipped_sigmoid",
    sql("alpha", body="SELECT id, model, round(1/(1+exp(-least(30,greatest(-30,(score-CAST(0.5 AS DOUBLE))*100)))),8) AS p FROM alpha"),
)
def b8(spark, sf):
    out = C.add_field(X.scores(spark, sf), "p", lambda c: sigmoid((c["score"] - F.lit(0.5)) * 100))
    return _r(C.to_long(out, "p"), "p")


@register(
    "b9_row_minmax",
    sql("alpha", body="""SELECT id, model, round((score-lo)/CASE WHEN hi-lo>1e-8 THEN hi-lo ELSE 1 END,8) AS score FROM
        (SELECT *, min(score) OVER (PARTITION BY id) AS lo, max(score) OVER (PARTITION BY id) AS hi FROM alpha)"""),
)
def b9(spark, sf):
    return _r(C.to_long(N.row_minmax(X.scores(spark, sf)), "score"), "score")


@register(
    "b10_model_minmax",
    sql("beta", body="""SELECT id, model, round((score-lo)/CASE WHEN hi-lo>1e-12 THEN hi-lo ELSE 1 END,8) AS score FROM
        (SELECT *, min(score) OVER (PARTITION BY model) AS lo, max(score) OVER (PARTITION BY model) AS hi FROM beta)"""),
)
def b10(spark, sf):
    return _r(C.to_long(N.model_minmax(X.scores(spark, sf, "beta")), "score"), "score")


# --- text rules ------------------------------------------------------------------------

_B = r"(^|[^\p{L}\p{N}_])"
_E = r"($|[^\p{L}\p{N}_])"


def _has(pattern: str, text: str = "query") -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _word(words: str) -> str:
    return f"{_B}({words}){_E}"


TASK_SQL = f"""CASE
 WHEN {_has(r"(?i)```|<code>|<issue>|traceback|diff --git|sample input|sample output|constraints\s*\n|" + _word("def|class|import|function") + "|" + _word("pytest|github|bug|exception|error|leetcode|codeforces|atcoder"))} THEN 'coding'
 WHEN {_has(r"(?i)\\frac|\\sqrt|\\sum|\\int|\$|" + _word("prove|solve|equation|integer|prime|probability|triangle|matrix|derivative|integral|geometry|algebra"))} THEN 'math'
 WHEN {_has("[぀-ヿ㐀-䶿一-鿿가-힯]")} THEN 'multilingual'
 WHEN {_has("(?i)" + _word("physics|chemistry|biology|molecule|protein|gene|cell|disease|reaction|velocity|force|pressure|temperature|organism|experiment"))} THEN 'science'
 WHEN {_has(r"(?i)^\s*(who|what|when|where|which|how many|how much|in what|why)" + _E)} THEN 'factual_qa'
 WHEN {_has("(?i)" + _word("write|rewrite|summarize|summary|story|poem|haiku|creative|compose|translate|tone|style|email|essay"))} THEN 'creative_language'
 WHEN {_has("(?i)" + _word("order|cancel|refund|return|tracking|booking|reservation|profile|cart|customer|agent|tool|api call|function call"))} THEN 'agentic'
 WHEN {_has("(?i)" + _word("riddle|logic puzzle|deduce|infer|correct order|arrange|constraint|reason step by step|which statement"))}
   OR (contains(lower(query),'step by step') AND NOT contains(lower(query),'explain')) THEN 'reasoning'
 ELSE 'general' END"""


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(query),'{w}')" for w in words) + ")"


def _profile_sql() -> str:
    from signalbox.functions import tasks as T

    return f"""CASE
 WHEN {_has(r"(?i)^\s*ARC-AGI Task" + _E)} THEN 'arc_agi/grid_abstraction'
 WHEN {_has("(?i)<issue>|<code>|partial code base|traceback|" + _word("diff --git|pytest|github|bug|regression|exception|error"))} THEN 'coding/repository_issue'
 WHEN {_has(r"(?i)Sample Input|Sample Output|" + _B + r"(Input\s*\n|Output\s*\n)|Constraints\s*\n|Standard Input|AtCoder|Codeforces")} THEN 'coding/competitive_programming'
 WHEN {_has("(?i)```|" + _B + r"(def\s+[\p{L}\p{N}_]+\s*\(|class\s+[\p{L}\p{N}_]|import\s+[\p{L}\p{N}_]|function\s+[\p{L}\p{N}_])|" + _word(r"public\s+class"))} THEN 'coding/code_generation'
 WHEN {_has("[぀-ヿ㐀-䶿一-鿿]")} AND {_any(T.MULTILINGUAL_WRITING_WORDS)} THEN 'creative_language/multilingual_writing'
 WHEN {_has("[぀-ヿ㐀-䶿一-鿿]")} THEN 'multilingual/non_english'
 WHEN {_has(r"(?i)\\frac|\\sqrt|\$|\\log_|" + _word("Find|Let|probability|integer|triangle|parabola|prime|divisor"))} THEN 'math/symbolic_reasoning'
 WHEN {_any(T.SCIENCE_WORDS)} THEN 'science/science_qa'
 WHEN {_has(r"(?i)^(Who|What|When|Where|Which|How many|In what|The .* called)" + _E, "trim(query, chr(32)||chr(9)||chr(10)||chr(13))")} THEN 'factual_qa/short_answer'
 WHEN {_any(T.WRITING_WORDS)} THEN 'creative_language/writing_summarization'
 WHEN {_any(T.INSTRUCTION_WORDS)} THEN 'agentic/instruction_following'
 WHEN {_any(T.PUZZLE_WORDS)} THEN 'reasoning/puzzle'
 ELSE 'general/general' END"""


PROFILE_SQL = _profile_sql()
LEVEL_SQL = "CASE WHEN length(query)>=2500 THEN 'hard' WHEN length(query)>=700 THEN 'medium' ELSE 'easy' END"


@register(
    "b11_task_label",
    sql("prompted", body=f"""SELECT 'prompted' AS origin, id, {TASK_SQL} AS task FROM prompted
      UNION ALL SELECT 'documents', doc_id, {TASK_SQL} FROM (SELECT doc_id, text AS query FROM documents)
      UNION ALL SELECT 'conversations', conv_id*1000+turn, {TASK_SQL} FROM (SELECT conv_id, turn, text AS query FROM conversations)"""),
)
def b11(spark, sf):
    talk = X.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("query"))
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("query"))
    tagged = lambda df, name: df.select(F.lit(name).alias("origin"), "id", task_label(F.col("query")).alias("task"))
    return tagged(X.prompted(spark, sf), "prompted").unionByName(tagged(docs, "documents")).unionByName(tagged(talk, "conversations"))


@register(
    "b12_task_profile",
    sql("prompted", body=f"""SELECT id, split_part(k,'/',1) AS task_domain, split_part(k,'/',2) AS task_subtask, d AS task_difficulty,
        k||'/'||d AS task_profile, k AS task_subtask_key FROM (SELECT id, {PROFILE_SQL} AS k, {LEVEL_SQL} AS d FROM prompted)"""),
)
def b12(spark, sf):
    return with_task_profile(X.prompted(spark, sf)).drop("query")


@register(
    "b13_id_only_family",
    sql("prompted", body=r"SELECT id, regexp_full_match(trim(query, chr(32)||chr(10)), 'ARC-AGI Task [0-9a-fA-F]+') AS id_only FROM prompted"),
)
def b13(spark, sf):
    return X.prompted(spark, sf).select("id", is_id_only(F.col("query")).alias("id_only"))


@register(
    "b14_truncate_text",
    r"""SELECT conv_id, turn, CASE WHEN length(text)>60 THEN regexp_replace(substr(text,1,60),'\s+$','')||chr(10)||'[truncated]' ELSE text END AS text
        FROM conversations""",
)
def b14(spark, sf):
    return X.table(spark, sf, "conversations").select("conv_id", "turn", truncate_text(F.col("text"), 60).alias("text"))


@register(
    "b15_implied_cost",
    sql("panel", "den", "rw", body="""SELECT id, model, round(greatest(0,(CAST(0.85 AS DOUBLE)*performance-reward)/(1-CAST(0.85 AS DOUBLE))),8) AS implied_cost FROM rw"""),
)
def b15(spark, sf):
    out = R.add_implied_cost(R.add_reward(X.panel(spark, sf), "mean-row-max"))
    return _r(C.to_long(out, "implied_cost"), "implied_cost")


# Answers as a judge might word them, made from conversation rows; {m} is a label, {t} the text.
ANSWER_FORMS = [
    "{m}", " `{m}` ", '"{m}"', '{"label": "{m}"}', '```{"pred_model":"Model_Z","answer":"{m}"}```', "I pick {m}.",
    "Model_Z or {m}, {t}", "{t}", "", '{"model": 3, "label": " {m} "}', "xModel_A {m}", "{\"label\": {\"x\": \"{m}\"}}",
]


def answers(spark, sf) -> DataFrame:
    talk = X.table(spark, sf, "conversations")
    key = F.col("conv_id") * 7 + F.col("turn")
    label = F.concat(F.lit("Model_"), F.char(65 + key % 11))
    form = F.get(F.lit(ANSWER_FORMS), (key % len(ANSWER_FORMS)).cast("int"))
    clean = F.regexp_replace(F.col("text"), r"[{}\"`]", "")
    return talk.select("conv_id", "turn", F.replace(F.replace(form, F.lit("{m}"), label), F.lit("{t}"), clean).alias("raw_response"))


_FORMS_SQL = "[" + ", ".join("'" + f.replace("'", "''") + "'" for f in ANSWER_FORMS) + "]"
ANSWERS_SQL = rf"""answers AS (SELECT conv_id, turn, replace(replace({_FORMS_SQL}[CAST((conv_id*7+turn)%{len(ANSWER_FORMS)}+1 AS INTEGER)],
    '{{m}}', 'Model_'||chr(CAST(65+(conv_id*7+turn)%11 AS INTEGER))), '{{t}}', regexp_replace(text, '[{{}}"`]', '', 'g')) AS raw_response FROM conversations)"""
_ALLOWED_SQL = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"
PARSED_SQL = rf"""parsed AS (SELECT *, coalesce(
      {", ".join(f"CASE WHEN json_type(doc,'$.{k}')='VARCHAR' AND list_contains({_ALLOWED_SQL}, trim(json_extract_string(doc,'$.{k}'))) THEN trim(json_extract_string(doc,'$.{k}')) END" for k in ("pred_model", "label", "model", "answer"))}) AS by_key,
      list_filter(regexp_extract_all(regexp_replace(bare, '([\p{{L}}\p{{N}}_]+)', ' \1 ', 'g'), '(?:^| )(Model_[A-Za-z]) ', 1), lambda x: list_contains({_ALLOWED_SQL}, x))[1] AS mention
    FROM (SELECT *, CASE WHEN json_valid(bare) AND starts_with(bare, '{{') THEN bare ELSE '{{}}' END AS doc FROM
      (SELECT *, trim(trim(trim(trim(raw_response, chr(32)||chr(10)), '`'), chr(32)||chr(10)), '"''') AS bare FROM answers)))"""


@register(
    "b16_parse_label",
    sql(ANSWERS_SQL, PARSED_SQL, body=f"""SELECT conv_id, turn,
        coalesce(by_key, CASE WHEN list_contains({_ALLOWED_SQL}, bare) THEN bare END, mention) AS label FROM parsed"""),
)
def b16(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", parse_label(F.col("raw_response"), MODELS).alias("label"))


# --- argmax and ranking -----------------------------------------------------------------

@register("c1_oracle_label", sql("panel", "den", "rw", "ranked", body="SELECT id, model AS label, round(reward,8) AS oracle_reward FROM ranked WHERE rk=1"))
def c1(spark, sf):
    return _r(D.oracle(R.add_reward(X.panel(spark, sf), "mean-row-max")), "oracle_reward")


@register(
    "c1_sparse_oracle_label",
    sql("sparse", body="""SELECT id, model AS label, round(reward,6) AS oracle_reward FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY reward DESC, model) AS rk
        FROM (SELECT id, model, CAST(0.85 AS DOUBLE)*performance-(1-CAST(0.85 AS DOUBLE))*(cost/(SELECT max(cost) FROM sparse)) AS reward FROM sparse)) WHERE rk=1"""),
)
def c1_sparse(spark, sf):
    return _r(D.oracle(R.add_reward(X.sparse_panel(spark, sf))), "oracle_reward", digits=6)


@register(
    "c2_route_decision",
    sql("alpha", body="""SELECT id, model AS pred_model, round(score,8) AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, model) AS rk FROM alpha) WHERE rk=1"""),
)
def c2(spark, sf):
    return _r(D.decide(X.scores(spark, sf)), "score")


@register("c3_constant_board", sql("panel", "den", "rw", body="SELECT model, round(avg(reward),8) AS mean_reward, count(*) AS n FROM rw GROUP BY model"))
def c3(spark, sf):
    return _r(D.constant_board(R.add_reward(X.panel(spark, sf), "mean-row-max")), "mean_reward")


@register(
    "c3_global_best_policy",
    sql("panel", "den", "rw", body="SELECT doc_id AS id, (SELECT model FROM rw GROUP BY model ORDER BY avg(reward) DESC, model LIMIT 1) AS pred_model FROM documents"),
)
def c3_policy(spark, sf):
    panel = R.add_reward(X.panel(spark, sf), "mean-row-max")
    return D.global_best_policy(panel, panel)


@register("c3_named_constant", "SELECT doc_id AS id, 'Model_F' AS pred_model FROM documents")
def c3_constant(spark, sf):
    return D.constant_policy(X.panel(spark, sf), "Model_F", MODELS)


_MARGIN = "max(CASE WHEN rk=1 THEN reward END)-max(CASE WHEN rk=2 THEN reward END)"


@register(
    "c4_margins",
    sql("panel", "den", "rw", "ranked", body=f"SELECT id, round({_MARGIN},8) AS margin, round(least(1,greatest(0,{_MARGIN})),8) AS clipped_margin FROM ranked GROUP BY id"),
)
def c4(spark, sf):
    return _r(D.margins(R.add_reward(X.panel(spark, sf), "mean-row-max")), "margin", "clipped_margin")


@register(
    "c5_examples_per_label",
    sql("panel", "den", "rw", "ranked", body=rf"""SELECT id, label, round(margin,8) AS margin,
        CASE WHEN length(query)>600 THEN regexp_replace(substr(query,1,600),'\s+$','')||chr(10)||'[truncated]' ELSE query END AS query, rank FROM
        (SELECT *, row_number() OVER (PARTITION BY label ORDER BY margin DESC, id) AS rank FROM
         (SELECT id, max(query) AS query, max(CASE WHEN rk=1 THEN model END) AS label, {_MARGIN} AS margin FROM ranked GROUP BY id)) WHERE rank<=3"""),
)
def c5(spark, sf):
    labelled = D.labelled_margins(R.add_reward(X.panel(spark, sf), "mean-row-max"))
    return _r(D.top_per_label(labelled, 3, 600), "margin")


VERSUS_SQL = """versus AS (SELECT b.id, b.pred_model AS base_pred, max(CASE WHEN rk=1 THEN model END) AS score_pred,
    max(CASE WHEN rk=1 THEN score END)-max(CASE WHEN model=b.pred_model THEN score END) AS margin,
    max(CASE WHEN rk=1 THEN score END)-max(CASE WHEN rk=2 THEN score END) AS gap
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, model) AS rk FROM alpha) s
    JOIN base b ON b.id=s.id GROUP BY b.id, b.pred_model)"""


@register(
    "c6_override_candidates",
    sql("alpha", "base", VERSUS_SQL, body="""SELECT id, base_pred, score_pred, round(margin,8) AS margin_vs_base, round(gap,8) AS top_gap FROM versus
        WHERE base_pred<>score_pred ORDER BY margin DESC, gap DESC, id LIMIT 40"""),
)
def c6(spark, sf):
    out = D.override_candidates(X.scores(spark, sf), X.base_decisions(spark, sf), 40)
    return _r(out, "margin_vs_base", "top_gap")


def _method_rewards(spark, sf) -> DataFrame:
    """Reward of each score source's decisions, long by method."""
    panel = R.add_reward(X.panel(spark, sf), "mean-row-max")
    out = None
    for name in X.SOURCES:
        value = D.gather(panel, D.decide(X.scores(spark, sf, name)), "reward", "reward").withColumn("method", F.lit(name))
        out = value if out is None else out.unionByName(value)
    return out


METHODS_SQL = "methods AS (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS method, r.id, r.reward FROM rw r JOIN (SELECT id, model, row_number() OVER (PARTITION BY id ORDER BY score DESC, model) AS rk
    FROM {n}) s ON s.id=r.id AND s.model=r.model AND s.rk=1""" for n in X.SOURCES
) + ")"


@register(
    "c7_method_leaderboard",
    sql("panel", "den", "rw", *X.SOURCES, METHODS_SQL, body="""SELECT method, round(avg(reward),8) AS mean_reward, count(*) AS n,
        CAST(row_number() OVER (ORDER BY avg(reward) DESC, method) AS INTEGER) AS rank FROM methods GROUP BY method"""),
)
def c7(spark, sf):
    return _r(D.leaderboard(_method_rewards(spark, sf)), "mean_reward")


@register(
    "c8_frequencies",
    sql("prompted", body=f"""SELECT label, n, round(n/sum(n) OVER (),8) AS share FROM
        (SELECT k AS label, count(*) AS n FROM (SELECT {PROFILE_SQL} AS k FROM prompted) GROUP BY k ORDER BY n DESC, label LIMIT 12)"""),
)
def c8(spark, sf):
    return _r(D.frequencies(with_task_profile(X.prompted(spark, sf)), "task_subtask_key", 12), "share")


@register(
    "c8_formatted_counts",
    sql("base", body="""SELECT string_agg(label||'='||n||' ('||printf('%.1f', round(100.0*n/t,9))||'%)', ', ' ORDER BY n DESC, label) AS counts FROM
        (SELECT pred_model AS label, count(*) AS n, sum(count(*)) OVER () AS t FROM base GROUP BY pred_model)"""),
)
def c8_text(spark, sf):
    counts = X.base_decisions(spark, sf).groupBy(F.col("pred_model").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return D.format_counts(counts)
