"""Queries over scores, costs, state changes and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.adapters import AS_OF, SCORES_AS_OF
from folio.functions import pdf
from folio.functions import text as T
from folio.operators import catalog as C
from folio.operators import cost as K
from folio.operators import quality as Q
from folio.operators import state as S
from folio.plans.registry import Tables, query

_T = f"TIMESTAMP '{AS_OF}'"
_D = f"CAST(TIMESTAMP '{SCORES_AS_OF}' AS DATE)"
_W = {c: f"{w}e0" for c, w in Q.WEIGHTS.items()}
_SUM = " + ".join(f"coalesce({c}, 0e0) * {w}" for c, w in _W.items())
_TOTAL = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0e0 END" for c, w in _W.items())
_OVERALL = f"CAST(floor(({_SUM}) / ({_TOTAL}) * 10000 + 0.5e0) AS DOUBLE) / 10000"
_BASE = f"""SELECT s.*, v.narration_tier, v.llm_cost, v.script_latency_ms, coalesce(v.scripter_mode, CASE WHEN v.narration_tier = 'base' THEN 'regex' ELSE 'llm' END) AS mode,
  coalesce(s.parser_commit, strftime(s.scored_at, '%Y-%m-%d')) AS period, {_OVERALL} AS score_overall
  FROM narration_scores s JOIN narration_versions v ON v.id = s.version_id"""
_MEANS = ", ".join(f"avg(score_{c}) AS avg_{c}" for c in ("overall", "fidelity", "citations", "header", "figures", "tts"))
_SCORED = ("narration_scores", "narration_versions")


def base(t: Tables):
    return Q.scored_versions(t["narration_scores"], t["narration_versions"])


@query("A11_overall_score", f"SELECT id, {_OVERALL} AS score FROM narration_scores", "narration_scores")
def a11(t: Tables):
    return t["narration_scores"].select("id", Q.overall().alias("score"))


@query("P9_mode", "SELECT id, coalesce(scripter_mode, CASE WHEN narration_tier = 'base' THEN 'regex' ELSE 'llm' END) AS mode FROM narration_versions", "narration_versions")
def p9(t: Tables):
    return t["narration_versions"].select("id", Q.mode().alias("mode"))


@query("P10_period", "SELECT id, coalesce(parser_commit, strftime(scored_at, '%Y-%m-%d')) AS period FROM narration_scores", "narration_scores")
def p10(t: Tables):
    return t["narration_scores"].select("id", Q.period().alias("period"))


@query(
    "J5_latest_scores",
    """SELECT v.id, v.paper_id, v.narration_tier, s.id AS score_id, s.score_fidelity FROM narration_versions v
       LEFT JOIN narration_scores s ON s.id = (SELECT max(id) FROM narration_scores x WHERE x.version_id = v.id)""",
    *_SCORED,
)
def j5(t: Tables):
    return Q.latest_scores(t["narration_versions"], t["narration_scores"])


@query(
    "A7_score_trends",
    f"""SELECT period, mode, period_start, {", ".join(f"round(avg_{c}, 6) AS avg_{c}" for c in ("overall", "fidelity", "citations", "header", "figures", "tts"))}, n FROM (
        SELECT period, mode, min(scored_at) AS period_start, {_MEANS}, count(*) AS n FROM ({_BASE}) b WHERE scored_at >= {_D} - INTERVAL '90' DAY GROUP BY period, mode
        UNION ALL SELECT commit_hash, m, registered_at, NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM (SELECT *, CASE WHEN tier = 'base' THEN 'regex' ELSE 'llm' END AS m FROM parser_versions) p
        WHERE registered_at >= {_D} - INTERVAL '90' DAY AND NOT EXISTS (SELECT 1 FROM ({_BASE}) b WHERE b.period = p.commit_hash AND b.mode = p.m AND b.scored_at >= {_D} - INTERVAL '90' DAY)) x""",
    *_SCORED, "parser_versions",
)
def a7(t: Tables):
    means = [F.round(f"avg_{c}", 6).alias(f"avg_{c}") for c in ("overall", "fidelity", "citations", "header", "figures", "tts")]
    return Q.daily(base(t), t["parser_versions"], SCORES_AS_OF).select("period", "mode", "period_start", *means, "n")


@query(
    "A8_score_summary",
    f"""SELECT mode, count(*) AS total_count, round(avg(score_overall), 6) AS avg_overall, round(avg(CASE WHEN scored_at >= {_D} - INTERVAL '7' DAY THEN score_overall END), 6) AS avg_7d,
        CAST(sum(CASE WHEN scored_at >= {_D} - INTERVAL '7' DAY THEN 1 ELSE 0 END) AS BIGINT) AS count_7d,
        round(avg(CASE WHEN scored_at >= {_D} - INTERVAL '14' DAY AND scored_at < {_D} - INTERVAL '7' DAY THEN score_overall END), 6) AS avg_prior_7d,
        round(avg(llm_cost), 6) AS avg_cost, round(avg(script_latency_ms), 4) AS avg_latency_ms FROM ({_BASE}) b GROUP BY mode""",
    *_SCORED,
)
def a8(t: Tables):
    r = lambda c, n=6: F.round(c, n).alias(c)
    return Q.summary(base(t), SCORES_AS_OF).select("mode", "total_count", r("avg_overall"), r("avg_7d"), "count_7d", r("avg_prior_7d"), r("avg_cost"), r("avg_latency_ms", 4))


_LATEST = f"""SELECT mode, period FROM (SELECT mode, period, row_number() OVER (PARTITION BY mode ORDER BY max(scored_at) DESC, period DESC) AS rn FROM ({_BASE}) b GROUP BY mode, period) x WHERE rn = 1"""


@query("W1_latest_period", _LATEST, *_SCORED)
def w1(t: Tables):
    return Q.current(base(t)).select("mode", "period")


@query(
    "W2_current_scores",
    f"""SELECT mode, period, round(avg(score_overall), 6) AS avg_overall, count(*) AS n, round(avg(llm_cost), 6) AS avg_cost FROM (
        SELECT b.*, row_number() OVER (PARTITION BY b.mode ORDER BY scored_at DESC, id DESC) AS rn FROM ({_BASE}) b JOIN ({_LATEST}) l ON l.mode = b.mode AND l.period = b.period) y WHERE rn <= 10 GROUP BY mode, period""",
    *_SCORED,
)
def w2(t: Tables):
    return Q.current(base(t)).select("mode", "period", F.round("avg_overall", 6).alias("avg_overall"), "n", F.round("avg_cost", 6).alias("avg_cost"))


@query(
    "A18_trend",
    f"""SELECT mode, CAST(round((max(CASE WHEN rn = 1 THEN m END) - max(CASE WHEN rn = 2 THEN m END)) * 100) AS BIGINT) AS points FROM (
        SELECT mode, avg(score_overall) AS m, row_number() OVER (PARTITION BY mode ORDER BY min(scored_at) DESC, period DESC) AS rn FROM ({_BASE}) b GROUP BY mode, period) x WHERE rn <= 2 GROUP BY mode""",
    *_SCORED,
)
def a18(t: Tables):
    return Q.trend(base(t)).select("mode", "points")


@query(
    "A12_acceptance",
    """SELECT round(avg(o), 6) AS old_mean, round(avg(n), 6) AS new_mean, avg(n) > avg(o) AND max(CASE WHEN o >= 0.65 AND n < 0.65 THEN 1 ELSE 0 END) = 0 AS accepted
       FROM (SELECT 0.6 + id % 30 * 0.01 AS o, 0.62 + id % 30 * 0.01 AS n FROM narration_versions) x""",
    "narration_versions",
)
def a12(t: Tables):
    score = lambda b: t["narration_versions"].select(F.col("id").alias("paper_id"), (F.lit(b) + F.col("id") % 30 * F.lit(0.01)).alias("score"))
    return Q.acceptance(score(0.6), score(0.62)).select(F.round("old_mean", 6).alias("old_mean"), F.round("new_mean", 6).alias("new_mean"), "accepted")


# --- cost -----------------------------------------------------------------------------------------------------------

_PRICE = {(p, m): (i, o) for p, m, i, o in K.LLM_PRICES}
_VOICE = {(p, m): r for p, m, r in K.TTS_PRICES}
_LLM = " UNION ALL ".join(f"SELECT '{p}' AS llm_provider, '{m}' AS llm_model, {_PRICE[p, m][0]}e0 AS i, {_PRICE[p, m][1]}e0 AS o" for p, m in K.LLM_OPTIONS)
_TTS = " UNION ALL ".join(
    f"SELECT {f"'{p}'" if p else 'CAST(NULL AS STRING)'} AS tts_provider, {f"'{m}'" if m else 'CAST(NULL AS STRING)'} AS tts_model, {_VOICE.get((p, m), 0.0)}e0 AS rate, {r} AS quality_rank"
    for (p, m), r in zip(K.TTS_OPTIONS, (5, 15, 25, 35, 45, 20), strict=True)
)
_OPTIONS = f"""SELECT id, llm_provider, llm_model, tts_provider, tts_model, quality_rank, llm AS llm_cost, tts AS tts_cost, llm + tts AS total_cost FROM (
    SELECT *, (tin * i + tout * o) / 1e6 AS llm, chars * rate / 1e6 AS tts FROM (
      SELECT *, CASE WHEN coalesce(latex_char_count, 0) > 0 THEN latex_char_count / 4e0 + figure_count * CASE llm_provider WHEN 'openai' THEN 85 ELSE 700 END ELSE chars / 4e0 * 3e0 END AS tin, chars / 4e0 AS tout
      FROM (SELECT id, latex_char_count, figure_count, ceil(script_char_count * 1.33e0) AS chars FROM papers WHERE script_char_count > 0) p CROSS JOIN ({_LLM}) l CROSS JOIN ({_TTS}) v) x) y"""


def _options(t: Tables):
    return K.option_matrix(t["papers"]).select("id", "llm_provider", "llm_model", "tts_provider", "tts_model", "quality_rank", "llm_cost", "tts_cost", "total_cost")


@query("J17_option_matrix", _OPTIONS, "papers")
def j17(t: Tables):
    return _options(t)


@query("A16_cheapest_per_rank", f"SELECT id, quality_rank, min(total_cost) AS total_cost FROM ({_OPTIONS}) o GROUP BY id, quality_rank", "papers")
def a16(t: Tables):
    return K.cheapest(_options(t), ["id", "quality_rank"]).select("id", "quality_rank", "total_cost")


@query("N5_quality_rank", "SELECT id, CASE id % 5 WHEN 0 THEN 5 WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 25 ELSE 15 END WHEN 2 THEN CASE WHEN id % 2 = 0 THEN 10 ELSE 20 END WHEN 3 THEN 35 ELSE 10 END AS quality_rank FROM narration_versions", "narration_versions")
def n5(t: Tables):
    k, even = F.col("id") % 5, F.col("id") % 2 == 0
    provider = F.when(k == 1, "openai").when(k == 2, "google").when(k == 3, "elevenlabs").when(k == 4, "polly")
    model = F.when((k == 1) & even, "tts-1-hd").when((k == 2) & ~even, "wavenet").otherwise("other")
    return t["narration_versions"].select("id", K.quality_rank(provider, model).alias("quality_rank"))


@query("A13_rmse", "SELECT provider_model, round(sqrt(avg(power(script_char_count / 4 * 3 - actual_input_tokens, 2))), 6) AS rmse FROM training_rows GROUP BY provider_model", "training_rows")
def a13(t: Tables):
    return t["training_rows"].groupBy("provider_model").agg(F.round(K.rmse(F.col("script_char_count") / 4 * 3, F.col("actual_input_tokens")), 6).alias("rmse"))


@query("A14_group_sizes", "SELECT provider_model, count(*) AS n FROM training_rows WHERE actual_output_tokens IS NOT NULL GROUP BY provider_model HAVING count(*) >= 5", "training_rows")
def a14(t: Tables):
    return t["training_rows"].where("actual_output_tokens is not null").groupBy("provider_model").agg(F.count("*").alias("n")).where("n >= 5")


@query("A15_least_squares", "SELECT provider_model, count(*) AS n, round(regr_slope(actual_output_tokens, script_char_count), 6) AS slope, round(regr_intercept(actual_output_tokens, script_char_count), 4) AS intercept FROM training_rows WHERE actual_output_tokens IS NOT NULL GROUP BY provider_model", "training_rows")
def a15(t: Tables):
    fit = K.fit_by_moments(t["training_rows"], "actual_output_tokens", ["script_char_count"])
    return fit.select("provider_model", "n", F.round(F.get("coeffs", F.lit(0)), 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


_ROW_FEATURES = [f"coalesce(CAST({f} AS DOUBLE), 0)" for f in K.FEATURES]
_TARGETS = ("actual_input_tokens", "actual_output_tokens")


def _determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'-+'[i % 2 == 0]} {x} * {_determinant([row[:i] + row[i + 1 :] for row in m[1:]])}" for i, x in enumerate(m[0])) + ")"


def _fitted(rows: str) -> str:
    """SQL of the normal equations by Cramer's rule, over correlations: provider_model, n, w<t>_<i> and b<t> of both targets."""
    k = len(_ROW_FEATURES)
    stats = [f"avg({x}) AS m{i}, stddev_pop({x}) AS s{i}" for i, x in enumerate(_ROW_FEATURES)] + [f"avg({y}) AS my{t}, stddev_pop({y}) AS sy{t}" for t, y in enumerate(_TARGETS)]
    stats += [f"corr({_ROW_FEATURES[i]}, {_ROW_FEATURES[j]}) AS r{i}{j}" for i in range(k) for j in range(i + 1, k)] + [f"corr({x}, {y}) AS q{t}{i}" for t, y in enumerate(_TARGETS) for i, x in enumerate(_ROW_FEATURES)]
    r = [["1e0" if i == j else f"r{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)]
    weights = {f"w{t}_{i}": f"{_determinant([[f'q{t}{a}' if b == i else r[a][b] for b in range(k)] for a in range(k)])} / {_determinant(r)} * sy{t} / s{i}" for t in range(2) for i in range(k)}
    shifts = [f"my{t} - " + " - ".join(f"w{t}_{i} * m{i}" for i in range(k)) + f" AS b{t}" for t in range(2)]
    inner = f"SELECT *, {', '.join(f'{w} AS {name}' for name, w in weights.items())} FROM (SELECT provider_model, count(*) AS n, {', '.join(stats)} FROM {rows} GROUP BY provider_model) s"
    return f"SELECT provider_model, n, {', '.join(weights)}, {', '.join(shifts)} FROM ({inner}) w"


_SIZED = "(SELECT *, CAST('0x' || substr(md5(CAST(id AS STRING)), 1, 8) AS BIGINT) % 5 = 0 AS test, count(*) OVER (PARTITION BY provider_model) AS sample_count FROM training_rows WHERE actual_input_tokens IS NOT NULL AND actual_output_tokens IS NOT NULL)"
_PREDICTED = [f"greatest({' + '.join(f'w{t}_{i} * {x}' for i, x in enumerate(_ROW_FEATURES))} + b{t}, 0)" for t in range(2)]
_PROXIES = "CASE WHEN latex_char_count > 0 THEN latex_char_count / 4 + figure_count * 300 ELSE script_char_count / 4 * 3 END", "script_char_count / 4"
_MODELS = f"""SELECT provider_model, CAST(max(sample_count) AS BIGINT) AS sample_count, {", ".join(f"round(any_value({c}), 3) + 0 AS {c}" for t in range(2) for c in (*(f"w{t}_{i}" for i in range(4)), f"b{t}"))},
    {", ".join(f"round(sqrt(avg(({p} - {y}) ** 2)), 3) + 0 AS {n}" for p, y, n in zip((*_PREDICTED, *_PROXIES), _TARGETS * 2, ("input_rmse", "output_rmse", "proxy_input_rmse", "proxy_output_rmse")))}
    FROM {_SIZED} z JOIN ({_fitted(f"{_SIZED} z WHERE NOT test")}) f USING (provider_model) WHERE test GROUP BY provider_model"""


def _shown_models(models):
    """Models with a column for each rounded coefficient."""
    weights = [F.get(f"{x}_coeffs", F.lit(i)).alias(f"w{t}_{i}") for t, x in enumerate(("input", "output")) for i in range(4)]
    wide = models.select("*", *weights, F.col("input_intercept").alias("b0"), F.col("output_intercept").alias("b1"))
    rounded = [*(f"w{t}_{i}" for t in range(2) for i in range(4)), "b0", "b1", "input_rmse", "output_rmse", "proxy_input_rmse", "proxy_output_rmse"]
    return wide.select("provider_model", "sample_count", *[(F.round(c, 3) + 0).alias(c) for c in rounded])


@query("A15_train_models", _MODELS, "training_rows")
def a15b(t: Tables):
    return _shown_models(K.train(t["training_rows"]))


@query("A15_weekly_increments", f"SELECT provider_model, n, {', '.join(f'round({c}, 3) + 0 AS {c}' for t in range(2) for c in (*(f'w{t}_{i}' for i in range(4)), f'b{t}'))} FROM ({_fitted(_SIZED + ' z')}) f", "training_rows")
def a15d(t: Tables):
    # Each week's rows are read once, for that week's moments; the models are solved from all weeks' tables.
    weekly = K.moments(t["training_rows"].withColumn("week", F.pmod(F.xxhash64("id"), F.lit(9))), ["provider_model", "week"], _TARGETS)
    fit = K.solved(K.merged_moments(weekly, ["provider_model"]), "provider_model", _TARGETS)
    columns = {f"w{n}_{i}": F.get(f"{y}_coeffs", F.lit(i)) for n, y in enumerate(_TARGETS) for i in range(4)} | {f"b{n}": F.col(f"{y}_intercept") for n, y in enumerate(_TARGETS)}
    return fit.select("provider_model", "n", *[(F.round(c, 3) + 0).alias(name) for name, c in columns.items()])


@query("A15_exact_models", "SELECT provider_model, count(*) AS n, TRUE AS exact_in, TRUE AS exact_out FROM training_rows WHERE actual_input_tokens IS NOT NULL AND actual_output_tokens IS NOT NULL GROUP BY provider_model HAVING count(*) >= 5", "training_rows")
def a15c(t: Tables):
    # The tokens of these rows are linear in the features, so a least-squares fit has no error left.
    m = K.train(t["training_rows"])
    return m.select("provider_model", F.col("sample_count").alias("n"), (F.col("input_rmse") < 1e-3).alias("exact_in"), (F.col("output_rmse") < 1e-3).alias("exact_out"))


_ONE_MODEL = _fitted(f"(SELECT * REPLACE ('openai:gpt-4o' AS provider_model) FROM {_SIZED} z WHERE NOT test) m")
_ESTIMATES = [f"greatest(w{t}_0 * coalesce(latex_char_count, 0) + w{t}_1 * coalesce(figure_count, 0) + w{t}_2 * coalesce(tar_bytes, 0) + w{t}_3 * chars + b{t}, 0)" for t in range(2)]


@query(
    "J18_estimate_with_models",
    f"""SELECT id, llm_provider, llm_model, tts_provider, tts_model, round((tin * i + tout * o) / 1e6 + 1e-9, 6) AS llm_cost, round(chars * rate / 1e6 + 1e-9, 6) AS tts_cost, source AS estimate_source FROM (
      SELECT *, CASE WHEN llm_model = 'gpt-4o' THEN 'ml' ELSE 'proxy' END AS source,
        CASE WHEN llm_model = 'gpt-4o' THEN {_ESTIMATES[0]} WHEN coalesce(latex_char_count, 0) > 0 THEN latex_char_count / 4e0 + figure_count * CASE llm_provider WHEN 'openai' THEN 85 ELSE 700 END ELSE chars / 4e0 * 3e0 END AS tin,
        CASE WHEN llm_model = 'gpt-4o' THEN {_ESTIMATES[1]} ELSE chars / 4e0 END AS tout
      FROM (SELECT id, latex_char_count, figure_count, tar_bytes, ceil(script_char_count * 1.33e0) AS chars FROM papers WHERE script_char_count > 0) p CROSS JOIN ({_LLM}) l CROSS JOIN ({_TTS}) v CROSS JOIN ({_ONE_MODEL}) f) x""",
    "papers", "training_rows",
)
def j18(t: Tables):
    models = K.train(t["training_rows"].withColumn("provider_model", F.lit("openai:gpt-4o")))
    o = K.option_matrix(t["papers"], models)
    # Costs of whole tokens lie on halves of the last place, so they are moved off them by far less.
    cost = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)
    return o.select("id", "llm_provider", "llm_model", "tts_provider", "tts_model", cost("llm_cost"), cost("tts_cost"), "estimate_source")


@query(
    "N7_speech_eta",
    "SELECT id, provider, CAST(ceil(script_char_count / chunk) * secs AS BIGINT) AS seconds, round(script_char_count * rate, 6) AS cost FROM papers CROSS JOIN (VALUES "
    + ", ".join(f"('{p}', {c}.0, {r}, {s})" for p, c, r, s in K.SPEECH) + ") v(provider, chunk, rate, secs)",
    "papers",
)
def n7(t: Tables):
    offers = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(c).alias("chunk"), F.lit(r).alias("rate"), F.lit(s).alias("secs")) for p, c, r, s in K.SPEECH])
    seconds, cost = K.speech_estimate(F.col("script_char_count"), F.col("o.chunk"), F.col("o.rate"), F.col("o.secs"))
    return t["papers"].select("id", "script_char_count", F.explode(offers).alias("o")).select("id", "o.provider", seconds.cast("long").alias("seconds"), cost.alias("cost"))


# --- state ----------------------------------------------------------------------------------------------------------


@query("M1_insert_absent", "SELECT id, title FROM papers WHERE seq % 2 = 0 UNION ALL SELECT id, 'new' FROM papers WHERE seq % 2 = 1 AND seq % 3 = 0", "papers")
def m1(t: Tables):
    p = t["papers"]
    return S.insert_absent(p.where("seq % 2 = 0").select("id", "title"), p.where("seq % 3 = 0").select("id", F.lit("new").alias("title")), ["id"])


@query(
    "M2_first_visits",
    """SELECT id, paper_id FROM (SELECT *, CASE WHEN visitor_token IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY paper_id, visitor_token ORDER BY id) END AS k FROM (
         SELECT *, row_number() OVER (PARTITION BY paper_id, visitor_ip ORDER BY id) AS n FROM page_visits) a WHERE n = 1) b WHERE k = 1""",
    "page_visits",
)
def m2(t: Tables):
    return S.first_visits(t["page_visits"]).select("id", "paper_id")


@query("M3_upsert", "SELECT id, title FROM papers WHERE seq % 3 <> 0 UNION ALL SELECT id, 'patched' FROM papers WHERE seq % 3 = 0", "papers")
def m3(t: Tables):
    p = t["papers"].select("id", "seq", "title")
    return S.upsert(p.select("id", "title"), p.where("seq % 3 = 0").select("id", F.lit("patched").alias("title")), ["id"])


_EVENTS = """SELECT user_id % 50 AS paper, ts, event_id, CASE event_type WHEN 'view' THEN 'narrating' WHEN 'purchase' THEN 'narrated' WHEN 'error' THEN 'failed' END AS status,
  CASE WHEN event_type = 'view' THEN value END AS eta, CASE WHEN event_type = 'error' THEN concat('e', CAST(event_id % 7 AS STRING)) END AS error FROM {}"""


@query(
    "Z1_fold_status",
    f"""SELECT paper, last(status ORDER BY ts, event_id) FILTER (status IS NOT NULL) AS status,
         CASE WHEN max(CASE WHEN error IS NOT NULL THEN ts END) > coalesce(max(CASE WHEN status IN ('narrating', 'narrated') THEN ts END), TIMESTAMP '1970-01-01')
              THEN last(error ORDER BY ts, event_id) FILTER (error IS NOT NULL) END AS error, max(CASE WHEN status = 'narrated' THEN ts END) AS completed_at
       FROM ({_EVENTS.format("events")}) e GROUP BY paper""",
)
def z1(t: Tables):
    events = t.spark.sql(_EVENTS.format("{events}"), events=t["events"])
    return S.fold_status(events, "paper", ["ts", "event_id"]).select("paper", "status", "error", "completed_at")


@query("M5_sparse_patch", f"SELECT paper, last(eta ORDER BY ts, event_id) FILTER (eta IS NOT NULL) AS eta, last(error ORDER BY ts, event_id) FILTER (error IS NOT NULL) AS error FROM ({_EVENTS.format('events')}) e GROUP BY paper")
def m5(t: Tables):
    return S.latest_known(t.spark.sql(_EVENTS.format("{events}"), events=t["events"]), "paper", ["ts", "event_id"], ["eta", "error"])


@query(
    "M6_first_claims",
    """SELECT p.id, CASE WHEN c.r IS NOT NULL AND p.status IN ('unnarrated', 'failed') THEN 'narrating' ELSE p.status END AS status,
         p.retry_count + CASE WHEN c.r IS NOT NULL AND p.status = 'failed' THEN 1 ELSE 0 END AS retry_count, CASE WHEN p.status IN ('unnarrated', 'failed') THEN c.r END AS claimed_by
       FROM papers p LEFT JOIN (SELECT paper_id, first(visitor_ip ORDER BY visited_at, id) AS r FROM page_visits GROUP BY paper_id) c ON c.paper_id = p.id""",
    "papers", "page_visits",
)
def m6(t: Tables):
    asks = t["page_visits"].select("paper_id", F.col("visited_at").alias("at"), F.col("id").alias("request_id"), F.col("visitor_ip").alias("requester"))
    return S.first_claims(asks, t["papers"], ["unnarrated", "failed"])


@query("M7_best_version", "SELECT paper_id, first(id ORDER BY quality_rank DESC, created_at, id) AS best_version_id FROM narration_versions GROUP BY paper_id", "narration_versions")
def m7(t: Tables):
    return S.best_versions(t["narration_versions"])


@query("M8_write_once", "SELECT id, CASE WHEN coalesce(latex_char_count, 0) = 0 THEN seq + 1 ELSE latex_char_count END AS latex_char_count FROM papers", "papers")
def m8(t: Tables):
    return S.write_once(t["papers"], "latex_char_count", F.col("seq") + 1).select("id", "latex_char_count")


@query("M9_cascade_delete", "SELECT r.id FROM ratings r WHERE r.paper_id NOT IN (SELECT id FROM papers WHERE seq % 10 = 0)", "papers", "ratings")
def m9(t: Tables):
    gone = t["papers"].where("seq % 10 = 0").select("id")
    return S.cascade_delete({"ratings": (t["ratings"].withColumnRenamed("id", "rating_id"), "paper_id")}, gone)["ratings"].select(F.col("rating_id").alias("id"))


@query("M10_retention", f"SELECT id FROM page_visits WHERE visited_at >= {_T} - INTERVAL '20' DAY", "page_visits")
def m10(t: Tables):
    return S.retain(t["page_visits"], "visited_at", AS_OF, 20).select("id")


_NEW = "SELECT o_custkey AS list_id, o_orderkey AS seq, CAST(o_orderkey % 1100 AS STRING) AS paper_id FROM {} WHERE o_orderkey % 3 = 0"


@query(
    "M11_append_items",
    f"""WITH items AS (SELECT o_custkey AS list_id, CAST(o_orderkey % 1200 AS STRING) AS paper_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders),
        n AS (SELECT x.*, coalesce((SELECT max(position) FROM items i WHERE i.list_id = x.list_id), -1) + row_number() OVER (PARTITION BY list_id ORDER BY seq) AS position,
              row_number() OVER (PARTITION BY list_id, paper_id ORDER BY seq) AS k FROM ({_NEW.format("orders")}) x)
        SELECT list_id, paper_id, position FROM items UNION ALL SELECT list_id, paper_id, position FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM items i WHERE i.list_id = n.list_id AND i.paper_id = n.paper_id)""",
)
def m11(t: Tables):
    return S.append_items(t["list_items"], t.spark.sql(_NEW.format("{orders}"), orders=t["orders"]))


@query("M12_reorder", "SELECT list_id, paper_id, CASE paper_id WHEN '31' THEN 0 WHEN '5' THEN 1 ELSE position END AS position FROM list_items", "list_items")
def m12(t: Tables):
    order = t["list_items"].select("list_id").distinct().withColumn("paper_ids", F.array(F.lit("31"), F.lit("5")))
    return S.reorder_items(t["list_items"], order).select("list_id", "paper_id", F.col("position").cast("long").alias("position"))


@query(
    "M13_merge_tokens",
    """SELECT 'u2' AS user_token, paper_id, max_by(position, updated_at) AS position FROM listens WHERE user_token IN ('u1', 'u2') GROUP BY paper_id
       UNION ALL SELECT user_token, paper_id, position FROM listens WHERE user_token NOT IN ('u1', 'u2')""",
    "listens",
)
def m13(t: Tables):
    return S.merge_tokens(t["listens"], "user_token", "paper_id", "u1", "u2", F.col("updated_at")).select("user_token", "paper_id", "position")


@query("M17_remap_status", "SELECT id, CASE status WHEN 'narrated' THEN 'complete' WHEN 'failed' THEN 'failed' WHEN 'narrating' THEN 'queued' END AS status FROM papers", "papers")
def m17(t: Tables):
    return t["papers"].select("id", S.remap(F.col("status"), {"narrated": "complete", "failed": "failed", "narrating": "queued"}).alias("status"))


@query(
    "M19_recover_stale",
    f"""SELECT id, CASE WHEN stale AND retry_count >= 3 THEN 'failed' WHEN stale THEN 'unnarrated' ELSE status END AS status, retry_count + CASE WHEN stale AND retry_count < 3 THEN 1 ELSE 0 END AS retry_count,
        CASE WHEN stale AND retry_count >= 3 THEN 'timeout' END AS error_category FROM (SELECT *, status = 'narrating' AND updated_at < {_T} - INTERVAL '20' MINUTE AS stale FROM papers) x""",
    "papers",
)
def m19(t: Tables):
    return S.recover_stale(t["papers"], AS_OF)


@query(
    "M20_priority_rating",
    """SELECT a.ask_id, coalesce(x.stars, y.stars) AS stars FROM (SELECT id AS ask_id, paper_id, visitor_token AS token, visitor_ip AS ip FROM page_visits) a
       LEFT JOIN (SELECT paper_id, rater_token, max_by(stars, id) AS stars FROM ratings GROUP BY ALL) x ON x.paper_id = a.paper_id AND x.rater_token = a.token
       LEFT JOIN (SELECT paper_id, rater_ip, max_by(stars, id) AS stars FROM ratings GROUP BY ALL) y ON y.paper_id = a.paper_id AND y.rater_ip = a.ip""",
    "ratings", "page_visits",
)
def m20(t: Tables):
    asks = t["page_visits"].select(F.col("id").alias("ask_id"), "paper_id", F.col("visitor_token").alias("token"), F.col("visitor_ip").alias("ip"))
    return S.priority_rating(t["ratings"], asks)


@query(
    "E4_tier_derivation",
    "SELECT id, CASE WHEN scripter_mode IS NULL THEN 'base' WHEN quality_rank >= 40 THEN 'plus3' WHEN quality_rank >= 30 THEN 'plus2' ELSE 'plus1' END AS tier, coalesce(audio_key, 'none') AS audio_key FROM narration_versions",
    "narration_versions",
)
def e4(t: Tables):
    r = F.col("quality_rank")
    tier = F.when(F.col("scripter_mode").isNull(), "base").when(r >= 40, "plus3").when(r >= 30, "plus2").otherwise("plus1")
    return t["narration_versions"].select("id", tier.alias("tier"), F.coalesce("audio_key", F.lit("none")).alias("audio_key"))


@query("E2_versions_from_papers", "SELECT id AS paper_id, 'base' AS tier, coalesce(completed_at, created_at) AS created_at FROM papers WHERE status = 'narrated'", "papers")
def e2(t: Tables):
    return t["papers"].where("status = 'narrated'").select(F.col("id").alias("paper_id"), F.lit("base").alias("tier"), F.coalesce("completed_at", "created_at").alias("created_at"))


@query(
    "Z7_milestones",
    "SELECT user_token, mark, min(updated_at) AS at FROM listens CROSS JOIN (VALUES (25), (50), (75)) m(mark) WHERE position >= mark GROUP BY user_token, mark",
    "listens",
)
def z7(t: Tables):
    return S.first_crossings(t["listens"].where("position is not null"), ["user_token"], "updated_at", F.col("position") / 100).withColumnRenamed("updated_at", "at")


@query("U1_registered_union", "SELECT commit_hash AS name, 'parser' AS kind FROM parser_versions UNION ALL SELECT DISTINCT parser_commit, 'score' FROM narration_scores WHERE parser_commit IS NOT NULL", "parser_versions", "narration_scores")
def u1(t: Tables):
    seen = t["narration_scores"].where("parser_commit is not null").select(F.col("parser_commit").alias("name")).distinct().withColumn("kind", F.lit("score"))
    return t["parser_versions"].select(F.col("commit_hash").alias("name"), F.lit("parser").alias("kind")).unionByName(seen)


# --- text -----------------------------------------------------------------------------------------------------------


@query("X41_paper_id", r"SELECT id, coalesce(nullif(regexp_extract(t, '(\d{4}\.\d{4,5})(v\d+)?', 1), ''), nullif(regexp_extract(t, '([a-zA-Z-]+/\d{7})(v\d+)?', 1), '')) AS paper_id FROM (SELECT id, CASE WHEN seq % 3 = 0 THEN concat('see 2103.', CAST(10000 + seq AS STRING), 'v2') WHEN seq % 3 = 1 THEN concat('astro-ph/', CAST(9900000 + seq AS STRING)) ELSE title END AS t FROM papers) x", "papers")
def x41(t: Tables):
    k = F.col("seq") % 3
    shown = F.when(k == 0, F.concat(F.lit("see 2103."), (F.col("seq") + 10000).cast("string"), F.lit("v2"))).when(k == 1, F.concat(F.lit("astro-ph/"), (F.col("seq") + 9900000).cast("string"))).otherwise(F.col("title"))
    return t["papers"].select("id", T.paper_id(shown).alias("paper_id"))


@query("X42_entities", "SELECT page_id, sha256(" + "replace(" * len(T.ENTITIES) + "html" + "".join(f", '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in T.ENTITIES) + ") AS sha FROM pages")
def x42(t: Tables):
    return t["pages"].select("page_id", F.sha2(T.decode_entities(F.col("html")), 256).alias("sha"))


@query("X42_strip_tags", "SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n FROM pages")
def x42b(t: Tables):
    return t["pages"].select("page_id", F.char_length(F.regexp_replace("html", "<[^>]+>", "")).cast("long").alias("n"))


_PLAIN_PAGE = "replace(" * (len(T.ENTITIES) + 1) + "regexp_replace(html, '<[^>]+>', '', 'g')" + "".join(f", '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in (*T.ENTITIES, ("&nbsp;", " ")))


# The pages hold no backslashes: of a page's TeX markup only dollar signs, quotes and braces are left to handle.
@query("X42_clean_pages", f"SELECT page_id, trim(regexp_replace(regexp_replace(replace(regexp_replace({_PLAIN_PAGE}, '\\$([^$]*)\\$', '\\1', 'g'), chr(39) || chr(39), '”'), '[{{}}]', '', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def x42c(t: Tables):
    return t["pages"].select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("X43_feed_date", "SELECT id, strftime(created_at, '%Y-%m-%d') AS date FROM papers", "papers")
def x43(t: Tables):
    raw = F.concat(F.lit("Submitted on "), F.date_format("created_at", "d MMM yyyy"), F.lit(" (v1)"))
    return t["papers"].select("id", T.feed_date(raw).alias("date"))


@query("X22_spoken_date", "SELECT id, strftime(created_at, '%B %-d, %Y') AS date FROM papers", "papers")
def x22(t: Tables):
    return t["papers"].select("id", T.spoken_date(F.date_format("created_at", "yyyy-MM-dd")).alias("date"))


@query("X22_authors", "SELECT id, CASE seq % 4 WHEN 0 THEN 'By A.' WHEN 1 THEN 'By A and B.' WHEN 2 THEN 'By A, B, and C.' ELSE 'By A, B, C, and 1 more author.' END AS by_line FROM papers", "papers")
def x22b(t: Tables):
    names = F.slice(F.array(*[F.lit(n) for n in ("A.", "B", "C", "D")]), F.lit(1), (F.col("seq") % 4 + 1).cast("int"))
    return t["papers"].select("id", T.spoken_authors(names).alias("by_line"))


_SCRIPT = """WITH s AS (SELECT *, CASE WHEN title = '' THEN 'Untitled.' WHEN title LIKE '%.' THEN title ELSE title || '.' END AS name, 'By ' || regexp_replace(submitted_by_city, '\\.+$', '') || '.' AS by_line,
  'Published on ' || strftime(created_at, '%B %-d, %Y') || '.' AS published FROM papers)
SELECT id, name || chr(10) || chr(10) || by_line || chr(10) || chr(10) || published || chr(10) || chr(10) || trim(abstract) || chr(10) || chr(10)
  || 'Thanks for listening. This has been an audio narration of ' || name || ' ' || by_line || ' ' || published || ' Narrated by the engine.' AS script FROM s"""


@query("X22_script", _SCRIPT.replace("WITH s AS (", "SELECT * FROM (WITH s AS (", 1) + ") y", "papers")
def x22c(t: Tables):
    return t["papers"].select("id", T.script(F.col("abstract"), F.col("title"), F.array(F.col("submitted_by_city")), F.date_format("created_at", "yyyy-MM-dd"), "the engine").alias("script"))


@query("X7_paragraphs", r"SELECT id, array_to_string(list_filter(list_transform(string_split_regex(t, '\n{2,}'), lambda p: trim(regexp_replace(replace(p, chr(10), ' '), ' {2,}', ' ', 'g'), ' ')), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM (SELECT id, replace(abstract, '. ', '.' || chr(10) || chr(10)) AS t FROM papers) x", "papers")
def x7(t: Tables):
    return t["papers"].select("id", T.paragraphs(F.replace("abstract", F.lit(". "), F.lit(".\n\n"))).alias("text"))


@query(
    "X36_chunks",
    """WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
       r(doc_id, i, chunk, held) AS (SELECT doc_id, 0, 0, 0 FROM p
         UNION ALL SELECT r.doc_id, i + 1, CASE WHEN i > 0 AND held + length(ps[i + 1]) > 400 THEN chunk + 1 ELSE chunk END,
           CASE WHEN i > 0 AND held + length(ps[i + 1]) > 400 THEN length(ps[i + 1]) ELSE held + length(ps[i + 1]) + 2 END FROM r JOIN p USING (doc_id) WHERE i < len(ps))
       SELECT doc_id, CAST(max(CASE WHEN i > 0 THEN chunk + 1 ELSE 0 END) AS INTEGER) AS n FROM r GROUP BY doc_id""",
)
def x36(t: Tables):
    return t["documents"].select("doc_id", F.size(T.chunks(F.replace("text", F.lit(". "), F.lit(".\n\n")), 400)).alias("n"))


@query("X39_max_tokens", "SELECT id, greatest(4096, least(CAST(floor(floor(script_char_count * 0.5) / 4) AS BIGINT), 16384)) AS n FROM papers", "papers")
def x39(t: Tables):
    return t["papers"].select("id", T.max_tokens(F.col("script_char_count")).cast("long").alias("n"))


@query("X40_short_authors", "SELECT list_id, CASE WHEN n > 3 THEN array_to_string(a[1:3], ', ') || ' + ' || CAST(n - 3 AS STRING) || ' more' ELSE array_to_string(a[1:3], ', ') END AS names FROM (SELECT list_id, list(paper_id ORDER BY position) AS a, count(*) AS n FROM list_items GROUP BY list_id) x", "list_items")
def x40(t: Tables):
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "paper_id"))), lambda s: s["paper_id"])
    return t["list_items"].groupBy("list_id").agg(names.alias("a")).select("list_id", T.short_authors(F.col("a")).alias("names"))


@query("X40_duration", "SELECT id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS STRING) || 'h ' || CAST(s % 3600 // 60 AS STRING) || 'm' ELSE CAST(s // 60 AS STRING) || 'm' END AS d FROM (SELECT id, seq * 37 % 9000 AS s FROM papers) x", "papers")
def x40b(t: Tables):
    return t["papers"].select("id", T.duration(F.col("seq") * 37 % 9000).alias("d"))


@query("N11_age", "SELECT id, CASE WHEN s >= 31536000 THEN CAST(s // 31536000 AS STRING) || 'y' WHEN s >= 86400 THEN CAST(s // 86400 AS STRING) || 'd' WHEN s >= 3600 THEN CAST(s // 3600 AS STRING) || 'h' ELSE CAST(s // 60 AS STRING) || 'm' END AS age FROM (SELECT id, seq * seq * 97 AS s FROM papers) x", "papers")
def n11(t: Tables):
    return t["papers"].select("id", T.age(F.col("seq") * F.col("seq") * 97).alias("age"))


@query("X49_error_category", "SELECT id, CASE seq % 4 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'image_processing' WHEN 2 THEN 'timeout' ELSE 'parsing' END AS category FROM papers", "papers")
def x49(t: Tables):
    k = F.col("seq") % 4
    msg = F.when(k == 0, "HTTP 429 Too Many Requests").when(k == 1, "Image exceeds pixel limit").when(k == 2, "request timed out").otherwise("bad brace")
    return t["papers"].select("id", T.error_category(msg, F.lit("parsing")).alias("category"))


@query("X29_before_references", r"SELECT doc_id, length(text) AS n FROM documents")
def x29(t: Tables):
    marked = F.concat("text", F.lit("\n References \nA. Author, 2020"))
    return t["documents"].select("doc_id", F.char_length(pdf.head_before_references(marked)).cast("long").alias("n"))


@query(
    "X30_numeric_rows",
    r"""WITH l AS (SELECT doc_id, list_transform(string_split('1.5 2.5 x 3%' || chr(10) || text || chr(10) || '12', chr(10)), lambda s: {'line': s, 'parts': list_filter(string_split_regex(trim(s, ' '), '[ \t\n\x0B\f\r]+'), lambda p: p <> '')}) AS lines FROM documents)
       SELECT doc_id, array_to_string(list_transform(list_filter(lines, lambda x: NOT (regexp_matches(trim(x.line, ' '), '^(https?://[^ \t\n\x0B\f\r]+|[0-9]{1,2})$')
         OR len(x.parts) >= 3 AND len(list_filter(x.parts, lambda p: regexp_matches(p, '^[0-9.,±]+%?$'))) > len(x.parts) * 0.5)), lambda x: x.line), chr(10)) AS text FROM l""",
)
def x30(t: Tables):
    marked = F.concat(F.lit("1.5 2.5 x 3%\n"), "text", F.lit("\n12"))
    return t["documents"].select("doc_id", pdf.numeric_rows_dropped(marked).alias("text"))
