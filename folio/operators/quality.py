"""Score analytics: weighted composite, trends by period and mode, summaries, the latest period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators.catalog import since_midnight

#: Weights of the composite score, and the floor that no paper may newly fall below.
WEIGHTS = {"score_fidelity": 0.35, "score_citations": 0.20, "score_header": 0.10, "score_figures": 0.15, "score_tts": 0.20}
FLOOR = 0.65


def overall(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the scores that are not null, 4 decimals; null if all are."""
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    total = add([F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in weights.items()])
    value = add([F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w) for c, w in weights.items()])
    # Half up on the binary value, so that every engine rounds alike.
    return F.when(total > 0, F.floor(value / total * 10000 + F.lit(0.5)) / 10000)


def half_up(value: Column, digits: int = 4) -> Column:
    """Halves of the last digit go up (toward positive infinity), on the binary value."""
    return F.floor(value * 10**digits + F.lit(0.5)) / 10**digits


def half_even(value: Column, digits: int = 4) -> Column:
    """Halves of the last digit go to the even neighbour."""
    return F.bround(value, digits)


def mode() -> Column:
    """The scripter's mode; older rows without one are regex in the base tier, else llm."""
    return F.coalesce("scripter_mode", F.when(F.col("narration_tier") == "base", "regex").otherwise("llm"))


def period() -> Column:
    """The parser's commit, else the date of the score."""
    return F.coalesce("parser_commit", F.date_format("scored_at", "yyyy-MM-dd"))


def scored_versions(scores: DataFrame, versions: DataFrame) -> DataFrame:
    """Scores with their version's tier, mode, cost and latency, their period and composite."""
    v = versions.select(F.col("id").alias("version_id"), "narration_tier", "scripter_mode", "llm_cost", "script_latency_ms")
    return scores.join(v, "version_id").withColumns({"mode": mode(), "period": period(), "score_overall": overall()})


_SCORES = ("overall", "fidelity", "citations", "header", "figures", "tts")


def _means() -> list[Column]:
    return [F.avg(f"score_{c}").alias(f"avg_{c}") for c in _SCORES]


def unscored(base: DataFrame, parsers: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Parsers registered in the last days, with their mode, that have no score of these days in their period and mode."""
    scored = base.where(since_midnight(F.col("scored_at"), as_of, days)).select(F.col("period").alias("commit_hash"), "mode").distinct()
    registered = parsers.where(since_midnight(F.col("registered_at"), as_of, days)).withColumn("mode", F.when(F.col("tier") == "base", "regex").otherwise("llm"))
    return registered.join(scored, ["commit_hash", "mode"], "left_anti")


def daily(base: DataFrame, parsers: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Means per period and mode, and registered parsers that have no score yet, in order of their start."""
    recent = base.where(since_midnight(F.col("scored_at"), as_of, days))
    scored = recent.groupBy("period", "mode").agg(F.min("scored_at").alias("period_start"), *_means(), F.count("*").alias("n"))
    missing = unscored(base, parsers, as_of, days)
    empty = missing.select(F.col("commit_hash").alias("period"), "mode", F.col("registered_at").alias("period_start"), *[F.lit(None).cast("double").alias(f"avg_{c}") for c in _SCORES], F.lit(0).cast("long").alias("n"))
    return scored.unionByName(empty).orderBy("period_start", "period", "mode")


def summary(base: DataFrame, as_of: str) -> DataFrame:
    """Per mode: means over all time, of the last 7 days and of the 7 before, with costs and latency."""
    at = F.col("scored_at")
    week, prior = since_midnight(at, as_of, 7), since_midnight(at, as_of, 14) & ~since_midnight(at, as_of, 7)
    return base.groupBy("mode").agg(
        *_means(), F.count("*").alias("total_count"), F.avg(F.when(week, F.col("score_overall"))).alias("avg_7d"), F.sum(F.when(week, 1).otherwise(0)).alias("count_7d"),
        F.avg(F.when(prior, F.col("score_overall"))).alias("avg_prior_7d"), F.avg("llm_cost").alias("avg_cost"), F.avg("script_latency_ms").alias("avg_latency_ms"),
    )


def current(base: DataFrame, newest: int = 10) -> DataFrame:
    """Per mode the period scored last, and means over its newest scores."""
    last = base.groupBy("mode", "period").agg(F.max("scored_at").alias("last"))
    w = W.partitionBy("mode").orderBy(F.col("last").desc(), F.col("period").desc())
    chosen = last.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("mode", "period")
    own = W.partitionBy("mode").orderBy(F.col("scored_at").desc(), F.col("id").desc())
    ranked = base.join(chosen, ["mode", "period"]).withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= newest)
    return ranked.groupBy("mode", "period").agg(*_means(), F.count("*").alias("n"), F.avg("llm_cost").alias("avg_cost"), F.avg("script_latency_ms").alias("avg_latency_ms"))


def latest_scores(versions: DataFrame, scores: DataFrame) -> DataFrame:
    """Versions with their latest score (greatest id) or none."""
    last = scores.groupBy("version_id").agg(F.max(F.struct("id", "score_fidelity", "scored_at")).alias("s"))
    return versions.join(last.withColumnRenamed("version_id", "id"), "id", "left").select("id", "paper_id", "narration_tier", F.col("s.id").alias("score_id"), F.col("s.score_fidelity").alias("score_fidelity"))


def trend(base: DataFrame) -> DataFrame:
    """Per mode: mean of the latest and the prior period, and the change in points (below 1 in size: flat)."""
    means = base.groupBy("mode", "period").agg(F.avg("score_overall").alias("m"), F.min("scored_at").alias("at"))
    w = W.partitionBy("mode").orderBy(F.col("at").desc(), F.col("period").desc())
    two = means.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    out = two.groupBy("mode").agg(F.max(F.when(F.col("rn") == 1, F.col("m"))).alias("latest"), F.max(F.when(F.col("rn") == 2, F.col("m"))).alias("prior"))
    points = F.round((F.col("latest") - F.col("prior")) * 100).cast("long")
    return out.withColumn("points", points).withColumn("direction", F.when(F.col("points").isNull(), "none").when(F.abs("points") < 1, "flat").when(F.col("points") > 0, "up").otherwise("down"))


def acceptance(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether a change is accepted: the mean rises and no paper newly falls below the floor. Columns paper_id, score."""
    both = before.select("paper_id", F.col("score").alias("old")).join(after.select("paper_id", F.col("score").alias("new")), "paper_id")
    breaks = F.max(((F.col("old") >= FLOOR) & (F.col("new") < FLOOR)).cast("int"))
    agg = both.agg(F.avg("old").alias("old_mean"), F.avg("new").alias("new_mean"), breaks.alias("breaks"))
    return agg.select("old_mean", "new_mean", ((F.col("new_mean") > F.col("old_mean")) & (F.col("breaks") == 0)).alias("accepted"))
