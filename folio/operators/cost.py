"""Cost model: features, token proxies, least squares per model, error gate, option matrix and prices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dollars for a million input and output tokens, and for a million characters.
LLM_PRICES = [
    ("openai", "gpt-4o", 2.50, 10.00), ("openai", "gpt-4o-mini", 0.15, 0.60),
    ("anthropic", "claude-haiku-4-5-20251001", 0.80, 4.00), ("anthropic", "claude-sonnet-4-6", 3.00, 15.00),
    ("anthropic", "claude-3-5-haiku-20241022", 0.80, 4.00), ("anthropic", "claude-3-7-sonnet-20250219", 3.00, 15.00),
]
TTS_PRICES = [("openai", "tts-1", 15.0), ("openai", "tts-1-hd", 30.0), ("elevenlabs", "eleven_flash_v2_5", 30.0), ("elevenlabs", "eleven_multilingual_v2", 180.0), ("google", "standard", 4.0), ("google", "wavenet", 16.0)]
#: Options offered, tokens of a figure, longer scripts of a model, rows a fit needs.
LLM_OPTIONS = [("openai", "gpt-4o-mini"), ("openai", "gpt-4o"), ("anthropic", "claude-3-5-haiku-20241022"), ("anthropic", "claude-3-7-sonnet-20250219")]
TTS_OPTIONS = [(None, None), ("openai", "tts-1"), ("openai", "tts-1-hd"), ("elevenlabs", "eleven_flash_v2_5"), ("elevenlabs", "eleven_multilingual_v2"), ("google", "wavenet")]
FIGURE_TOKENS, OTHER_FIGURE_TOKENS = {"openai": 85, "anthropic": 700, "gemini": 550}, 300
SCRIPT_GROWTH, LEAST_ROWS = 1.33, 5
FEATURES = ("latex_char_count", "figure_count", "tar_bytes", "script_char_count")
#: Speech providers' chunk characters, dollars a character and seconds a chunk (used for ETA).
SPEECH = [("elevenlabs", 5000, 0.0003, 15), ("openai", 2000, 0.000015, 20), ("google", 5000, 0.000016, 10), ("polly", 3000, 0.000016, 8), ("azure", 3000, 0.000016, 8), ("free", 4000, 0.0, 5)]
#: Display name, display rank, seconds per thousand characters of the voice tiers.
VOICE_TIERS = [("plus3", "Premium", 3, 3.0), ("plus2", "Studio", 2, 10.0), ("plus1", "Enhanced", 1, 1.25), ("base", "Standard", 0, 1.25)]


def accumulated(versions: DataFrame, keys: Sequence[str] = ("paper_id",)) -> DataFrame:
    """Per paper, over all its versions: cost and latency in all, and the model of the last version that has one.

    Costs are added as decimals of 12 places, so that the sum does not depend on the order of the rows.
    """
    named = F.when(F.col("scripter_mode").isNotNull(), F.col("id"))
    cost = F.sum(F.col("llm_cost").cast("decimal(28,12)")).cast("double")
    return versions.groupBy(*keys).agg(cost.alias("cost"), F.sum("script_latency_ms").alias("tokens"), F.max_by("scripter_mode", named).alias("model"))


def price_table(spark: SparkSession) -> DataFrame:
    """provider, model, input_rate, output_rate (dollars for a million tokens)."""
    return spark.createDataFrame(LLM_PRICES, "provider string, model string, input_rate double, output_rate double")


def quality_rank(provider: Column, model: Column) -> Column:
    """Rank of a voice: better and dearer ones are higher."""
    pick = lambda best, high, low: F.when(model == best, high).otherwise(low)
    return (
        F.when(provider.isNull(), 5)
        .when(provider == "openai", pick("tts-1-hd", 25, 15))
        .when(provider == "google", pick("wavenet", 20, 10))
        .when(provider == "elevenlabs", pick("eleven_multilingual_v2", 45, 35))
        .otherwise(10)
    )


def figure_tokens(provider: Column) -> Column:
    """Input tokens of one figure."""
    out = F.lit(OTHER_FIGURE_TOKENS)
    for name, tokens in FIGURE_TOKENS.items():
        out = F.when(provider == name, tokens).otherwise(out)
    return out


def proxy_tokens(script_chars: Column, latex_chars: Column, figures: Column, provider: Column) -> tuple[Column, Column]:
    """(input, output) tokens by rule of thumb: a quarter of the characters, figures apart; three times the output without a source."""
    output = script_chars / 4
    source = F.coalesce(latex_chars, F.lit(0))
    return F.when(source > 0, source / 4 + F.coalesce(figures, F.lit(0)) * figure_tokens(provider)).otherwise(output * 3.0), output


def dot(coefficients: Column, features: Sequence[Column], intercept: Column) -> Column:
    """Linear prediction, not below zero; missing features count as zero."""
    values = F.array(*[F.coalesce(f.cast("double"), F.lit(0.0)) for f in features])
    return F.greatest(F.aggregate(F.zip_with(coefficients, values, lambda c, x: c * x), F.lit(0.0), lambda a, x: a + x) + intercept, F.lit(0.0))


def token_costs(input_tokens: Column, output_tokens: Column, llm: Column, chars: Column, voice: Column) -> tuple[Column, Column]:
    """(model cost, speech cost) in dollars; llm and voice are provider:model, and what has no price costs nothing."""
    rate = lambda key, rows, i: F.coalesce(*[F.when(key == f"{r[0]}:{r[1]}", F.lit(r[i])) for r in rows], F.lit(0.0))
    spoken = chars * rate(voice, TTS_PRICES, 2)
    return (input_tokens * rate(llm, LLM_PRICES, 2) + output_tokens * rate(llm, LLM_PRICES, 3)) / 1000000, spoken / 1000000


def passes_gate(n: Column, input_rmse: Column, output_rmse: Column, proxy_input: Column, proxy_output: Column) -> Column:
    """A model is used if it has rows enough and beats the rules of thumb in both errors."""
    return (n >= LEAST_ROWS) & (input_rmse < proxy_input) & (output_rmse < proxy_output)


def option_matrix(papers: DataFrame, coefficients: DataFrame | None = None) -> DataFrame:
    """Every paper with a script times every pair of model and voice: tokens, costs, rank, source of the estimate.

    The option list (24 rows, fixed) is exploded from literals, so nothing is joined but prices, which are literals too.
    coefficients: provider_model, input_coeffs, input_intercept, output_coeffs, output_intercept, sample_count and RMSEs.
    """
    prices = {(p, m): (i, o) for p, m, i, o in LLM_PRICES}
    voices = {(p, m): r for p, m, r in TTS_PRICES}
    llm = F.array(*[F.struct(F.lit(p).alias("llm_provider"), F.lit(m).alias("llm_model"), F.lit(prices[p, m][0]).alias("in_rate"), F.lit(prices[p, m][1]).alias("out_rate")) for p, m in LLM_OPTIONS])
    tts = F.array(*[F.struct(F.lit(p).cast("string").alias("tts_provider"), F.lit(m).cast("string").alias("tts_model"), F.lit(voices.get((p, m), 0.0)).alias("voice_rate")) for p, m in TTS_OPTIONS])
    base = papers.where("script_char_count > 0").withColumn("chars", F.ceil(F.col("script_char_count") * F.lit(SCRIPT_GROWTH)))
    wide = base.withColumn("l", F.explode(llm)).withColumn("t", F.explode(tts)).select("*", "l.*", "t.*").drop("l", "t")
    wide = wide.withColumn("provider_model", F.concat_ws(":", "llm_provider", "llm_model"))
    tokens_in, tokens_out = proxy_tokens(F.col("chars"), F.col("latex_char_count"), F.col("figure_count"), F.col("llm_provider"))
    source = F.lit("proxy")
    if coefficients is not None:
        wide = wide.join(coefficients, "provider_model", "left")
        good = F.coalesce(passes_gate(F.col("sample_count"), F.col("input_rmse"), F.col("output_rmse"), F.col("proxy_input_rmse"), F.col("proxy_output_rmse")), F.lit(False))
        x = [F.col("latex_char_count"), F.col("figure_count"), F.col("tar_bytes"), F.col("chars")]
        tokens_in = F.when(good, dot(F.col("input_coeffs"), x, F.col("input_intercept"))).otherwise(tokens_in)
        tokens_out = F.when(good, dot(F.col("output_coeffs"), x, F.col("output_intercept"))).otherwise(tokens_out)
        source = F.when(good, "ml").otherwise("proxy")
    wide = wide.withColumns({"tokens_in": tokens_in, "tokens_out": tokens_out, "estimate_source": source})
    llm_cost = (F.col("tokens_in") * F.col("in_rate") + F.col("tokens_out") * F.col("out_rate")) / F.lit(1e6)
    tts_cost = F.col("chars") * F.col("voice_rate") / F.lit(1e6)
    out = wide.withColumns({"llm_cost": llm_cost, "tts_cost": tts_cost, "quality_rank": quality_rank(F.col("tts_provider"), F.col("tts_model"))})
    return out.withColumn("total_cost", F.col("llm_cost") + F.col("tts_cost")).select("id", "llm_provider", "llm_model", "tts_provider", "tts_model", "quality_rank", "llm_cost", "tts_cost", "total_cost", "estimate_source")


def moments(rows: DataFrame, keys: Sequence[str], targets: Sequence[str], features: Sequence[str] = FEATURES) -> DataFrame:
    """Moment table per keys: n, means m<i> and centred sums of products c<i>_<j> of features and targets, in that order.

    One pass with a map-side combine: Spark's covariance merges centred sums, so nothing is squared before its mean is off. Null
    features are 0, rows without all targets drop out. Such tables add up (merged_moments), whatever the rows were split by.
    """
    z = [*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features], *[F.col(t).cast("double") for t in targets]]
    known = rows.dropna(subset=list(targets))
    pairs = [(F.covar_pop(z[i], z[j]) * F.count("*")).alias(f"c{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]
    return known.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(z)], *pairs)


def merged_moments(tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moment tables of parts (weeks, say) as one row for keys: centred sums plus what the parts' means are off the whole's."""
    k = sum(c[0] == "m" and c[1:].isdigit() for c in tables.columns)
    whole = tables.groupBy(*keys).agg(F.sum("n").alias("w"), *[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(f"w{i}") for i in range(k)])
    off = lambda i: F.col(f"m{i}") - F.col(f"w{i}")
    sums = [F.sum(F.col(f"c{i}_{j}") + F.col("n") * off(i) * off(j)).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    return tables.join(whole, list(keys)).groupBy(*keys).agg(F.first("w").alias("n"), *[F.first(f"w{i}").alias(f"m{i}") for i in range(k)], *sums)


def solved(table: DataFrame, key: str, targets: Sequence[str], features: Sequence[str] = FEATURES) -> DataFrame:
    """key, n and for each target <target>_coeffs and <target>_intercept: least squares of a moment table, a row per model.

    The small systems are solved with the least norm, so rank-deficient groups have one answer.
    """
    k = len(features)

    def solve(batches):
        for pdf in batches:
            out = {key: pdf[key], "n": pdf["n"]} | {f"{t}_{x}": [] for t in targets for x in ("coeffs", "intercept")}
            for r in pdf.to_dict("records"):
                c = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + len(targets))] for i in range(k)])
                scale = np.sqrt(np.maximum(np.diag(c[:, :k]), 1e-300))
                for i, t in enumerate(targets, k):
                    w = np.linalg.lstsq(c[:, :k] / np.outer(scale, scale), c[:, i] / scale, rcond=1e-10)[0] / scale
                    out[f"{t}_coeffs"].append(w.tolist())
                    out[f"{t}_intercept"].append(float(r[f"m{i}"] - w @ np.array([r[f"m{j}"] for j in range(k)])))
            yield pd.DataFrame(out)

    schema = f"{key} string, n long, " + ", ".join(f"{t}_coeffs array<double>, {t}_intercept double" for t in targets)
    return table.mapInPandas(solve, schema)


def fit_by_moments(rows: DataFrame, target: str, features: Sequence[str] = FEATURES) -> DataFrame:
    """Least squares per provider_model: coeffs array, intercept, n, in one pass over the rows."""
    fit = solved(moments(rows, ["provider_model"], [target], features), "provider_model", [target], features)
    return fit.select("provider_model", F.col(f"{target}_coeffs").alias("coeffs"), F.col(f"{target}_intercept").alias("intercept"), "n")


def rmse(predicted: Column, actual: Column) -> Column:
    """Aggregate: root mean square error, infinite without rows."""
    return F.coalesce(F.sqrt(F.avg(F.pow(predicted - actual, 2))), F.lit(float("inf")))


def is_test_row(row_id: Column) -> Column:
    """A fifth of the rows, by a hash of the id that other engines have, too."""
    return F.conv(F.substring(F.md5(row_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 5 == 0


def train(rows: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Coefficients of both targets and errors of fit and rules of thumb on the same held-out rows, per model.

    rows: provider_model, FEATURES, actual_input_tokens, actual_output_tokens, id. By default a fifth of the rows, by hash of
    the id, is held out where a model has at least ten.
    """
    out = held_out if held_out is not None else is_test_row(F.col("id"))
    sized = rows.where("actual_input_tokens is not null and actual_output_tokens is not null")
    counts = sized.groupBy("provider_model").agg(F.count("*").alias("sample_count")).where(F.col("sample_count") >= LEAST_ROWS)
    sized = sized.join(counts, "provider_model").withColumn("test", out & (F.col("sample_count") >= 10))
    targets = {"actual_input_tokens": "input", "actual_output_tokens": "output"}
    fit = solved(moments(sized.where("not test"), ["provider_model"], list(targets)), "provider_model", list(targets))
    coeffs = fit.select("provider_model", *[F.col(f"{t}_{x}").alias(f"{name}_{x}") for t, name in targets.items() for x in ("coeffs", "intercept")])
    judged = sized.where("test or sample_count < 10").join(coeffs, "provider_model")
    x = [F.col(f) for f in FEATURES]
    proxy_in, proxy_out = proxy_tokens(F.col("script_char_count"), F.col("latex_char_count"), F.col("figure_count"), F.split_part("provider_model", F.lit(":"), F.lit(1)))
    errors = judged.groupBy("provider_model").agg(
        F.first("sample_count").alias("sample_count"),
        rmse(dot(F.col("input_coeffs"), x, F.col("input_intercept")), F.col("actual_input_tokens")).alias("input_rmse"),
        rmse(dot(F.col("output_coeffs"), x, F.col("output_intercept")), F.col("actual_output_tokens")).alias("output_rmse"),
        rmse(proxy_in, F.col("actual_input_tokens")).alias("proxy_input_rmse"),
        rmse(proxy_out, F.col("actual_output_tokens")).alias("proxy_output_rmse"),
    )
    return coeffs.join(errors, "provider_model")


def cheapest(options: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The option of least total cost for each key; ties go to the first by model and voice."""
    label = F.concat_ws("/", "llm_provider", "llm_model", F.coalesce("tts_provider", F.lit("free")), F.coalesce("tts_model", F.lit("free")))
    best = F.min(F.struct("total_cost", label.alias("label")))
    return options.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.label").alias("label"), F.col("b.total_cost").alias("total_cost"))


def speech_estimate(chars: Column, chunk: Column, rate: Column, seconds: Column) -> tuple[Column, Column]:
    """(seconds of all chunks, dollars rounded to 6 places)."""
    return F.ceil(chars / chunk) * seconds, F.round(chars * rate, 6)
