"""Writes as relational operators: a new snapshot is a function of the old one and a delta."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Minutes after which a job is stale, and retries it has.
STALE_MINUTES, MAX_RETRIES = 20, 3


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and new rows whose key none has."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key; both must be unique by key."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new)


def first_visits(visits: DataFrame) -> DataFrame:
    """Visits in order of id, less those whose paper already has one of the same ip or of the same token.

    A visit is kept if it is the first of its ip and no earlier kept visit has its token; a visit refused for its ip leaves
    its token free. Each (paper, ip) can keep one visit only, so these first visits alone compete for tokens.
    """
    by_ip = W.partitionBy("paper_id", "visitor_ip").orderBy("id")
    heads = visits.withColumn("n", F.row_number().over(by_ip)).where("n = 1").drop("n")
    token = W.partitionBy("paper_id", "visitor_token").orderBy("id")
    return heads.withColumn("n", F.when(F.col("visitor_token").isNull(), 1).otherwise(F.row_number().over(token))).where("n = 1").drop("n")


def latest_known(events: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sparse patches folded in order: of each column the last value that is not null."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def fold_status(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Job state after all events (columns status, eta, error): the last status, its time, an error only if no later
    narrating or narrated clears it, and eta 0 once narrated."""
    at = F.struct(*order)
    cleared = F.max(F.when(F.col("status").isin("narrating", "narrated"), at))
    error_at = F.max(F.when(F.col("error").isNotNull(), at))
    out = events.groupBy(key).agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("status"), F.max_by("eta", F.when(F.col("eta").isNotNull(), at)).alias("eta"),
        F.max_by("error", F.when(F.col("error").isNotNull(), at)).alias("error"), cleared.alias("cleared"), error_at.alias("error_at"),
        F.max(F.when(F.col("status") == "narrated", F.col(order[0]))).alias("completed_at"), F.max(order[0]).alias("updated_at"),
    )
    live = F.col("error_at").isNotNull() & (F.col("cleared").isNull() | (F.col("error_at") > F.col("cleared")))
    return out.select(key, "status", F.when(F.col("status") == "narrated", F.lit(0).cast("double")).otherwise(F.col("eta")).alias("eta"), F.when(live, F.col("error")).alias("error"), "completed_at", "updated_at")


def job_history(events: DataFrame, as_of: str, stale_minutes: int = STALE_MINUTES, most_retries: int = MAX_RETRIES) -> DataFrame:
    """Job state per paper after all events and scheduled recoveries up to as_of.

    events: paper, ts, event_id, status, eta, error, side, transcript_key, applied in order of (ts, event_id). A status replaces
    the last one; narrating and narrated clear the error, narrated also sets eta to 0. A job that narrates and isn't heard of for
    more than stale_minutes goes back for a retry, or fails when it has had most_retries. Side events leave all that alone: each
    adds a version, or is invalid if it has no transcript key.
    """
    by = W.partitionBy("paper").orderBy("ts", "event_id")
    main = events.where("not side")
    segment = F.count("status").over(by)
    silent = F.coalesce(F.lead("ts").over(by), F.lit(as_of).cast("timestamp")) > F.col("ts") + F.expr(f"INTERVAL {stale_minutes} MINUTES")
    at = F.struct("ts", "event_id")
    rows = main.select("*", segment.alias("segment"), (F.last("status", True).over(by) == "narrating").alias("narrating"), silent.alias("silent"))
    # A recovery ends its segment: however often it falls silent after, it counts once.
    stale = F.col("narrating") & F.col("silent")
    segments = rows.groupBy("paper", "segment").agg(
        F.coalesce(F.max(stale), F.lit(False)).alias("stale"), F.max("status").alias("status"),
        F.max_by(F.when(F.col("status") == "narrated", 0.0).otherwise(F.col("eta")), F.when((F.col("status") == "narrated") | F.col("eta").isNotNull(), at)).alias("eta"),
        F.max(F.when((F.col("status") == "narrated") | F.col("eta").isNotNull(), at)).alias("eta_at"),
        F.max_by("error", F.when(F.col("error").isNotNull() & ~F.coalesce(F.col("status").isin("narrating", "narrated"), F.lit(False)), at)).alias("error"),
        F.max(F.when(F.col("status") == "narrated", F.col("ts"))).alias("completed_at"),
    )
    cleared = F.max(F.when(F.col("status").isin("narrating", "narrated"), F.col("segment")))
    jobs = segments.groupBy("paper").agg(
        F.max_by("status", "segment").alias("last"), F.max_by("stale", "segment").alias("ended"), F.sum(F.col("stale").cast("int")).cast("int").alias("recoveries"),
        F.max_by("eta", "eta_at").alias("eta"), cleared.alias("cleared"), F.max_by(F.struct("segment", "error"), F.when(F.col("error").isNotNull(), F.col("segment"))).alias("error"),
        F.max("completed_at").alias("completed_at"),
    )
    side = events.where("side").groupBy("paper").agg(
        F.sum(F.when(F.coalesce("transcript_key", F.lit("")) != "", 1).otherwise(0)).cast("int").alias("versions"), F.sum(F.when(F.coalesce("transcript_key", F.lit("")) != "", 0).otherwise(1)).cast("int").alias("invalid")
    )
    failed = F.col("ended") & (F.col("recoveries") > most_retries)
    return jobs.join(side, "paper", "full").select(
        "paper", F.when(failed, "failed").when(F.col("ended"), "unnarrated").otherwise(F.col("last")).alias("status"), "eta",
        F.when(F.col("cleared").isNull() | (F.col("error.segment") >= F.col("cleared")), F.col("error.error")).alias("error"),
        F.when(failed, "timeout").alias("category"), "completed_at", F.least(F.coalesce("recoveries", F.lit(0)), F.lit(most_retries)).alias("retries"),
        F.coalesce("versions", F.lit(0)).alias("versions"), F.coalesce("invalid", F.lit(0)).alias("invalid"),
    )


def first_claims(requests: DataFrame, papers: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Papers after claims: the first request of each paper in an allowed state wins; a failed paper gains a retry."""
    won = requests.groupBy(F.col("paper_id").alias("id")).agg(F.min_by("requester", F.struct("at", "request_id")).alias("claimed_by"))
    free = F.col("claimed_by").isNotNull() & F.col("status").isin(list(allowed))
    out = papers.join(won, "id", "left")
    return out.select(
        "id", F.when(free, "narrating").otherwise(F.col("status")).alias("status"),
        (F.col("retry_count") + F.when(free & (F.col("status") == "failed"), 1).otherwise(0)).alias("retry_count"), F.when(free, F.col("claimed_by")).alias("claimed_by"),
    )


def best_versions(versions: DataFrame) -> DataFrame:
    """paper_id, best_version_id: only a strictly higher rank replaces, so the earliest of the highest rank stays."""
    best = F.max_by("id", F.struct(F.col("quality_rank"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("early"), (-F.col("id")).alias("low")))
    return versions.groupBy("paper_id").agg(best.alias("best_version_id"))


def write_once(df: DataFrame, column: str, value: Column) -> DataFrame:
    """The value where the column is null or 0."""
    return df.withColumn(column, F.when(F.col(column).isNull() | (F.col(column) == 0), value).otherwise(F.col(column)))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows whose key column names a deleted id (column id)."""
    return {name: df.join(gone.select(F.col("id").alias(key)), key, "left_anti") for name, (df, key) in tables.items()}


def retain(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than `days` days."""
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def append_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """Append (list_id, seq, paper_id) after each list's last position. A paper that is there already is skipped but uses its place."""
    last = items.groupBy("list_id").agg(F.max("position").alias("last"))
    placed = new.join(last, "list_id", "left").withColumn("position", F.coalesce("last", F.lit(-1)) + F.row_number().over(W.partitionBy("list_id").orderBy("seq")))
    once = placed.withColumn("n", F.row_number().over(W.partitionBy("list_id", "paper_id").orderBy("seq"))).where("n = 1")
    kept = once.join(items.select("list_id", "paper_id"), ["list_id", "paper_id"], "left_anti")
    return items.select("list_id", "paper_id", "position").unionByName(kept.select("list_id", "paper_id", "position"))


def reorder_items(items: DataFrame, order: DataFrame) -> DataFrame:
    """order: list_id, paper_ids array. Positions become the array's; papers it lacks keep theirs."""
    new = order.select("list_id", F.posexplode("paper_ids").alias("new_position", "paper_id"))
    return items.join(new, ["list_id", "paper_id"], "left").withColumn("position", F.coalesce("new_position", "position")).drop("new_position")


def merge_tokens(df: DataFrame, token: str, key: str, old: str, new: str, newest: Column | None = None) -> DataFrame:
    """Rows of the old token go to the new one; where both hold a key the new token's row stays (or the newest, if given)."""
    mine = F.col(token).isin(old, new)
    order = [newest.desc()] if newest is not None else []
    w = W.partitionBy(key, F.when(mine, F.lit(new)).otherwise(F.col(token))).orderBy(*order, (F.col(token) == new).desc())
    ranked = df.withColumn("__n", F.row_number().over(w)).where(~mine | (F.col("__n") == 1)).drop("__n")
    return ranked.withColumn(token, F.when(mine, F.lit(new)).otherwise(F.col(token)))


def recover_stale(papers: DataFrame, as_of: str) -> DataFrame:
    """Narrating papers not updated for STALE_MINUTES go back for a retry, or fail when they have had MAX_RETRIES."""
    stale = (F.col("status") == "narrating") & (F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES"))
    spent = F.col("retry_count") >= MAX_RETRIES
    return papers.select(
        "id", F.when(stale & spent, "failed").when(stale, "unnarrated").otherwise(F.col("status")).alias("status"),
        (F.col("retry_count") + F.when(stale & ~spent, 1).otherwise(0)).alias("retry_count"), F.when(stale & spent, "timeout").alias("error_category"),
    )


def priority_rating(ratings: DataFrame, asks: DataFrame) -> DataFrame:
    """asks: ask_id, paper_id, token, ip. Each ask's rating: that of the token, else that of the ip (newest id)."""
    newest = lambda df, who: df.groupBy("paper_id", who).agg(F.max_by("stars", "id").alias(f"{who}_stars"))
    by_token = newest(ratings, "rater_token").withColumnRenamed("rater_token", "token")
    by_ip = newest(ratings, "rater_ip").withColumnRenamed("rater_ip", "ip")
    return asks.join(by_token, ["paper_id", "token"], "left").join(by_ip, ["paper_id", "ip"], "left").select("ask_id", F.coalesce("rater_token_stars", "rater_ip_stars").alias("stars"))


def remap(column: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Values by a map; others the default (null unless given)."""
    out = default if default is not None else F.lit(None).cast("string")
    for source, target in mapping.items():
        out = F.when(column == source, F.lit(target)).otherwise(out)
    return out


def first_crossings(plays: DataFrame, keys: Sequence[str], at: str, share: Column, marks: Sequence[int] = (25, 50, 75)) -> DataFrame:
    """keys, mark, at: when each key's share (0 to 1) first reached each mark."""
    reached = F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: share * 100 >= m)
    return plays.select(*keys, at, F.explode(reached).alias("mark")).groupBy(*keys, "mark").agg(F.min(at).alias(at))


def throttled(plays: DataFrame, position: Column, every: int = 3) -> DataFrame:
    """The positions that are saved: whole seconds divisible by `every`."""
    return plays.where(F.floor(position) % every == 0)


def script_ready(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions added, outcome of every event) of side events that a script is ready.

    events: paper_id, event, transcript_key. Such an event adds a version and leaves the paper's status alone; one without a
    transcript key, like any other unknown event, is an invalid status.
    """
    ready = (F.col("event") == "script_ready") & (F.coalesce("transcript_key", F.lit("")) != "")
    outcome = F.when(F.coalesce(ready, F.lit(False)), "accepted").otherwise("invalid_status")
    return events.where(ready).select("paper_id", "transcript_key"), events.select("paper_id", "event", outcome.alias("outcome"))


def upkeep(visits: DataFrame, submissions: DataFrame, papers: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run of the scheduled upkeep: visits of 30 days and submissions of 2 days are kept, stale jobs recovered."""
    return retain(visits, "visited_at", as_of, 30), retain(submissions, "submitted_at", as_of, 2), recover_stale(papers, as_of)
