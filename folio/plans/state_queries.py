"""Job state from events: the batch fold, and the same from a stream whose events come out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import state
from folio.plans.registry import Tables, query
from folio.sources import storage
from folio.streaming import jobs

#: When the fold ends; how long a job may be silent here, where a paper has an event every few hours.
UNTIL, SILENT_MINUTES = "2024-02-10 00:00:00", 600
#: Batches in which the stream's events come, and days by which they are mixed.
BATCHES, MIXED_DAYS = 5, 3
#: Events that a state of the stream holds over the whole run, on average.
SHARD_EVENTS = 8192

_FOLD = f"""
main AS (
  SELECT *, count(status) OVER by_time AS segment, last_value(status IGNORE NULLS) OVER by_time AS standing,
         coalesce(lead(ts) OVER by_time, TIMESTAMP '{UNTIL}') > ts + INTERVAL '{SILENT_MINUTES}' MINUTE AS silent
  FROM job_events WHERE NOT side WINDOW by_time AS (PARTITION BY paper ORDER BY ts, event_id)
), recovered AS (
  SELECT paper, segment FROM main WHERE standing = 'narrating' AND silent GROUP BY paper, segment
), jobs AS (
  SELECT paper, max(segment) AS last_segment, arg_max(status, (ts, event_id)) FILTER (status IS NOT NULL) AS last,
         arg_max(CASE WHEN status = 'narrated' THEN 0 ELSE eta END, (ts, event_id)) FILTER (status = 'narrated' OR eta IS NOT NULL) AS eta,
         arg_max(CASE WHEN status IN ('narrating', 'narrated') THEN '' ELSE error END, (ts, event_id)) FILTER (status IN ('narrating', 'narrated') OR error IS NOT NULL) AS error,
         max(ts) FILTER (status = 'narrated') AS completed_at
  FROM main GROUP BY paper
), counts AS (
  SELECT paper, count(*) AS recoveries, max(segment) AS last_recovered FROM recovered GROUP BY paper
), side AS (
  SELECT paper, count(transcript_key) AS versions, count(*) - count(transcript_key) AS invalid FROM job_events WHERE side GROUP BY paper
)"""
_STATES = """
SELECT paper, CASE WHEN last_recovered = last_segment THEN CASE WHEN recoveries > 3 THEN 'failed' ELSE 'unnarrated' END ELSE last END AS status, eta, nullif(error, '') AS error,
       CASE WHEN last_recovered = last_segment AND recoveries > 3 THEN 'timeout' END AS category, completed_at, CAST(least(coalesce(recoveries, 0), 3) AS INTEGER) AS retries,
       CAST(coalesce(versions, 0) AS INTEGER) AS versions, CAST(coalesce(invalid, 0) AS INTEGER) AS invalid
FROM jobs FULL JOIN side USING (paper) LEFT JOIN counts USING (paper)"""


def _with_fold(select: str) -> str:
    from folio.adapters import oracle

    return oracle("", "job_events").rstrip() + "," + _FOLD + select


def arriving(t: Tables, lateness_days: int) -> DataFrame:
    """The job events as a stream of files: dealt over BATCHES by time, mixed by up to MIXED_DAYS, and a last one that moves the
    watermark to UNTIL. A batch has a file for each partition of the events; where some have none, a batch begins with files of the
    next one, whose events are less than the lateness apart."""
    events = t["job_events"].withColumn("ts", F.col("ts").cast("timestamp"))
    path = storage.new_path(t.spark, "job-events")
    days = F.datediff("ts", F.lit("2024-01-01")) + F.pmod(F.xxhash64("event_id"), F.lit(MIXED_DAYS + 1))
    dealt = events.withColumn("batch", F.floor(days * BATCHES / (31 + MIXED_DAYS)))
    for n in range(BATCHES):
        dealt.where(F.col("batch") == n).drop("batch").write.mode("append").parquet(path)
    end = F.lit(UNTIL).cast(events.schema["ts"].dataType) + F.expr(f"INTERVAL {lateness_days} DAYS")
    events.limit(1).select(*[{"ts": end, "paper": F.lit(-1).cast("long")}.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema]).withColumns({"event_id": F.lit(-1).cast("long"), "side": F.lit(False)}).coalesce(1).write.mode("append").parquet(path)
    return jobs.event_stream(t.spark, path, events.schema, dealt.rdd.getNumPartitions())


@query("Z1_job_history", _with_fold(_STATES))
def z1_history(t: Tables):
    return state.job_history(t["job_events"], UNTIL, SILENT_MINUTES)


@query("Z1_stream_of_events", _with_fold(_STATES))
def z1_stream(t: Tables):
    shards = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-t["job_events"].count() // SHARD_EVENTS))
    stream = jobs.job_states(arriving(t, MIXED_DAYS + 8), SILENT_MINUTES, lateness=f"{MIXED_DAYS + 8} days", shards=shards)
    return jobs.run_jobs(stream, storage.new_path(t.spark, "job-states"), storage.new_path(t.spark, "job-checkpoint")).where("paper >= 0").withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))
