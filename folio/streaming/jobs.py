"""Structured Streaming: event folds, idempotent visits, trailing windows, milestones.

Every job reads an events folder as a stream, runs with availableNow and writes through foreachBatch snapshots or the
sinks of Spark, so a rerun picks up at its checkpoint. Batch twins of all of them are in folio.operators.state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.operators.state import MAX_RETRIES, STALE_MINUTES

#: How late an event may come.
LATENESS = "1 day"
#: States that the jobs are dealt to.
SHARDS = 256


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """Files of Parquet events as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unique_visits(events: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The first event of each key within the lateness; state is dropped behind the watermark."""
    return events.withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark(keys)


def trailing_counts(events: DataFrame, key: str, window: str = "7 days", slide: str = "1 day", ts: str = "ts") -> DataFrame:
    """Events per key in sliding windows, final once the watermark has passed."""
    return events.withWatermark(ts, LATENESS).groupBy(F.window(ts, window, slide), key).agg(F.count("*").alias("n")).select(F.col("window.end").alias("until"), key, "n")


def first_milestones(events: DataFrame, key: str, share: str, marks: tuple[int, ...] = (25, 50, 75), ts: str = "ts") -> DataFrame:
    """The first time within the lateness that a key's share (0 to 1) reaches each mark."""
    reached = F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.col(share) * 100 >= m)
    return events.withWatermark(ts, LATENESS).select(ts, key, F.explode(reached).alias("mark")).dropDuplicatesWithinWatermark([key, "mark"])


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = ["paper", "at", "event_id", "status", "eta", "error", "side", "transcript_key"]
_JOB = "status string, at long, eta double, error string, category string, completed_at long, retries int, versions int, invalid int, applied long"
JOB_COLUMNS = ("status", "eta", "error", "category", "completed_at", "retries", "versions", "invalid")


class JobFold(StatefulProcessor):
    """The state of a shard of papers' jobs, folded in event time whatever the order of arrival.

    Events wait in a list state until the watermark has passed them and are then applied by (ts, event_id) of each paper; a shard's
    only timer wakes it for the first event that waits or the first job that narrates and isn't heard of for `stale` microseconds.
    A call for each paper and timer would cost more than the fold, so what a call brings is kept as Arrow in one row. The
    rules are those of folio.operators.state.job_history, its batch twin.
    """

    def __init__(self, stale: int, most_retries: int):
        self.stale, self.most_retries = stale, most_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", "papers binary")
        self.waiting = handle.getListState("waiting", "events binary")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            self.waiting.appendValue((_packed(pa.Table.from_pandas(batch[_EVENT], _EVENTS, preserve_index=False)),))
            at = int(batch["at"].min())
            first = at if first is None else min(first, at)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        events = pa.concat_tables([_EVENTS.empty_table(), *(_unpacked(r[0]) for r in self.waiting.get())])
        passed = pc.less_equal(events["at"], now)
        due, later = events.filter(passed), events.filter(pc.invert(passed))
        jobs = {r.pop("paper"): r for r in _unpacked(self.jobs.get()[0]).to_pylist()} if self.jobs.exists() else {}
        changed = self._fold(jobs, due.sort_by([("paper", "ascending"), ("at", "ascending"), ("event_id", "ascending")]), now)
        if len(due):
            self.waiting.put([(_packed(later),)]) if len(later) else self.waiting.clear()
        if changed:
            self.jobs.update((_packed(pa.Table.from_pylist([{"paper": p, **job} for p, job in jobs.items()], _JOBS)),))
        silent = [job["at"] + self.stale for job in jobs.values() if job["status"] == "narrating"]
        waking = [pc.min(later["at"]).as_py(), *silent] if len(later) else silent
        if waking:
            self._wake(min(waking))
        if changed:
            yield pd.DataFrame([{"paper": p, **{c: jobs[p][c] for c in JOB_COLUMNS}, "applied": jobs[p]["applied"]} for p in changed]).astype({"eta": "float64", "completed_at": "Int64"})

    def _fold(self, jobs: dict, due: pa.Table, now: int) -> list:
        """Apply events in order, then recover what is silent; the papers whose job is another one now."""
        before = {}
        for paper, *event in zip(*(c.to_pylist() for c in due.columns), strict=True):
            job = jobs.get(paper)
            if job is None:
                job = jobs[paper] = dict.fromkeys(_names(_JOB)) | {"retries": 0, "versions": 0, "invalid": 0, "applied": 0}
            if paper not in before:
                before[paper] = dict(job)
            self._apply(job, *event)
        for paper, job in jobs.items():
            if self._silent(job, now):
                before.setdefault(paper, dict(job))
                self._recover(job, now)
        changed = [p for p, job in before.items() if jobs[p] != job]
        for p in changed:
            jobs[p]["applied"] += 1
        return changed

    def _wake(self, at: int) -> None:
        # A timer of the millisecond after: the watermark has then passed the whole of this one. A later one gives way.
        at = at // 1000 + 1
        if self.timer.exists():
            (known,) = self.timer.get()
            if known <= at:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _silent(self, job: dict, now: int) -> bool:
        return job["status"] == "narrating" and now > job["at"] + self.stale

    def _recover(self, job: dict, now: int) -> None:
        if self._silent(job, now):
            spent = job["retries"] >= self.most_retries
            job.update(status="failed", category="timeout") if spent else job.update(status="unnarrated", retries=job["retries"] + 1)

    def _apply(self, job: dict, at: int, event_id: int, status: str | None, eta: float | None, error: str | None, side: bool | None, transcript_key: str | None) -> None:
        if side:
            job["versions" if transcript_key else "invalid"] += 1
            return
        self._recover(job, at)
        job["at"] = at
        if error is not None:
            job["error"] = error
        if eta is not None:
            job["eta"] = eta
        if status is not None:
            job.update(status=status, category=None)
        if status in ("narrating", "narrated"):
            job["error"] = None
        if status == "narrated":
            job.update(eta=0.0, completed_at=at)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
_EVENTS = pa.schema([*((c, pa.int64()) for c in _EVENT[:3]), ("status", pa.string()), ("eta", pa.float64()), ("error", pa.string()), ("side", pa.bool_()), ("transcript_key", pa.string())])
_JOBS = pa.schema([("paper", pa.int64()), *((c.split()[0], _ARROW[c.split()[1]]) for c in _JOB.split(", "))])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


def job_states(events: DataFrame, stale_minutes: int = STALE_MINUTES, most_retries: int = MAX_RETRIES, lateness: str = LATENESS, shards: int = SHARDS) -> DataFrame:
    """Job state per paper, a row whenever it changed; of a paper's rows the one of largest `applied` holds. Papers are dealt to
    `shards` states, each of which a task has in memory while it folds: some thousand events a shard are right.

    events: paper long, ts timestamp, event_id long, status string, eta double, error string (nulls are not in the patch), side
    boolean (a side event that a script is ready) and transcript_key string. Needs the RocksDB state store (run_jobs sets it).
    """
    # Papers without a number are a shard of their own, so that the numbers of others stay whole in pandas.
    shard = F.when(F.col("paper").isNull(), -1).otherwise(F.pmod(F.xxhash64("paper"), F.lit(shards))).cast("int")
    rows = events.withWatermark("ts", lateness).select(shard.alias("shard"), "ts", F.unix_micros("ts").alias("at"), *[c for c in _EVENT if c != "at"])
    out = "paper long, status string, eta double, error string, category string, completed_at long, retries int, versions int, invalid int, applied long"
    return rows.groupBy("shard").transformWithStateInPandas(JobFold(stale_minutes * 60_000_000, most_retries), out, "Append", "EventTime")


def run_jobs(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run job_states() over all that is there now into Parquet files and return each paper's last state."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, _ROCKS)
    try:
        run_to_parquet(stream, path, checkpoint)
    finally:
        spark.conf.set(key, before)
    states = spark.read.schema(stream.schema).parquet(path)
    last = states.groupBy("paper").agg(F.max_by(F.struct(*JOB_COLUMNS), "applied").alias("job")).select("paper", "job.*")
    return last.withColumn("completed_at", F.timestamp_micros("completed_at"))


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run all that is there now into an in-memory table (tests, small results) and return it."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run all that is there now into Parquet files, exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
