from datetime import timedelta

from pyspark.sql import functions as F

from folio.operators import state
from folio.plans.registry import Tables
from folio.plans.state_queries import arriving
from folio.sources import storage
from folio.streaming import jobs
from tests.test_search_streaming import SCHEMA, START, job_events


def test_state_has_rows_for_shards_not_for_papers_and_events(spark, tmp_path):
    """a state, a timer and calls for each paper cost more than the fold."""
    rows = [(i % 300 if i % 50 else None, *r[1:]) for i, r in enumerate(job_events(3, 1500))]
    for part in (rows[::2], rows[1::2], [(-1, START + timedelta(days=6), -1, None, None, None, False, None)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.job_states(jobs.event_stream(spark, str(tmp_path / "in"), SCHEMA, 1), lateness="3 days", shards=4)
    seen, start = [], stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs._ROCKS)
    try:
        run = start.trigger(availableNow=True).start()
        run.awaitTermination()
        seen = [o.numRowsTotal for p in run.recentProgress for o in p.stateOperators]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    # Jobs, a timer and its time, and what each of two batches brought, of four shards and those of no paper and of the last event.
    assert seen and max(seen) <= 6 * 6
    got = jobs.run_jobs(stream, str(tmp_path / "out"), str(tmp_path / "c")).where("paper >= 0 OR paper IS NULL")
    want = state.job_history(spark.createDataFrame(rows, SCHEMA), "2024-01-05 00:00:00")
    shown = lambda df: sorted(map(str, df.select("paper", *jobs.JOB_COLUMNS).where("paper IS NOT NULL").collect()))
    assert len(shown(want)) > 200 and shown(got) == shown(want)
    assert got.where("paper IS NULL").count() == 1


def test_every_partition_writes_its_own_events(spark, tmp_path, monkeypatch):
    """one task wrote all events of a batch."""
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    made, new_path = [], storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda *a: made.append(new_path(*a)) or made[-1])
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 30)
    try:
        t = Tables(spark, str(tmp_path))
        stream = arriving(t, 11)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    written = spark.read.schema(stream.schema).parquet(made[-1])
    assert written.select(F.input_file_name()).distinct().count() > 6
    assert written.where("paper >= 0").count() == t["job_events"].count()
