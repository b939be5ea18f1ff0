import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folio.operators import cost, state
from folio.plans import search
from folio.streaming import jobs


@pytest.mark.parametrize(
    "query, expression, feed",
    [
        ("graph neural", '"graph"* "neural"*', "all:graph AND all:neural"), ('"deep learning" -survey', '"deep learning" NOT ("survey"*)', 'all:"deep learning" ANDNOT all:survey'),
        ("a OR b", '"a"* OR "b"*', "all:a OR all:b"), ("OR a OR", '"a"*', "all:a"), ("-x", "", ""), ("a or b", '"a"* "or"* "b"*', "all:a AND all:or AND all:b"),
        ('"open end', '"open end"', 'all:"open end"'), ("a OR -b", '"a"* NOT ("b"*)', "all:a ANDNOT all:b"), ("-b a", '"a"* NOT ("b"*)', "all:a"), ("", "", ""),
    ],
)
def test_query_language(query, expression, feed):
    assert search.match_expression(search.parse(query)) == expression
    assert search.feed_expression(search.parse(query)) == feed


def test_search(spark):
    docs = spark.createDataFrame([(1, "Café society", "a c"), (2, "cafes of the world", "b"), (3, "the end", "of the"), (4, None, "b c")], "id long, title string, abstract string")
    ids = lambda q: [r["id"] for r in search.search(docs, q, "id", ["title", "abstract"]).collect()]
    assert sorted(ids("cafe")) == [1, 2] and ids('"of the"') and sorted(ids('"of the"')) == [2, 3]
    assert ids("a OR b -c") == [1] and ids("-c") == [] and ids('"end of"') == []
    assert ids("nothing") == []


SCHEMA = "paper long, ts timestamp, event_id long, status string, eta double, error string, side boolean, transcript_key string"
START = datetime(2024, 1, 1, tzinfo=UTC)


def job_events(seed, count):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        side = rng.random() < 0.2
        status = None if side else rng.choice([None, None, "narrating", "narrating", "narrated", "failed"])
        at = START + timedelta(minutes=rng.randrange(3000), microseconds=rng.randrange(3))
        out.append((rng.randrange(6), at, i, status, None if side else rng.choice([None, 5.0, 9.0]), f"e{i}" if status == "failed" else None, side, rng.choice([None, "", "t.txt"]) if side else None))
    return out


def folded(rows, end, stale=20, most=3):
    """The jobs, event by event."""
    jobs = {}
    for paper in {r[0] for r in rows}:
        job = {"status": None, "eta": None, "error": None, "category": None, "completed_at": None, "retries": 0, "versions": 0, "invalid": 0}
        heard = None

        def recover(now):
            if job["status"] == "narrating" and now > heard + timedelta(minutes=stale):
                job.update({"status": "failed", "category": "timeout"} if job["retries"] >= most else {"status": "unnarrated", "retries": job["retries"] + 1})

        for _, ts, _, status, eta, error, side, transcript in sorted((r for r in rows if r[0] == paper), key=lambda r: (r[1], r[2])):
            if side:
                job["versions" if transcript else "invalid"] += 1
                continue
            recover(ts)
            heard = ts
            job["error"] = None if status in ("narrating", "narrated") else error or job["error"]
            job["eta"] = 0.0 if status == "narrated" else eta if eta is not None else job["eta"]
            job["completed_at"] = ts if status == "narrated" else job["completed_at"]
            job.update({"status": status, "category": None} if status else {})
        recover(end)
        jobs[paper] = tuple(job.values())
    return jobs


def test_history_equals_event_by_event(spark):
    for seed in range(4):
        rows = job_events(seed, 250)
        df = spark.createDataFrame(rows, SCHEMA)
        got = {r["paper"]: tuple(r)[1:] for r in state.job_history(df, "2024-01-05 00:00:00").withColumn("completed_at", F.unix_micros("completed_at")).collect()}
        want = folded(rows, START + timedelta(days=4))
        assert got == {p: (*j[:4], j[4] and int((j[4] - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)), *j[5:]) for p, j in want.items()}


def test_stream_of_shuffled_events_equals_history(spark, tmp_path):
    rows = job_events(7, 300)
    mixed = random.Random(1).sample(rows, len(rows))
    for part in (mixed[:100], mixed[100:101], mixed[101:], [(-1, START + timedelta(days=6), -1, None, None, None, False, None)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.job_states(jobs.event_stream(spark, str(tmp_path / "in"), SCHEMA, 1), lateness="2 days")
    got = jobs.run_jobs(stream, str(tmp_path / "out"), str(tmp_path / "c")).where("paper >= 0")
    want = state.job_history(spark.createDataFrame(rows, SCHEMA), "2024-01-05 00:00:00")
    shown = lambda df: sorted(map(str, df.select("paper", *jobs.JOB_COLUMNS).collect()))
    assert shown(got) == shown(want)
    # Another run finds nothing new, and each paper's changes are numbered without gaps.
    jobs.run_jobs(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    again = spark.read.parquet(str(tmp_path / "out")).groupBy("paper").agg(F.count("*").alias("n"), F.max("applied").alias("m"), F.count_distinct("applied").alias("d"))
    assert all(r["n"] == r["m"] == r["d"] for r in again.collect())


def test_unique_visits_and_windows(spark, tmp_path):
    events = spark.sql("select id % 10 as user_id, id % 4 as page, timestamp'2024-01-01' + make_interval(0,0,0,0,id) as ts, (id % 100) / 100d as share from range(96)")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = events.schema
    stream = lambda: jobs.event_stream(spark, str(tmp_path / "in"), schema)
    assert jobs.run_to_end(jobs.unique_visits(stream(), ["user_id", "page"]), "unique_visits", str(tmp_path / "c1")).count() == 20
    assert jobs.run_to_end(jobs.trailing_counts(stream(), "page", "2 days", "1 day"), "trailing", str(tmp_path / "c2")).count() > 0
    marks = jobs.run_to_end(jobs.first_milestones(stream(), "user_id", "share"), "milestones", str(tmp_path / "c3"))
    assert marks.count() == events.selectExpr("user_id", "explode(filter(array(25,50,75), m -> share * 100 >= m)) as m").distinct().count()


def test_least_squares_with_a_rank_deficient_group(spark):
    rows = [("m", float(i), 2.0, None, float(i % 3), 3.0 * i + 7.0) for i in range(20)] + [("n", 1.0, 1.0, 1.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "provider_model string, latex_char_count double, figure_count double, tar_bytes double, script_char_count double, y double")
    fit = {r["provider_model"]: r for r in cost.fit_by_moments(df, "y").collect()}
    assert abs(fit["m"]["coeffs"][0] - 3) < 1e-8 and abs(fit["m"]["intercept"] - 7) < 1e-6
    assert fit["n"]["coeffs"] == [0, 0, 0, 0] and abs(fit["n"]["intercept"] - 5) < 1e-9


def test_moments_of_parts_are_those_of_the_whole(spark):
    rng = random.Random(4)
    rows = [(f"m{i % 3}", rng.randrange(5) if i % 3 else 0, 1e3 * rng.random(), rng.random() * 1e-3, None if i % 7 == 0 else rng.random(), 5.0, rng.gauss(0, 1) * 1e3, rng.random() if i % 11 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "provider_model string, week int, latex_char_count double, figure_count double, tar_bytes double, script_char_count double, y double, z double")
    whole = cost.moments(df, ["provider_model"], ["y", "z"])
    parts = cost.merged_moments(cost.moments(df, ["provider_model", "week"], ["y", "z"]), ["provider_model"])
    got, want = ({r["provider_model"]: r.asDict() for r in x.collect()} for x in (parts, whole))
    assert got.keys() == want.keys()
    for m, w in want.items():
        scale = {c: abs(w[c]) if c[0] != "c" else (w[f"c{c[1]}_{c[1]}"] * w[f"c{c[3]}_{c[3]}"]) ** 0.5 for c in whole.columns[1:]}
        assert all(abs(got[m][c] - w[c]) <= 1e-9 * scale[c] for c in scale)
    fits = [{r["provider_model"]: r.asDict() for r in cost.solved(x, "provider_model", ["y", "z"]).collect()} for x in (parts, whole)]
    assert all(fits[0][m][c] == pytest.approx(fits[1][m][c], rel=1e-6, abs=1e-6) for m in fits[1] for c in ("n", "y_coeffs", "y_intercept", "z_coeffs", "z_intercept"))


def test_visits_are_unique_by_ip_and_by_token(spark):
    rows = [(1, "p", "i1", "t1"), (2, "p", "i1", "t2"), (3, "p", "i2", "t1"), (4, "p", "i3", "t2"), (5, "p", "i4", None), (6, "p", "i4", None)]
    df = spark.createDataFrame(rows, "id long, paper_id string, visitor_ip string, visitor_token string")
    assert sorted(r["id"] for r in state.first_visits(df).collect()) == [1, 4, 5]
