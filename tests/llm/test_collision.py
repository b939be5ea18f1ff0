import numpy as np
from pyspark.sql import functions as F

from folio.llm import collision


def brute(rows, k=20):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in usable:
        if q % 20 == 0:
            out[q] = sorted((-float(v @ w), i) for i, w in usable if i != q)[:k]
    return out


def run(spark, df):
    got = {}
    for r in collision.nearest(df, df.where(F.col("vec_id") % 20 == 0)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_recall_on_the_test_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want, got = brute([(r["vec_id"], r["embedding"]) for r in df.collect()]), run(spark, df)
    assert set(want) == set(got)
    assert all(x == sorted(x) and len(x) == 20 for x in got.values())
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    scores = {(q, i): s for q in want for s, i in want[q]}
    assert all(abs(s - scores[q, i]) < 1e-12 for q in got for s, i in got[q] if (q, i) in scores)


def test_norms_differ(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(16) * rng.uniform(0.1, 9)).tolist()) for i in range(1200)]
    want, got = brute(rows), run(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_bad_vectors_ties_and_few_rows(spark):
    good = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [3.0, 4.0])]
    bad = [(40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [1.0, None]), (120, [float("inf"), 1.0]), (140, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    assert run(spark, df) == brute(good + bad)
    assert run(spark, df.limit(0)) == {}
    assert run(spark, df.where("vec_id = 60")) == {}


def test_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    other = (7, (100 * np.ones(8)).tolist())
    df = spark.createDataFrame([*rows, rows[20], rows[20], rows[31], other], "vec_id long, embedding array<double>")
    least = {i: min(v for j, v in [*rows, other] if j == i) for i, _ in rows}
    want = brute(list(least.items()))
    got = run(spark, df)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert all(len({i for _, i in x}) == 20 for x in got.values())


def test_equal_vectors_stand_in_the_order_of_ids(spark):
    rng = np.random.default_rng(4)
    for trial in range(4):
        rows = [(i, rng.standard_normal(64).tolist()) for i in range(300)]
        same = rng.permutation(300)[:24].tolist()
        rows = [(i, [2 * x for x in rows[0][1]] if i in same else v) for i, v in rows]
        for found in run(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).values():
            assert found == sorted(found)
            equal = [(s, i) for s, i in found if i in same]
            assert len({s for s, _ in equal}) <= 1 and [i for _, i in equal] == sorted(i for _, i in equal)


def test_few_vectors_are_verified():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((64, 64))
    vectors = np.repeat(centres, 64, axis=0) + 0.5 * rng.standard_normal((4096, 64))
    index = collision.CollisionIndex(np.arange(4096), vectors, float(np.linalg.norm(vectors, axis=1).max()))
    found = index.search(np.arange(0, 4096, 64), vectors[::64], 20)
    assert index.verified < 0.2 * index.asked
    exact = [set(np.argsort(-np.where(np.arange(4096) == q, -1e9, vectors @ vectors[q]))[:20].tolist()) for q in range(0, 4096, 64)]
    assert sum(len(e & set(f[0].tolist())) for e, f in zip(exact, found, strict=True)) >= 0.95 * 20 * 64


def test_one_long_vector_changes_nothing():
    rng = np.random.default_rng(6)
    vectors = np.repeat(rng.standard_normal((32, 64)), 64, axis=0) + 0.4 * rng.standard_normal((2048, 64))
    ids, asked = np.arange(2048), slice(None, None, 64)
    plain = collision.RangedIndex(ids, vectors)
    want = plain.search(ids[asked], vectors[asked], 20)
    longer = vectors.copy()
    longer[5] *= 100
    ranged = collision.RangedIndex(ids, longer)
    got = ranged.search(ids[asked], vectors[asked], 20)
    assert ranged.verified <= 1.1 * plain.verified + len(want)
    exact = [np.argsort(-np.where(ids == q, -np.inf, longer @ v))[:20] for q, v in zip(ids[asked], vectors[asked], strict=True)]
    assert sum(len(set(e.tolist()) & set(f[0].tolist())) for e, f in zip(exact, got, strict=True)) >= 0.95 * 20 * len(got)


def test_norms_that_overflow_or_underflow(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(200)]
    rows += [(200, [1e200] + [0.0] * 7), (220, [-1e200, 1e200] + [0.0] * 6), (240, [1e-200] * 8), (201, [5e-324] + [0.0] * 7), (202, [-1e300] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with np.errstate(over="ignore", invalid="ignore"):
        want = brute(rows)
    got = run(spark, df)
    assert set(got) == set(want)
    for q in (0, 200, 220):
        assert [i for _, i in got[q]][:3] == [i for _, i in want[q]][:3]
    assert sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want) >= 0.9 * 20 * len(want)
