import hashlib

from pyspark.sql import functions as F

from folio.llm import fingerprint


def edited(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        out[doc] = text[: len(text) - cut] + after[:cut]
    return out


def jaccard(a, b):
    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_edited_texts_and_likeness(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    want, texts = edited(docs), dict(docs)
    errors = []
    for r in fingerprint.compare_edited(df).collect():
        text = want[r["doc_id"]]
        assert r["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_chars"] == len(texts[r["doc_id"]])
        errors.append(abs(r["near_edited"] - jaccard(texts[r["doc_id"]], text)))
    assert len(errors) == len(docs) and sum(errors) / len(errors) < 0.05 and max(errors) < 0.25


def test_sparse_ids_cross_buckets(spark):
    docs = [(i, f"text {i} " * 7) for i in (-(1 << 40), -9000, -1, 0, 1, 8191, 8192, 8193, 900_000, 70_000_000, 1 << 41)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.compare_edited(df).collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in edited(docs).items()}


def test_nulls_ties_empty(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "no id at all here"), (5, "é" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    out = fingerprint.compare_edited(df).collect()
    assert len(out) == 6
    by = {r["doc_id"]: r for r in out}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] >= 0
    assert all(len(r["fingerprint"]) == 256 and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    one = fingerprint.compare_edited(df.where("doc_id = 5")).first()
    assert one["near_next"] == 1.0
    assert fingerprint.compare_edited(df.limit(0)).count() == 0
    assert fingerprint.fingerprints(df).count() == 6
