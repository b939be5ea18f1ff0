import collections

from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import toxicity
from tests.llm.test_chosen_path import brute as brute_classes
from tests.llm.test_suffixes import brute as brute_repeats

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(texts(kept)) == {d for d, p in scores.items() if not p}
    before = texts(kept)
    single = stage["jaccard_join"](spark, kept, SF)
    assert texts(single) == {d: t for d, t in before.items() if brute_classes(before)[d][0] == d}
    before = texts(single)
    cut = stage["suffix_dedup"](spark, single, SF)
    order = sorted(before)
    gone = dict(zip(order, brute_repeats([before[d].encode() for d in order], 100), strict=True))
    for r in cut.collect():
        want, at = [], 0
        for char in before[r["doc_id"]]:
            size = len(char.encode())
            if not gone[r["doc_id"]][at : at + size].all():
                want.append(char)
            at += size
        assert r["text"] == "".join(want) and r["n_chars"] == len(want)
    packed = stage["packing"](spark, cut, SF)
    total = collections.Counter()
    for r in packed.collect():
        total[r["doc_id"]] += r["length"]
        assert r["length"] <= 4096
    assert set(total) == set(before) and all(total[r["doc_id"]] == r["doc_tokens"] for r in packed.collect())


def test_shared_and_null_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    for _, f in corpus_pipeline.STAGES[:3]:
        odd = f(spark, odd, SF)
        assert odd.columns == docs.columns
    assert odd.count() >= 10


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(("row_key", "row_key__gone", "spans", "id", "doc", "predicted", "class_id", "kept"))])
    for _, f in corpus_pipeline.STAGES[:3]:
        odd = f(spark, odd, SF)
        assert odd.columns[len(docs.columns) :] == ["row_key", "row_key__gone", "spans", "id", "doc", "predicted", "class_id", "kept"]
    assert odd.count() > 10
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), SF).count() == 0
