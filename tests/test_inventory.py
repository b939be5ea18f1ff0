"""Inventory queries over whole tables, against results worked out by hand or in plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folio import adapters
from folio.operators import catalog
from folio.plans import inventory_queries
from folio.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_costs_of_papers_with_many_versions(spark):
    papers = defaultdict(list)
    for r in adapters.logical(spark, SF, "narration_versions").collect():
        papers[r["paper_id"]].append(r)
    assert max(len(v) for v in papers.values()) > 1
    got = {r["paper_id"]: r for r in entry.queries()["A21_cost_totals"](spark, SF).collect()}
    assert set(got) == set(papers)
    for paper, rows in papers.items():
        modes = [r["scripter_mode"] for r in sorted(rows, key=lambda r: r["id"]) if r["scripter_mode"] is not None]
        assert got[paper]["cost"] == pytest.approx(sum(r["llm_cost"] for r in rows), rel=1e-9)
        assert got[paper]["tokens"] == sum(r["script_latency_ms"] for r in rows)
        assert got[paper]["model"] == (modes[-1] if modes else None)


class Given(Tables):
    """Logical tables made of rows."""

    def __init__(self, tables):
        self.tables = tables

    def __getitem__(self, name):
        return self.tables[name]


def test_parsers_scored_in_another_mode_or_long_ago_are_unscored(spark):
    parsers = [("now", "llm"), ("mode", "llm"), ("old", "llm"), ("base", "base"), ("never", "llm")]
    scores = [(1, 1, "now", "2001-10-20"), (2, 2, "mode", "2001-10-20"), (3, 1, "old", "2001-01-01"), (4, 2, "base", "2001-10-20")]
    versions = [(1, "plus1", "llm", 0.1, 5), (2, "base", None, 0.1, 5)]
    score_columns = ", ".join(f"cast(0.5 as double) as score_{c}" for c in ("fidelity", "citations", "header", "figures", "tts"))
    tables = {
        "parser_versions": spark.createDataFrame(parsers, "commit_hash string, tier string").selectExpr("*", "timestamp'2001-10-10' as registered_at"),
        "narration_scores": spark.createDataFrame(scores, "id long, version_id long, parser_commit string, at string").selectExpr("id", "version_id", "parser_commit", "cast(at as timestamp) as scored_at", *score_columns.split(", ")),
        "narration_versions": spark.createDataFrame(versions, "id long, narration_tier string, scripter_mode string, llm_cost double, script_latency_ms long"),
    }
    assert sorted(r["commit_hash"] for r in inventory_queries.j8(Given(tables)).collect()) == ["mode", "never", "old"]


def test_trailing_counts_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(0, 400_000)) for i in range(1500)] + [(-1, "b", None)]
    df = spark.createDataFrame(rows, "id long, who string, s long").withColumn("at", F.timestamp_seconds("s"))
    for bucket in (500, 86_400, 10_000_000):
        got = {r["id"]: r["n"] for r in catalog.trailing_counts(df, "id", "who", "at", 86_400, bucket).collect()}
        assert got == {i: sum(w == who and s is not None and t is not None and s - 86_400 <= t < s for _, w, t in rows) for i, who, s in rows}
