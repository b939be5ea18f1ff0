"""The index gives what a search over the texts gives, reads its terms' partitions only, and keeps up with changes."""

import pytest

from folio.plans import search
from folio.plans.search_index import SearchIndex

FIELDS = ["title", "abstract"]
QUERIES = ["cafe", '"of the"', "a OR b -c", "-c", '"end of"', "nothing", "the world", "e-ma", '"the the"', "b", '"of the" OR cafe -societ', "wor th", '"b c" a', "naïve OR ÉCOLE", '"mail e"']


@pytest.fixture
def docs(spark):
    rows = [
        (1, "Café society", "a c"), (2, "cafes of the world", "b"), (3, "the end", "of the e-mail e"), (4, None, "b c"), (5, "", None), (6, "a " * 3000 + "b c", "the the the"),
        (7, "naive école", "Worlds of\nthe_end, of-the"), (8, "e mail", "emails"), (9, "end", "of the"),
    ]
    return spark.createDataFrame(rows, "id long, title string, abstract string")


def same(index, docs, queries=QUERIES):
    for q in queries:
        got = [(r["id"], round(r["rank"], 9)) for r in index.search(q).collect()]
        assert got == [(r["id"], round(r["rank"], 9)) for r in search.search(docs, q, "id", FIELDS).collect()], q


def test_index_equals_search_over_texts(spark, docs, tmp_path):
    same(SearchIndex.build(docs, str(tmp_path / "i"), "id", FIELDS), docs)


def test_updates_deletions_and_compaction(spark, docs, tmp_path):
    index = SearchIndex.build(docs, str(tmp_path / "i"), "id", FIELDS)
    new = spark.createDataFrame([(2, "the world", "changed twice of the"), (10, "cafe", "b b b")], docs.schema)
    index.update(new)
    index.update(deleted=docs.where("id = 6 or id = 4"))
    index.update(docs.where("id = 4"), docs.where("id = 3"))
    assert index.segments() == 4
    now = docs.where("id not in (2, 3, 6)").unionByName(new)
    same(index, now, QUERIES[::2])
    whole = index.compact(str(tmp_path / "c"))
    assert whole.segments() == 1
    same(whole, now, QUERIES[1::4])


def test_a_segment_without_totals_does_not_count(spark, docs, tmp_path):
    index = SearchIndex.build(docs, str(tmp_path / "i"), "id", FIELDS)
    docs.limit(0).write.parquet(str(tmp_path / "i" / "000001" / "postings"))
    assert index.segments() == 1
    same(index, docs, QUERIES[:2])


def test_search_reads_its_terms_only(spark, docs, tmp_path):
    index = SearchIndex.build(docs, str(tmp_path / "i"), "id", FIELDS)
    plan = index.search("cafe world")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "bucket" in line]
    assert scans and all("StringStartsWith(term,cafe)" in s and "bucket#" in s.split("PartitionFilters:")[1].split("PushedFilters")[0] for s in scans)
    assert all("positions" not in s.split("ReadSchema:")[1] for s in scans) and "title" not in plan


def test_empty_index(spark, docs, tmp_path):
    index = SearchIndex.build(docs.limit(0), str(tmp_path / "i"), "id", FIELDS)
    assert index.search("a").collect() == [] and index.search("-a").collect() == []
    with pytest.raises(ValueError, match="no index"):
        SearchIndex(spark, str(tmp_path / "none"), "id", FIELDS).update(docs)


def test_building_and_compacting_shuffle_no_postings(spark, docs, tmp_path, monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("postings are dealt out")

    monkeypatch.setattr(type(docs), "repartition", refused)
    index = SearchIndex.build(docs, str(tmp_path / "i"), "id", FIELDS).compact(str(tmp_path / "c"))
    monkeypatch.undo()
    rows = {(r["term"], r["id"], r["field"]): (r["tf"], r["len"], r["positions"]) for r in index.postings().collect()}
    assert rows["the", 6, 1] == (3, 3005, [0, 1, 2]) and rows["a", 6, 0] == (3000, 3005, list(range(3000))) and rows["b", 6, 0][2] == [3000]
    assert len(rows) == index.postings().count() and all(term for term, _, _ in rows)


def test_empty_documents_that_go_are_counted(spark, docs, tmp_path):
    index = SearchIndex.build(docs, str(tmp_path / "i"), "id", FIELDS)
    index.update(deleted=docs.where("id = 5"))
    same(index, docs.where("id <> 5"), ["cafe", '"of the"'])
