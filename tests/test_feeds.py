"""Atom feeds: pages of a file, ids of entries."""

from pyspark.sql import functions as F

from folio.sources import feeds

ENTRY = "<entry><id>http://arxiv.org/abs/{}v2</id><title>T {}</title><published>2024-01-02T00:00:00Z</published><author><name>A</name></author><summary>s</summary></entry>"


def page(total, *ids):
    return f"<feed>\n<opensearch:totalResults>{total}</opensearch:totalResults>\n" + "\n".join(ENTRY.format(i, i) for i in ids) + "</feed>\n"


def test_pages_of_one_file_keep_their_totals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(page(2, "2401.10001", "2401.10002") + page(7, "2401.10003") + page(5))
    stream = feeds.entry_stream(spark, str(tmp_path / "in"))
    q = stream.writeStream.format("memory").queryName("feed_pages").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["id"], r["total"]) for r in spark.table("feed_pages").collect())
    assert got == [("2401.10001", 2), ("2401.10002", 2), ("2401.10003", 7)]


def test_ids_are_whole(spark):
    ids = {"2401.100000v1": "2401.100000", "2401.10000": "2401.10000", "math.GT/0309136v12": "math.GT/0309136"}
    for shown, want in ids.items():
        xml = f"<feed><entry><id>http://arxiv.org/abs/{shown}</id></entry><entry><id>see {want}</id></entry></feed>"
        got = spark.createDataFrame([(xml,)], "x string").select(feeds.feed_entries(F.col("x")).alias("e")).first()["e"]
        assert got[0]["id"] == want
    assert spark.createDataFrame([("<entry><id>x 2401.10000v1</id>",)], "x string").select(feeds.feed_entries(F.col("x")).alias("e")).first()["e"][0]["id"] == "2401.10000"
