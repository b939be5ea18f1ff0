"""Lines and markers of PDF text, against the SQL of their queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folio.functions import pdf


def test_digits_that_name_something_are_no_rows_of_numbers(spark):
    kept = ["4486733645976649 17.65.244.232 of.", "17.65.244.232", "It 17.65.244.232, 18.65.244.232"]
    gone = ["1.5 2% x 3", "1,024.5 7 ±3", "3.2.1", "12"]
    row = spark.createDataFrame([("\n".join(kept + gone),)], "t string").select(pdf.without_artifacts(F.col("t")).alias("t")).first()
    assert row["t"].split("\n") == kept


@pytest.mark.parametrize("name", ["X31_pdf_markers", "X28_page_artifacts"])
def test_ends_of_documents(spark, tmp_path, name):
    texts = ["of.86", "12.44.178.86", "a,1 b", "see [1", "https://x.y", "x.12\n", "4486733645976649 17.65.244.232 of.", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(duck.execute(entry.oracle_sql()[name]).fetchall())
