"""sections of whole documents, odd ones too, against the SQL of the query."""

import duckdb

import __spark_entry__ as entry


def test_ends_and_paragraphs_of_sections(spark, tmp_path):
    long = "\n\n".join(f"Paragraph {i} " + "of some words " * 300 + "end." for i in range(15))
    texts = ["Plain.", "", None, " ", "ends in blanks \n ", "no-break ", "\n\nlead", "\\relax", "a|b", long, long + "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in entry.queries()["X37_sections"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(duck.execute(entry.oracle_sql()["X37_sections"]).fetchall())
    assert len(long) > 50_000 and [i for i in want if got[i] != want[i]] == []
