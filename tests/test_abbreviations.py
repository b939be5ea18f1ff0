"""Abbreviations and what only looks like one, in whole documents, against the SQL of their queries."""

import duckdb
import pytest

import __spark_entry__ as entry
from folio.functions import latex


def test_an_abbreviation_is_a_word_of_its_own():
    for text in ("ecf.40@mail4.example.com", "ücf.9", "cf.40@mail4.example.com", "cf.a-b.c+d@x.y", "1i.e.2"):
        assert latex.spoken_marks(f"As {text} of.") == f"As {text} of."
    assert latex.spoken_marks("(cf.~A), cf., B--i.e.,x e.g.~,y cf. a@b w.r.t. c") == "(compare A), compare B to that is, x for example, y compare a@b with respect to c"


@pytest.mark.parametrize("name", ["X55_latex_to_speech", "X56_hybrid_scripts", "X57_model_scripts", "X26_legacy_clean", "X54_legacy_speech", "D7_hybrid_guard", "X33_pdf_spoken_marks", "X34_pdf_to_speech"])
def test_addresses_are_left_as_they_are(spark, tmp_path, name):
    words = " Thorthti the ofheshen of ea, ecf.40@mail4.example.com onan cf.7@mail1.example.com." * 4
    spark.createDataFrame([(0, words), (1, "bdicf.70@mail2.example.com")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = entry.queries()[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, rows.collect())) == sorted(duck.execute(entry.oracle_sql()[name]).fetchall())
