"""Archives and folders as tables: members come in bounded batches, and Python's batches are bounded by bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from folio.plans.registry import BATCH_BYTES, Tables
from folio.sources import archive_source, archives


def test_folders_are_read_as_sources(spark, tmp_path):
    rows = [("1", "main.tex", b"\\documentclass{a}\\begin{document}\\input{Sec/One}\\input{gone}\\end{document}"), ("1", "sec/one.tex", b"One"), ("1", "f.png", b"x"), ("2", "f.png", b"")]
    base = f"file://{tmp_path}/sources"
    archive_source.write_members(spark.createDataFrame(rows, "path string, name string, content binary"), base, layout="folder")
    (tmp_path / "sources" / "loose.tex").write_text("in no folder")
    found = archive_source.read_members(spark, base, "path string, name string, size long", layout="folder")
    assert sorted(map(tuple, found.collect())) == [("1", "f.png", 1), ("1", "main.tex", 74), ("1", "sec/one.tex", 3), ("2", "f.png", 0)]
    texts = archives.latex_texts(archive_source.read_members(spark, base, "path string, name string, content binary", ".tex", "folder"), missing="[{}]")
    assert [tuple(r) for r in texts.collect()] == [("1", "\\documentclass{a}\\begin{document}One[gone]\\end{document}")]


def test_members_are_handed_on_in_bounded_batches(tmp_path):
    big = b"x" * (archive_source.BATCH_BYTES // 2)
    writer = archive_source.ArchiveWriter({"path": str(tmp_path)}, ["path", "name", "content"])
    writer.write(iter([{"path": "a.tar", "name": f"{i}.tex", "content": big} for i in range(6)]))
    reader = archive_source.ArchiveReader({"path": str(tmp_path)}, ["name", "content"])
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(isinstance(b, pa.RecordBatch) for b in batches) and [b.num_rows for b in batches] == [2, 2, 2, 0]


def test_batches_of_texts_are_bounded_by_bytes(spark, tmp_path):
    wide = spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1 << 20).alias("text"))
    wide.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    texts = Tables(spark, str(tmp_path)).spread("documents").select("text").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    got = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 64 and max(got) <= BATCH_BYTES // (1 << 20) + 1
