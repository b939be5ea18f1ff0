import hashlib

import pytest
from pyspark.sql import functions as F

from folio.llm import warc


def test_pages_round_trip(spark):
    big, small = "WARC/1.1\r\n\r\nx" * 20, "tiny"
    rows = [(5, "http://a/b c", big), (3, "https://x/", big), (9, "ftp://y", big), (4, None, small), (6, "http://z", small), (7, "http://n", None), (None, "http://q", big), (3, "https://x/", big), (8, "http://é", "é漢" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit("clash"))
    out = warc.archive_pages(df).collect()
    assert len(out) == len(rows)
    for r in out:
        html = {x[0]: x[2] for x in rows}[r["page_id"]] or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in out}
    assert kinds[5] == kinds[9] == ("revisit", 3)
    assert all(kinds[p] == ("response", None) for p in (3, 4, 6, 7, 8, None))
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_both_arc_versions():
    one = b"filedesc://t.arc 0.0.0.0 20050101000000 text/plain 76\n1 0 org\nURL IP-address Archive-date Content-type Archive-length\n" + b" " * 10 + b"\n"
    body = one.index(b"\n") + 1
    one = one.replace(b" 76\n", f" {len(one) - body:02d}\n".encode())
    one += b"http://a/with blank 1.2.3.4 20050102030405 text/html 5\nhello\nhttp://b 1.2.3.4 20050102 image/gif 0\n\n"
    records = list(warc.parse_arc(one))
    assert [(r["version"], r["url"], r["payload"]) for r in records[1:]] == [(1, "http://a/with blank", b"hello"), (1, "http://b", b"")]
    record = warc.to_warc(records[1], "k", None)
    assert b"WARC-Type: resource" in record and b"WARC-Date: 2005-01-02T03:04:05Z" in record and record.endswith(b"hello")
    with pytest.raises(ValueError):
        list(warc.parse_arc(one[:-8] + b"http://c 1.2.3.4 20050102 text/html 99\nshort"))


def test_version_two_through_spark(spark):
    df = spark.createDataFrame([(1, "http://a", b"xyz")], "k long, u string, p binary")
    data = df.select(warc.arc_archive(F.col("u"), F.col("p"), F.lit(2)).alias("a")).first()["a"]
    head, record = list(warc.parse_arc(bytes(data)))
    assert head["version"] == record["version"] == 2 and record["status"] == "200" and warc.split_http(record["payload"])[1] == b"xyz"


def http_archive(version):
    names = warc.ARC_NAMES[version]
    tail = b"" if version == 1 else b" 200 - - 0 t.arc"
    body = f"{version} 0 org\n{names}\n\n".encode()
    answer = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>HTTP/1.1 is here\r\n\r\n</p>"
    moved = b"HTTP/1.0 302 Found\nLocation: /y\n\n"
    line = lambda url, n: url + b" 1.2.3.4 20050102030405 text/html" + tail + f" {n}\n".encode()
    return b"filedesc://t.arc 0.0.0.0 20050101000000 text/plain" + tail + f" {len(body)}\n".encode() + body + line(b"http://a", len(answer)) + answer + b"\n" + line(b"https://b", len(moved)) + moved + b"\n"


@pytest.mark.parametrize("version", [1, 2])
def test_http_responses_keep_one_header(spark, tmp_path, version):
    df = spark.createDataFrame([("k", http_archive(version), None), ("again", http_archive(version), "k")], "k string, content binary, refers string").coalesce(1)
    records = warc.convert(df, "k", "content", "refers")
    by_key = {r["key"]: bytes(r["record"]) for r in records.collect()}
    assert [k for k in by_key] == [f"filedesc://t.arc#{version}", "k", "k#1", "again", "again#1"]
    record, payload = by_key["k"], b"<p>HTTP/1.1 is here\r\n\r\n</p>"
    assert record.count(b"HTTP/1.1 200 OK") == 1 and record.endswith(b"Server: x\r\n\r\n" + payload) and b"WARC-Type: response" in record
    assert f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}".encode() in record
    assert b"WARC-Type: warcinfo" in by_key[f"filedesc://t.arc#{version}"] and f"ARC version {version}".encode() in by_key[f"filedesc://t.arc#{version}"]
    assert by_key["again"].endswith(b"Server: x\r\n\r\n")
    warc.write_archives(records, str(tmp_path / "w"))
    back = {r["key"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert (back["k"]["payload_bytes"], back["k"]["record_type"], back["again"]["refers_to"]) == (len(payload), "response", "k")
    assert (back["k#1"]["payload_bytes"], back["k#1"]["payload_digest"]) == (0, hashlib.sha256(b"").hexdigest())


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 50_000)
    df = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://a").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("y"), 9000)).alias("html")).coalesce(1)
    monkeypatch.setattr(warc, "new_path", lambda spark, label: str(tmp_path / label))
    assert warc.archive_pages(df).count() == 40
    sizes = [f.stat().st_size for f in (tmp_path / "warc").glob("file=*/part*")]
    assert sum(sizes) > 7 * 50_000 and max(sizes) <= 50_000 and len(sizes) == 8  # as few as hold them


def test_one_large_page_does_not_scatter_the_archive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1_000_000)
    html = F.when(F.col("id") == 150, F.repeat(F.lit("long "), 600_000)).otherwise(F.concat(F.lit("page "), F.col("id").cast("string")))
    df = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://a").alias("url"), html.alias("html")).repartition(3)
    monkeypatch.setattr(warc, "new_path", lambda spark, label: str(tmp_path / label))
    out = {r["page_id"]: r["payload_bytes"] for r in warc.archive_pages(df).collect()}
    assert len(out) == 300 and out[150] == 3_000_000
    files = list((tmp_path / "warc").glob("file=*/part*"))
    # Those of the three tasks; the large record has one of its own, and what comes behind it another.
    assert 3 <= len(files) <= 5
