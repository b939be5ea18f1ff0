"""Legacy ARC archives to WARC records, and WARC archives as files (operator 8).

An ARC archive starts with a version block that names its version (1 or 2) and the fields of the header lines; each record
is one header line and as many bytes as the line declares; of an http page these bytes are the whole HTTP response, header
and body. The converter parses both versions and synthesises what WARC asks for besides: record ids (from the record's key,
so a rerun writes the same), ISO timestamps, types, and digests of the payload (the body) and of the block. The version block
becomes a warcinfo record, once for each file.
Archives are written by Spark's text writer, whose line separator is the two line ends that close every WARC record, and
read back from whole files by declared lengths, never by searching for separators.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import materialize, new_path, release, setting

#: Payloads shorter than this are never replaced by a reference.
MIN_REVISIT_BYTES = 100
#: Bytes of one archive file, which is read back as a whole, and bytes that a record has at most beside its payload and URL.
FILE_BYTES, OPEN_FILES = 64 << 20, 16
_END = b"\r\n\r\n"
#: The field lists of the two ARC versions.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _is_http(url: Column) -> Column:
    return F.coalesce(F.lower(F.substring_index(url, ":", 1)).isin("http", "https"), F.lit(False))


def arc_archive(url: Column, payload: Column, version: Column, date: str = "20240101000000") -> Column:
    """A one-record ARC archive as binary: version block, header line, record. Blanks in the URL are percent-encoded.

    Of an http URL the record is an HTTP response with the payload as its body, of any other the payload itself.
    """
    safe = F.regexp_replace(F.coalesce(url, F.lit("about:blank")), r"[\s\x00-\x1f]", "%20")
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    body = F.when(_is_http(safe), F.concat(answer, payload)).otherwise(payload)
    size = F.octet_length(body).cast("string")
    one = F.concat(safe, F.lit(f" 0.0.0.0 {date} text/html "), size, F.lit("\n"))
    two = F.concat(safe, F.lit(f" 0.0.0.0 {date} text/html 200 - - 0 pages.arc "), size, F.lit("\n"))

    def block(n: int) -> str:
        text = f"{n} 0 folio\n{ARC_NAMES[n]}\n\n"
        tail = {1: "", 2: "200 - - 0 pages.arc "}[n]
        return f"filedesc://pages.arc 0.0.0.0 {date} text/plain {tail}{len(text)}\n{text}"

    head = F.when(version == 2, F.concat(F.lit(block(2)), two)).otherwise(F.concat(F.lit(block(1)), one))
    return F.concat(head.cast("binary"), body, F.lit("\n").cast("binary"))


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC archive: version, the fields of the header line, offset, payload.

    The version comes from the version block's second line. A header line splits from the right, so a URL with blanks
    stays whole. A truncated last record raises ValueError.
    """
    at, version, size = 0, 1, len(data)
    while at < size:
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at byte {at}")
        line = data[at:end].decode("utf-8", "replace")
        if line.startswith("filedesc://"):
            # The header line of the version block follows the version that the block itself declares.
            version = int(data[end + 1 : data.find(b"\n", end + 1)].split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
        names = ARC_FIELDS[version]
        values = line.rsplit(" ", len(names) - 1)
        record = dict(zip(names, values, strict=True))
        length = int(record["length"])
        if length < 0 or end + 1 + length > size:
            raise ValueError(f"the record at byte {at} declares {length} bytes")
        yield record | {"version": version, "offset": at, "payload": data[end + 1 : end + 1 + length]}
        at = end + 1 + length


def record_id(key: str) -> str:
    """The WARC-Record-ID of a key: a version-8 UUID of its SHA-256."""
    raw = bytearray(hashlib.sha256(key.encode()).digest()[:16])
    raw[6], raw[8] = raw[6] & 0x0F | 0x80, raw[8] & 0x3F | 0x80
    return f"<urn:uuid:{uuid.UUID(bytes=bytes(raw))}>"


def _iso(date: str) -> str:
    d = (date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(header with its empty line, body) of an HTTP response; no header where the bytes do not begin as one does."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    at, size = min(ends, default=(len(block), 0))
    return block[: at + size], block[at + size :]


def _digest(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def warcinfo(record: dict, key: str) -> bytes:
    """A version block as a warcinfo record without its closing line ends."""
    fields = f"software: folio\r\nformat: WARC File Format 1.1\r\nsource-format: ARC version {record['version']}\r\nsource-name: {record['url'].removeprefix('filedesc://')}\r\n".encode()
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {_iso(record['date'])}", f"WARC-Block-Digest: {_digest(fields)}", f"X-Source-Key: {key}", "Content-Type: application/warc-fields", f"Content-Length: {len(fields)}"]
    return "\r\n".join(lines).encode() + _END + fields


def to_warc(record: dict, key: str, refers_to: str | None) -> bytes:
    """One ARC record as a WARC record without its closing line ends. With `refers_to` a revisit without payload.

    An http record whose bytes are an HTTP response is a `response` and keeps its header; all others are a `resource`. The
    payload digest is that of the body alone.
    """
    header, payload = split_http(record["payload"]) if record["url"].split(":", 1)[0].lower() in ("http", "https") else (b"", record["payload"])
    block = header if refers_to is not None else header + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response' if header else 'resource'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {_iso(record['date'])}",
        f"WARC-Target-URI: {record['url']}",
        f"WARC-IP-Address: {record['ip']}",
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
        f"X-Source-Key: {key}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if header else record['mime']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block


def convert(archives: DataFrame, key_col: str, content_col: str, refers_col: str) -> DataFrame:
    """WARC records of one-key ARC archives: key string, record binary (without closing line ends), file int.

    file numbers a task's files: a record goes into the next one where it would take a file above FILE_BYTES.
    An archive's first content record has the archive's key, further ones key#n. A version block is a warcinfo record, the
    first of its kind in a task; equal ones that follow add nothing to a file and are left out. Null archives give nothing.
    refers_col names the key that a revisit points to, null for all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        described: set[tuple] = set()
        file, held = 0, 0
        for batch in batches:
            keys, records = [], []
            for key, content, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = 0
                for record in parse_arc(content or b""):
                    if record["url"].startswith("filedesc://"):
                        kind = (record["version"], record["url"], record["date"])
                        if kind not in described:
                            described.add(kind)
                            keys.append(f"{record['url']}#{record['version']}")
                            records.append(warcinfo(record, keys[-1]))
                        continue
                    keys.append(key if n == 0 else f"{key}#{n}")
                    records.append(to_warc(record, keys[-1], refers))
                    n += 1
            files = []
            for record in records:
                if held and held + len(record) > FILE_BYTES:
                    file, held = file + 1, 0
                held += len(record) + len(_END)
                files.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(records, pa.large_binary()), pa.array(files, pa.int32())], names=["key", "record", "file"])

    plain = archives.select(F.coalesce(F.col(key_col).cast("string"), F.lit("")).alias("key"), F.col(content_col).cast("binary").alias("content"), F.col(refers_col).cast("string").alias("refers"))
    return plain.mapInArrow(run, "key string, record binary, file int")


def write_archives(records: DataFrame, path: str) -> None:
    """Write records (record, file) as WARC files below `path` on any Hadoop file system; idempotent under task retries.

    A file holds the records of one number of one task, so it has at most FILE_BYTES, or one larger record. Tasks keep their few
    files open together, which spares a sort of the records by file.
    """
    with setting(records.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
        records.select(F.col("record").cast("string").alias("value"), "file").write.partitionBy("file").option("lineSep", _END.decode()).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files below `path`: key, record_id, record_type, target_uri, date, payload_bytes, payload_digest, refers_to (key).

    Header names count in any case. Lengths and digests of records with a payload are computed from the bytes read; a revisit
    carries those that its headers keep (null where they keep none). Archives of other writers have no keys of ours: the key
    is then the record id. A record whose payload does not match its declared SHA-256 raises ValueError.
    """

    def parse(data: bytes) -> Iterator[tuple]:
        at, size = 0, len(data)
        while at < size:
            end = data.find(_END, at)
            lines = data[at:end].decode().split("\r\n")
            head = {n.lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
            start = end + len(_END)
            block = data[start : start + int(head["content-length"])]
            at = start + len(block) + len(_END)
            kind, declared = head["warc-type"], head.get("warc-payload-digest", "")
            n_bytes = int(head["x-payload-length"]) if "x-payload-length" in head else None
            digest = declared.removeprefix("sha256:") if declared.startswith("sha256:") else None
            if kind not in ("revisit", "warcinfo"):
                payload = split_http(block)[1] if head.get("content-type", "").startswith("application/http") else block
                n_bytes, found = len(payload), hashlib.sha256(payload).hexdigest()
                if digest not in (None, found):
                    raise ValueError(f"{head['warc-record-id']}: the payload does not have the declared digest")
                digest = found
            own = head["warc-record-id"]
            yield head.get("x-source-key", own), own, kind, head.get("warc-target-uri"), head["warc-date"], n_bytes, digest, head.get("x-refers-to-key", head.get("warc-refers-to"))

    names = ["key", "record_id", "record_type", "target_uri", "date", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = list(zip(*parse(batch.column(0)[i].as_py() or b""), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "key string, record_id string, record_type string, target_uri string, date string, payload_bytes long, payload_digest string, refers_to string")


def revisits(payloads: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Of rows (page, digest, bytes): page, refers_to for every page whose payload of at least `min_bytes` a smaller page has.

    Only digests are shuffled; the least page of a digest is found with a map-side combine, so a digest that a third of
    all pages share is no burden. Null pages take no part; repeated rows of the least page all stay responses.
    """
    large = payloads.where((F.col("bytes") >= min_bytes) & F.col("page").isNotNull())
    first = large.groupBy("digest").agg(F.min("page").alias("refers_to"), F.max("page").alias("last")).where("refers_to < last").select("digest", "refers_to")
    return large.join(first, "digest").where("page <> refers_to").select("page", "refers_to").distinct()


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages to ARC archives (versions 1 and 2 alternate by id), to WARC files in the shared folder, and read back.

    Null html is an empty payload, null url about:blank (null ids: the empty key, always a response). Empty tables write
    and read an empty archive. Payload texts are never shuffled unless the table of revisits is too large to broadcast by
    Spark's own threshold. Memory per task is bounded by one archive file: FILE_BYTES, or one record.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    digests = materialize(base.select("page", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("bytes")), "digests")
    known = materialize(revisits(digests, min_bytes), "revisits")
    release(digests)
    marked = base.join(known, "page", "left")
    archives = marked.select(F.col("page").alias("key"), arc_archive(F.col("url"), F.col("payload"), F.pmod(F.coalesce("page", F.lit(0)), F.lit(2)) + 1).alias("content"), "refers_to")
    path = new_path(spark, "warc")
    write_archives(convert(archives, "key", "content", "refers_to"), path)
    back = read_archives(spark, path).where("record_type <> 'warcinfo'")
    # A page whose URL is not http(s) is archived as a resource; for the pages table that is its own payload, a response.
    kind = F.when(F.col("record_type") == "revisit", "revisit").otherwise("response")
    return back.select(F.when(F.col("key") != "", F.col("key")).cast("long").alias(id_col), "payload_bytes", "payload_digest", kind.alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))
