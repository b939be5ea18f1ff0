"""Repeated windows of long sequences: sampling, routing and result plumbing shared by operators 9 and 10.

A window is a fixed number of consecutive symbols (bytes or words) of one document. Every window is charged to one anchor:
the k-gram in it with the least hash (a minimizer). Equal windows have equal anchors at equal places, so:

1. Each document's anchors are found in numpy. An anchor hash that occurs once in the corpus cannot lie in a repeated
   window; only the others go on. (Arrays of anchors are shuffled, never windows: one anchor in about 35 bytes.) Operator 9
   sends a hash of all that is charged to the anchor along: of equal segments only the first in the corpus goes on, and only
   where the anchor has others that differ; so what travels as text does not grow with the number of copies.
2. Documents with repeated anchors cut out one segment per anchor: the windows charged to it. Segments are routed to
   shards by anchor hash, so all equal windows meet in one shard. Equal segments of a task are combined before the shuffle.
3. A shard judges its windows (by suffix array or by parsing, see the operators) and returns runs of window starts.
4. Runs are gathered by document and joined to the texts.

Buckets and shards are counted by the bytes of the texts, so that what one task holds does not grow with the corpus. Hot
anchors do no harm: in steps 1 and 2 a task hands on one entry for all its equal ones, so a hash has no more entries than
there are batches; and shards much larger than the others are split, either at random, to be merged by the operator
(split_shards), or by what their windows hold besides the anchor, so that equal windows still meet (resplit).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import materialize, shuffle_width, small_batches

#: Symbols hashed at once; positions within a chunk break ties, so it must stay below 2**20.
CHUNK = 1 << 17
#: Entries of anchors or segments that a task holds before it hands them on.
FLUSH_ENTRIES = 1_000_000
FLUSH_SEGMENTS = 200_000
#: Shards and buckets for each shuffle partition at least, and bytes of text for each of them at most, on average: small ones
#: keep the arrays of a Python task within some 100 MB.
SHARDS_PER_PARTITION, BUCKETS_PER_PARTITION, SHARD_TEXT, BUCKET_TEXT = 24, 4, 1_000_000, 16_000_000
#: Segment bytes of a shard above which it is split: so many times the mean of all shards, within these bounds.
TIMES_MEAN, LEAST_SHARD, SHARD_BYTES = 4, 1 << 16, 1_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def _gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hashes of all k-grams of 64-bit symbols."""
    parts, level, size = [], symbols, 1
    while True:
        if k & size:
            parts.append((size, level))
        if size * 2 > k:
            break
        n = len(level) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        level = level[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + level[size:]
        size *= 2
    n, at, out = len(symbols) - k + 1, 0, None
    if n <= 0:
        return np.zeros(0, np.uint64)
    for size, level in reversed(parts):
        piece = level[at : at + n]
        out = piece.copy() if out is None else out * np.uint64(pow(_BASE, size, 1 << 64)) + piece
        at += size
    out ^= out >> np.uint64(32)
    out *= _MUL
    out ^= out >> np.uint64(29)
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    size, level = 1, x
    while size * 2 <= w:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    return level if size == w else np.minimum(level[: len(x) - w + 1], level[w - size : w - size + len(x) - w + 1])


def anchor_runs(symbols: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts charged to one anchor: (anchor hash, document number, first start in the document, starts).

    symbols: the documents' symbols, joined; bounds: len+1 offsets of the documents.
    """
    w, out = window - k + 1, []
    low = np.uint64((1 << 20) - 1)
    last = len(symbols) - window + 1
    doc_of = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
    for begin in range(0, max(last, 0), CHUNK):
        part = symbols[begin : begin + CHUNK + window - 1]
        grams = _gram_hashes(part, k)
        key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_sliding_min(key, w) & low).astype(np.int64)
        starts = np.arange(begin, begin + len(anchor))
        doc = doc_of[starts]
        inside = doc == doc_of[starts + window - 1]
        # A run ends where the anchor, the document or validity changes.
        change = np.ones(len(anchor), bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, len(anchor)))
        keep = inside[first]
        first, count = first[keep], count[keep]
        out.append((grams[anchor[first]], doc[first], first + begin - bounds[doc[first]], count))
    if not out:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def segment_hashes(symbols: np.ndarray, at: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each segment (the symbols of `count` windows from `at` on, ascending), from its first and last window, which
    cover it, and its length."""
    out, i = np.empty(len(at), np.uint64), 0
    while i < len(at):  # long texts in blocks
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK)))
        low = int(at[i])
        whole = _gram_hashes(symbols[low : int((at[i:j] + count[i:j]).max()) + window - 1], window)
        first, last = whole[at[i:j] - low], whole[at[i:j] + count[i:j] - 1 - low]
        out[i:j] = first * _MUL + (last ^ (last >> np.uint64(31))) * np.uint64(_BASE) + count[i:j].astype(np.uint64)
        i = j
    return out


def pack_run(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A run's first start (48 bits) and number of starts (15 bits) in one long."""
    return (start.astype(np.int64) << 15) | count


def unpack_run(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed >> 15, packed & 0x7FFF


# --- step 1: anchors that occur again -------------------------------------------------------------------------------

_BLOB = "bucket int, hash binary, doc binary, run binary, kind binary"
_KNOWN, _ONCE, _SUMMARY = 0, 1, 2


def _dealt(bucket: np.ndarray, columns: dict[str, np.ndarray | None]) -> pa.RecordBatch:
    """A row for each bucket with its entries as bytes, documents as differences."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else []
    rows = [order[a:b] for a, b in zip(edges, [*edges[1:], len(order)], strict=True)]
    held = {"bucket": pa.array([int(bucket[own[0]]) for own in rows], pa.int32())}
    for name, values in columns.items():
        held[name] = pa.array([None if values is None else (np.diff(values[own], prepend=0) if name == "doc" else values[own]).tobytes() for own in rows], pa.binary())
    return pa.RecordBatch.from_arrays(list(held.values()), names=list(held))


def _sampler(symbols_of: Callable, window: int, k: int, flush: Callable, whole: bool = False) -> Callable:
    """The anchors of a task's documents, handed to flush(hash, doc, packed run, with `whole` the segment's hash) some at a time."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for doc_ids, texts in text_chunks(batches):
            symbols, bounds = symbols_of(texts)
            h, doc, start, count = anchor_runs(symbols, bounds, window, k)
            if len(h):
                held.append((h, doc_ids[doc], pack_run(start, count), *([segment_hashes(symbols, bounds[doc] + start, count, window)] if whole else [])))
                size += len(h)
            if size >= FLUSH_ENTRIES:
                yield from flush(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield from flush(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return sample


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def repeated_anchors(docs: DataFrame, size: int, symbols_of: Callable, window: int, k: int) -> DataFrame:
    """doc, runs array<binary>: the packed runs of each document's anchors that occur again in the corpus.

    docs: doc long, text string; size: their text_bytes(). symbols_of(list of texts) -> (symbols, bounds).
    """
    buckets = max(BUCKETS_PER_PARTITION * shuffle_width(docs.sparkSession), -(-size // BUCKET_TEXT))

    def flush(h: np.ndarray, doc: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(h, kind="stable")
        ordered = h[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(h)))
        # What repeats within the task is known to repeat: it needs no answer, others only learn that the hash is taken.
        many = np.empty(len(h), bool)
        many[order] = np.repeat(size, size) > 1
        heads = order[new & many[order]]
        once = ~many
        h_all = np.concatenate([h[once], h[heads], h[many]])
        doc_all = np.concatenate([doc[once], doc[heads], doc[many]])
        run_all = np.concatenate([run[once], run[heads], run[many]])
        kind = np.concatenate([np.full(once.sum(), _ONCE, np.uint8), np.full(len(heads), _SUMMARY, np.uint8), np.full(many.sum(), _KNOWN, np.uint8)])
        spread = np.where(kind == _KNOWN, (doc_all.view(np.uint64) * _MUL) >> np.uint64(40), h_all >> np.uint64(40))
        return _dealt(spread % np.uint64(buckets), {"hash": h_all, "doc": doc_all, "run": run_all, "kind": kind})

    def again(blobs: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(blobs.column(name).to_pylist()), kind)
        h, run, kind = join("hash", np.uint64), join("run", np.int64), join("kind", np.uint8)
        doc = np.concatenate([np.cumsum(np.frombuffer(b, np.int64)) for b in blobs.column("doc").to_pylist()])
        known, asked = kind == _KNOWN, kind != _KNOWN
        order = np.argsort(h[asked], kind="stable")
        ah, ad, ar, ak = (x[asked][order] for x in (h, doc, run, kind))
        first = np.flatnonzero(np.append(True, ah[1:] != ah[:-1])) if len(ah) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(ah)))
        hit = np.repeat(size > 1, size) & (ak == _ONCE)
        return by_doc(np.concatenate([doc[known], ad[hit]]), np.concatenate([run[known], ar[hit]]), "runs")

    blobs = docs.mapInArrow(_sampler(symbols_of, window, k, lambda *held: [flush(*held)]), _BLOB)
    return blobs.groupBy("bucket").applyInArrow(again, "doc long, runs binary").groupBy("doc").agg(F.collect_list("runs").alias("runs"))


_EQUAL = "bucket int, hash binary, whole binary, doc binary, run binary"


def equal_segments(docs: DataFrame, size: int, symbols_of: Callable, window: int, k: int) -> DataFrame:
    """doc long, runs binary, copied binary (one of both is null), as packed runs, several rows for a document.

    copied: runs of anchors whose segment equals one that starts earlier in the corpus (by document, start), so that all their
    windows repeat. runs: of each other segment the one that starts first, if its anchor occurs in segments that differ; only in
    these can windows be equal. An anchor that has but one segment, however often, needs no more than that.

    Segments of an anchor are told apart by 64-bit hashes of all their symbols (with the anchor's, 128 bits). docs, size and
    symbols_of as in repeated_anchors().
    """
    buckets = max(BUCKETS_PER_PARTITION * shuffle_width(docs.sparkSession), -(-size // BUCKET_TEXT))

    def flush(h: np.ndarray, doc: np.ndarray, run: np.ndarray, whole: np.ndarray) -> Iterator[pa.RecordBatch]:
        # The first of a task's equal segments goes on; the others are known to be copies and go by document.
        if np.any(doc[1:] < doc[:-1]):
            order = np.lexsort((run, doc))
            h, doc, run, whole = h[order], doc[order], run[order], whole[order]
        order = np.argsort(h * _MUL + whole, kind="stable")
        copied = np.zeros(len(h), bool)
        copied[order[1:]] = (h[order][1:] == h[order][:-1]) & (whole[order][1:] == whole[order][:-1])
        first = ~copied
        yield _dealt((h[first] >> np.uint64(40)) % np.uint64(buckets), {"hash": h[first], "whole": whole[first], "doc": doc[first], "run": run[first]})
        if copied.any():
            yield _dealt(((doc[copied].view(np.uint64) * _MUL) >> np.uint64(40)) % np.uint64(buckets), {"hash": None, "whole": None, "doc": doc[copied], "run": run[copied]})

    def judge(blobs: pa.Table) -> pa.Table:
        known = blobs.filter(pc.is_null(blobs.column("hash")))
        asked = blobs.filter(pc.is_valid(blobs.column("hash")))
        join = lambda t, name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), kind)
        docs_of = lambda t: np.concatenate([np.zeros(0, np.int64), *(np.cumsum(np.frombuffer(b, np.int64)) for b in t.column("doc").to_pylist())])
        h, whole, run, doc = join(asked, "hash", np.uint64), join(asked, "whole", np.uint64), join(asked, "run", np.int64), docs_of(asked)
        order = np.lexsort((run, doc, whole, h))
        h, whole, run, doc = h[order], whole[order], run[order], doc[order]
        anchor = np.append(True, h[1:] != h[:-1])[: len(h)]
        first = anchor | np.append(True, whole[1:] != whole[:-1])[: len(h)]
        of = np.cumsum(anchor) - 1
        asked_on = first & (np.bincount(of, weights=first)[of] > 1) if len(h) else first
        runs = by_doc(doc[asked_on], run[asked_on], "runs")
        copied = by_doc(np.concatenate([doc[~first], docs_of(known)]), np.concatenate([run[~first], join(known, "run", np.int64)]), "copied")
        return pa.concat_tables([runs.append_column("copied", pa.nulls(runs.num_rows, pa.binary())), copied.add_column(1, "runs", pa.nulls(copied.num_rows, pa.binary()))])

    blobs = docs.mapInArrow(_sampler(symbols_of, window, k, flush, whole=True), _EQUAL)
    return blobs.groupBy("bucket").applyInArrow(judge, "doc long, runs binary, copied binary")


def by_doc(doc: np.ndarray, run: np.ndarray, name: str) -> pa.Table:
    """One row per document with its packed runs as bytes."""
    order = np.argsort(doc, kind="stable")
    doc, run = doc[order], run[order]
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    edges = np.append(first, len(doc))
    data = np.ascontiguousarray(run).tobytes()
    return pa.table({"doc": pa.array(doc[first], pa.int64()), name: pa.array([data[8 * a : 8 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})


def text_chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Document keys and UTF-8 texts of the batches' first two columns, in chunks of about `most` bytes."""
    for batch in batches:
        ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        begin, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= most or i == len(texts) - 1:
                yield ids[begin : i + 1], texts[begin : i + 1]
                begin, size = i + 1, 0


# --- step 2: segments -----------------------------------------------------------------------------------------------

SEGMENTS = "shard int, doc long, start long, starts int, many boolean, segment binary, runs binary"
_NAMES = [x.strip().split(" ")[0] for x in SEGMENTS.split(",")]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]


class _Pieces:
    """Segments of a task, equal ones combined: the one that starts first keeps its bytes and is marked `many`."""

    def __init__(self):
        self.held: dict[bytes, list] = {}
        self.passed: list[list] = [[], [], []]

    def add(self, piece: bytes, doc: int, start: int, count: int, shard: int, many: bool = False) -> None:
        old = self.held.get(piece)
        if old is None:
            self.held[piece] = [doc, start, count, shard, many]
            return
        old[4] = True
        late = (doc, start) if (doc, start) > (old[0], old[1]) else (old[0], old[1])
        if late != (doc, start):
            old[0], old[1] = doc, start
        for column, value in zip(self.passed, (late[0], late[1], count), strict=True):
            column.append(value)

    def __len__(self) -> int:
        return len(self.held) + len(self.passed[0]) // 4

    @staticmethod
    def _rows(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    def flush(self) -> Iterator[pa.RecordBatch]:
        found = list(self.held.items())
        if found:
            yield self._rows([[v[3] for _, v in found], [v[0] for _, v in found], [v[1] for _, v in found], [v[2] for _, v in found], [v[4] for _, v in found], [s for s, _ in found], [None] * len(found)])
        if self.passed[0]:
            doc, start, count = (np.asarray(c, np.int64) for c in self.passed)
            known = by_doc(doc, pack_run(start, count), "runs")
            n = known.num_rows
            yield self._rows([[None] * n, known.column("doc").to_pylist(), *([None] * n for _ in range(4)), known.column("runs").to_pylist()])
        self.held.clear()
        for c in self.passed:
            c.clear()


def segments(docs: DataFrame, size: int, repeated: DataFrame, cut: Callable) -> DataFrame:
    """The segments of all repeated anchors: SEGMENTS. A row with `runs` (and no shard) has a document's runs that equal runs,
    starting earlier, represent.

    size: bytes from which the shards are counted. cut(text bytes, starts, counts, shards) -> (segments, their shards). Equal segments of a task
    are combined.
    """
    shards = max(SHARDS_PER_PARTITION * shuffle_width(docs.sparkSession), -(-size // SHARD_TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                doc = batch.column(0)[i].as_py()
                packed = np.frombuffer(b"".join(batch.column(2)[i].as_py()), np.int64)
                start, count = unpack_run(np.sort(packed))
                found, shard = cut(texts[i].as_py(), start, count, shards)
                for piece, s, c, where in zip(found, start.tolist(), count.tolist(), shard.tolist(), strict=True):
                    pieces.add(piece, doc, s, c, where)
            if len(pieces) >= FLUSH_SEGMENTS:
                yield from pieces.flush()
        yield from pieces.flush()

    return docs.join(repeated, "doc").select("doc", "text", "runs").mapInArrow(run, SEGMENTS)


def with_salts(parts: DataFrame, growth: int = 1) -> DataFrame:
    """The segments of `parts` (a written table of SEGMENTS) with a column `salts`: into how many groups their shard is split.

    A shard is split if it is much larger than the mean (TIMES_MEAN) or than SHARD_BYTES; growth: how many times its bytes the
    pieces have. The shards' sizes are joined, not collected: those that are split are few, and Spark broadcasts them if its
    own threshold allows it.
    """
    parts = parts.where("shard is not null")
    sizes = materialize(parts.groupBy("shard").agg(F.sum(F.octet_length("segment") + 16).alias("bytes")), "sizes")
    mean = sizes.agg(F.avg("bytes")).first()[0] or 0.0
    most = max(1, min(SHARD_BYTES, max(LEAST_SHARD, TIMES_MEAN * mean)))
    split = sizes.where(F.col("bytes") > most).select("shard", F.ceil(F.col("bytes") * growth / most).cast("int").alias("salts"))
    return parts.join(split, "shard", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))


def split_shards(parts: DataFrame) -> DataFrame:
    """with_salts() and a column `salt`: large shards are dealt out by hash, so that equal windows may fall into several groups."""
    return with_salts(parts).withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("doc", "start"), F.col("salts"))).otherwise(0).cast("int"))


#: Times the bytes of a segment that its pieces have, about: a piece has fewer windows for its last one's length.
PIECES_GROWTH = 4


def resplit(parts: DataFrame, symbols_of: Callable, slice_of: Callable, window: int, k: int) -> DataFrame:
    """SEGMENTS with a column `salt`: large shards are split by content, so that equal windows still meet.

    All windows of a segment share the least gram, its anchor. Here they are told apart by the least gram that is another: a
    segment is cut where it changes, and its hash tells the group. Equal pieces of a task are combined as in segments().
    slice_of(segment, first, end) -> the bytes of these symbols.
    """
    salted = with_salts(parts, PIECES_GROWTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[tuple[int, int], _Pieces] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (_, salt), own in pieces.items():
                for out in own.flush():
                    yield out.append_column("salt", pa.array([salt] * out.num_rows, pa.int32()))
            pieces.clear()

        held = 0
        for batch in batches:
            for shard, doc, start, many, segment, salts in zip(*(batch.column(n).to_pylist() for n in ("shard", "doc", "start", "many", "segment", "salts")), strict=True):
                grams = _gram_hashes(symbols_of([segment])[0], k) >> np.uint64(20)
                w = window - k + 1
                rest = np.where(grams == grams[:w].min(), np.uint64((1 << 44) - 1), grams)
                least = _sliding_min(rest, w)
                first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
                salt = ((least[first] * _MUL >> np.uint64(33)) % np.uint64(salts)).tolist()
                for a, b, s in zip(first.tolist(), [*first[1:].tolist(), len(least)], salt, strict=True):
                    own = pieces.setdefault((shard, s), _Pieces())
                    own.add(slice_of(segment, a, b + window - 1), doc, start + a, b - a, shard, many)
                    held += 1
            if held >= FLUSH_SEGMENTS:
                yield from flush()
                held = 0
        yield from flush()

    columns = [n for n in _NAMES if n != "runs"]
    small = salted.where("salts = 1").select(*columns, F.lit(None).cast("binary").alias("runs"), F.lit(0).alias("salt"))
    large = salted.where("salts > 1").select(*columns, "salts").mapInArrow(run, SEGMENTS + ", salt int")
    return small.unionByName(large)


# --- step 4: runs back to texts -------------------------------------------------------------------------------------


def segment_bytes(anchors: DataFrame, window: int, k: int) -> int:
    """Bytes at most of the segments of all `runs` (rows of equal_segments())."""
    return int((anchors.agg(F.sum(F.octet_length("runs"))).first()[0] or 0) // 8 * (2 * window - k))


def gather_runs(runs: DataFrame) -> DataFrame:
    """doc, runs array<binary> from rows (doc, runs binary)."""
    return runs.groupBy("doc").agg(F.collect_list("runs").alias("runs"))


def covered(runs: list[bytes] | None, window: int, length: int) -> np.ndarray:
    """Mask of the symbols that windows starting in the packed runs cover."""
    if not runs:
        return np.zeros(length, bool)
    start, count = unpack_run(np.frombuffer(b"".join(runs), np.int64))
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + count + window - 1, length), -1)
    return np.cumsum(edge[:length]) > 0


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc long (unique, ordered as the ids), id long, text string (null: empty).

    Where ids are unique and not null they are the keys. Else the rows are written once in the order of (id, nulls last;
    text) with running keys, so rows that share an id are documents of their own in that order.
    """
    small_batches(df.sparkSession)
    base = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if not base.groupBy("id").count().where("count > 1 or id is null").limit(1).count():
        return base.select(F.col("id").alias("doc"), "id", "text")
    order = [F.col("id").asc_nulls_last(), F.col("text")]
    placed = base.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(placed.select(F.monotonically_increasing_id().alias("doc"), "id", "text"), "keyed")


def shard_of(symbols: np.ndarray, start: np.ndarray, window: int, k: int, shards: int) -> np.ndarray:
    """Shard of the windows that start at `start`: from the least k-gram hash in each, so the same for equal windows."""
    w, grams = window - k + 1, np.append(_gram_hashes(symbols, k), np.uint64(0))
    edges = np.empty(2 * len(start), np.int64)
    edges[0::2], edges[1::2] = start, start + w
    least = np.minimum.reduceat(grams, edges)[0::2] >> np.uint64(20)
    return ((least * _MUL >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)
