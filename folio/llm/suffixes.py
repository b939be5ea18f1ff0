"""Repeated byte strings by suffix arrays (operator 9).

A shard's segments get one suffix array (Larsson-Sadakane: groups that are still tied are refined by the ranks at double
the depth, all in numpy) and its common prefixes (Kasai's walk in text order, in lockstep over the segments). Suffixes
that share `length` bytes stand together; of each such group the start that comes first in the corpus stays, all others
are repeats. Equal segments are combined before that, over the whole corpus, by their hashes: the first one goes into
the suffix array (if its anchor has other segments), the others repeat as a whole. Shards that were split are merged by binary search in their sorted windows,
dealt to tasks by content. See folio.llm.spans for how segments come to shards and results to texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import spans
from folio.llm.common import materialize, release

#: Bytes of a repeated string, and of the grams that anchor it.
LENGTH, GRAM = 100, 24


def _byte_symbols() -> np.ndarray:
    """A 64-bit symbol for each byte (splitmix64 of the byte)."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_SYMBOLS = _byte_symbols()


class SuffixArray:
    """Suffix array of several byte strings; each ends in a terminator of its own, below all bytes.

    Attributes: offset (first position of each string, and the end), order (positions sorted), lcp (with the one before).
    """

    def __init__(self, texts: list[bytes]):
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.length = length
        self.offset = np.concatenate([[0], np.cumsum(length + 1)])
        n = int(self.offset[-1])
        self.ends = np.repeat((self.offset[1:] - 1).astype(np.int32), length + 1)
        self.left = self.ends - np.arange(n, dtype=np.int32)
        symbols = np.zeros(n, np.uint64)
        symbols[self.left > 0] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
        self.key = self._first_seven(symbols)
        self.order = self._sort()
        self.lcp = self._common_prefixes()

    def _first_seven(self, one: np.ndarray) -> np.ndarray:
        """Seven 9-bit symbols from each position on, zeros after the terminator."""

        def joined(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> np.ndarray:
            follow = np.zeros(len(a), np.uint64)
            follow[: len(a) - size_a] = b[size_a:]
            follow[self.left < size_a] = 0
            return a << np.uint64(9 * size_b) | follow

        two = joined(one, one, 1, 1)
        return joined(joined(two, two, 2, 2), joined(two, one, 2, 1), 4, 3)

    def _sort(self) -> np.ndarray:
        n = len(self.key)
        order = np.argsort(self.key, kind="stable").astype(np.int32)
        sorted_key = self.key[order]
        head = np.append(True, sorted_key[1:] != sorted_key[:-1])
        head[: len(self.length)] = True  # terminators differ from each other
        slots = np.arange(n, dtype=np.int32)
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
        single = head & np.append(head[1:], True)
        slots = np.flatnonzero(~single).astype(np.int32)
        depth = 7
        while len(slots):
            at = order[slots].astype(np.int64)
            key = rank[at].astype(np.int64) << 32 | rank[np.minimum(at + depth, self.ends[at])]
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[slots] = at
            head = np.append(True, key[1:] != key[:-1])
            rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
            single = head & np.append(head[1:], True)
            slots = slots[~single]
            depth *= 2
        return order

    def _common_prefixes(self) -> np.ndarray:
        """Kasai: walking each string from left to right, a prefix shared with the neighbour shrinks by one at most."""
        n = len(self.order)
        before = np.full(n, -1, np.int32)
        before[self.order[1:]] = self.order[:-1]
        by_text = np.zeros(n, np.int32)
        lanes = np.argsort(-self.length, kind="stable")
        starts, lengths = self.offset[lanes], self.length[lanes]
        shared = np.zeros(len(lanes), np.int64)
        for t in range(int(lengths[0]) if len(lanes) else 0):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            i = starts[:live] + t
            j = before[i]
            own = np.where(j >= 0, np.maximum(shared[:live] - 1, 0), 0)
            j = np.maximum(j, 0)
            most = np.where(before[i] >= 0, np.minimum(self.left[i], self.left[j]), 0)
            todo = np.flatnonzero(own < most)
            while len(todo):
                a, b = self.key[i[todo] + own[todo]], self.key[j[todo] + own[todo]]
                differ = a ^ b
                same = differ == 0
                # The first of the seven symbols that differs, from the highest set bit (exact: below 2**63).
                high = np.frexp(differ.astype(np.float64))[1]
                high = np.where((differ >> np.maximum(high - 1, 0).astype(np.uint64)) == 0, high - 1, high)
                own[todo] += np.where(same, 7, (63 - high) // 9)
                todo = todo[same & (own[todo] < most[todo])]
            own = np.minimum(own, most)
            shared[:live] = own
            by_text[i] = own
        return by_text[self.order]


def judge(texts: list[bytes], docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place, removed, group) of every window of the distinct segments `texts`.

    Segment s starts at (docs[s], starts[s]) and has counts[s] windows; a window is removed if an equal one comes earlier.
    """
    array = SuffixArray(texts)
    group_of = np.empty(len(array.order), np.int64)
    group_of[array.order] = np.cumsum(array.lcp < length)
    segment = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
    group = group_of[array.offset[segment] + place]
    order = np.lexsort((starts[segment] + place, docs[segment], group))
    removed = np.ones(len(segment), bool)
    removed[order[np.append(True, group[order][1:] != group[order][:-1])]] = False
    return segment, place, removed, group


_OUT = "doc long, runs binary, shard int, part int, windows binary, docs binary, starts binary"


def _out_table(doc: np.ndarray, run: np.ndarray, merges: list[tuple] = ()) -> pa.Table:
    plain = spans.by_doc(doc, run, "runs")
    n, m = plain.num_rows, len(merges)
    columns = [pa.concat_arrays([plain.column("doc").combine_chunks() if n else pa.array([], pa.int64()), pa.nulls(m, pa.int64())]), pa.concat_arrays([plain.column("runs").combine_chunks() if n else pa.array([], pa.binary()), pa.nulls(m, pa.binary())])]
    for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())):
        columns.append(pa.concat_arrays([pa.nulls(n, kind), pa.array([x[i] for x in merges], kind)]))
    return pa.table(dict(zip([x.strip().split(" ")[0] for x in _OUT.split(",")], columns, strict=True)))


def _runs_of(mask_segment: np.ndarray, place: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed runs (doc, run) of windows given by segment and place, both ascending."""
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, (mask_segment[1:] != mask_segment[:-1]) | (place[1:] != place[:-1] + 1)))
    size = np.diff(np.append(first, len(place)))
    segment = mask_segment[first]
    return docs[segment], spans.pack_run(starts[segment] + place[first], size)


def _shard_task(length: int):
    def run(rows: pa.Table) -> pa.Table:
        shard, salts = rows.column("shard")[0].as_py(), rows.column("salts")[0].as_py()
        take = lambda t, name: np.asarray(t.column(name).to_numpy(), np.int64)
        out_doc, out_run = [], []
        merges = []
        if rows.num_rows:
            coded = pc.dictionary_encode(rows.column("segment").combine_chunks())
            code, texts = np.asarray(coded.indices), coded.dictionary.to_pylist()
            doc, start, count = (take(rows, name) for name in ("doc", "start", "starts"))
            # Equal segments are sorted once; all but the first of them repeat as a whole.
            order = np.lexsort((start, doc, code))
            lead = np.append(True, code[order][1:] != code[order][:-1])
            rest, heads = order[~lead], order[lead]
            out_doc.append(doc[rest])
            out_run.append(spans.pack_run(start[rest], count[rest]))
            doc, start, count = doc[heads], start[heads], count[heads]
            segment, place, removed, _ = judge(texts, doc, start, count, length)
            d, r = _runs_of(segment[removed], place[removed], doc, start)
            out_doc.append(d)
            out_run.append(r)
            if salts > 1:
                merges = _sorted_windows(texts, segment[~removed], place[~removed], doc, start, length, shard, 4 * salts)
        return _out_table(np.concatenate(out_doc), np.concatenate(out_run), merges)

    return run


def _sorted_windows(texts: list[bytes], segment: np.ndarray, place: np.ndarray, docs: np.ndarray, starts: np.ndarray, length: int, shard: int, parts: int) -> list[tuple]:
    """The windows of one group of a split shard that come first in it, dealt to parts by content, each part sorted."""
    offset = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = offset[segment] + place
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    part = (spans._gram_hashes(_SYMBOLS[data], length)[at] >> np.uint64(40)) % np.uint64(parts)
    out = []
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        windows = np.ascontiguousarray(view[at[own]]).view(f"V{length}").ravel()
        order = np.argsort(windows)
        own = own[order]
        out.append((shard, int(p), windows[order].tobytes(), docs[segment[own]].tobytes(), (starts[segment] + place)[own].tobytes()))
    return out


def _merge_task(length: int):
    def run(rows: pa.Table) -> pa.Table:
        lost_doc, lost_start = [], []
        base = None
        for windows, docs, starts in zip(*(rows.column(c).to_pylist() for c in ("windows", "docs", "starts")), strict=True):
            more = (np.frombuffer(windows, f"V{length}"), np.frombuffer(docs, np.int64), np.frombuffer(starts, np.int64))
            if base is None:
                base = tuple(x.copy() for x in more)
                continue
            at = np.searchsorted(base[0], more[0])
            near = np.minimum(at, len(base[0]) - 1)
            same = (at < len(base[0])) & (base[0][near] == more[0])
            old, new = near[same], np.flatnonzero(same)
            wins = (more[1][new] < base[1][old]) | ((more[1][new] == base[1][old]) & (more[2][new] < base[2][old]))
            lost_doc += [base[1][old[wins]], more[1][new[~wins]]]
            lost_start += [base[2][old[wins]], more[2][new[~wins]]]
            base[1][old[wins]], base[2][old[wins]] = more[1][new[wins]], more[2][new[wins]]
            fresh = ~same
            base = tuple(np.insert(b, at[fresh], m[fresh]) for b, m in zip(base, more, strict=True))
        doc = np.concatenate(lost_doc) if lost_doc else np.zeros(0, np.int64)
        start = np.concatenate(lost_start) if lost_start else np.zeros(0, np.int64)
        return spans.by_doc(doc, spans.pack_run(start, np.ones(len(start), np.int64)), "runs")

    return run


def _symbols_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _SYMBOLS[np.frombuffer(b"".join(texts), np.uint8)], np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


def _cutter(length: int, gram: int):
    def cut(text: bytes, start: np.ndarray, count: np.ndarray, shards: int) -> tuple[list[bytes], np.ndarray]:
        pieces = [text[a:b] for a, b in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)]
        shard, i = np.empty(len(start), np.int32), 0
        while i < len(start):  # long texts in blocks
            j = max(i + 1, int(np.searchsorted(start, start[i] + (1 << 20))))
            low = int(start[i])
            symbols = _SYMBOLS[np.frombuffer(text, np.uint8, int(start[j - 1]) + length - low, low)]
            shard[i:j] = spans.shard_of(symbols, start[i:j] - low, length, gram, shards)
            i = j
        return pieces, shard

    return cut


def repeated_bytes(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, kept binary, n_bytes, n_removed, n_spans, spans array<struct<start, end>> for every row.

    A byte is removed if a string of `length` bytes that covers it also starts earlier: in a document of smaller id, or in
    the same document before. Strings never cross documents; overlaps count; strings are judged on the input.

    Null text is empty. Texts shorter than `length` and empty tables give rows without removals, or none. Rows that share
    an id, or have none, are documents of their own, ordered by id (nulls last), then text. Other columns are not read.
    """
    docs = spans.keyed(df, id_col, text_col)
    texts = docs.select("doc", "text")
    size = spans.text_bytes(texts)
    # Each step is written before the next, so that its shuffle files are gone by then.
    anchors = materialize(spans.equal_segments(texts, size, _symbols_of, length, gram), "anchors")
    found = spans.gather_runs(anchors.where("runs is not null").select("doc", "runs"))
    # Shards are counted by what comes to them, so that none is split but those of hot anchors: split ones hand on their windows.
    size = spans.TIMES_MEAN * spans.segment_bytes(anchors, length, gram)
    found = materialize(spans.segments(texts, size, found, _cutter(length, gram)), "segments")
    # Written before the texts are shuffled again, so the segments' shuffle files are gone by then.
    judged = materialize(spans.split_shards(found).groupBy("shard", "salt").applyInArrow(_shard_task(length), _OUT), "judged")
    merged = judged.where("windows is not null").groupBy("shard", "part").applyInArrow(_merge_task(length), "doc long, runs binary")
    runs = judged.where("runs is not null").select("doc", "runs").unionByName(found.where("runs is not null").select("doc", "runs")).unionByName(merged).unionByName(anchors.where("copied is not null").select("doc", F.col("copied").alias("runs")))
    runs = materialize(spans.gather_runs(runs), "runs")
    # What the runs were made from is gone by the time the texts are shuffled again.
    release(anchors, found, judged)
    joined = docs.join(runs, "doc", "left").select("id", "text", "runs")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            columns: list[list] = [[] for _ in range(5)]
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                gone = spans.covered(batch.column(2)[i].as_py(), length, len(text))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                begin, end = edge[0::2].tolist(), edge[1::2].tolist()
                kept = b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True))
                for column, value in zip(columns, (kept, len(text), len(text) - len(kept), len(begin), [{"start": a, "end": b} for a, b in zip(begin, end, strict=True)]), strict=True):
                    column.append(value)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "kept", "n_bytes", "n_removed", "n_spans", "spans"])

    out = joined.mapInArrow(keep, "id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>")
    return out.withColumnRenamed("id", id_col)


def without_spans(text: Column, spans_col: Column) -> Column:
    """The text without its removed spans, in whole characters: one that a span covers only in part stays."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        def one(text: str | None, parts) -> str | None:
            if text is None or parts is None or not len(parts):
                return text
            data, out, at = text.encode(), [], 0
            for part in parts:
                begin, end = part["start"], part["end"]
                while begin < end and data[begin] & 0xC0 == 0x80:
                    begin += 1
                while begin < end < len(data) and data[end] & 0xC0 == 0x80:
                    end -= 1
                out.append(data[at:begin])
                at = max(end, begin)
            return b"".join([*out, data[at:]]).decode()

        return pd.Series([one(t, p) for t, p in zip(texts, removed, strict=True)], dtype=object)

    return cut(text, spans_col)
