"""Repeated word sequences by relative Lempel-Ziv parsing (operator 10).

The segments that meet in a shard (see folio.llm.spans) form an indexed reference block: every window of `length` words is
found by its hash and checked word by word. Each segment is then factored greedily against the block: at the cursor the
match with another occurrence is extended as far as it goes; the factor's windows are duplicates, and the cursor moves to
the first window that straddles the factor's end, so nothing at a boundary is missed. All segments of a shard are parsed
in lockstep, in numpy. A segment that stands in the block more than once is a factor as a whole. A large shard is split by
what its windows hold, so that equal windows still meet in one block, and its parts are parsed like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from folio.llm import spans
from folio.llm.common import materialize
from folio.llm.suffixes import _SYMBOLS

#: Words of a window, and of the grams that anchor it.
LENGTH, GRAM = 35, 8
#: Fixed value: the bytes that separate words.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, 0 to n."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the texts, and the texts' bounds among the words. Only samples windows: no exactness rests on it."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    up, down = _power_tables(len(data))
    blank = _BLANK[data]
    edge = np.diff(np.concatenate([[True], blank]).view(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SYMBOLS[data] * up[: len(data)])])
    symbols = (total[end] - total[begin]) * down[begin]
    symbols ^= symbols >> np.uint64(31)
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return symbols, np.concatenate([[0], np.searchsorted(begin, text_ends)])


def _window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return spans._gram_hashes((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), length)


class ReferenceBlock:
    """Word sequences, indexed by their windows."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        words = [t.split(b" ") for t in texts]
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        number: dict[bytes, int] = {}
        flat = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(self.size.sum()))
        # Each sequence is followed by a separator that nothing equals.
        self.offset = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1]
        self.ids = np.empty(len(flat) + len(words), np.int64)
        at = np.ones(len(self.ids), bool)
        self.separators = self.offset + self.size
        at[self.separators] = False
        self.ids[at] = flat
        self.ids[self.separators] = len(number) + np.arange(len(words))
        self.other = self._occurrences()

    def _occurrences(self) -> np.ndarray:
        """For each position another one with an equal window, or -1."""
        n, length = len(self.ids), self.length
        other = np.full(n, -1, np.int64)
        ends = np.repeat(self.separators, self.size + 1)
        starts = np.flatnonzero(np.arange(n) + length <= ends)
        if not len(starts):
            return other
        h = _window_hashes(self.ids, length)[starts]
        order = np.argsort(h, kind="stable")
        starts, h = starts[order], h[order]
        tied = np.flatnonzero(h[1:] == h[:-1])
        if not len(tied):
            return other
        view = np.lib.stride_tricks.sliding_window_view(self.ids, length)
        same = np.zeros(len(tied), bool)
        for i in range(0, len(tied), 1 << 15):
            t = tied[i : i + (1 << 15)]
            same[i : i + (1 << 15)] = (view[starts[t]] == view[starts[t + 1]]).all(axis=1)
        left, right = starts[tied[same]], starts[tied[same] + 1]
        other[left], other[right] = right, left
        if not same.all():  # windows that only share a hash: compare all of that hash
            for value in np.unique(h[tied[~same]]):
                seen: dict[bytes, int] = {}
                for s in starts[h == value].tolist():
                    key = view[s].tobytes()
                    if key in seen:
                        other[s], other[seen[key]] = seen[key], s
                    seen.setdefault(key, s)
        return other

    def parse(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy factors of the sequences `which` that are long enough: (sequence, start, length)."""
        out = []
        lane, cursor = which, self.offset[which].copy()
        while len(lane):
            inside = cursor + self.length <= self.separators[lane]
            lane, cursor = lane[inside], cursor[inside]
            source = self.other[cursor]
            found = source >= 0
            step = np.ones(len(lane), np.int64)
            if found.any():
                size, at, src = np.full(int(found.sum()), self.length, np.int64), cursor[found], source[found]
                grow = np.arange(len(size))
                while len(grow):  # separators differ from everything, so no match runs past an end
                    a, b = at[grow] + size[grow], np.minimum(src[grow] + size[grow], len(self.ids) - 1)
                    grow = grow[(self.ids[a] == self.ids[b]) & (a != b)]
                    size[grow] += 1
                out.append((lane[found], at - self.offset[lane[found]], size))
                step[found] = size - self.length + 1
            cursor = cursor + step
        if not out:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _shard_task(length: int):
    def run(rows: pa.Table) -> pa.Table:
        take = lambda t, name: np.asarray(t.column(name).to_numpy(), np.int64)
        out_doc, out_run = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if rows.num_rows:
            coded = pc.dictionary_encode(rows.column("segment").combine_chunks())
            code, texts = np.asarray(coded.indices), coded.dictionary.to_pylist()
            doc, start, count = (take(rows, name) for name in ("doc", "start", "starts"))
            # Segments that occur more than once repeat as a whole; all are part of the reference block.
            times = np.bincount(code, minlength=len(texts)) + np.bincount(code, np.asarray(rows.column("many").to_numpy(zero_copy_only=False), float), len(texts))
            whole = times[code] > 1
            out_doc.append(doc[whole])
            out_run.append(spans.pack_run(start[whole], count[whole]))
            row_of = np.empty(len(texts), np.int64)
            row_of[code] = np.arange(len(code))
            block = ReferenceBlock(texts, length)
            sequence, first, size = block.parse(np.flatnonzero(times == 1))
            at = row_of[sequence]
            out_doc.append(doc[at])
            out_run.append(spans.pack_run(start[at] + first, size - length + 1))
        return spans.by_doc(np.concatenate(out_doc), np.concatenate(out_run), "runs")

    return run


def _slice_words(segment: bytes, first: int, end: int) -> bytes:
    return b" ".join(segment.split(b" ")[first:end])


def _cutter(length: int, gram: int):
    def cut(text: bytes, start: np.ndarray, count: np.ndarray, shards: int) -> tuple[list[bytes], np.ndarray]:
        words = text.split()
        pieces = [b" ".join(words[a:b]) for a, b in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)]
        return pieces, spans.shard_of(word_symbols([text])[0], start, length, gram, shards)

    return cut


def repeated_words(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, kept string (words joined by one space), n_words, n_removed, spans array<struct<start, end>> (in words).

    Words are runs of anything but space and the control characters 0x09 to 0x0D, unchanged. A word is removed if a window
    of `length` words of its document that covers it also starts anywhere else, in the same document or another.

    Null text has no words. Shorter texts and empty tables give rows without removals, or none. Rows that share an id, or
    have none, are documents of their own (repeated rows remove each other). Other columns are not read.
    """
    docs = spans.keyed(df, id_col, text_col)
    texts = docs.select("doc", "text")
    size = spans.text_bytes(texts)
    found = spans.repeated_anchors(texts, size, word_symbols, length, gram)
    found = materialize(spans.segments(texts, size, found, _cutter(length, gram)), "segments")
    parts = materialize(spans.resplit(found, word_symbols, _slice_words, length, gram), "parts")
    # Written before the texts are shuffled again, so the segments' shuffle files are gone by then.
    judged = materialize(parts.where("shard is not null").groupBy("shard", "salt").applyInArrow(_shard_task(length), "doc long, runs binary"), "judged")
    known = lambda df: df.where("runs is not null").select("doc", "runs")
    runs = judged.unionByName(known(found)).unionByName(known(parts))
    joined = docs.join(spans.gather_runs(runs), "doc", "left").select("id", "text", "runs")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            columns: list[list] = [[] for _ in range(4)]
            for i in range(batch.num_rows):
                words = texts[i].as_py().split()
                gone = spans.covered(batch.column(2)[i].as_py(), length, len(words))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                begin, end = edge[0::2].tolist(), edge[1::2].tolist()
                kept = [w for a, b in zip([0, *end], [*begin, len(words)], strict=True) for w in words[a:b]]
                for column, value in zip(columns, (b" ".join(kept).decode(), len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in zip(begin, end, strict=True)]), strict=True):
                    column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "kept", "n_words", "n_removed", "spans"])

    return joined.mapInArrow(keep, "id long, kept string, n_words long, n_removed long, spans array<struct<start: long, end: long>>").withColumnRenamed("id", id_col)
