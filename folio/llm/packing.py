"""Vector bin packing of token sequences (operator 2).

Every example is a vector: tokens, segments (one) and loss-bearing tokens. A bin (sequence) limits all three at once. The
open bin takes, of a window of waiting examples, the one that fits and has the largest dot product with what the bin has
left, each dimension weighted by how scarce it is; when nothing fits, the bin is topped up by cutting an example. A bin that its
other limits close before it is full can give back what is beyond a power of two, which needs no padding. Windows are bounded,
so memory does not grow with a partition; partitions are packed independently, without a shuffle.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import small_batches

#: Limits of a sequence; examples that wait at once, and their tokens.
MAX_TOKENS, MAX_SEGMENTS, WINDOW, WINDOW_TOKENS = 4096, 1024, 1024, 2_000_000
#: Remembered words and runs of letters of a worker (checked before each chunk of texts), runs encoded in one string.
WORD_ENTRIES, RUN_ENTRIES, RUNS_AT_ONCE = 400_000, 1_000_000, 2000
#: Characters of the texts that are encoded together.
CHUNK_CHARS = 2_000_000


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold; the loss limit counts loss-bearing tokens. One that its other limits close before it is full is
    padded, or (padded=False) cut back to a power of two: no padding, but more sequences."""

    tokens: int = MAX_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_TOKENS
    padded: bool = True


class VectorPacker:
    """Packs a stream of (key, tokens, loss_start) examples; tokens from loss_start on bear loss.

    push() and finish() return placements: (key, start, length, sequence, offset).
    """

    def __init__(self, limits: Limits, first_sequence: int = 0):
        self.limits = limits
        self.next_sequence = first_sequence
        self.keys: list = []
        self.start = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int64)
        self.loss_from = np.zeros(0, np.int64)
        self.waiting: list[tuple] = []
        self.waiting_tokens = 0

    def push(self, key, tokens: int, loss_start: int) -> list[tuple]:
        """Take an example; returns placements once the window is full."""
        out, start = [], 0
        while start < tokens:
            size = self._cut(tokens - start, loss_start - start, self.limits.tokens, self.limits.loss)
            # A whole sequence needs no choice, unless its share of a scarce dimension is what others lack.
            if size == self.limits.tokens and self.limits.loss >= size:
                out.append((key, start, size, self._take(), 0))
            else:
                self.waiting.append((key, start, size, loss_start))
                self.waiting_tokens += size
            start += size
        if len(self.waiting) >= WINDOW or self.waiting_tokens >= WINDOW_TOKENS:
            out += self._pack(self.waiting_tokens // 2)
        return out

    def finish(self) -> list[tuple]:
        """Pack all that still waits."""
        return self._pack(0)

    def _take(self) -> int:
        self.next_sequence += 1
        return self.next_sequence - 1

    @staticmethod
    def _cut(tokens: int, before_loss: int, room: int, loss_room: int) -> int:
        """The longest prefix within `room` tokens and `loss_room` loss-bearing tokens."""
        return min(tokens, room, max(0, before_loss) + loss_room)

    def score(self, size: np.ndarray, loss: np.ndarray, room: int, slots: int, loss_room: int, asked: tuple[int, int, int]) -> np.ndarray:
        """The dot product of each example with what the bin has left, by share of the limits; a dimension weighs by its scarcity:
        what the waiting examples ask of it against what the bin has left. (Segments add the same to all: one each.)"""
        full = self.limits
        scarce = (asked[0] / room, asked[1] / slots, asked[2] / max(1, loss_room))
        whole = sum(scarce)
        a, c = (weight / whole * left / limit / limit for weight, left, limit in ((scarce[0], room, full.tokens), (scarce[2], loss_room, full.loss)))
        return a * size + c * loss

    def _pack(self, keep: int) -> list[tuple]:
        """Fill sequences until at most `keep` tokens wait."""
        keys = [w[0] for w in self.waiting]
        start, size, loss_from = (np.array([w[i] for w in self.waiting], np.int64) for i in (1, 2, 3))
        loss = size - np.clip(loss_from - start, 0, size)
        left, left_loss, alive, out = int(size.sum()), int(loss.sum()), len(keys), []
        full = self.limits

        def change(i: int, by: int) -> int:
            """Take (or, below 0, give back) the next tokens of an example; returns the loss-bearing ones among them."""
            nonlocal left, left_loss, alive
            had, bore = int(size[i]), int(loss[i])
            start[i] += by
            size[i] -= by
            loss[i] = had - by - min(max(int(loss_from[i] - start[i]), 0), had - by)
            left, left_loss, alive = left - by, left_loss - bore + int(loss[i]), alive + (size[i] > 0) - (had > 0)
            return bore - int(loss[i])

        while left > keep:
            room, slots, loss_room = full.tokens, full.segments, full.loss
            sequence, placed = self._take(), []
            # The last sequence is cut down to a power of two, which needs no padding.
            if left < room:
                room = 1 << (left.bit_length() - 1)
            filled, offset = room, 0
            while room and slots and left:
                fits = (size <= room) & (loss <= loss_room) & (size > 0)
                if slots > 1 and fits.any():
                    i = int(np.argmax(np.where(fits, self.score(size, loss, room, slots, loss_room, (left, alive, left_loss)), -1.0)))
                    cut = int(size[i])
                else:
                    # Nothing fits whole (or one slot is left): cut the example that gives the longest piece.
                    pieces = np.minimum(np.minimum(size, room), size - loss + loss_room)
                    i = int(np.argmax(pieces))
                    cut = int(pieces[i])
                    if not cut:
                        break
                placed.append((i, int(start[i]), cut))
                loss_room -= change(i, cut)
                room, slots = room - cut, slots - 1
            size_now = filled - room
            fit = size_now if not room or full.padded else 1 << (size_now.bit_length() - 1)
            while size_now > fit:
                i, at, cut = placed.pop()
                back = min(cut, size_now - fit)
                change(i, -back)
                size_now -= back
                if back < cut:
                    placed.append((i, at, cut - back))
            for i, at, cut in placed:
                out.append((keys[i], at, cut, sequence, offset))
                offset += cut
        self.waiting = [(keys[i], int(start[i]), int(size[i]), int(loss_from[i])) for i in np.flatnonzero(size > 0)]
        self.waiting_tokens = left
        return out


def _slices(runs: list[str]) -> Iterator[list[str]]:
    return (runs[i : i + RUNS_AT_ONCE] for i in range(0, len(runs), RUNS_AT_ONCE))


class WordTokenizer:
    """Ids of whole texts by a `tokenizers` file whose tokens never cross white space: words are encoded once and remembered.

    The file's special tokens (none has white space in it) count as such where their strings stand in a text, as the library
    does by default. A new word of letters, perhaps with punctuation behind, is split there (the file's own pattern does so,
    too). New runs of letters are encoded many at a time in one string, in which each token's run is known.
    All other words are encoded by themselves.
    """

    _LETTERS_THEN_MARKS = re.compile(r"([^\W\d_]+)([^\w\s]+)")

    def __init__(self, data: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(data)
        # With a suffix, every pre-token ends in one token that has it.
        vocabulary, suffix = self.model.get_vocab(), json.loads(data)["model"].get("end_of_word_suffix") or ""
        self.suffixed = bool(suffix)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.lowers = '"Lowercase"' in json.dumps(json.loads(data).get("normalizer"))
        self.words: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {}
        self.end = end_id.to_bytes(4, "little")

    def _alone(self, words: list[str]) -> Iterator[bytes]:
        for encoded in self.model.encode_batch_fast(words, add_special_tokens=False):
            yield np.asarray(encoded.ids, "<u4").tobytes()

    def _learn_runs(self, runs: list[str]) -> None:
        # Letters of ASCII are one pre-token each, whatever the normalizer does to them; others are told apart by offsets.
        plain = [run for run in runs if run.isascii()] if self.suffixed else []
        for part in _slices(plain):
            ids = np.asarray(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            self._keep(part, ids, np.append(0, np.flatnonzero(self.ends_word[ids]) + 1))
        for part in _slices([run for run in runs if not run.isascii()] if self.suffixed else runs):
            encoded = self.model.encode(" ".join(part), add_special_tokens=False)
            places = np.array(encoded.offsets, np.int64).reshape(-1, 2)[:, 0]
            self._keep(part, np.asarray(encoded.ids, "<u4"), np.searchsorted(places, np.cumsum([0, *(len(run) + 1 for run in part)])))

    def _keep(self, runs: list[str], ids: np.ndarray, edges: np.ndarray) -> None:
        packed, at = ids.tobytes(), (4 * edges).tolist()
        self.runs.update((run, packed[a:b]) for run, a, b in zip(runs, at[:-1], at[1:], strict=True))

    def _learn(self, words: list[str]) -> None:
        alone, marked, rest = [], [], []  # letters alone, letters with marks behind, all others
        for word in words:
            if word.isalpha():
                alone.append(word)
                continue
            found = self._LETTERS_THEN_MARKS.fullmatch(word)
            # A combining mark could join the letter before.
            if found and (word.isascii() or unicodedata.category(found[2][0])[0] != "M"):
                marked.append((word, *found.groups()))
            else:
                rest.append(word)
        lower = (lambda run: run.lower() if run.isascii() else run) if self.lowers else str
        runs = list(map(lower, alone)) + [lower(run) for _, run, _ in marked]
        self._learn_runs([run for run in set(runs) if run not in self.runs])
        known, get = self.words, self.runs.__getitem__
        rest += {marks for _, _, marks in marked if marks not in known}
        known.update(zip(rest, self._alone(rest), strict=True))
        known.update(zip(alone, map(get, runs), strict=False))
        known.update((word, get(run) + known[marks]) for (word, _, marks), run in zip(marked, runs[len(alone) :], strict=True))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text, with the end id."""
        if len(self.words) > WORD_ENTRIES:
            self.words = {"": b""}
        if len(self.runs) > RUN_ENTRIES:
            self.runs = {}
        words = [text.replace("\n", " ").split(" ") for text in texts]
        self._learn([w for w in set().union(*words) if w not in self.words])
        known = self.words.__getitem__
        return [b"".join(map(known, w)) + self.end for w in words]


_tokenizers: dict[tuple, WordTokenizer] = {}


def _tokenizer(data: str, end_id: int) -> WordTokenizer:
    key = (hash(data), end_id)
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(data, end_id)
    return _tokenizers[key]


def pack_documents(df: DataFrame, tokenizer_file: str, end_id: int = 2, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", prompt_tokens_col: str | None = None, prompt_share: float = 0.0) -> DataFrame:
    """Tokenize and pack whole texts: id_col, start, length, ids binary (packed), doc_tokens, loss_tokens, sequence_id, offset.

    One row per piece; every id of a document, its end id included, lies in exactly one piece, and the pieces of a sequence
    are gapless from offset 0. prompt_tokens_col (instruction data) gives the number of leading tokens that bear no loss; without
    it that is prompt_share of a document's tokens, rounded down. A sequence may be padded to limits.tokens; one whose length is a power of two need not.

    Null and very long texts are documents like others (null: just the end id; long ones are cut). Null ids, ties and repeated rows are packed as rows of their own; empty tables
    give empty results; other columns are not read. Sequence ids are unique: the partition's number times 2**33 plus a
    count. The tokenizer file (under 2 MB, fixed) is read on the driver and broadcast.
    """
    limits = limits or Limits()
    small_batches(df.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())
    prompt = F.coalesce(F.col(prompt_tokens_col).cast("long"), F.lit(0)) if prompt_tokens_col else F.lit(None).cast("long")
    plain = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), prompt.alias("prompt"))
    return plain.mapInArrow(_packing_task(lambda: _tokenizer(data.value, end_id).encode_many, limits, prompt_share), _SCHEMA).withColumnRenamed("doc", id_col)


_SCHEMA = "doc long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


def _packing_task(make: Callable[[], Callable[[list[str]], list[bytes]]], limits: Limits, prompt_share: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        packer = VectorPacker(limits, TaskContext.get().partitionId() << 33)
        held: dict[int, list] = {}  # row -> [doc, packed ids, first loss token, ids not placed yet]
        row = 0

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in range(8)]
            for key, start, length, sequence, offset in placed:
                doc, ids, loss_from, _ = held[key]
                bears = length - min(max(loss_from - start, 0), length)
                for column, value in zip(columns, (doc, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, bears, sequence, offset), strict=True):
                    column.append(value)
                held[key][3] -= length
                if not held[key][3]:
                    del held[key]
            kinds = [pa.binary() if i == 3 else pa.int64() for i in range(8)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.strip().split(" ")[0] for x in _SCHEMA.split(",")])

        for batch in batches:
            docs, texts, prompts = (c.to_pylist() for c in batch.columns)
            begin, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size < CHUNK_CHARS and i < len(texts) - 1:
                    continue
                placed = []
                for n, ids in enumerate(encode([t or "" for t in texts[begin : i + 1]]), begin):
                    prompt = prompts[n] if prompts[n] is not None else int(len(ids) // 4 * prompt_share)
                    held[row] = [docs[n], ids, prompt, len(ids) // 4]
                    placed += packer.push(row, len(ids) // 4, prompt)
                    row += 1
                begin, size = i + 1, 0
                if placed:
                    yield rows(placed)
        yield rows(packer.finish())

    return run


def crc32(data: bytes) -> int:
    """Unsigned CRC-32, as Spark's crc32()."""
    return zlib.crc32(data)
