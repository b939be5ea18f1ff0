"""Byte-level BPE by longest matches and backtracking (operator 4).

A rank file maps byte strings to ids. Bytes are read as Latin-1 characters, so that one Aho-Corasick automaton over
all tokens finds, for every position of a pre-token, the longest token that starts there. The encoder takes the longest
match, keeps it if it can stand after the token before it, else tries the next shorter prefix, else steps back. Whether
two tokens can be neighbours is asked often and memoised: they can if merging their joined bytes gives just these two.
A position that once led to no encoding is marked and never entered again, so each position is left at most once per
token that ends there: the time is linear in the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import small_batches

#: Pre-tokens up to this many bytes are remembered; longer ones are encoded each time.
MEMO_BYTES = 48
#: Remembered pre-tokens (or neighbour pairs) of a worker; a full memo starts anew.
MEMO_ENTRIES = 400_000
#: Texts of a batch are encoded and handed on in chunks of about this many bytes.
CHUNK_BYTES = 8 << 20


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines `base64 rank`."""
    out = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The textbook encoder: join the neighbouring pair of lowest rank until none can be joined (quadratic)."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class BacktrackingEncoder:
    """Encodes pre-tokens exactly as rank-ordered merging does."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.stable: dict[bytes, bool] = {}
        self.shorter: dict[bytes, bytes] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}

    def is_stable(self, token: bytes) -> bool:
        """Whether merging the token's own bytes gives the token."""
        found = self.stable.get(token)
        if found is None:
            found = self.stable[token] = merge_by_rank(token, self.ranks) == [self.ranks[token]]
        return found

    def next_shorter(self, token: bytes) -> bytes:
        """The longest proper prefix that is a token; empty if none."""
        found = self.shorter.get(token)
        if found is None:
            cut = len(token) - 1
            while cut and token[:cut] not in self.ranks:
                cut -= 1
            found = self.shorter[token] = token[:cut]
        return found

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay apart when their joined bytes are merged."""
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= MEMO_ENTRIES:
                self.fits.clear()
            found = merge_by_rank(left + right, self.ranks) == [self.ranks[left], self.ranks[right]]
            self.fits[key] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; a pre-token that is itself a token gets that id."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, size in self.automaton.iter(piece.decode("latin-1")):
            start = end - size + 1
            if size > longest[start]:
                longest[start] = size
        dead = bytearray(n + 1)
        path: list[bytes] = []
        at = 0
        candidate = piece[: longest[0]]
        while at < n:
            last = path[-1] if path else None
            while candidate:
                end = at + len(candidate)
                if not dead[end] and self.is_stable(candidate) and (last is None or self.compatible(last, candidate)):
                    break
                candidate = self.next_shorter(candidate)
            if candidate:
                path.append(candidate)
                at += len(candidate)
                candidate = piece[at : at + longest[at]] if at < n else b""
            else:
                if not path:
                    raise ValueError("the rank file lacks a byte of the text")
                dead[at] = 1
                last = path.pop()
                at -= len(last)
                candidate = self.next_shorter(last)
        return [self.ranks[token] for token in path]


class _PieceMemo(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encoder: BacktrackingEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        ids = b"".join(i.to_bytes(4, "little") for i in self.encoder.encode_piece(raw))
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class TextCodec:
    """Whole texts to packed ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder = BacktrackingEncoder(ranks)
        self.pieces = _PieceMemo(self.encoder)
        self.split = regex.compile(pattern).findall
        self.token_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token_of[rank] = token

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token_of.__getitem__, memoryview(packed).cast("I")))


_codecs: dict[tuple[int, str], TextCodec] = {}


def _codec(rank_data: bytes, pattern: str) -> TextCodec:
    key = (hash(rank_data), pattern)
    if key not in _codecs:
        _codecs[key] = TextCodec(parse_ranks(rank_data), pattern)
    return _codecs[key]


def encode_and_decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids: id_col, n_tokens long, ids binary (packed little-endian unsigned
    32-bit), decoded binary.

    The rank file (under 1 MB, fixed) is read on the driver and broadcast. No shuffle; memory per task is bounded by the
    longest text. Null text counts as empty: no tokens, empty ids. Null ids and repeated rows pass through row by row; an
    empty table gives an empty result; columns other than the two named are not read.
    """
    small_batches(df.sparkSession)
    with open(rank_file, "rb") as f:
        rank_data = df.sparkSession.sparkContext.broadcast(f.read())
    fields = df.select(F.col(id_col)).schema.fields
    id_type = fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(rank_data.value, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            begin, held, packed, decoded = 0, 0, [], []
            for i, text in enumerate(texts):
                packed.append(codec.encode(text or ""))
                decoded.append(codec.decode(packed[-1]))
                held += 4 * len(packed[-1]) // 3 + len(decoded[-1])
                if held >= CHUNK_BYTES or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [ids[begin : i + 1], pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())],
                        names=["id", "n_tokens", "ids", "decoded"],
                    )
                    begin, held, packed, decoded = i + 1, 0, [], []

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, n_tokens long, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)
