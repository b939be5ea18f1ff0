"""what travels as text must not grow with the copies of a passage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import common, spans, suffixes
from tests.llm.test_suffixes import check


def corpus(n, rng):
    passages = ["".join(rng.choice("abcdefghij klm.") for _ in range(600)) for _ in range(3)]
    own = ["".join(rng.choice("nopqrs tuv") for _ in range(150)) for _ in range(n)]
    rows = {}
    for i in range(n):
        a, b = rng.sample(passages, 2)
        rows[i * 7 % n] = own[i] + a + own[i][:60] + (b if i % 3 else b[: rng.randint(0, 600)])
    return rows


@pytest.mark.parametrize("entries", [1, 500, 1_000_000])
def test_same_rows_however_they_are_dealt(spark, monkeypatch, entries):
    monkeypatch.setattr(spans, "FLUSH_ENTRIES", entries)
    monkeypatch.setattr(spans, "CHUNK", 512)
    rows = corpus(40, random.Random(entries))
    rows |= {50: rows[3], 51: "x" * 3000, 52: "x" * 400, 53: "ab" * 900, 54: rows[3] + rows[3], 55: ""}
    df = spark.createDataFrame([(i, rows[i]) for i in sorted(rows, key=lambda i: -i * 11 % 59)], "doc_id long, text string").repartition(5)
    check(df, {i: t.encode() for i, t in rows.items()}, 100, 24)


def test_bytes_of_segments_do_not_grow_with_copies(spark, monkeypatch):
    sizes, write = [], suffixes.materialize

    def measured(df, label):
        out = write(df, label)
        if label == "segments":
            sizes.append(out.agg(F.sum(F.octet_length("segment"))).first()[0] or 0)
        return out

    monkeypatch.setattr(suffixes, "materialize", measured)
    rows = corpus(30, random.Random(5))
    for copies in (1, 6):
        df = spark.createDataFrame([(i + 100 * c, t) for c in range(copies) for i, t in rows.items()], "doc_id long, text string").repartition(copies, "doc_id")
        removed = suffixes.repeated_bytes(df).where("doc_id >= 100").agg(F.sum("n_bytes") - F.sum("n_removed")).first()[0]
        assert copies == 1 or removed == 0
    assert 0 < sizes[1] <= sizes[0]


def test_shards_are_counted_by_what_comes_to_them(spark, monkeypatch):
    """Most of a corpus in near copies: once the mean shard was large, nearly all were split and handed on 100 bytes a window."""
    for name, value in (("SHARD_TEXT", 40_000), ("SHARD_BYTES", 40_000), ("LEAST_SHARD", 40_000), ("SHARDS_PER_PARTITION", 1)):
        monkeypatch.setattr(spans, name, value)
    salts, split = [], spans.split_shards

    def measured(parts):
        out = split(parts)
        salts.append(out.agg(F.max("salts")).first()[0])
        return out

    monkeypatch.setattr(spans, "split_shards", measured)
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefghij klm.") for _ in range(3000))
    rows = {i: "".join("#" if rng.random() < 0.008 else c for c in base) for i in range(60)}
    check(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), {i: t.encode() for i, t in rows.items()}, 100, 24)
    assert salts == [1]


def test_tables_of_the_steps_are_gone_before_texts_are_shuffled_again(spark):
    before = {path for _, path in common._written}
    rows = corpus(12, random.Random(4))
    found = suffixes.repeated_bytes(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    assert {path.rpartition("/")[2].partition("-")[0] for _, path in common._written if path not in before} == {"sizes", "runs"}
    assert found.agg(F.sum("n_removed")).first()[0] > 0


def test_segments_of_other_content_or_length_have_other_hashes():
    text = np.frombuffer(b"abab" * 100 + bytes(range(200)), np.uint8)
    at, count = np.repeat(np.arange(0, 420), 60), np.tile(np.arange(1, 61), 420)
    got = spans.segment_hashes(suffixes._SYMBOLS[text], at, count, 100)
    content = [text[a : a + c + 99].tobytes() for a, c in zip(at, count, strict=True)]
    assert len(set(got.tolist())) == len(set(content)) == len(set(zip(content, got.tolist(), strict=True)))
