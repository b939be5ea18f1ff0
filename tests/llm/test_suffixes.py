import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import spans, suffixes


def brute(texts, length):
    """Removed masks of documents in order; texts: list of bytes."""
    seen, out = set(), []
    for text in texts:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            piece = text[i : i + length]
            if piece in seen:
                gone[i : i + length] = True
            seen.add(piece)
        out.append(gone)
    return out


def check(df, texts, length=100, gram=32):
    """texts: {id: bytes} in the order of ids."""
    order = sorted(texts)
    want = dict(zip(order, brute([texts[i] for i in order], length), strict=True))
    got = {r["doc_id"]: r for r in suffixes.repeated_bytes(df, length, gram).collect()}
    assert set(got) == set(order)
    for i in order:
        text, gone, r = texts[i], want[i], got[i]
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        assert bytes(r["kept"]) == kept, i
        assert (r["n_bytes"], r["n_removed"]) == (len(text), int(gone.sum()))
        assert r["n_spans"] == len(r["spans"]) == int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    texts = list({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 30))) for _ in range(200)}) + [b"aaaa" * 10]
    array = suffixes.SuffixArray(texts)
    suffix = sorted(([x + 1 for x in t[i:]] + [0], s, int(array.offset[s]) + i) for s, t in enumerate(texts) for i in range(len(t) + 1))
    assert [p for _, _, p in suffix] == array.order.tolist()
    shared = [0] + [next((n for n, (x, y) in enumerate(zip(a[0], b[0])) if x != y or not x), 0) for a, b in zip(suffix, suffix[1:])]
    assert shared == array.lcp.tolist()


def test_documents_of_the_test_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(df, {r["doc_id"]: r["text"].encode() for r in df.collect()})


def test_small_alphabet_and_long_runs(spark):
    rng = random.Random(7)
    base = "".join(rng.choice("ab ") for _ in range(400))
    rows = {i: base[rng.randint(0, 200) :][: rng.randint(0, 300)] + "".join(rng.choice("abé") for _ in range(60)) for i in range(60)}
    rows |= {100: "x" * 5000, 101: "x" * 300, 102: "", 103: "xy" * 700, 104: base, 105: base}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").withColumn("kept", F.lit("clash"))
    check(df, {i: t.encode() for i, t in rows.items()}, 30, 12)


@pytest.mark.parametrize("size", [3000])
def test_split_shards_merge(spark, monkeypatch, size):
    monkeypatch.setattr(spans, "SHARD_BYTES", size)
    monkeypatch.setattr(spans, "LEAST_SHARD", 0)
    monkeypatch.setattr(spans, "TIMES_MEAN", 1)
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(600))
    rows = {}
    for i in range(120):
        text = list(base)
        for _ in range(12):
            text[rng.randrange(len(text))] = rng.choice("ijkl")
        rows[i] = "".join(text)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    check(df, {i: t.encode() for i, t in rows.items()}, 40, 16)


def test_nulls_and_shared_ids(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijk") for _ in range(150))
    rows = [(1, text), (1, text), (None, text), (None, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffixes.repeated_bytes(df).collect()
    assert len(out) == 5
    assert sorted(r["n_removed"] for r in out if r["n_bytes"]) == [0, 150, 150]
    assert [r["n_removed"] for r in out if r["doc_id"] is None and r["n_bytes"]] == [150]
    assert suffixes.repeated_bytes(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    long = text(120_000)
    rows = [(1, long), (2, "y" * 50_000), (3, text(500) + long[40_000:90_000] + text(500)), (4, "yz" * 20_000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), {i: t.encode() for i, t in rows})
