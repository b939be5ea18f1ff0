import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from folio.llm import factors, spans

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(texts, length):
    """[(n_words, kept)] of the texts."""
    split = [WORD.findall(t or "") for t in texts]
    times = collections.Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for words in split:
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if times[tuple(words[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(words), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def check(df, rows, length=35, gram=8):
    want = sorted(zip((str(r[0]) for r in rows), brute([r[1] for r in rows], length), strict=True))
    got = factors.repeated_words(df, length, gram).collect()
    assert sorted((str(r["doc_id"]), (r["n_words"], r["kept"])) for r in got) == want
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in got)


def test_documents_of_the_test_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(df, [(r["doc_id"], r["text"]) for r in df.collect()])


def noisy(n, words, edits, seed):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(edits):
            text[rng.randrange(words)] = rng.choice(["é", "ü\x1c", " q"])
        at = rng.randrange(words // 2)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(text[at : at + rng.randrange(words)])))
    return rows


def test_edges_of_copies(spark):
    rows = noisy(80, 150, 4, 11) + [(200, "a b " * 300), (201, "a b " * 30), (202, None), (203, ""), (204, "z " * 34), (205, "z " * 34)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(0))
    check(df, rows, 12, 4)
    check(df, rows)


@pytest.mark.parametrize("size", [2500])
def test_split_shards(spark, monkeypatch, size):
    monkeypatch.setattr(spans, "SHARD_BYTES", size)
    monkeypatch.setattr(spans, "LEAST_SHARD", 0)
    monkeypatch.setattr(spans, "TIMES_MEAN", 1)
    rows = noisy(150, 200, 8, 5)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 12, 4)


def test_nulls_and_shared_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text + " tail"), (None, None), (3, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows)
    assert factors.repeated_words(df.limit(0)).count() == 0


def test_very_long_texts_and_a_copy_of_5000_words(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, long = [word() for _ in range(5000)], [word() for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["a", *passage, "b"])), (3, " ".join(long[:20_000] + ["x"] + passage)), (4, "same " * 30_000), (5, "c\n" * 40_000 + "unique end")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
