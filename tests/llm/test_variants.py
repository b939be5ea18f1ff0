import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folio.llm import variants as V


def one_error(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def brute(words, ratio=10):
    near = {w: [v for v in words if one_error(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) if vs else None for w, vs in near.items()}
    form = {w: b if b and words[b] >= ratio * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def found(df, **kw):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in V.variants(df, **kw).collect()}


def random_words(seed, count, letters, lengths):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))): rng.choice([1, 2, 3, 30, 31, 400, 9000]) for _ in range(count)}


def test_automaton_numbers_and_minimality():
    words = sorted(random_words(1, 500, "abé", range(0, 9)))
    a = V.Automaton(words)
    for i, w in enumerate(words):
        state, number = a.walk(a.start, 0, w)
        assert number == i and a.final[state]
        for exact in range(len(w) + 1):
            want = {j for j, v in enumerate(words) if v[:exact] == w[:exact] and len(v) >= exact and one_error(w, v)}
            assert a.near(w, exact) == want
    # Equal right languages share a state: 3 words with a common end have one path for it.
    assert len(V.Automaton(["axyz", "bxyz", "cxyz"]).final) == 5
    assert V.Automaton([]).near("a", 0) == set()


@pytest.mark.parametrize(("bucket_words", "splits"), [(20_000, 3), (40, 3), (3, 1)])
def test_equals_brute_force(spark, bucket_words, splits):
    words = random_words(2, 700, "abé", range(1, 12)) | {"aaaa" * 500 + c: 5 for c in ("", "b", "bb", "c")} | {"": 4, "a": 60}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert found(df, bucket_words=bucket_words, splits=splits) == brute(words)


def test_chains_end_at_the_root(spark):
    words = {"abcdefg" + "h" * i: 20 ** i for i in range(7)}
    got = found(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got == brute(words) and {g[1] for g in got.values()} == {"abcdefghhhhhh"}


def test_words_of_texts(spark):
    texts = [(i, f"The Überraschung, NAÏVETÉS x÷yzabcd {'spelling ' * 40}{'Q' * 9}") for i in range(90)] + [(1, None), (2, ""), (None, "spelling spelling lonely_and"), (3, "a1b " * 50_000)]
    want = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                want[run] += 1
    want = {w: n for w, n in want.items() if n >= 2}
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"word": F.lit("clash"), "id": F.lit(1)})
    assert {r.word: r.n for r in V.words_of(df).collect()} == want and len(want) > 4


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 3, 1), ("abcdefg", 3, 2)], "word string, n int, near int")
    assert found(df) == {"abcdefg": (None, "abcdefg", 3, 0, None)}
    assert V.variants(df.limit(0)).collect() == [] and V.words_of(df.select(F.lit(1).alias("doc_id"), F.col("word").alias("text")).limit(0)).collect() == []
