import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import chosen_path
from folio.llm.components import connected_components


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    """{id: (class, links)}; empty sets are copies of each other."""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent, links = {d: d for d in docs}, collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(docs)
    for i, a in enumerate(order):
        for b in order[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in docs}


def near_copies(seed, bases=4, each=25, words=90):
    rng, docs = random.Random(seed), {}
    for b in range(bases):
        base = [f"{rng.choice('abcdefg')}{rng.randrange(60)}" for _ in range(words)]
        for _ in range(each):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(words)] = f"e{rng.randrange(500)}"
            docs[len(docs) * 7 % 1009] = " ".join(text)
    return docs


def check(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5).withColumn("links", F.lit("clash"))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.similar_documents(df).collect()}
    assert got == brute(docs)


def test_documents_of_the_test_data(spark):
    check(spark, {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()})


def test_groups_of_near_copies(spark):
    docs = near_copies(1) | {2000: None, 2001: "", 2002: "a b", 2003: "a b", 2004: "a b c", 2005: "x " * 30_000}
    check(spark, docs)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 12)
    monkeypatch.setattr(chosen_path, "DENSE", 5)
    check(spark, near_copies(2, bases=3, each=40))


def test_groups_split_by_shingles_with_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK_SHINGLES", 400)
    check(spark, near_copies(6, bases=12, each=2, words=300) | {3000 + d: t for d, t in near_copies(7, bases=3, each=4, words=300).items()})


def test_nulls_and_shared_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "other text of five words"), (3, None)], "doc_id long, text string")
    out = chosen_path.similar_documents(df).collect()
    assert sorted(r["n_links"] for r in out) == [0, 0, 2, 2, 2] and sum(r["is_representative"] for r in out) == 3
    assert chosen_path.similar_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [2, 48])
def test_common_counts(monkeypatch, dense):
    monkeypatch.setattr(chosen_path, "DENSE", dense)
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(50), rng.randrange(1, 30))) for _ in range(40)]
    hashes, bounds = np.concatenate([np.array(s, np.uint64) for s in sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    want = np.array([[len(set(a) & set(b)) for b in sets] for a in sets])
    assert (chosen_path.common_counts(hashes, bounds, 40) == np.triu(want, 1)).all()
    assert (chosen_path.common_counts(hashes, bounds, 15) == want[:15, 15:]).all()


def test_recall_of_one_link_by_walks_alone():
    rng, met, runs = np.random.default_rng(5), 0, 300
    for _ in range(runs):
        both = rng.integers(1, 2**48, 160, np.uint64)
        a, b = (np.sort(np.append(both, rng.integers(1, 2**48, 20, np.uint64))) for _ in range(2))
        doc, key = chosen_path.leaf_keys(np.concatenate([a, b]), np.array([0, 180, 360]))
        met += bool(set(key[doc == 0]) & set(key[doc == 1]))
    assert met >= runs - 2


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(20)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_boilerplate_makes_no_class(spark):
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = {}
    for i in range(80):  # half of each text is the same passage: they meet in many buckets, but are not similar
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
        docs[i] = f"{passage} {own}"
    docs |= {100 + i: docs[i] + " end" for i in range(5)}
    check(spark, docs)
