import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from folio.llm import merkle, queries


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def brute(leaves):
    """{(group, order, leaf): (subroot, root, proof, levels)} of sorted (group, order, leaf) rows, by following every path."""
    def tree(nodes):
        levels = [list(nodes)]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([H(*last[i : i + 16]) for i in range(0, len(last), 16)])
        return levels

    def siblings(levels, at):
        out = []
        for level in levels[:-1]:
            run = at // 16 * 16
            out.append((at - run, [d for i, d in enumerate(level[run : run + 16], run) if i != at]))
            at //= 16
        return out

    groups = {}
    for g, _, leaf in leaves:
        groups.setdefault(g, []).append(leaf)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree(groups[g]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out, seen = [], {}
    for g, o, leaf in leaves:
        at = seen[g] = seen.get(g, -1) + 1
        path = siblings(trees[g], at) + siblings(top, order.index(g))
        out.append((g, o, leaf, trees[g][-1][0], top[-1][0], path))
    return out


def fold(leaf, path):
    for place, rest in path:
        leaf = H(*rest[:place], leaf, *rest[place:])
    return leaf


@pytest.mark.parametrize("sizes", [{"only": 1}, {"a": 1, "b": 16, None: 17}, {"hot": 600, "é": 33, "z": 5, "": 2} | {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_equals_brute_force(spark, sizes):
    rows = [(g, o, H(str(g), str(o)), H("forged") if o % 7 == 3 else None, "x") for g, n in sizes.items() for o in range(n)]
    df = spark.createDataFrame(rows, "source string, n long, leaf string, presented string, root string").repartition(5)
    got = merkle.manifest(df, "source", "n", "leaf", "presented").toDF("source", "n", "leaf", "presented", "clash", "subroot", "root", "proof", "folded", "verified").collect()
    ordered = sorted(((g, o, leaf) for g, o, leaf, *_ in rows), key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    want = {(g, o): (leaf, sub, root, H(*[d for _, rest in path for d in rest]), fold(H("forged") if o % 7 == 3 else leaf, path)) for g, o, leaf, sub, root, path in brute(ordered)}
    assert len(got) == len(rows) and {(r.source, r.n): (r.leaf, r.subroot, r.root, r.proof, r.folded) for r in got} == want
    assert all(r.verified == (r.n % 7 != 3) and r.clash == "x" for r in got)


def test_nulls_ties_repeats_empty(spark):
    rows = [(None, None, "a"), (None, None, "a"), ("s", None, None), ("s", 1, "b"), ("s", 1, "a"), ("s", 1, "a")]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string").withColumn("leaf", merkle.leaf([F.col("doc_id"), F.col("text")]))
    got = merkle.manifest(df, "source", "doc_id", "leaf").collect()
    leaves = sorted(((r.source, r.doc_id, r.leaf) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    want = sorted((str((g, o, leaf, sub, root)), H(*[d for _, rest in path for d in rest])) for g, o, leaf, sub, root, path in brute(leaves))
    assert sorted((str((r.source, r.doc_id, r.leaf, r.subroot, r.root)), r.proof_sha256) for r in got) == want
    assert all(r.verified and r.folded_root == r.root for r in got)
    assert merkle.manifest(df.limit(0), "source", "doc_id", "leaf").collect() == []


def test_leaf_framing(spark):
    df = spark.createDataFrame([(12, None, ""), (1, "2", "é")], "a long, b string, c string")
    got = [r[0] for r in df.select(merkle.leaf([F.col(c) for c in "abc"])).collect()]
    assert got == [H("2:12", "-", "0:"), H("1:1", "1:2", "2:é")]


def test_query_detects_tampering(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = queries.op11_merkle(spark, "/root/testdata/sf0.001").collect()
    for r in got:
        text = texts[r.doc_id]
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text is not None and any("A" <= c <= "Z" for c in text)
        assert r.verified == (not changed)
    assert len(got) == len(texts) and not all(r.verified for r in got)


def test_missing_child_is_an_error(spark):
    level = spark.createDataFrame([(0, 0, 3, "a"), (0, 2, 3, "c")], "tree long, at long, nodes long, digest string")
    with pytest.raises(Exception, match="not heard from all"):
        merkle._upward(spark, level, "gap")
