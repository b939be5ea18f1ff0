import numpy as np

from folio.llm import collision


def test_a_query_of_the_block_is_looked_up_twice_at_most_on_average(monkeypatch):
    """A query that stood in the sample itself began with windows of no width and looked some 35 times."""
    vectors = np.random.default_rng(9).standard_normal((2000, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    looks, candidates = [], collision.CollisionIndex._candidates
    monkeypatch.setattr(collision.CollisionIndex, "_candidates", lambda *a: looks.append(1) or candidates(*a))
    index = collision.CollisionIndex(np.arange(2000), vectors, 1.0 + 1e-9)
    found = index.search(np.arange(0, 2000, 20), vectors[::20], 20)
    assert index.sorted.flags.c_contiguous and len(looks) <= 2 * 100
    exact = [set(np.argsort(-np.where(np.arange(2000) == q, -9, vectors @ vectors[q]))[:20].tolist()) for q in range(0, 2000, 20)]
    assert sum(len(e & set(f[0].tolist())) for e, f in zip(exact, found, strict=True)) >= 0.95 * 20 * 100


def test_best_of_many_queries_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(10)
    vectors = np.repeat(rng.standard_normal((6, 8)), 50, axis=0)
    ids = rng.permutation(300)
    index = collision.CollisionIndex(ids, vectors, float(np.linalg.norm(vectors, axis=1).max()))
    monkeypatch.setattr(collision, "SCORED", 130)
    asked = np.arange(0, 300, 7)
    found = index.search(ids[asked], vectors[asked], 20)
    assert len(found) == len(asked)
    for i, (near, score) in zip(asked.tolist(), found, strict=True):
        exact = collision._plain_products(vectors, vectors[i])
        want = np.lexsort((ids, -exact))
        want = want[ids[want] != ids[i]][:20]
        assert near.tolist() == ids[want].tolist() and score.tolist() == exact[want].tolist()
    assert index.search(ids[:0], vectors[:0], 20) == []
