"""Python passes hold few texts at a time."""

import weakref

import pyarrow as pa

from folio.functions import text as T


class Text(str):
    pass


def test_only_a_piece_of_the_results_is_held():
    alive, most = weakref.WeakSet(), 0

    def step(t):
        nonlocal most
        alive.add(out := Text(t + "!"))
        most = max(most, len(alive))
        return out

    texts = pa.array([None if i % 7 == 0 else str(i) for i in range(5000)])
    assert T.mapped(texts, step).to_pylist() == [None if i % 7 == 0 else f"{i}!" for i in range(5000)]
    assert most <= 2 * T.PIECE_ROWS
    assert T.mapped(pa.array([], pa.string()), step).to_pylist() == []
