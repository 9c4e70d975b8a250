"""Encoding holds the distances of a tile of rows at a time."""

import tracemalloc

import numpy as np

from studyloom.operators import vector_index as V


def test_encoding_in_tiles(monkeypatch):
    rnd = np.random.default_rng(3)
    unit, centres, words = rnd.normal(size=(9000, 8)), rnd.normal(size=(700, 8)), rnd.normal(size=(2, 16, V.WIDE))
    book = V.Codebook(centres, words, 8, 1)
    tracemalloc.start()
    lists, codes = book.encode(unit)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 9000 * 700 * 8 / 2
    assert (lists == np.argmin((centres**2).sum(1) - 2 * unit @ centres.T, axis=1)).all()
    rest = (unit - centres[lists]).reshape(-1, 2, 1, V.WIDE)
    assert (codes == np.argmin(((rest - words) ** 2).sum(3), axis=2)).all()
    monkeypatch.setattr(V, "ROW_TILE", 7)
    assert (book.encode(unit[:30])[0] == lists[:30]).all() and len(book.encode(unit[:0])[0]) == 0
