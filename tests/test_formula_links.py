"""Formula boxes are linked by numbers."""

from studyloom.operators import geometry as G

BOX = "page long, x0 double, y0 double, x1 double, y1 double, seed boolean"


def test_rounds_of_components_carry_numbers(spark, monkeypatch):
    seen, plain = [], G.components
    monkeypatch.setattr(G, "components", lambda links: seen.append(dict(links.dtypes)) or plain(links))
    boxes = [(1, 0.0, 0.0, 10.0, 10.0, True), (1, 15.0, 1.0, 30.0, 9.0, False), (1, 35.0, 2.0, 50.0, 9.0, None), (1, 300.0, 0.0, 310.0, 10.0, False), (2, 15.0, 1.0, 30.0, 9.0, False), (1, 0.0, 0.0, 10.0, 10.0, False), (None, 0.0, 0.0, 1.0, 1.0, True)]
    got = G.formula_fragments(spark.createDataFrame(boxes, BOX), 600.0)
    assert seen == [{"a": "bigint", "b": "bigint"}]
    assert sorted(map(tuple, got.collect())) == [(1, 0.0, 0.0, 10.0, 10.0, True), (1, 15.0, 1.0, 30.0, 9.0, False), (1, 35.0, 2.0, 50.0, 9.0, False)]
