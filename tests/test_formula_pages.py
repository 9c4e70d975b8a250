"""Pages of formula boxes are looked at whole; large and odd ones go by links."""

import numpy as np
from pyspark.sql import functions as F

from studyloom.operators import geometry as G

BOX = "page long, x0 double, y0 double, x1 double, y1 double, seed boolean"


def made(n, pages):
    r = np.random.default_rng(n)
    x, y = r.integers(0, 550, n).astype(float), r.integers(0, 780, n).astype(float)
    w, h = r.integers(-1, 50, n), r.integers(-1, 40, n)
    return list(zip(r.integers(0, pages, n).tolist(), x.tolist(), y.tolist(), (x + w).tolist(), (y + h).tolist(), [None if k < 0.02 else bool(k < 0.1) for k in r.random(n)]))


def test_only_boxes_of_large_or_odd_pages_make_links(spark, monkeypatch):
    rows = [*made(3000, 60), (1, 0.0, None, 3.0, 4.0, True), (2, 0.0, float("nan"), 3.0, 4.0, True), (None, 0.0, 0.0, 1.0, 1.0, True)]
    rows += [(100, *r[1:]) for r in made(120, 1)]
    df = spark.createDataFrame(rows, BOX).repartition(3)
    want = sorted(map(str, G._linked_fragments(df.where("page IS NOT NULL").groupBy("page", *G.SIDES).agg(F.bool_or(F.coalesce("seed", F.lit(False))).alias("seed")), 600.0).collect()))
    seen, plain = [], G._linked_fragments
    monkeypatch.setattr(G, "_linked_fragments", lambda b, width: seen.extend(x.page for x in b.select("page").distinct().collect()) or plain(b, width))
    monkeypatch.setattr(G, "PAGE_BOXES", 100)
    monkeypatch.setattr(G, "HELD_BOXES", 70)
    monkeypatch.setattr(G, "HELD_LINKS", 5)
    assert sorted(map(str, G.formula_fragments(df, 600.0).collect())) == want and len(want) > 100
    assert sorted(seen) == [1, 2, 100]


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    seq = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
    return sum(seq.apply(k).shuffleWriteBytes() for k in range(seq.size()))


def test_boxes_are_moved_once(spark, tmp_path):
    spark.createDataFrame(made(20_000, 500), BOX).write.parquet(str(tmp_path / "boxes"))
    before = shuffled(spark)
    assert G.formula_fragments(spark.read.parquet(str(tmp_path / "boxes")), 600.0).count() > 0
    assert shuffled(spark) - before < 20_000 * 40
