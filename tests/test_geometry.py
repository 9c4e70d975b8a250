"""Formula boxes, columns, hashes and components against brute force."""

import numpy as np
from pyspark.sql import functions as F

from studyloom.operators import geometry as G
from studyloom.operators.graph import components

BOX = "page int, x0 double, y0 double, x1 double, y1 double, seed boolean"


def banded(p, q, far):
    shared = max(0.0, min(p[3], q[3]) - max(p[1], q[1]))
    return shared / max(1.0, min(p[3] - p[1], q[3] - q[1])) >= 0.2 and max(0.0, max(p[0], q[0]) - min(p[2], q[2])) <= far


def test_components(spark):
    rnd = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rnd.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1300)] + [(5000, 5000), (None, 3), (7, None)]
    up = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            up.setdefault(a, a), up.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in up and b in up and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    got = components(spark.createDataFrame(links, "a int, b int")).collect()
    assert {r.node: r.component for r in got} == up and len(got) == len(up)
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_formula_boxes(spark):
    rnd = np.random.default_rng(5)
    rows = []
    for page in range(4):
        for _ in range(150):
            x, y = rnd.uniform(0, 560), rnd.uniform(0, 760)
            w, h = (300, 200) if rnd.random() < 0.02 else (rnd.uniform(0, 40), rnd.uniform(0, 30))
            rows.append((page, float(x), float(y), float(x + w), float(y + h), bool(rnd.random() < 0.06)))
    rows += rows[:5] + [(9, 1.0, 1.0, 2.0, 2.0, False), (10, 1.0, 1.0, 2.0, 2.0, True), (11, 0.0, None, 1.0, 1.0, True), (None, 1.0, 1.0, 2.0, 2.0, True), (12, -30.0, -20.0, -18.0, -5.0, True), (12, 0.0, -12.0, 9.0, 0.5, None)]
    df = spark.createDataFrame(rows, BOX)
    got = G.formula_fragments(df, 600.0)
    want, merged = set(), set()
    for page in {r[0] for r in rows if r[0] is not None}:
        own = {r[1:5] for r in rows if r[0] == page}
        live = {r[1:5] for r in rows if r[0] == page and r[5]}
        while more := {b for b in own - live if None not in b and any(None not in c and banded(c, b, 18.0) for c in live)}:
            live |= more
        want |= {(page, *b) for b in live}
        out = []
        for b in sorted((b for b in live if None not in b), key=lambda b: (b[1], b[0], b[3], b[2])):
            at = next((k for k, c in enumerate(out) if banded(c, b, 18.0)), None)
            if at is None:
                out.append(b)
            else:
                c = out[at]
                out[at] = (min(b[0], c[0]), min(b[1], c[1]), max(b[2], c[2]), max(b[3], c[3]))
        merged |= {(page, *b) for b in out}
    assert {tuple(r)[:5] for r in got.collect()} == want and got.count() == len(want)
    boxes = G.merged_formulas(got, 600.0)
    assert {(r.page, r.x0, r.y0, r.x1, r.y1) for r in boxes.collect()} == merged and boxes.count() == len(merged)
    assert "NestedLoop" not in G.banded_pairs(df, 600.0)._jdf.queryExecution().toString() and "Cartesian" not in G.banded_pairs(df, 600.0)._jdf.queryExecution().toString()
    assert G.formula_fragments(spark.createDataFrame([], BOX), 600.0).count() == 0


def test_columns(spark):
    text = "top " + "word " * 10
    spec = "page int, block int, kind string, tokens int, text string, x0 double, y0 double, x1 double, y1 double"
    box = {"l": (10.0, 280.0), "r": (330.0, 590.0), "w": (10.0, 590.0)}
    row = lambda page, block, s, y, kind="PARAGRAPH", t=text: (page, block, kind, 11, t, box[s][0], y, box[s][1], y + 40)
    rows = [row(1, 0, "l", 100.0), row(1, 1, "r", 100.0), row(1, 2, "l", 200.0), row(1, 3, "r", 200.0)]
    rows += [row(2, 0, "w", 10.0), *[row(2, k, s, y) for k, s, y in ((1, "l", 100.0), (2, "r", 100.0), (3, "l", 200.0), (4, "r", 200.0))], (2, 5, "PARAGRAPH", 11, text, None, None, None, None)]
    rows += [row(3, k, "l", 100.0 * k) for k in range(5)]  # one column
    rows += [row(4, 0, "l", 0.0), row(4, 1, "l", 50.0), row(4, 2, "r", 500.0), row(4, 3, "r", 600.0)]  # not side by side
    rows += [row(5, k, "lr"[k % 2], 100.0, "CODE") for k in range(4)]
    rows += [row(6, k, "lr"[k % 2], 100.0, t="1 2 3 4 5 6 7 8 9 10 11") for k in range(4)] + [(7, 0, None, None, None, None, None, None, None)]
    got = {}
    for r in G.column_order(spark.createDataFrame(rows, spec), 600.0).orderBy("position").collect():
        got.setdefault((r.page, r.columns), []).append(r.block)
    assert got == {(1, True): [0, 2, 1, 3], (2, True): [0, 1, 3, 2, 4, 5], (3, False): [0, 1, 2, 3, 4], (4, False): [0, 1, 2, 3], (5, False): [0, 1, 2, 3], (6, False): [0, 1, 2, 3], (7, False): [0]}
    gutter = G.column_gutters(spark.createDataFrame(rows, spec), 600.0).where("page = 1").first()
    assert (gutter.x0, gutter.x1) == (280.0, 330.0)


def test_hashes(spark):
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 256, (40, 64)).astype(float)
    images = [b.tolist() for b in base]
    for b in base:
        for flips in (1, 2, 3, 4):
            v = b.copy()
            for k in rnd.choice(64, flips, replace=False):
                v[k] = 255 - v[k]
            images.append(v.tolist())
    images += images[:10] + [[0.0] * 64, [255.0] * 64, [1.0] * 63, None, [None] * 64]

    def plain(v):
        if v is None or len(v) != 64 or None in v:
            return None
        return f"{int(''.join('1' if x >= sum(v) / 64 else '0' for x in v), 2):016x}"

    df = spark.createDataFrame(list(enumerate(images)), "image int, luma array<double>").select("image", G.average_hash(F.col("luma")).alias("hash"))
    assert {r.image: r.hash for r in df.collect()} == {k: plain(v) for k, v in enumerate(images)}
    known = sorted({plain(v) for v in images} - {None})
    for most in (0, 3, 6):
        want = {(a, b, n) for a in known for b in known if a < b and (n := (int(a, 16) ^ int(b, 16)).bit_count()) <= most}
        got = [tuple(r) for r in G.similar_hashes(df, most).collect()]
        assert set(got) == want and len(got) == len(want)
    assert want
