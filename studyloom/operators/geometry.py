"""Boxes of formulas clustered in two dimensions, text in two columns, hashes of pictures."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle
from .folds import fold_rows
from .graph import components

SIDES = ["x0", "y0", "x1", "y1"]
#: The part of the lower box's height that two boxes share in a band, and how far apart they may stand, at least and as a part of the page's width.
BAND_SHARE, BAND_GAP, BAND_WIDTH = 0.20, 12.0, 0.03


def reach(width: float) -> float:
    return max(BAND_GAP, BAND_WIDTH * width)


def _lit(v: float | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def banded_pairs(boxes: DataFrame, width: float) -> DataFrame:
    """boxes(page, x0, y0, x1, y1[, id]), different ones -> (a, b): ids, or structs without them, of boxes of a page that stand in one band, a < b.

    A spatial join: a box lies in the squares of a grid as coarse as it is large, four at most, and is looked up in
    the grids of all coarser sizes of its page that any box has. So two boxes meet only where they are near, not all
    boxes of a page. Boxes with a null side, or that end before they begin, have no band.
    """
    far = reach(width)
    named = "id" in boxes.columns
    b = boxes.where("x1 >= x0 AND y1 >= y0")
    b = b.select("page", *SIDES, F.struct("id" if named else "page", *SIDES).alias("box"))
    # the side of a square is a power of two that the box and the gap around it fit in
    grain = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0") + far, F.col("y1") - F.col("y0"), F.lit(1.0))))).cast("int")
    b = b.withColumn("grain", grain)
    sizes = b.groupBy("page").agg(F.collect_set("grain").alias("sizes"))  # no more than the powers of two there are
    cells = lambda lo, hi, g: F.sequence(F.floor(lo / F.pow(F.lit(2.0), g)), F.floor(hi / F.pow(F.lit(2.0), g)))

    def placed(df: DataFrame, g: str, name: str) -> DataFrame:
        df = df.withColumn("cx", F.explode(cells(F.col("x0") - far / 2, F.col("x1") + far / 2, F.col(g)))).withColumn("cy", F.explode(cells(F.col("y0"), F.col("y1"), F.col(g))))
        return df.select("page", F.col(g).alias("g"), "cx", "cy", F.col("box").alias(name), F.col("grain").alias(f"{name}_grain"))

    large = placed(b, "grain", "p")
    small = placed(b.join(sizes, "page").withColumn("g", F.explode(F.filter("sizes", lambda s: s >= F.col("grain")))), "g", "q")
    met = large.join(small, ["page", "g", "cx", "cy"]).where("p_grain > q_grain OR (p_grain = q_grain AND p < q)")
    side = lambda f, i: f(F.col("p")[i], F.col("q")[i])
    shared = side(F.least, "y1") - side(F.greatest, "y0")
    height = F.greatest(F.lit(1.0), F.least(F.col("p.y1") - F.col("p.y0"), F.col("q.y1") - F.col("q.y0")))
    near = (F.greatest(F.lit(0.0), shared) / height >= BAND_SHARE) & (F.greatest(F.lit(0.0), side(F.greatest, "x0") - side(F.least, "x1")) <= far)
    p, q = ("p.id", "q.id") if named else ("p", "q")
    return met.where(near).select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).distinct()


#: Boxes of a page up to which one task holds it; about how many boxes of whole pages, and links between them, it holds at once; up to how many pages with more are sent to all.
PAGE_BOXES, HELD_BOXES, HELD_LINKS, SENT_PAGES = 32_768, 65_536, 1_000_000, 20_000


def _joined(root: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """root, a number for each row's component, after links between rows: the larger root of a link hangs below the smaller one."""
    u, v = (root[np.concatenate(side)] for side in zip(*links))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    return root


def _banded_components(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, far: float) -> np.ndarray:
    """banded_pairs and their components at once, of rows in order of (page, y0): a number for each row, equal in one component."""
    label = np.arange(len(page))
    live = np.flatnonzero((x1 >= x0) & (y1 >= y0))
    page, x0, y0, x1, y1 = (c[live] for c in (page, x0, y0, x1, y1))
    root, links, held = np.arange(len(live)), [], 0
    step, near = 1, np.arange(len(live))
    while len(near):  # a box meets those below it until one begins where it has ended
        near = near[near + step < len(live)]
        near = near[(page[near] == page[near + step]) & (y0[near + step] < y1[near])]
        other = near + step
        shared = np.minimum(y1[near], y1[other]) - np.maximum(y0[near], y0[other])
        height = np.maximum(1.0, np.minimum(y1[near] - y0[near], y1[other] - y0[other]))
        ok = (np.maximum(0.0, shared) / height >= BAND_SHARE) & (np.maximum(0.0, np.maximum(x0[near], x0[other]) - np.minimum(x1[near], x1[other])) <= far)
        ok &= root[near] != root[other]
        links.append((near[ok], other[ok]))
        held += int(ok.sum())
        if held > HELD_LINKS:
            root, links, held = _joined(root, links), [], 0
        step += 1
    label[live] = live[_joined(root, links) if links else root]
    return label


def _page_fragments(far: float):
    """From rows in order of (page, y0): those of components that hold a seed."""

    def run(batches):
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf])
            if len(rest) >= HELD_BOXES:
                page = rest["page"].to_numpy()
                cut = int(np.flatnonzero(np.append(True, page[1:] != page[:-1]))[-1])  # the last page may go on
                yield whole(rest.iloc[:cut])
                rest = rest.iloc[cut:]
        if rest is not None and len(rest):
            yield whole(rest)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        label = _banded_components(*(pdf[c].to_numpy() for c in ("page", *SIDES)), far)
        return pdf[np.isin(label, label[pdf["seed"].to_numpy(bool)])]

    return run


def _linked_fragments(b: DataFrame, width: float) -> DataFrame:
    """formula_fragments of boxes without repetition by links and rounds of components, for pages of any size."""
    # links and rounds carry numbers, not boxes; in order of pages the rows of the grid are alike and shuffle small
    b = settle(b.repartitionByRange("page", *SIDES).sortWithinPartitions("page", *SIDES).withColumn("id", F.monotonically_increasing_id()))
    found = components(banded_pairs(b, width)).withColumnRenamed("node", "id")
    at = b.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    live = at.where("seed").select("component").distinct()
    return at.join(live, "component", "left_semi").select("page", *SIDES, "seed")


def formula_fragments(boxes: DataFrame, width: float) -> DataFrame:
    """boxes(page, x0, y0, x1, y1, seed) -> the different boxes that are seeds, or that a seed reaches from box to box of one band.

    What grows step by step from the seeds until nothing changes is the components that hold a seed. Boxes without a page are left out.
    A page of up to PAGE_BOXES boxes is looked at whole, so its boxes are moved once; pages with more, or with a null or NaN side, go by
    links that are found in a grid and by rounds of components.
    """
    b = boxes.where(F.col("page").isNotNull())
    kinds = dict(b.dtypes)
    real = [c for c in ("page", *SIDES) if kinds[c] in ("double", "float")]
    strange = functools.reduce(Column.__or__, [*[F.col(c).isNull() for c in SIDES], *[F.isnan(c) for c in real]])
    if not all(kinds[c] in ("double", "int", "bigint") for c in SIDES):
        strange = F.lit(True)  # numbers of these kinds only are the same in tasks
    sizes = b.groupBy("page").agg(F.count("*").alias("n"), F.bool_or(strange).alias("strange"))
    apart = settle(sizes.where((F.col("n") > PAGE_BOXES) | F.col("strange")).select("page"))
    pages = apart.count()
    apart = F.broadcast(apart) if pages <= SENT_PAGES else apart
    different = lambda rows: rows.groupBy("page", *SIDES).agg(F.bool_or(F.coalesce("seed", F.lit(False))).alias("seed"))
    whole = different((b.join(apart, "page", "left_anti") if pages else b).repartition("page")).sortWithinPartitions("page", "y0")
    whole = whole.mapInPandas(_page_fragments(reach(width)), whole.schema)
    return whole.unionByName(_linked_fragments(different(b.join(apart, "page", "left_semi") if pages else b.where(F.lit(False))), width))


def merged_formulas(fragments: DataFrame, width: float) -> DataFrame:
    """fragments(page, x0, y0, x1, y1) -> (page, formula, x0, y0, x1, y1, parts): fragments of one formula as one box; stacked formulas stay apart.

    From the top down, then from the left, a fragment joins the first formula whose box so far is in its band, or begins one. As tops only come lower, a formula
    that ends above the current fragment is never joined again, so a page's state is what is open at one height.
    """
    far = reach(width)

    def step(state, x0, y0, x1, y1):
        count, live = state
        live = [f for f in live if f[4] > y0]
        for f in live:
            low = max(1.0, min(f[4] - f[2], y1 - y0))
            if (min(f[4], y1) - max(f[2], y0)) / low >= BAND_SHARE and max(f[1], x0) - min(f[3], x1) <= far:
                f[1:] = min(f[1], x0), min(f[2], y0), max(f[3], x1), max(f[4], y1)
                return (count, live), [(x0, y0, x1, y1, f[0])]
        return (count + 1, [*live, [count, x0, y0, x1, y1]]), [(x0, y0, x1, y1, count)]

    d = fragments.select("page", *[F.col(c).cast("double").alias(c) for c in SIDES]).dropna()
    joined = fold_rows(d, ["page"], ["y0", "x0", "y1", "x1"], SIDES, "x0 double, y0 double, x1 double, y1 double, formula long", lambda: (0, []), step)
    return joined.groupBy("page", "formula").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("parts"))


#: Fixed values of pages in two columns: kinds and least tokens of body text, its least words with letters and their share; widths and centres as parts of the page's
#: width; how far the columns run side by side; the least blocks in both columns, or tokens in each.
BODY_KINDS, BODY_TOKENS, BODY_WORDS, BODY_SHARE = ["PARAGRAPH", "LIST"], 10, 8, 0.62
NARROW, LEFT, RIGHT, ACROSS, SIDE_BY_SIDE = 0.52, 0.42, 0.58, 0.72, 0.35
LEAST_BLOCKS, LEAST_TOKENS = 4, 25


def column_gutters(blocks: DataFrame, width: float | Column) -> DataFrame:
    """blocks(page, block, kind, tokens, text, x0, y0, x1, y1) -> pages set in two columns, with the gutter (x0, x1) between their body text.

    One aggregation by page, in parts before the shuffle. A page has columns if both sides have narrow body text, enough of it, and it runs side by side.
    """
    w = _lit(width)
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    lettered = F.size(F.filter(words, lambda x: x.rlike("[A-Za-z]{2}")))
    prose = (lettered >= BODY_WORDS) & (lettered >= BODY_SHARE * F.size(words))
    body = F.col("kind").isin(BODY_KINDS) & (F.col("tokens") >= BODY_TOKENS) & prose & (F.col("x1") - F.col("x0") <= NARROW * w)
    centre = (F.col("x0") + F.col("x1")) / 2
    sides = {"l": body & (centre <= LEFT * w), "r": body & (centre >= RIGHT * w)}
    sums = [F.count("x0").alias("boxed")]
    for s, own in sides.items():
        sums += [F.count_if(own).alias(f"{s}n"), F.sum(F.when(own, F.col("tokens"))).alias(f"{s}t"), F.min(F.when(own, F.col("y0"))).alias(f"{s}top"), F.max(F.when(own, F.col("y1"))).alias(f"{s}end")]
    sums += [F.max(F.when(sides["l"], F.col("x1"))).alias("x0"), F.min(F.when(sides["r"], F.col("x0"))).alias("x1")]
    beside = F.greatest(F.lit(0.0), F.least("lend", "rend") - F.greatest("ltop", "rtop"))
    shorter = F.greatest(F.lit(1.0), F.least(F.col("lend") - F.col("ltop"), F.col("rend") - F.col("rtop")))
    enough = (F.col("ln") + F.col("rn") >= LEAST_BLOCKS) | ((F.col("lt") >= LEAST_TOKENS) & (F.col("rt") >= LEAST_TOKENS))
    g = blocks.groupBy("page").agg(*sums).where((F.col("boxed") >= LEAST_BLOCKS) & (F.col("ln") > 0) & (F.col("rn") > 0) & enough)
    return g.where(beside / shorter >= SIDE_BY_SIDE).select("page", "x0", "x1")


def column_order(blocks: DataFrame, width: float) -> DataFrame:
    """blocks(page, block, kind, tokens, text, box) -> (page, block, columns, position).

    On a page in two columns, blocks across it part it: each stands before what lies between the block across above it and itself (as the rule has
    it; the one on top is a title), and there the left column comes before the right one. Blocks without a box come last. On other pages the order by block stays.
    """
    pages = column_gutters(blocks, width).select("page", F.lit(True).alias("columns"))
    b = blocks.join(pages, "page", "left").withColumn("columns", F.coalesce("columns", F.lit(False)))
    boxed = F.col("x0").isNotNull()
    across = F.coalesce((F.col("x1") - F.col("x0")) > ACROSS * width, F.lit(False))
    down = Window.partitionBy("page").orderBy(F.col("y0").asc_nulls_last(), "block")
    # blocks across that start above: those of equal height don't count for one that isn't across
    higher = Window.partitionBy("page").orderBy(F.col("y0").asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("page", "y0")
    n = F.when(across, 1).otherwise(0)
    b = b.withColumn("__n", n).withColumn("__above", F.sum("__n").over(higher) - F.sum("__n").over(level)).withColumn("__rank", F.sum("__n").over(down) - F.col("__n"))
    band = F.when(F.col("__n") == 1, 2 * F.col("__rank")).otherwise(2 * F.col("__above") + 1)
    column = F.when((F.col("__n") == 1) | ((F.col("x0") + F.col("x1")) / 2 < width / 2), 0).otherwise(1)
    keys = [F.when(F.col("columns"), c) for c in (F.when(boxed, 0).otherwise(1), F.when(boxed, band), F.when(boxed, column), F.when(boxed, F.col("y0")), F.when(boxed, F.col("x0")))]
    order = Window.partitionBy("page").orderBy(*keys, "block")
    return b.select("page", "block", "columns", F.row_number().over(order).alias("position"))


def average_hash(luma: Column) -> Column:
    """16 hexadecimal digits of 64 grey values: a bit is set where a value is not below their mean. Null without 64 values or with a null among them."""
    total = F.aggregate(luma, F.lit(0.0), lambda a, x: a + x)
    bits = F.array_join(F.transform(luma, lambda x: F.when(x * 64 >= total, "1").otherwise("0")), "")
    return F.when((F.size(luma) == 64) & ~F.exists(luma, lambda x: x.isNull()), F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0")))


#: Bits from which a run of bits parts hashes well enough to meet by it, and about how many hashes a block has where it doesn't.
LEAST_RUN, HASH_BLOCK = 8, 16_384


def _near_hashes(most: int):
    """From the hashes (h, block) of one block or two: the pairs near each other, of different blocks if there are two."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, block = pdf["h"].to_numpy().view(np.uint64), pdf["block"].to_numpy()
        alone = block.min() == block.max()
        p, q = h[block == block.min()], h[block == block.max()]
        found = []
        for i in range(0, len(p), 16):  # tiles that stay in a core's cache
            for j in range(0, len(q), 8192):
                bits = np.bitwise_count(p[i : i + 16, None] ^ q[None, j : j + 8192])
                if bits.min() <= most:
                    r, c = np.nonzero(bits <= most)
                    a, b = p[i + r], q[j + c]
                    keep = (a < b) | ((a > b) & (not alone))
                    found.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], bits[r, c][keep]))
        a, b, n = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.uint64),) * 3
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64), "bits": n.astype(np.int32)})

    return run


def _compared_hashes(images: DataFrame, most: int) -> DataFrame:
    """similar_hashes by comparing all pairs, block by block: work is quadratic by nature, a task holds two blocks."""
    h = settle(images.where("hash IS NOT NULL").select(F.conv("hash", 16, -10).cast("long").alias("h")).distinct())
    blocks = max(1, -(-h.count() // HASH_BLOCK))
    h = h.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = h.groupBy(F.least("block", "other").alias("__lo"), F.greatest("block", "other").alias("__hi")).applyInPandas(_near_hashes(most), "a long, b long, bits int")
    return met.select(*[F.lower(F.lpad(F.hex(c), 16, "0")).alias(c) for c in ("a", "b")], "bits")


def similar_hashes(images: DataFrame, most: int = 3) -> DataFrame:
    """images(hash) -> (a, b, bits): different hashes, a < b, that differ in no more than `most` bits (fewer than 16).

    Equal hashes are one row, whatever the number of images. The 64 bits are cut into most + 1 runs; two near hashes agree in one of
    them at least, so hashes meet by equal runs only, and in the first run alone that they share. Runs of a few bits tell too
    little apart: there all pairs are compared.
    """
    if 64 // (most + 1) < LEAST_RUN:
        return _compared_hashes(images, most)
    cuts = [round(64 * k / (most + 1)) for k in range(most + 2)]
    # as signed halves, as a number of 64 bits has no positive place in a long
    half = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    h = images.where("hash IS NOT NULL").select("hash").distinct().withColumn("bits", F.concat(*[F.lpad(F.conv(F.substring("hash", at, 8), 16, 2), 32, "0") for at in (1, 9)]))
    h = h.withColumn("runs", F.array(*[F.substring("bits", lo + 1, hi - lo) for lo, hi in zip(cuts, cuts[1:])]))
    flat = h.select("hash", "runs", F.posexplode("runs").alias("run", "value"))
    other = flat.select("run", "value", F.col("hash").alias("b"), F.col("runs").alias("others"))
    met = flat.join(other, ["run", "value"]).where("hash < b")
    first = F.array_position(F.transform(F.arrays_zip("runs", "others"), lambda z: z["runs"] == z["others"]), True) - 1
    apart = sum(F.bit_count(half(F.col("hash"), at).bitwiseXOR(half(F.col("b"), at))) for at in (1, 9))
    return met.where(F.col("run") == first).withColumn("apart", apart).where(F.col("apart") <= most).select(F.col("hash").alias("a"), "b", F.col("apart").cast("int").alias("bits"))
