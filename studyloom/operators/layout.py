"""Page geometry: boxes (x0, y0, x1, y1) of blocks, regions and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up


def area(p: str = "") -> Column:
    return F.greatest(F.lit(0.0), F.col(p + "x1") - F.col(p + "x0")) * F.greatest(F.lit(0.0), F.col(p + "y1") - F.col(p + "y0"))


def blocks_in_regions(blocks: DataFrame, regions: DataFrame, least: float = 0.45) -> DataFrame:
    """blocks(page, block, box), regions(page, region, box) -> (page, block, region, share): regions that cover that share of a block. Joined by page."""
    r = regions.select("page", "region", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    wide = F.greatest(F.lit(0.0), F.least("x1", "r_x1") - F.greatest("x0", "r_x0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "r_y1") - F.greatest("y0", "r_y0"))
    j = blocks.join(r, "page").withColumn("share", F.when(area() > 0, F.round(wide * high / area(), 6)).otherwise(0.0))
    return j.where(F.col("share") >= least).select("page", "block", "region", "share")


def image_coverage(images: DataFrame, page_area: float) -> DataFrame:
    """images(page, box) -> the share of each page that images cover (1 at most) and whether the page counts as visual."""
    g = images.groupBy("page").agg(F.count("*").alias("images"), half_up(F.least(F.lit(1.0), F.sum(area()) / page_area), 6).alias("coverage"))
    return g.withColumn("full_page", F.col("coverage") >= 0.12)


def usable_regions(regions: DataFrame, page_area: float, least: float = 0.03, side: float = 40.0, aspect: float = 12.0) -> DataFrame:
    """Regions large enough, or formulas, of a side and an aspect that can be read."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    formula = F.col("kind") == "FORMULA"
    return regions.where(((area() / page_area >= least) | formula) & (w >= side) & (h >= F.when(formula, 24.0).otherwise(side)) & (w <= h * aspect) & (h <= w * aspect))


def repeated_images(images: DataFrame, pages: DataFrame, doc: str, share: float = 0.15, least: int = 3, area: float = 0.08) -> DataFrame:
    """images(doc, page, image, hash, kind, area), pages(doc, page) -> those to drop: small, of a kind that is never critical, and with a hash that a document has many times (logos and ornaments)."""
    n = pages.select(doc, "page").distinct().groupBy(doc).agg(F.count("*").alias("pages"))
    seen = images.where("hash IS NOT NULL").groupBy(doc, "hash").agg(F.count("*").alias("seen"))
    critical = F.col("kind").isin("CODE_IMAGE", "FORMULA_IMAGE", "HANDWRITTEN", "FULL_PAGE_VISUAL")
    many = F.col("seen") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))
    return images.join(seen, [doc, "hash"]).join(n, doc).where(many & ~critical & (F.coalesce("area", F.lit(0.0)) < area)).select(doc, "page", "image", "hash", "seen")


def reading_order(blocks: DataFrame, width: float, wide: float = 0.6) -> DataFrame:
    """blocks(page, block, box) -> with position: blocks across the page part it into bands; in a band the left column comes before the right one."""
    across = (F.col("x1") - F.col("x0")) >= wide * width
    down = Window.partitionBy("page").orderBy("y0", "x0", "block")
    b = blocks.withColumn("__w", across.cast("int"))
    b = b.withColumn("__band", F.sum("__w").over(down) * 2 - F.col("__w"))
    column = F.when(F.col("__w") == 1, 0).when((F.col("x0") + F.col("x1")) / 2 < width / 2, 0).otherwise(1)
    order = Window.partitionBy("page").orderBy("__band", column, "y0", "x0", "block")
    return b.withColumn("position", F.row_number().over(order)).drop("__w", "__band")


def merge_bands(boxes: DataFrame, gap: float = 0.0) -> DataFrame:
    """boxes(page, box) -> one box for each run of boxes whose heights overlap or lie within the gap. Sorted by their top, one running maximum finds the runs."""
    w = Window.partitionBy("page").orderBy("y0", "y1", "x0", "x1")
    above = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = boxes.withColumn("__new", F.coalesce((F.col("y0") > above + gap).cast("int"), F.lit(1)))
    b = b.withColumn("band", F.sum("__new").over(w))
    return b.groupBy("page", "band").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("boxes"))


def join_spans(spans: DataFrame, least: float = 0.8, share: float = 0.16) -> DataFrame:
    """spans(line, x0, x1, size, text) -> a line's text; spans further apart than max(0.8, 0.16 of the font size) get a space between them."""
    w = Window.partitionBy("line").orderBy("x0", "x1", "text")
    apart = F.col("x0") - F.lag("x1").over(w) >= F.greatest(F.lit(least), share * F.col("size"))
    s = spans.withColumn("__p", F.concat(F.when(apart, " ").otherwise(""), F.col("text"))).withColumn("__n", F.row_number().over(w))
    return s.groupBy("line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__p"))), lambda x: x["__p"]), "").alias("text"))
