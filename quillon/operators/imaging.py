"""Statistics and neighbourhoods of image cells, in long form: image_id, x, y and a value."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.num import clamp, lerp
from .parts import labelled

#: What is dark, bright and clipped; the least contrast that counts as full; the strength of an edge.
DARK, BRIGHT, BLACK, WHITE = 0.12, 0.90, 0.015, 0.985
FULL_GLOBAL, FULL_RANGE, FULL_LOCAL, EDGE = 0.055, 0.18, 0.035, 0.12
#: Bins; share, bounds and correction of the threshold and the shares of foreground outside which it is made.
BINS, OTSU_SHARE, LEAST_CUT, MOST_CUT, CUT_STEP, LEAST_SHARE, MOST_SHARE = 256, 0.58, 0.28, 0.72, 0.08, 0.002, 0.985
#: Centers that every task may hold at once.
MOST_CENTERS = 10_000
#: From which score on a scan is accepted, accepted with a warning, retried.
ACCEPT, WARN, RETRY = 0.78, 0.66, 0.48


def r6(x: Column) -> Column:
    return F.round(x, 6)


def brightness(cells: DataFrame) -> DataFrame:
    """One pass: mean, median, range, shares of dark, bright and clipped cells, and the range from 5 to 95 percent."""
    v = F.col("lum")
    share = lambda c, name: r6(F.count_if(c) / F.count("*")).alias(name)
    return cells.where(~F.isnan(v)).groupBy("image_id").agg(
        r6(F.avg(v)).alias("mean"), r6(F.percentile(v, F.lit(0.5))).alias("median"), r6(F.min(v)).alias("minimum"), r6(F.max(v)).alias("maximum"), share(v <= DARK, "dark_ratio"), share(v >= BRIGHT, "bright_ratio"),
        share(v <= BLACK, "clipped_black_ratio"), share(v >= WHITE, "clipped_white_ratio"), r6(F.percentile(v, F.lit(0.95)) - F.percentile(v, F.lit(0.05))).alias("dynamic_range"),
    )


def percentiles(cells: DataFrame, at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact percentiles with linear interpolation, and the deviation of the whole."""
    v = F.col("lum")
    return cells.groupBy("image_id").agg(*[r6(F.percentile(v, F.lit(p))).alias(f"p{round(p * 100)}") for p in at], r6(F.stddev_pop(v)).alias("deviation"))


def _across(rows: str = "x") -> W:
    return W.partitionBy("image_id", "y" if rows == "x" else "x").orderBy(rows)


def contrast(cells: DataFrame) -> DataFrame:
    """Deviation, the range from 10 to 90 percent, the mean difference to the right and lower neighbour, and their blend."""
    v = F.col("lum")
    rows = cells.withColumn("right", F.abs(F.lead("lum").over(_across("x")) - v)).withColumn("below", F.abs(F.lead("lum").over(_across("y")) - v))
    local = (F.coalesce(F.sum("right"), F.lit(0.0)) + F.coalesce(F.sum("below"), F.lit(0.0))) / F.greatest(F.lit(1), F.count("right") + F.count("below"))
    rows = rows.groupBy("image_id").agg(F.stddev_pop(v).alias("d"), (F.percentile(v, F.lit(0.9)) - F.percentile(v, F.lit(0.1))).alias("r"), local.alias("l"))
    part = lambda c, full: clamp(F.col(c) / full, 0.0, 1.0)
    return rows.select("image_id", r6("d").alias("deviation"), r6("r").alias("percentile_range"), r6("l").alias("local_contrast"), r6(part("d", FULL_GLOBAL) * 0.40 + part("r", FULL_RANGE) * 0.25 + part("l", FULL_LOCAL) * 0.35).alias("score"))


def neighbours(cells: DataFrame, column: str = "lum") -> DataFrame:
    """The eight neighbours of each cell as columns ul, u, ur, l, r, dl, d, dr; null beyond the border. Two windows: three
    values of a row side by side, then the rows above and below."""
    row, col = _across("x"), _across("y")
    sides = cells.withColumn("l", F.lag(column).over(row)).withColumn("r", F.lead(column).over(row))
    three = F.struct(F.col("l").alias("l"), F.col(column).alias("m"), F.col("r").alias("r"))
    rows = sides.withColumn("up", F.lag(three).over(col)).withColumn("down", F.lead(three).over(col))
    return rows.select(*cells.columns, "l", "r", *[F.col(f"up.{a}").alias(b) for a, b in (("l", "ul"), ("m", "u"), ("r", "ur"))], *[F.col(f"down.{a}").alias(b) for a, b in (("l", "dl"), ("m", "d"), ("r", "dr"))])


def _inner(rows: DataFrame) -> DataFrame:
    return rows.where("ul IS NOT NULL AND ur IS NOT NULL AND dl IS NOT NULL AND dr IS NOT NULL AND u IS NOT NULL AND d IS NOT NULL AND l IS NOT NULL AND r IS NOT NULL")


def laplacian(cells: DataFrame) -> DataFrame:
    """The variance of the four-neighbour Laplacian inside the border."""
    edge = F.col("u") + F.col("d") + F.col("l") + F.col("r") - F.col("lum") * 4
    rows = _inner(neighbours(cells)).withColumn("e", edge)
    return rows.groupBy("image_id").agg(r6(F.greatest(F.lit(0.0), F.avg(F.col("e") * F.col("e")) - F.avg("e") * F.avg("e"))).alias("variance"))


def sobel(cells: DataFrame) -> DataFrame:
    """Mean strength of the Sobel gradient inside the border, and the share of cells above EDGE."""
    c = F.col
    gx = c("ur") - c("ul") + (c("r") - c("l")) * 2 + c("dr") - c("dl")
    gy = c("dl") - c("ul") + (c("d") - c("u")) * 2 + c("dr") - c("ur")
    rows = _inner(neighbours(cells)).withColumn("m", F.round(clamp(F.sqrt(gx * gx + gy * gy) / 4, 0.0, 1.0), 12))
    return rows.groupBy("image_id").agg(r6(F.avg("m")).alias("edge_strength"), r6(F.count_if(c("m") >= EDGE) / F.count("*")).alias("edge_density"))


def box_blur(cells: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """image_id, x, y, blurred: means over 2 radius + 1 cells of a row, then of a column; the border is repeated outwards.

    A window frame ends at the border, so the missing cells are the border's own value times how many are missing.
    """

    def pass_over(rows: DataFrame, along: str, last: int, column: str) -> DataFrame:
        order = _across(along)
        frame = order.rowsBetween(-radius, radius)
        every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        before, after = F.greatest(F.lit(0), radius - F.col(along)), F.greatest(F.lit(0), F.col(along) + radius - last)
        total = F.sum(column).over(frame) + before * F.first(column).over(every) + after * F.last(column).over(every)
        return rows.withColumn(column, total / (2 * radius + 1))

    rows = cells.select("image_id", "x", "y", F.col("lum").alias("blurred"))
    rows = pass_over(pass_over(rows, "x", width - 1, "blurred"), "y", height - 1, "blurred")
    return rows.withColumn("blurred", r6("blurred"))


def integral(cells: DataFrame) -> DataFrame:
    """image_id, x, y, total: the sum over all cells up to x and y."""
    rows = cells.withColumn("s", F.sum("lum").over(_across("x").rowsBetween(W.unboundedPreceding, 0)))
    return rows.select("image_id", "x", "y", r6(F.sum("s").over(_across("y").rowsBetween(W.unboundedPreceding, 0))).alias("total"))


def histogram(cells: DataFrame) -> DataFrame:
    return cells.groupBy("image_id", F.least(F.lit(BINS - 1), F.floor(F.col("lum") * (BINS - 1))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def otsu(bins: DataFrame) -> DataFrame:
    """image_id, otsu_bin: the bin that parts the cells with the largest variance between the parts, the first of equals. An
    image has BINS rows at most here."""
    upto = W.partitionBy("image_id").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy("image_id")
    rows = bins.select("image_id", "bin", F.sum("n").over(upto).alias("w"), F.sum(F.col("n") * F.col("bin")).over(upto).alias("s"), F.sum("n").over(every).alias("wt"), F.sum(F.col("n") * F.col("bin")).over(every).alias("st"))
    gap = F.col("s") / F.col("w") - (F.col("st") - F.col("s")) / (F.col("wt") - F.col("w"))
    split = rows.where("w < wt").withColumn("v", F.round(F.col("w") * (F.col("wt") - F.col("w")) * gap * gap, 6))
    best = split.groupBy("image_id").agg(F.max_by("bin", F.struct("v", -F.col("bin"))).alias("b"))
    fallback = math.floor(0.5 * (BINS - 1) + 0.5)
    return bins.select("image_id").distinct().join(best, "image_id", "left").select("image_id", F.coalesce("b", F.lit(fallback)).cast("int").alias("otsu_bin"))


def adaptive_threshold(cells: DataFrame, configured: float = 0.5) -> DataFrame:
    """image_id, threshold, foreground_ratio: between the configured threshold and Otsu's, bounded, and one step lower or
    higher where hardly anything or almost all would be foreground."""
    cut = clamp(lerp(F.lit(configured), F.col("otsu_bin") / (BINS - 1), F.lit(OTSU_SHARE)), LEAST_CUT, MOST_CUT)
    found = otsu(histogram(cells)).select("image_id", cut.alias("t"))
    share = lambda name: F.count_if(F.col("lum") >= F.col(name)) / F.count("*")
    rows = cells.select("image_id", "lum").join(found, "image_id")
    first = rows.groupBy("image_id", "t").agg(share("t").alias("s"))
    moved = F.when(F.col("s") < LEAST_SHARE, F.greatest(F.lit(LEAST_CUT), F.col("t") - CUT_STEP)).when(F.col("s") > MOST_SHARE, F.least(F.lit(MOST_CUT), F.col("t") + CUT_STEP)).otherwise(F.col("t"))
    again = cells.select("image_id", "lum").join(first.select("image_id", moved.alias("threshold")), "image_id")
    return again.groupBy("image_id", "threshold").agg(r6(share("threshold")).alias("foreground_ratio")).withColumn("threshold", r6("threshold"))


def mask_metrics(cells: DataFrame, width: int, height: int) -> DataFrame:
    """The foreground's share, bounding box and contact with each edge; an image without foreground has no box."""
    m = F.col("mask")
    n = F.count_if(m)
    contact = lambda c, of, name: r6(F.count_if(m & c) / of).alias(name)
    box = [f(F.when(m, F.col(c))).alias(name) for f, c, name in ((F.min, "x", "min_x"), (F.max, "x", "max_x"), (F.min, "y", "min_y"), (F.max, "y", "max_y"))]
    return cells.groupBy("image_id").agg(
        n.alias("foreground"), r6(n / F.count("*")).alias("foreground_ratio"), *box, contact(F.col("y") == 0, width, "top"), contact(F.col("y") == height - 1, width, "bottom"),
        contact(F.col("x") == 0, height, "left"), contact(F.col("x") == width - 1, height, "right"),
    )


def components(cells: DataFrame, value: bool = True, diagonal: bool = True) -> DataFrame:
    """image_id, label, area, min_x, max_x, min_y, max_y, edge: connected cells with mask = value; label is the smallest cell."""
    size = cells.groupBy("image_id").agg(F.max("x").alias("right"), F.max("y").alias("bottom"))
    rows = labelled(cells, value, diagonal).groupBy("image_id", "label").agg(F.count("*").alias("area"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    edge = (F.col("min_x") == 0) | (F.col("min_y") == 0) | (F.col("max_x") == F.col("right")) | (F.col("max_y") == F.col("bottom"))
    return rows.join(size, "image_id").select("image_id", "label", "area", "min_x", "max_x", "min_y", "max_y", edge.alias("edge"))


def holes(cells: DataFrame) -> DataFrame:
    """image_id, holes, hole_cells: background that no side step connects with the border."""
    inner = components(cells, value=False, diagonal=False).where("NOT edge")
    return inner.groupBy("image_id").agg(F.count("*").alias("holes"), F.sum("area").alias("hole_cells"))


def decision(metrics: DataFrame) -> DataFrame:
    """decision of score and issues: accepted without issues from ACCEPT on, with a warning from WARN, retried from RETRY;
    retried at once without foreground."""
    s = clamp(F.col("score"), 0.0, 1.0)
    word = F.when(F.col("missing_foreground"), "retry").when(s >= ACCEPT, F.when(F.col("issues") > 0, "accept-with-warning").otherwise("accept")).when(s >= WARN, "accept-with-warning").when(s >= RETRY, "retry").otherwise("reject")
    return metrics.withColumn("decision", word)


def polygon_metrics(points: DataFrame) -> DataFrame:
    """polygon, area, perimeter, centroid and roundness of points x, y in order of i; the last one leads back to the first."""
    order = W.partitionBy("polygon").orderBy("i")
    first = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = points.select("polygon", "x", "y", *[F.coalesce(F.lead(c).over(order), F.first(c).over(first)).alias(f"{c}2") for c in "xy"])
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    step = F.sqrt((F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x")) + (F.col("y2") - F.col("y")) * (F.col("y2") - F.col("y")))
    sums = rows.groupBy("polygon").agg(F.sum(cross).alias("c"), F.sum((F.col("x") + F.col("x2")) * cross).alias("cx"), F.sum((F.col("y") + F.col("y2")) * cross).alias("cy"), F.sum(step).alias("p"), *[f(c).alias(n) for f, c, n in ((F.min, "x", "x0"), (F.max, "x", "x1"), (F.min, "y", "y0"), (F.max, "y", "y1"))])
    flat = F.abs("c") <= 1e-9
    centre = lambda s, a, b: F.when(flat, (F.col(a) + F.col(b)) / 2).otherwise(F.col(s) / (F.col("c") * 3))
    area = F.abs("c") / 2
    return sums.select("polygon", r6(area).alias("area"), r6("p").alias("perimeter"), F.round(centre("cx", "x0", "x1"), 4).alias("centre_x"), F.round(centre("cy", "y0", "y1"), 4).alias("centre_y"), r6(F.when(F.col("p") <= 1e-9, 0.0).otherwise(clamp(area * 4 * math.pi / (F.col("p") * F.col("p")), 0.0, 1.0))).alias("roundness"))


def box_overlap(boxes: DataFrame, suffixes: tuple[str, str] = ("1", "2")) -> DataFrame:
    """intersection and iou of two boxes x, y, w, h on one row."""
    a, b = suffixes
    side = lambda p, n: F.greatest(F.lit(0.0), F.least(F.col(p + a) + F.col(n + a), F.col(p + b) + F.col(n + b)) - F.greatest(F.col(p + a), F.col(p + b)))
    both = side("x", "w") * side("y", "h")
    union = F.col("w" + a) * F.col("h" + a) + F.col("w" + b) * F.col("h" + b) - both
    return boxes.withColumn("intersection", r6(both)).withColumn("iou", r6(F.when(union <= 0, 0.0).otherwise(both / union)))


def nearest_center(vectors: DataFrame, centers: DataFrame, most: float) -> DataFrame:
    """id, center, distance: the nearest center of each vector, the smaller name of equals, if it is nearer than most.

    centers (center, c) has one row a label; up to MOST_CENTERS of them are sent to all tasks, more are joined by length.
    """
    return nearest_of_blocks(vectors, centers, most)


def nearest_of_blocks(vectors: DataFrame, centers: DataFrame, most: float, at_once: int = MOST_CENTERS) -> DataFrame:
    """The same, in blocks of centers that are sent to all tasks one after another: a vector meets every block, and only its
    nearest center of each is kept."""
    blocks = [centers]
    if (n := centers.count()) > at_once:
        part = F.pmod(F.xxhash64("center"), F.lit(-(-n // at_once)))
        blocks = [centers.where(part == i) for i in range(-(-n // at_once))]
    return functools.reduce(DataFrame.unionByName, [_nearest(vectors, F.broadcast(b)) for b in blocks]).groupBy("id").agg(F.min(F.struct("distance", "center")).alias("b")).select("id", "b.center", "b.distance").where(F.col("distance") < most)


def _nearest(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    far = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    rows = vectors.join(centers, F.size("v") == F.size("c")).select("id", "center", F.round(far, 6).alias("distance"))
    return rows.groupBy("id").agg(F.min(F.struct("distance", "center")).alias("b")).select("id", "b.center", "b.distance")


