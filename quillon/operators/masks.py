"""Masks of images in long form (image_id, x, y, mask): growing, shrinking, cleaning, distances, and images' neighbourhoods."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import kept
from .imaging import MOST_CENTERS
from .parts import with_labels

#: The share of an image and of the largest part from which on a part stays; what is trimmed at either end, the
#: least number for that, and the shares of median and trimmed mean.
LEAST_AREA, LEAST_SHARE, TRIM, LEAST_TO_TRIM, MEDIAN_SHARE = 0.003, 0.035, 0.12, 8, 0.58
#: How a mask's size compares with the one before when it has collapsed or expanded.
COLLAPSED, EXPANDED = 0.45, 1.75


def _square(value: Column, radius: int, fold) -> Column:
    """A fold of the values in the square around each cell, row by row first; the square ends at the border."""
    rows = W.partitionBy("image_id", "y").orderBy("x").rowsBetween(-radius, radius)
    return fold(value).over(rows)


def _around(cells: DataFrame, column: str, value: Column, radius: int, fold) -> DataFrame:
    columns = W.partitionBy("image_id", "x").orderBy("y").rowsBetween(-radius, radius)
    return cells.withColumn(column, _square(value, radius, fold)).withColumn(column, fold(column).over(columns))


def dilated(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Foreground grows by radius cells in all eight directions."""
    return _around(cells, "mask", F.col("mask"), radius, F.max)


def eroded(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Foreground shrinks by radius cells; what is beyond the border counts as background."""
    edge = lambda c: (F.max(c).over(W.partitionBy("image_id")) - F.col(c) < radius) | (F.col(c) < radius)
    rows = _around(cells.withColumn("on edge", edge("x") | edge("y")), "mask", F.col("mask"), radius, F.min)
    return rows.withColumn("mask", F.col("mask") & ~F.col("`on edge`")).drop("on edge")


def without_small_parts(cells: DataFrame, least: float = LEAST_AREA, largest_only: bool = False) -> DataFrame:
    """The mask without small connected parts: those under `least` of the image and under LEAST_SHARE of the largest part."""
    rows = with_labels(cells)
    parts = rows.groupBy("image_id", "label").agg(F.count("*").alias("area"))
    size = parts.groupBy("image_id").agg(F.greatest(F.lit(1), F.floor(F.sum("area") * least)).alias("floor"))
    real = parts.where("label IS NOT NULL")
    first = real.groupBy("image_id").agg(F.min(F.struct(-F.col("area"), "label")).alias("f")).select("image_id", F.col("f.label").alias("first"), (-F.col("f.col1")).alias("largest"))
    stays = F.col("label") == F.col("first")
    if not largest_only:
        stays = stays | (F.col("area") >= F.col("floor")) | (F.col("area") / F.col("largest") >= LEAST_SHARE)
    kept_parts = real.join(first, "image_id").join(size, "image_id").where(stays).select("image_id", "label", F.lit(True).alias("stays"))
    return rows.join(kept_parts, ["image_id", "label"], "left").withColumn("mask", F.coalesce("stays", F.lit(False))).select(*[F.col(f"`{c}`") for c in cells.columns])


def filled(cells: DataFrame) -> DataFrame:
    """The mask with its holes: background that no side step connects with the border becomes foreground."""
    rows = with_labels(cells, value=False, diagonal=False)
    size = cells.groupBy("image_id").agg(F.max("x").alias("right"), F.max("y").alias("bottom"))
    ends = [f(c).alias(n) for c in "xy" for f, n in ((F.min, f"low_{c}"), (F.max, f"high_{c}"))]
    parts = rows.where("label IS NOT NULL").groupBy("image_id", "label").agg(*ends).join(size, "image_id")
    at_border = (F.col("low_x") == 0) | (F.col("low_y") == 0) | (F.col("high_x") == F.col("right")) | (F.col("high_y") == F.col("bottom"))
    open_parts = parts.where(at_border).select("image_id", "label", F.lit(True).alias("reached"))
    return rows.join(open_parts, ["image_id", "label"], "left").withColumn("mask", F.col("reached").isNull()).select(*[F.col(f"`{c}`") for c in cells.columns])


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """image_id, intersection, union, iou, size_ratio, collapsed, expanded of two masks of the same images."""
    rows = first.select("image_id", "x", "y", F.col("mask").alias("a")).join(second.select("image_id", "x", "y", F.col("mask").alias("b")), ["image_id", "x", "y"])
    sums = rows.groupBy("image_id").agg(F.count_if(F.col("a") & F.col("b")).alias("intersection"), F.count_if(F.col("a") | F.col("b")).alias("union"), F.count_if("a").alias("n"), F.count_if("b").alias("before"))
    ratio = F.when(F.col("before") > 0, F.col("n") / F.col("before")).otherwise(1.0)
    iou = F.when(F.col("union") > 0, F.col("intersection") / F.col("union")).otherwise(0.0)
    there = F.col("before") > 0
    return sums.select("image_id", "intersection", "union", iou.alias("iou"), ratio.alias("size_ratio"), (there & (ratio < COLLAPSED)).alias("collapsed"), (there & (ratio > EXPANDED)).alias("expanded"))


def gradients(cells: DataFrame) -> DataFrame:
    """gradient: of the differences of the neighbours on either side, above and below, and across; the border repeats itself."""
    along = W.partitionBy("image_id", "y").orderBy("x")
    down = W.partitionBy("image_id", "x").orderBy("y")
    rows = cells.withColumns({"l": F.coalesce(F.lag("lum").over(along), "lum"), "r": F.coalesce(F.lead("lum").over(along), "lum")})
    shifted = {f"{c}{n}": F.coalesce(f(c).over(down), c) for c in ("l", "lum", "r") for n, f in (("_up", F.lag), ("_down", F.lead))}
    rows = rows.withColumns(shifted)
    square = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    total = square("r", "l") + square("lum_down", "lum_up") + square("r_down", "l_up") * 0.5 + square("l_down", "r_up") * 0.5
    return rows.withColumn("gradient", F.least(F.lit(1.0), F.sqrt(total) / math.sqrt(3))).select(*cells.columns, "gradient")


def textures(cells: DataFrame, radius: int = 1) -> DataFrame:
    """texture: four times the deviation in the square around each cell, which is smaller at the border, 1 at most."""
    rows = cells
    for name, value in (("n", F.lit(1)), ("s", F.col("lum")), ("q", F.col("lum") * F.col("lum"))):
        rows = _around(rows, name, value, radius, F.sum)
    variance = F.greatest(F.lit(0.0), F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")))
    return rows.withColumn("texture", F.least(F.lit(1.0), F.sqrt(variance) * 4)).select(*cells.columns, "texture")


#: Values that a task ranks, about.
AT_ONCE = 2_000_000


def robust_colors(pixels: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """image_id and r, g, b between the median and the mean without the ends, for each channel by itself.

    Each channel is ranked within its image, so what is trimmed is known without gathering an image's pixels in one place. Parts are as
    many as the values need, so what a task sorts doesn't grow with the table.
    """
    width = max(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-3 * pixels.count() // at_once))
    long = pixels.select("image_id", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in "rgb"])).alias("p")).select("image_id", "p.*").repartition(width, "image_id", "c")
    every = W.partitionBy("image_id", "c")
    rows = long.withColumns({"n": F.count("*").over(every), "at": F.row_number().over(every.orderBy("v"))})
    cut = F.when(F.col("n") < LEAST_TO_TRIM, 0).otherwise(F.floor(F.col("n") * TRIM))
    inner = (F.col("at") > cut) & (F.col("at") <= F.col("n") - cut)
    sums = rows.groupBy("image_id", "c").agg(F.percentile("v", F.lit(0.5)).alias("median"), F.avg(F.when(inner, F.col("v"))).alias("mean"))
    sums = sums.withColumn("v", F.col("median") * MEDIAN_SHARE + F.col("mean") * (1 - MEDIAN_SHARE))
    return sums.groupBy("image_id").agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in "rgb"])


def closest_pair(centers: DataFrame, at_once: int = MOST_CENTERS) -> DataFrame:
    """a, b, distance: the two nearest of centers (center, c), the first of equals. Every center meets every other one, in blocks of at
    most at_once of them that are sent to all tasks one after another; of each block only the nearest pair is kept."""
    far = F.sqrt(F.aggregate(F.zip_with("c", "d", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    blocks = max(1, -(-centers.count() // at_once))
    of = F.pmod(F.xxhash64("center"), F.lit(blocks))
    found = []
    for k in range(blocks):
        block = centers.where(of == k).select(F.col("center").alias("b"), F.col("c").alias("d"))
        both = centers.select(F.col("center").alias("a"), "c").join(F.broadcast(block), F.col("a") < F.col("b"))
        found.append(both.agg(F.min(F.struct(F.round(far, 6).alias("distance"), "a", "b")).alias("m")))
    every = functools.reduce(DataFrame.unionByName, found).agg(F.min("m").alias("m"))
    return every.where("m IS NOT NULL").select("m.a", "m.b", "m.distance")


#: The eight neighbours, clockwise from the right (y grows downwards).
AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def _trace(there: set[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The boundary of the part that the first cell, in reading order, is in: from each cell on to the next one clockwise from
    where it was come from, until the start is reached as it was begun, or after `most` steps where it never is."""
    if not there:
        return []
    at = start = min(there, key=lambda p: (p[1], p[0]))
    back, out = 4, []  # come from the left
    while True:
        out.append(at)
        turn = next((k for k in range(1, 9) if (at[0] + AROUND[(back + k) % 8][0], at[1] + AROUND[(back + k) % 8][1]) in there), None)
        if turn is None:
            return out
        to, before = AROUND[(back + turn) % 8], AROUND[(back + turn - 1) % 8]
        at = at[0] + to[0], at[1] + to[1]
        back = AROUND.index((before[0] - to[0], before[1] - to[1]))
        if at == start and back == 4 or len(out) > most:
            return out


def boundaries(cells: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, i, x, y: the boundary of each mask as points in order. An image is a group; only its foreground is gathered."""
    import pandas as pd

    most = max(64, 4 * width * height)

    def run(image: pd.DataFrame) -> pd.DataFrame:
        points = _trace(set(zip(image["x"].tolist(), image["y"].tolist(), strict=True)), most)
        return pd.DataFrame({"image_id": image["image_id"].iloc[0], "i": range(len(points)), "x": [p[0] for p in points], "y": [p[1] for p in points]})

    return cells.where("mask").select("image_id", "x", "y").groupBy("image_id").applyInPandas(run, "image_id long, i int, x int, y int")


#: What confidence and distance count when points are chosen, and how distance grows.
SURE, FAR, FAR_TIMES = 0.66, 0.34, 2.5


def spread_points(points: DataFrame, count: int, width: int, height: int) -> DataFrame:
    """image_id, turn, i, x, y: `count` points (image_id, i, x, y, confidence) of each image, the surest one first, then each
    time the one that is best by confidence and by its distance from those chosen; of equals the surer, then the first.

    Every turn is one aggregation and one join by image, so an image's points are never in one place; what is chosen so far is a
    table in the shared folder, so a turn doesn't read those before it again.
    """
    diagonal = math.hypot(width, height)
    place = lambda p: F.sqrt(((F.col("x") - p["x"]) * (F.col("x") - p["x"]) + (F.col("y") - p["y"]) * (F.col("y") - p["y"])).cast("double")) / diagonal
    chosen = kept(points.groupBy("image_id").agg(F.array(F.max_by(F.struct("i", "x", "y"), F.struct("confidence", -F.col("i")))).alias("chosen")))
    for _ in range(count - 1):
        rows = points.join(chosen, "image_id").where(~F.exists("chosen", lambda p: p["i"] == F.col("i")))
        rows = rows.withColumn("near", F.array_min(F.transform("chosen", place)))
        value = F.round(F.col("confidence") * SURE + F.least(F.lit(1.0), F.col("near") * FAR_TIMES) * FAR, 9)
        best = rows.groupBy("image_id").agg(F.max_by(F.struct("i", "x", "y"), F.struct(value, "confidence", -F.col("i"))).alias("next"))
        more = F.when(F.col("next").isNotNull(), F.array_append("chosen", F.col("next"))).otherwise(F.col("chosen"))
        chosen = kept(chosen.join(best, "image_id", "left").select("image_id", more.alias("chosen")))
    return chosen.select("image_id", F.posexplode("chosen").alias("turn", "p")).select("image_id", "turn", "p.i", "p.x", "p.y")
