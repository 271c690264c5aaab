"""Contours: lists of points in order, the last one leading back to the first.

A contour is a row with an array `points` of (x, y), as long as its outline needs; everything that looks at one contour is a
function of its array, and what measures along it goes over its segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The smallest length that counts, samples of a comparison, and how simplified and smoothed by default.
TINY, SAMPLES, TOLERANCE, LEAST_POINTS, SMOOTHING = 1e-6, 96, 2.0, 8, 0.25


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)


def following(points: Column) -> Column:
    """The points from the second on and the first one again."""
    return F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))


def inside(p: Column, points: Column) -> Column:
    """Whether a point is inside: an odd number of sides cross the line from it to the right."""
    def crossed(n: Column, s: Column) -> Column:
        a, b = s["b"], s["a"]  # a side from b, the point before, to a
        cut = (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"] + TINY) + a["x"]
        return n + ((((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < cut)).cast("int"))

    return (F.size(points) >= 3) & (F.aggregate(_sides(points), F.lit(0), crossed) % 2 == 1)


def _sides(points: Column) -> Column:
    return F.zip_with(points, following(points), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def segments(contours: DataFrame) -> DataFrame:
    """The segments of the contours (contour, points): seg from 0, a and b."""
    return contours.select("contour", F.posexplode(_sides(F.col("points"))).alias("seg", "s")).select("contour", "seg", "s.a", "s.b")


def nearest_points(asked: DataFrame, contours: DataFrame) -> DataFrame:
    """contour, seg, x, y, distance: where each contour comes nearest to the point p asked for it; the first segment of equals."""
    rows = segments(contours).join(asked, "contour")
    a, b, p = F.col("a"), F.col("b"), F.col("p")
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = dx * dx + dy * dy
    t = F.when(length <= TINY, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / length)))
    rows = rows.withColumn("t", t).withColumn("q", point(a["x"] + dx * F.col("t"), a["y"] + dy * F.col("t")))
    far = F.round(distance(F.col("q"), p), 9)
    best = rows.groupBy("contour").agg(F.min_by(F.struct("seg", "q", far.alias("distance")), F.struct(far, "seg")).alias("n"))
    return best.select("contour", "n.seg", F.col("n.q.x").alias("x"), F.col("n.q.y").alias("y"), "n.distance")


def spread(points: Column, least: float) -> Column:
    """The points without those nearer than `least` to the one kept before, and without a last one that near to the first."""
    kept = F.aggregate(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1), lambda out, p: F.when(distance(F.element_at(out, -1), p) >= least, F.concat(out, F.array(p))).otherwise(out))
    ends = (F.size(kept) > 2) & (distance(F.element_at(kept, 1), F.element_at(kept, -1)) < least)
    return F.when(ends, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)


def in_unit_box(points: Column) -> Column:
    """The points moved and stretched so that their box is from 0 to 1 both ways."""
    low = lambda c: F.array_min(F.transform(points, lambda p: p[c]))
    size = lambda c: F.greatest(F.lit(TINY), F.array_max(F.transform(points, lambda p: p[c])) - low(c))
    return F.transform(points, lambda p: point((p["x"] - low("x")) / size("x"), (p["y"] - low("y")) / size("y")))


def resampled(contours: DataFrame, count: int) -> DataFrame:
    """contour, i, x, y: `count` points at equal distances along each contour, the first one where it starts.

    Every segment gives the samples whose distance from the start is behind its own start and up to its end, so nothing is
    joined: the running length is a window over the segments of a contour.
    """
    order = W.partitionBy("contour").orderBy("seg")
    rows = segments(contours).withColumn("len", distance(F.col("a"), F.col("b"))).where(F.col("len") > TINY)
    rows = rows.withColumn("to", F.sum("len").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("from", F.col("to") - F.col("len"))
    rows = rows.withColumn("total", F.sum("len").over(W.partitionBy("contour"))).withColumn("first", F.row_number().over(order) == 1)
    share = lambda c: F.round(F.col(c) / F.col("total") * count, 9)
    lo, hi = F.when(F.col("first"), 0).otherwise(F.floor(share("from")) + 1), F.least(F.floor(share("to")), F.lit(count - 1))
    rows = rows.withColumns({"lo": lo.cast("int"), "hi": hi.cast("int")}).where("lo <= hi").withColumn("i", F.explode(F.sequence("lo", "hi")))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("i") / count * F.col("total") - F.col("from")) / F.col("len")))
    return rows.select("contour", "i", (F.col("a.x") + (F.col("b.x") - F.col("a.x")) * t).alias("x"), (F.col("a.y") + (F.col("b.y") - F.col("a.y")) * t).alias("y"))


def oriented(samples: DataFrame, count: int) -> DataFrame:
    """Samples numbered clockwise (of positive area) from the leftmost one, the upper of equals."""
    samples = samples.withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})
    order = W.partitionBy("contour").orderBy("i")
    rows = samples.withColumns({f"{c}2": F.coalesce(F.lead(c).over(order), F.first(c).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))) for c in "xy"})
    of = rows.groupBy("contour").agg(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")).alias("area"), F.min_by("i", F.struct("x", "y")).alias("start"))
    step = F.when(F.col("area") > 0, F.col("i") - F.col("start")).otherwise(F.col("start") - F.col("i"))
    return samples.join(of, "contour").select("contour", F.pmod(step, F.lit(count)).alias("i"), "x", "y")


def similarity(first: DataFrame, second: DataFrame, count: int = SAMPLES) -> DataFrame:
    """contour, average, most, least, similarity of the contours with the same name: both in a box of one, by samples."""
    ready = lambda df: oriented(resampled(df.select("contour", in_unit_box(F.col("points")).alias("points")), count), count)
    a, b = ready(first), ready(second).withColumnsRenamed({"x": "u", "y": "v"})
    far = F.sqrt((F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v")))
    rows = a.join(b, ["contour", "i"]).groupBy("contour").agg(F.avg(far).alias("average"), F.max(far).alias("most"), F.min(far).alias("least"))
    return rows.withColumn("similarity", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("average") / math.sqrt(2))))


def smoothed(points: Column, strength: float = SMOOTHING) -> Column:
    """Every segment gives two points, at `strength` of its length from either end."""
    at = lambda a, b, t: point(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t)
    return F.flatten(F.transform(_sides(points), lambda s: F.array(at(s["a"], s["b"], strength), at(s["a"], s["b"], 1 - strength))))


def rotated(p: Column, degrees: float, cx: float, cy: float) -> Column:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    x, y = p["x"] - cx, p["y"] - cy
    return point(x * c - y * s + cx, x * s + y * c + cy)


def scaled(p: Column, sx: float, sy: float, cx: float, cy: float) -> Column:
    return point((p["x"] - cx) * sx + cx, (p["y"] - cy) * sy + cy)


def curve(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    """The point at t of a cubic curve from p0 to p3."""
    u = 1 - t
    mix = lambda c: p0[c] * u * u * u + p1[c] * 3 * u * u * t + p2[c] * 3 * u * t * t + p3[c] * t * t * t
    return point(mix("x"), mix("y"))


def path_text(points: Column) -> Column:
    """The contour as the text of a path, in hundredths."""
    def say(x: Column) -> Column:
        hundredths = F.round(x * 100).cast("long")
        digits = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.abs(hundredths) / 100), "0+$", ""), r"\.$", "")
        return F.concat(F.when(hundredths < 0, "-").otherwise(""), digits)

    said = F.transform(points, lambda p: F.concat_ws(" ", say(p["x"]), say(p["y"])))
    return F.when(F.size(points) == 0, "").otherwise(F.concat(F.lit("M "), F.concat_ws(" L ", said), F.lit(" Z")))


def _line(points: list[tuple[float, float]], tolerance: float) -> list[int]:
    """Places of the points of a line that stay: those farther than tolerance from the line between the kept ones beside them."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (x0, y0), (x1, y1) = points[a], points[b]
        length, most, at = math.hypot(x1 - x0, y1 - y0), tolerance, None
        for i in range(a + 1, b):
            x, y = points[i]
            d = abs((y1 - y0) * x - (x1 - x0) * y + x1 * y0 - y1 * x0) / length if length > TINY else math.hypot(x - x0, y - y0)
            if d > most:
                most, at = d, i
        if at is not None:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return sorted(keep)


def simplify(points: list[tuple[float, float]], tolerance: float = TOLERANCE) -> list[tuple[float, float]]:
    """A closed contour in two lines, from its leftmost point to the farthest one and back, each without what is near it."""
    if len(points) <= LEAST_POINTS:
        return points
    first = min(range(len(points)), key=lambda i: (points[i][0], i))
    far = max(range(len(points)), key=lambda i: ((points[i][0] - points[first][0]) ** 2 + (points[i][1] - points[first][1]) ** 2, -i))
    turned = points[first:] + points[:first]
    cut = (far - first) % len(points)
    there, back = turned[: cut + 1], turned[cut:] + turned[:1]
    return [there[i] for i in _line(there, tolerance)[:-1]] + [back[i] for i in _line(back, tolerance)[:-1]]


def simplified(contours: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """contour, kept, points: the contours without the points that a straight line stands for. Row by row, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [simplify([(p["x"], p["y"]) for p in points], tolerance) for points in batch["points"]]
            yield pd.DataFrame({"contour": batch["contour"], "kept": [len(d) for d in done], "points": [[{"x": x, "y": y} for x, y in d] for d in done]})

    return contours.select("contour", "points").mapInPandas(run, "contour long, kept int, points array<struct<x: double, y: double>>")


def merged(x: str, y: str, w: str, h: str) -> list[Column]:
    """Aggregates of boxes: the box around all of them."""
    left, top = F.min(x), F.min(y)
    return [left.alias("x"), top.alias("y"), (F.max(F.col(x) + F.col(w)) - left).alias("w"), (F.max(F.col(y) + F.col(h)) - top).alias("h")]
