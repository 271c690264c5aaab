"""What the background of an image looks like: seeds near its border, clusters of their colours, and how near each cell is to one.

Cells are rows (image_id, x, y, alpha, gradient, texture, l, a, b) with colours in units from 0 to 1.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Steps between places that are looked at; the border's share of the shorter side and its bounds; the share of a corner;
#: most alpha, gradient and texture of a seed, of a place further in, and seeds of an image at most.
STRIDE, BAND, CORNER = 2, (0.035, 3, 32), 0.12
MOST_ALPHA, LOW_ALPHA, MOST_GRADIENT, MOST_TEXTURE, MOST_SEEDS = 0.34, 0.16, 0.24, 0.22, 4096
#: What a seed's alpha, gradient, texture, nearness to the border, distance from the subject and source count, and what
#: each source is worth.
SHARES = (0.30, 0.20, 0.14, 0.10, 0.12, 0.14)
WORTH = {"corner": 1.0, "border": 0.92, "low mask": 0.82}
#: Clusters at most, distance up to which a colour belongs to one, share of the seeds of one that counts, and the
#: bounds of what is still like a cluster, before and with the spread of its colours.
CLUSTERS, SAME, LEAST_SHARE = 5, 0.115, 0.08
BASE, TIMES, TOLERANCE = 0.13, 2.1, (0.07, 0.32)
PLACES = 9


def _let(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.transform(F.array(value), f)[0]


def _fades(c: Column, most: float) -> Column:
    """1 at 0, 0 from `most` on, and smooth between."""
    return _let(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / most)), lambda t: 1 - t * t * (3 - t * 2))


def seeds(cells: DataFrame) -> DataFrame:
    """image_id, place, source, x, y, l, a, b, texture, confidence: cells near the border that look like background.

    Corners are looked at first, then the borders from the top clockwise, then cells of a low mask up to twice as far in; place is the
    order, row by row in each. A cell counts once. There is no subject's box here, so its distance counts in full. The surest MOST_SEEDS of
    an image stay.
    """
    size = cells.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    x, y, w, h = (F.col(c) for c in "xywh")
    side = F.least("w", "h")
    share, low, high = BAND
    band = F.greatest(F.lit(low), F.least(F.floor(side * share + 0.5), F.lit(high))).cast("int")
    band = F.least(band, F.greatest(F.lit(1), F.floor(side * 0.25).cast("int")))
    corner = lambda n: F.greatest(F.lit(1), F.least(F.floor(n * CORNER).cast("int"), F.floor(n * 0.4).cast("int")))
    cw, ch, zero = corner(w), corner(h), F.lit(0)
    box = lambda x0, x1, y0, y1: (x >= x0) & (x < x1) & (y >= y0) & (y < y1) & ((x - x0) % STRIDE == 0) & ((y - y0) % STRIDE == 0)
    edge = F.least(x, y, w - 1 - x, h - 1 - y)
    right, bottom = F.greatest(zero, w - cw), F.greatest(zero, h - ch)
    sources = [
        ("corner", box(zero, cw, zero, ch)), ("corner", box(right, w, zero, ch)), ("corner", box(right, w, bottom, h)), ("corner", box(zero, cw, bottom, h)),
        ("border", box(zero, w, zero, band)), ("border", box(F.greatest(zero, w - band), w, zero, h)), ("border", box(zero, w, F.greatest(zero, h - band), h)), ("border", box(zero, band, zero, h)),
        ("low mask", box(zero, w, zero, h) & (edge <= band * 2) & (F.col("alpha") <= LOW_ALPHA)),
    ]
    turn = functools.reduce(lambda found, k: found.when(sources[k][1], k), range(1, len(sources)), F.when(sources[0][1], 0))
    rows = cells.join(size, "image_id").withColumns({"turn": turn, "edge": edge, "side": side})
    rows = rows.where(F.col("turn").isNotNull() & (F.col("alpha") <= MOST_ALPHA) & (F.col("gradient") <= MOST_GRADIENT) & (F.col("texture") <= MOST_TEXTURE))
    worth = F.element_at(F.array(*[F.lit(WORTH[name]) for name, _ in sources]), F.col("turn") + 1)
    near = 1 - F.least(F.lit(1.0), F.col("edge") / F.greatest(F.lit(1.0), F.col("side") * 0.5))
    parts = (_fades(F.col("alpha"), MOST_ALPHA), _fades(F.col("gradient"), MOST_GRADIENT), _fades(F.col("texture"), MOST_TEXTURE), near, F.lit(1.0), worth)
    sure = F.round(functools.reduce(lambda a, b: a + b, [p * s for p, s in zip(parts, SHARES, strict=True)]), PLACES)
    order = F.row_number().over(W.partitionBy("image_id").orderBy("turn", "y", "x"))
    rows = rows.select("image_id", order.alias("place"), F.element_at(F.array(*[F.lit(name) for name, _ in sources]), F.col("turn") + 1).alias("source"), "x", "y", "l", "a", "b", "texture", sure.alias("confidence"))
    first = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("confidence"), "place"))
    return rows.withColumn("n", first).where(F.col("n") <= MOST_SEEDS).drop("n")


_SUMS = ("l", "a", "b", "ll", "aa", "bb", "texture", "x", "y")


def _far(p: Column, q: Column) -> Column:
    """The distance of the mean colours of two accumulators."""
    apart = [p[c] / p["n"] - q[c] / q["n"] for c in "lab"]
    return F.round(F.sqrt(sum((d * d for d in apart[1:]), apart[0] * apart[0])) / math.sqrt(3), PLACES)


def _plus(p: Column, q: Column) -> Column:
    return F.struct((p["n"] + q["n"]).alias("n"), *[(p[c] + q[c]).alias(c) for c in _SUMS])


def _taken(clusters: Column, seed: Column, most: int) -> Column:
    """The clusters after one more seed: it joins the nearest one, if that is near enough, or is a new one; if there are then too many,
    the two nearest of all become one."""
    near = F.array_min(F.transform(clusters, lambda c, i: F.struct(_far(c, seed).alias("d"), i.alias("i"))))
    joined = _let(near, lambda b: F.when(b.isNotNull() & (b["d"] <= SAME), F.transform(clusters, lambda c, i: F.when(i == b["i"], _plus(c, seed)).otherwise(c))).otherwise(F.concat(clusters, F.array(seed))))

    def merged(now: Column) -> Column:
        pairs = F.flatten(F.transform(now, lambda p, i: F.transform(F.slice(now, i + 2, F.size(now)), lambda q, j: F.struct(_far(p, q).alias("d"), i.alias("i"), (i + j + 1).alias("j")))))
        one = lambda m: F.filter(F.transform(now, lambda c, k: F.when(k == m["i"], _plus(c, F.get(now, m["j"]))).when(k == m["j"], F.lit(None)).otherwise(c)), lambda c: c.isNotNull())
        return F.when(F.size(now) > most, _let(F.array_min(pairs), one)).otherwise(now)

    return _let(joined, merged)


def color_clusters(found: DataFrame, most: int = CLUSTERS) -> DataFrame:
    """image_id, cluster, n, l, a, b, texture, x, y, tolerance: the clusters of the seeds' colours, the largest first.

    The seeds are taken one after the other, the surest first, so each image is a fold over its seeds, MOST_SEEDS at most; of that only
    `most` + 1 sums are kept. Clusters with few seeds are left out, unless all are such. tolerance says how far from its colour
    a cell is still like a cluster: further, the more the seeds differ.
    """
    value = {"l": F.col("l"), "a": F.col("a"), "b": F.col("b"), "ll": F.col("l") * F.col("l"), "aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "texture": F.col("texture"), "x": F.col("x"), "y": F.col("y")}
    seed = F.struct(F.lit(1).cast("long").alias("n"), *[value[c].cast("double").alias(c) for c in _SUMS])
    rows = found.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("sure"), "place", seed.alias("seed")))).alias("seeds"))
    kind = "array<struct<n:bigint," + ",".join(f"{c}:double" for c in _SUMS) + ">>"
    rows = rows.withColumn("clusters", F.aggregate("seeds", F.array().cast(kind), lambda s, e: _taken(s, e["seed"], most)))
    enough = F.greatest(F.lit(2).cast("double"), F.floor(F.size("seeds") * LEAST_SHARE))
    large = F.filter("clusters", lambda c: c["n"] >= enough)
    chosen = F.when(F.size(large) > 0, large).otherwise(F.col("clusters"))
    numbered = F.array_sort(F.transform(chosen, lambda c, i: F.struct((-c["n"]).alias("size"), i.alias("i"), c.alias("c"))))
    rows = rows.select("image_id", F.posexplode(numbered).alias("cluster", "p")).select("image_id", "cluster", "p.c.*")
    spread = lambda c: F.greatest(F.lit(0.0), F.col(c * 2) / F.col("n") - (F.col(c) / F.col("n")) * (F.col(c) / F.col("n")))
    differ = F.least(F.lit(1.0), F.sqrt(spread("l") + spread("a") + spread("b")) / math.sqrt(3))
    tolerance = F.round(F.least(F.lit(TOLERANCE[1]), F.greatest(F.lit(TOLERANCE[0]), BASE + differ * TIMES)), PLACES)
    return rows.select("image_id", "cluster", "n", *[F.round(F.col(c) / F.col("n"), PLACES).alias(c) for c in ("l", "a", "b", "texture", "x", "y")], tolerance.alias("tolerance"))


def likeness(cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """cells with cluster (the nearest one by colour, the larger of equals) and background, from 1 (of its colour) to 0 (beyond its
    tolerance); 0 and null in an image without clusters. An image's clusters, CLUSTERS at most, are one row that its cells are joined with."""
    its = clusters.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "l", "a", "b", "tolerance"))).alias("clusters"))
    apart = lambda c: [F.col(x) - c[x] for x in "lab"]
    far = lambda c: F.round(F.sqrt(sum((d * d for d in apart(c)[1:]), apart(c)[0] * apart(c)[0])) / math.sqrt(3), PLACES)
    nearest = F.array_min(F.transform("clusters", lambda c: F.struct(far(c).alias("d"), c["cluster"].alias("cluster"), c["tolerance"].alias("tolerance"))))
    rows = cells.join(its, "image_id", "left").withColumn("nearest", nearest)
    t = F.least(F.lit(1.0), F.col("nearest.d") / F.col("nearest.tolerance"))
    return rows.select(*cells.columns, F.col("nearest.cluster").alias("cluster"), F.coalesce(F.round(_let(t, lambda u: 1 - u * u * (3 - u * 2)), PLACES), F.lit(0.0)).alias("background"))
