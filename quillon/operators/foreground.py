"""A colour model of what an image shows: prototypes of foreground and background, regions of the foreground, and how alike a cell is.

Cells are rows (image_id, x, y, alpha, lum, r, g, b, main, boundary_distance), all but the last in units from 0 to 1 (see boundary). All
reliable cells are samples, however many there are: they are summed where they are, so an image is never in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.num import half_up
from ..sources.shared import kept
from .boundary import mixed, unit

PLACES = 9
#: Least alpha and depth of a foreground sample, most alpha of a background sample; regions, their radius as a share of the
#: main part's shorter side, samples that one needs and that are enough; least distance of the two prototypes.
LEAST_ALPHA, LEAST_DEPTH, MOST_BACKGROUND = 0.82, 5.0, 0.08
REGIONS, RADIUS, LEAST_SAMPLES, ENOUGH = 8, 0.09, 24, 512
SEPARATION = 0.08
#: How fast likeness falls with the distance in each space, and what each space counts.
SOFTNESS = {"rgb": 4.5, "hsv": 4.0, "lab": 5.0, "light": 2.5}
SPACES = {"rgb": 0.24, "hsv": 0.18, "lab": 0.42, "light": 0.16}
LEAST_VARIANCE = 0.000001


def _colors(r: Column, g: Column, b: Column) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Hue, saturation, value, and lightness and the two opponent values, all in units."""
    eight = (r * 255.0, g * 255.0, b * 255.0)
    l, p, q = C.lab(*eight)
    return C.hsv(*eight), (unit(l / 100), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p / 128)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / 128)))


def with_colors(rows: DataFrame) -> DataFrame:
    """rows with h, s, v, lab_l, lab_a, lab_b of r, g and b."""
    hsv, lab = _colors(F.col("r"), F.col("g"), F.col("b"))
    return rows.withColumns(dict(zip(("h", "s", "v", "lab_l", "lab_a", "lab_b"), (F.round(c, PLACES) for c in (*hsv, *lab)), strict=True)))


def _sums(where: Column) -> list[Column]:
    of = lambda c: F.sum(F.when(where, c))
    return [F.count_if(where).alias("n"), *[of(F.col(c)).alias(c) for c in ("r", "g", "b", "lum")], of(F.col("lum") * F.col("lum")).alias("squares")]


def _prototypes(sums: DataFrame) -> DataFrame:
    """The sums as a prototype: mean colour, its variance, and confidence by number and evenness. Nothing where there are no samples."""
    rows = sums.where("n > 0").withColumns({c: F.round(F.col(c) / F.col("n"), PLACES) for c in ("r", "g", "b", "lum")})
    rows = rows.withColumn("variance", F.round(unit(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - F.col("lum") * F.col("lum"))), PLACES))
    even = unit(1 - F.sqrt(F.greatest(F.lit(LEAST_VARIANCE), "variance")))
    return with_colors(rows.withColumn("confidence", F.round(mixed((unit(F.log2(F.col("n") + 1) / 12), 0.55), (even, 0.45)), PLACES)).drop("squares"))


_PROTOTYPE = ("n", "r", "g", "b", "h", "s", "v", "lab_l", "lab_a", "lab_b", "lum", "variance", "confidence")


def _distances(p: dict[str, Column], q: dict[str, Column]) -> dict[str, Column]:
    root = lambda *d: unit(F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0])) / math.sqrt(3))
    hsv = C.hsv_distance(tuple(p[c] for c in "hsv"), tuple(q[c] for c in "hsv"))
    lab = root(p["lab_l"] - q["lab_l"], (p["lab_a"] - q["lab_a"]) / 2, (p["lab_b"] - q["lab_b"]) / 2)
    return {"rgb": root(*[p[c] - q[c] for c in "rgb"]), "hsv": hsv, "lab": lab}


def _fields(s: Column) -> dict[str, Column]:
    return {c: s[c] for c in _PROTOTYPE}


def prototypes(cells: DataFrame, least_depth: float = LEAST_DEPTH) -> DataFrame:
    """image_id, foreground, background (structs of _PROTOTYPE, null without samples), separation, usable, and the box of the main part."""
    front = F.col("main") & (F.col("alpha") >= LEAST_ALPHA) & (F.col("boundary_distance") >= least_depth)
    back = ~F.col("main") & (F.col("alpha") <= MOST_BACKGROUND)
    x0, x1, y0, y1 = ((f(F.when(F.col("main"), F.col(c)))) for c in "xy" for f in (F.min, F.max))
    boxes = cells.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), (x1 - x0 + 1).alias("main_w"), (y1 - y0 + 1).alias("main_h"))
    boxes = boxes.withColumns({"main_w": F.coalesce("main_w", "w"), "main_h": F.coalesce("main_h", "h")})
    one = lambda test, name: _prototypes(cells.groupBy("image_id").agg(*_sums(test))).select("image_id", F.struct(*_PROTOTYPE).alias(name))
    rows = boxes.join(one(front, "foreground"), "image_id", "left").join(one(back, "background"), "image_id", "left")
    f, b = _fields(F.col("foreground")), _fields(F.col("background"))
    far = _distances(f, b) | {"light": F.abs(f["lum"] - b["lum"])}
    combined = unit(mixed((far["rgb"], 0.24), (far["hsv"], 0.20), (far["lab"], 0.42), (far["light"], 0.14)))
    separation = F.coalesce(F.round(unit(combined * (0.70 + F.sqrt(f["confidence"] * b["confidence"]) * 0.30)), PLACES), F.lit(0.0))
    rows = rows.withColumn("separation", separation)
    there = F.col("foreground").isNotNull() & F.col("background").isNotNull()
    return rows.withColumn("usable", there & (F.col("separation") >= SEPARATION)).withColumn("radius", F.greatest(F.lit(2), F.floor(F.least("main_w", "main_h") * RADIUS + 0.5)).cast("int"))


def region_seeds(cells: DataFrame, models: DataFrame, least_depth: float = LEAST_DEPTH, regions: int = REGIONS) -> DataFrame:
    """image_id, seeds: places of the samples that regions are laid around, the deepest one first, then each time the one that is best by
    its distance from those chosen, its depth and its alpha; of equals the first in reading order.

    A turn is one aggregation over the samples and the few seeds of each image, which are a table in the shared folder, so turns
    don't read one another's plans again.
    """
    front = F.col("main") & (F.col("alpha") >= LEAST_ALPHA) & (F.col("boundary_distance") >= least_depth)
    box = models.select("image_id", "radius", F.sqrt((F.col("main_w") * F.col("main_w") + F.col("main_h") * F.col("main_h")).cast("double")).alias("across"))
    samples = kept(cells.where(front).select("image_id", "x", "y", "alpha", F.col("boundary_distance").alias("depth")).join(box, "image_id"))
    first = F.struct(-F.col("y"), -F.col("x"))
    place = F.struct("x", "y")
    seeds = kept(samples.groupBy("image_id").agg(F.array(F.max_by(place, F.struct("depth", first))).alias("seeds")))
    for _ in range(regions - 1):
        away = lambda p: F.sqrt(((F.col("x") - p["x"]) * (F.col("x") - p["x"]) + (F.col("y") - p["y"]) * (F.col("y") - p["y"])).cast("double"))
        rows = samples.join(seeds, "image_id").withColumn("near", F.array_min(F.transform("seeds", away)))
        rows = rows.where(F.col("near") >= F.greatest(F.lit(2.0), F.col("radius") * 0.75))
        score = F.round(mixed((unit(F.col("near") / F.greatest(F.lit(1.0), "across")), 0.58), (unit(F.col("depth") / F.greatest(F.lit(1.0), F.col("radius") * 2)), 0.30), ("alpha", 0.12)), PLACES)
        best = kept(rows.groupBy("image_id").agg(F.max_by(place, F.struct(score, first)).alias("next")))
        if best.isEmpty():
            break
        seeds = kept(seeds.join(best, "image_id", "left").select("image_id", F.when(F.col("next").isNotNull(), F.array_append("seeds", F.col("next"))).otherwise(F.col("seeds")).alias("seeds")))
    return seeds


def regions_of(cells: DataFrame, models: DataFrame, seeds: DataFrame, least_depth: float = LEAST_DEPTH, least_samples: int = LEAST_SAMPLES) -> DataFrame:
    """image_id, region, x, y, radius, reliable (share of samples among its cells), alpha (mean), and its prototype: the disc around each
    seed. A cell is summed up for the few discs that it is in."""
    front = F.col("main") & (F.col("alpha") >= LEAST_ALPHA) & (F.col("boundary_distance") >= least_depth)
    rows = cells.withColumn("sample", front).join(seeds.join(models.select("image_id", "radius"), "image_id"), "image_id")
    numbered = F.transform("seeds", lambda p, i: F.struct(i.alias("region"), p["x"].alias("x"), p["y"].alias("y")))
    inside = F.filter(numbered, lambda p: (F.col("x") - p["x"]) * (F.col("x") - p["x"]) + (F.col("y") - p["y"]) * (F.col("y") - p["y"]) <= F.col("radius") * F.col("radius"))
    rows = rows.withColumn("of", F.explode(inside))
    sums = rows.groupBy("image_id", F.col("of.region").alias("region"), F.col("of.x").alias("x"), F.col("of.y").alias("y"), "radius").agg(F.count("*").alias("cells"), F.avg("alpha").alias("alpha"), *_sums(F.col("sample")))
    found = _prototypes(sums.where(F.col("n") >= least_samples))
    found = found.withColumns({"reliable": F.round(F.col("n") / F.col("cells"), PLACES), "alpha": F.round("alpha", PLACES)})
    sure = unit(mixed(("confidence", 0.55), ("reliable", 0.25), ("alpha", 0.20), (unit(F.col("n") / ENOUGH), 0.10)))
    # its terms are short decimals, so that many sums end in a 5 behind PLACES: these are rounded as doubles, not by how they are written
    return found.withColumn("confidence", half_up(sure * 10**PLACES) / 10**PLACES).select("image_id", "region", "x", "y", "radius", "reliable", "alpha", F.struct(*_PROTOTYPE).alias("prototype"))


def _alike(p: dict[str, Column], q: dict[str, Column]) -> dict[str, Column]:
    """How alike a cell p is to a prototype q in each space, and in all of them; 0 without a prototype."""
    far = _distances(p, q)
    allowed = F.greatest(F.lit(0.05), F.greatest(F.lit(0.025), F.sqrt(F.greatest(F.lit(LEAST_VARIANCE), q["variance"])) * 2.5))
    far["light"] = unit(F.abs(p["lum"] - q["lum"]) / allowed)
    out = {k: F.exp(-far[k] * far[k] * SOFTNESS[k]) for k in SPACES}
    every = unit(mixed(*[(out[k], w) for k, w in SPACES.items()]) * (0.72 + q["confidence"] * 0.28))
    return {k: F.coalesce(v, F.lit(0.0)) for k, v in (out | {"all": every}).items()}


def similarities(cells: DataFrame, models: DataFrame, regions: DataFrame) -> DataFrame:
    """cells with fg_rgb, fg_hsv, fg_lab, bg_rgb, bg_hsv, bg_lab, local_fg, all_fg, all_bg: what the classifier (see boundary) takes.

    local_fg weighs the regions by their distance from the cell and by how far they can be trusted; where none is near the nearest one
    counts, and without regions the prototype of the whole foreground. A cell meets one row of its image, which has a bounded
    number of regions.
    """
    its = regions.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("region", "x", "y", "radius", "reliable", "alpha", "prototype"))).alias("regions"))
    model = models.select("image_id", "foreground", "background", "separation").join(its, "image_id", "left")
    rows = with_colors(cells).join(model, "image_id")
    p = {c: F.col(c) for c in ("r", "g", "b", "h", "s", "v", "lab_l", "lab_a", "lab_b", "lum")}
    front, back = _alike(p, _fields(F.col("foreground"))), _alike(p, _fields(F.col("background")))
    rows = rows.withColumns({f"fg_{k}": front[k] for k in ("rgb", "hsv", "lab", "all")} | {f"bg_{k}": back[k] for k in ("rgb", "hsv", "lab", "all")})

    def seen(q: Column) -> Column:
        d = F.sqrt(((F.col("x") - q["x"]) * (F.col("x") - q["x"]) + (F.col("y") - q["y"]) * (F.col("y") - q["y"])).cast("double"))
        d = F.round(d, PLACES)  # the same number that the nearest one is found by
        t = d / F.greatest(F.lit(1), q["radius"])
        near = F.exp(-t * t * 0.65)
        trust = F.greatest(F.lit(0.05), mixed((q["prototype"]["confidence"], 0.50), (q["reliable"], 0.30), (q["alpha"], 0.20)))
        return F.struct(d.alias("d"), (-q["prototype"]["confidence"]).alias("sure"), q["region"].alias("region"), F.when(near >= 0.001, near * trust).otherwise(0.0).alias("w"), _alike(p, _fields(q["prototype"]))["all"].alias("alike"))

    rows = rows.withColumn("seen", F.transform("regions", seen))
    total = lambda f: F.aggregate("seen", F.lit(0.0), lambda s, q: s + f(q))
    weight, nearest = total(lambda q: q["w"]), F.array_min("seen")
    local = F.when(weight > LEAST_VARIANCE, total(lambda q: q["w"] * q["alike"]) / weight).otherwise(nearest["alike"])
    here = F.coalesce(nearest["sure"] < 0, F.lit(False))
    reliable = 0.55 + F.col("separation") * 0.45
    own = F.when(here, local * 0.62 + F.col("fg_all") * 0.38).otherwise(F.col("fg_all"))
    rows = rows.withColumns({"local_fg": unit(unit(own) * reliable), "all_fg": unit(F.col("fg_all") * reliable), "all_bg": F.col("bg_all")})
    named = ("fg_rgb", "fg_hsv", "fg_lab", "bg_rgb", "bg_hsv", "bg_lab", "local_fg", "all_fg", "all_bg")
    return rows.select(*cells.columns, *[F.round(c, PLACES).alias(c) for c in named])
