"""Queries over image cells, contours and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imaging as I
from ..sources.tables import SQL_GRID, given, grid


def quality_brightness(spark, sf):
    return I.brightness(grid(spark, sf))


def quality_percentiles(spark, sf):
    return I.percentiles(grid(spark, sf))


def value_statistics(spark, sf):
    """Mean, variance and deviation of the whole, and the median, of the finite values; with fewer than two they don't vary."""
    v = F.col("lum")
    many = F.count("*") > 1
    return grid(spark, sf).where(~F.isnan(v)).groupBy("image_id").agg(I.r6(F.avg(v)).alias("mean"), I.r6(F.when(many, F.var_pop(v)).otherwise(0.0)).alias("variance"), I.r6(F.when(many, F.stddev_pop(v)).otherwise(0.0)).alias("deviation"), I.r6(F.median(v)).alias("median"))


def quality_contrast(spark, sf):
    return I.contrast(grid(spark, sf))


def quality_laplacian(spark, sf):
    return I.laplacian(grid(spark, sf))


def quality_sobel(spark, sf):
    return I.sobel(grid(spark, sf))


def box_blur(spark, sf):
    return I.box_blur(grid(spark, sf), 2, 8, 8)


def integral_sum(spark, sf):
    return I.integral(grid(spark, sf))


def histogram_256(spark, sf):
    return I.histogram(grid(spark, sf))


def otsu_threshold(spark, sf):
    return I.otsu(I.histogram(grid(spark, sf)))


def adaptive_threshold(spark, sf):
    return I.adaptive_threshold(grid(spark, sf))


def mask_metrics(spark, sf):
    return I.mask_metrics(grid(spark, sf), 8, 8)


def mask_components(spark, sf):
    return I.components(grid(spark, sf))


def mask_holes(spark, sf):
    return I.holes(grid(spark, sf))


def quality_decision(spark, sf):
    cells = grid(spark, sf)
    rows = I.contrast(cells).join(I.mask_metrics(cells, 8, 8), "image_id")
    rows = rows.select("image_id", "score", (F.col("foreground") == 0).alias("missing_foreground"), ((F.col("top") > 0.5).cast("int") + (F.col("left") > 0.5).cast("int")).alias("issues"))
    return I.decision(rows)


def _points(spark, sf):
    rows = given(spark, sf, "embeddings").selectExpr("vec_id AS polygon", "posexplode(embedding) AS (j, v)")
    pair = rows.groupBy("polygon", F.floor(F.col("j") / 2).alias("i")).agg(F.max(F.when(F.col("j") % 2 == 0, F.col("v"))).cast("double").alias("x"), F.max(F.when(F.col("j") % 2 == 1, F.col("v"))).cast("double").alias("y"))
    return pair


def polygon_metrics(spark, sf):
    return I.polygon_metrics(_points(spark, sf))


def bounds_iou(spark, sf):
    """Boxes of the foreground of each image and the next one."""
    box = I.mask_metrics(grid(spark, sf), 8, 8).where("foreground > 0").selectExpr("image_id", "CAST(min_x AS double) AS x", "CAST(min_y AS double) AS y", "CAST(max_x - min_x + 1 AS double) AS w", "CAST(max_y - min_y + 1 AS double) AS h")
    one = box.selectExpr("image_id", "x AS x1", "y AS y1", "w AS w1", "h AS h1")
    two = box.selectExpr("image_id - 1 AS image_id", "x AS x2", "y AS y2", "w AS w2", "h AS h2")
    return I.box_overlap(one.join(two, "image_id")).select("image_id", "intersection", "iou")


def nearest_cluster(spark, sf):
    rows = given(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    parts = rows.select("label", F.posexplode("v").alias("j", "x")).groupBy("label", "j").agg(F.round(F.avg("x"), 9).alias("m"))
    centers = parts.groupBy(F.col("label").alias("center")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("c"))
    return I.nearest_center(rows.select("id", "v"), centers, 1.05)


QUERIES = {f.__name__: f for f in (
    value_statistics, quality_brightness, quality_percentiles, quality_contrast, quality_laplacian, quality_sobel, box_blur, integral_sum, histogram_256, otsu_threshold, adaptive_threshold, mask_metrics, mask_components, mask_holes,
    quality_decision, polygon_metrics, bounds_iou, nearest_cluster,
)}

_G = "WITH " + SQL_GRID
_CONTRAST = """nb AS (SELECT *, abs(lead(lum) OVER (PARTITION BY image_id, y ORDER BY x) - lum) AS rt, abs(lead(lum) OVER (PARTITION BY image_id, x ORDER BY y) - lum) AS bl FROM grid),
  c0 AS (SELECT image_id, stddev_pop(lum) AS d, quantile_cont(lum, 0.9) - quantile_cont(lum, 0.1) AS r, (coalesce(sum(rt), 0) + coalesce(sum(bl), 0)) / greatest(1, count(rt) + count(bl)) AS l FROM nb GROUP BY 1),
  contrast AS (SELECT image_id, round(d, 6) AS deviation, round(r, 6) AS percentile_range, round(l, 6) AS local_contrast, round(least(1, d / 0.055e0) * 0.40e0 + least(1, r / 0.18e0) * 0.25e0 + least(1, l / 0.035e0) * 0.35e0, 6) AS score FROM c0)"""
_NEAR = """s AS (SELECT *, lag(lum) OVER w AS l, lead(lum) OVER w AS r FROM grid WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
  n AS (SELECT *, lag(l) OVER w AS ul, lag(lum) OVER w AS u, lag(r) OVER w AS ur, lead(l) OVER w AS dl, lead(lum) OVER w AS d, lead(r) OVER w AS dr FROM s WINDOW w AS (PARTITION BY image_id, x ORDER BY y)),
  inside AS (SELECT * FROM n WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6)"""
_MASK = """mask AS (SELECT image_id, count(*) FILTER (WHERE mask) AS foreground, round(count(*) FILTER (WHERE mask) / count(*), 6) AS foreground_ratio, min(x) FILTER (WHERE mask) AS min_x, max(x) FILTER (WHERE mask) AS max_x, min(y) FILTER (WHERE mask) AS min_y,
  max(y) FILTER (WHERE mask) AS max_y, count(*) FILTER (WHERE mask AND y = 0) / 8 AS top, count(*) FILTER (WHERE mask AND y = 7) / 8 AS bottom, count(*) FILTER (WHERE mask AND x = 0) / 8 AS left, count(*) FILTER (WHERE mask AND x = 7) / 8 AS right FROM grid GROUP BY 1)""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"')
_HIST = "hist AS (SELECT image_id, CAST(least(255, floor(lum * 255)) AS int) AS bin, count(*) AS n FROM grid GROUP BY 1, 2)"
_OTSU = """o0 AS (SELECT image_id, bin, sum(n) OVER u AS w, sum(n * bin) OVER u AS s, sum(n) OVER a AS wt, sum(n * bin) OVER a AS st FROM hist WINDOW u AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY image_id)),
  o1 AS (SELECT image_id, bin, round(w * (wt - w) * pow(CAST(s AS double) / w - CAST(st - s AS double) / (wt - w), 2), 6) AS v FROM o0 WHERE w < wt), o2 AS (SELECT image_id, bin, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, bin) AS place FROM o1),
  otsu AS (SELECT i.image_id, coalesce(o2.bin, 128) AS otsu_bin FROM (SELECT DISTINCT image_id FROM grid) i LEFT JOIN o2 ON o2.image_id = i.image_id AND place = 1)"""


def _components(value: str, diagonal: bool) -> str:
    near = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1" if diagonal else "abs(a.x - b.x) + abs(a.y - b.y) <= 1"
    return f"""RECURSIVE {SQL_GRID}, cell AS (SELECT image_id, i, x, y FROM grid WHERE {value}), reach(image_id, i, x, y, j) AS (SELECT image_id, i, x, y, i FROM cell UNION
  SELECT b.image_id, b.i, b.x, b.y, a.j FROM reach a JOIN cell b ON a.image_id = b.image_id AND {near}), lab AS (SELECT image_id, i, x, y, min(j) AS label FROM reach GROUP BY ALL),
  comp AS (SELECT image_id, CAST(label AS bigint) AS label, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(x) = 0 OR min(y) = 0 OR max(x) = 7 OR max(y) = 7 AS edge FROM lab GROUP BY image_id, label)"""


ORACLES = {
    "value_statistics": _G + " SELECT image_id, round(avg(lum), 6) AS mean, round(var_pop(lum), 6) AS variance, round(stddev_pop(lum), 6) AS deviation, round(median(lum), 6) AS median FROM grid GROUP BY 1",
    "quality_brightness": _G + """ SELECT image_id, round(avg(lum), 6) AS mean, round(quantile_cont(lum, 0.5), 6) AS median, round(min(lum), 6) AS minimum, round(max(lum), 6) AS maximum, round(count(*) FILTER (WHERE lum <= 0.12e0) / count(*), 6) AS dark_ratio,
      round(count(*) FILTER (WHERE lum >= 0.9e0) / count(*), 6) AS bright_ratio, round(count(*) FILTER (WHERE lum <= 0.015e0) / count(*), 6) AS clipped_black_ratio, round(count(*) FILTER (WHERE lum >= 0.985e0) / count(*), 6) AS clipped_white_ratio,
      round(quantile_cont(lum, 0.95) - quantile_cont(lum, 0.05), 6) AS dynamic_range FROM grid GROUP BY 1""",
    "quality_percentiles": _G + " SELECT image_id, " + ", ".join(f"round(quantile_cont(lum, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90)) + ", round(stddev_pop(lum), 6) AS deviation FROM grid GROUP BY 1",
    "quality_contrast": f"{_G}, {_CONTRAST} SELECT * FROM contrast",
    "quality_laplacian": f"{_G}, {_NEAR}, e AS (SELECT image_id, u + d + l + r - lum * 4 AS e FROM inside) SELECT image_id, round(greatest(0, avg(e * e) - avg(e) * avg(e)), 6) AS variance FROM e GROUP BY 1",
    "quality_sobel": f"""{_G}, {_NEAR}, g AS (SELECT image_id, ur - ul + (r - l) * 2 + dr - dl AS gx, dl - ul + (d - u) * 2 + dr - ur AS gy FROM inside), m AS (SELECT image_id, round(least(1, sqrt(gx * gx + gy * gy) / 4), 12) AS m FROM g)
      SELECT image_id, round(avg(m), 6) AS edge_strength, round(count(*) FILTER (WHERE m >= 0.12e0) / count(*), 6) AS edge_density FROM m GROUP BY 1""",
    "box_blur": _G + """, k AS (SELECT unnest(generate_series(-2, 2)) AS k), a AS (SELECT g.image_id, g.x, g.y, avg(s.lum) AS v FROM grid g, k JOIN grid s ON s.image_id = g.image_id AND s.y = g.y AND s.x = least(7, greatest(0, g.x + k.k)) GROUP BY 1, 2, 3)
      SELECT g.image_id, g.x, g.y, round(avg(s.v), 6) AS blurred FROM a g, k JOIN a s ON s.image_id = g.image_id AND s.x = g.x AND s.y = least(7, greatest(0, g.y + k.k)) GROUP BY 1, 2, 3""",
    "integral_sum": _G + " SELECT g.image_id, g.x, g.y, round(sum(s.lum), 6) AS total FROM grid g JOIN grid s ON s.image_id = g.image_id AND s.x <= g.x AND s.y <= g.y GROUP BY 1, 2, 3",
    "histogram_256": f"{_G}, {_HIST} SELECT * FROM hist",
    "otsu_threshold": f"{_G}, {_HIST}, {_OTSU} SELECT * FROM otsu",
    "adaptive_threshold": f"""{_G}, {_HIST}, {_OTSU}, t AS (SELECT image_id, least(0.72e0, greatest(0.28e0, 0.5e0 + (otsu_bin / 255.0e0 - 0.5e0) * 0.58e0)) AS t FROM otsu), f AS (SELECT image_id, t, count(*) FILTER (WHERE lum >= t) / count(*) AS s FROM grid JOIN t USING (image_id) GROUP BY 1, 2),
      m AS (SELECT image_id, CASE WHEN s < {I.LEAST_SHARE}e0 THEN greatest(0.28e0, t - 0.08e0) WHEN s > {I.MOST_SHARE}e0 THEN least(0.72e0, t + 0.08e0) ELSE t END AS threshold FROM f)
      SELECT image_id, round(threshold, 6) AS threshold, round(count(*) FILTER (WHERE lum >= threshold) / count(*), 6) AS foreground_ratio FROM grid JOIN m USING (image_id) GROUP BY image_id, m.threshold""",
    "mask_metrics": f"{_G}, {_MASK} SELECT * FROM mask",
    "mask_components": f"WITH {_components('mask', True)} SELECT * FROM comp",
    "mask_holes": f"WITH {_components('NOT mask', False)} SELECT image_id, count(*) AS holes, CAST(sum(area) AS bigint) AS hole_cells FROM comp WHERE NOT edge GROUP BY 1",
    "quality_decision": f"""{_G}, {_CONTRAST}, {_MASK}, q AS (SELECT image_id, score, foreground = 0 AS missing_foreground, CAST(top > 0.5e0 AS int) + CAST("left" > 0.5e0 AS int) AS issues FROM contrast JOIN mask USING (image_id))
      SELECT *, CASE WHEN missing_foreground THEN 'retry' WHEN score >= 0.78e0 THEN CASE WHEN issues > 0 THEN 'accept-with-warning' ELSE 'accept' END WHEN score >= 0.66e0 THEN 'accept-with-warning' WHEN score >= 0.48e0 THEN 'retry' ELSE 'reject' END AS decision FROM q""",
    "polygon_metrics": """WITH j AS (SELECT vec_id AS polygon, unnest(generate_series(0, len(embedding) // 2 - 1)) AS i, embedding AS e FROM embeddings), p AS (SELECT polygon, i, CAST(e[2 * i + 1] AS double) AS x, CAST(e[2 * i + 2] AS double) AS y, CAST(e[2 * ((i + 1) % (len(e) // 2)) + 1] AS double) AS x2,
      CAST(e[2 * ((i + 1) % (len(e) // 2)) + 2] AS double) AS y2 FROM j), s AS (SELECT polygon, sum(x * y2 - x2 * y) AS c, sum((x + x2) * (x * y2 - x2 * y)) AS cx, sum((y + y2) * (x * y2 - x2 * y)) AS cy, sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) AS p,
      min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY 1)
      SELECT polygon, round(abs(c) / 2, 6) AS area, round(p, 6) AS perimeter, round(CASE WHEN abs(c) <= 1e-9 THEN (x0 + x1) / 2 ELSE cx / (c * 3) END, 4) AS centre_x, round(CASE WHEN abs(c) <= 1e-9 THEN (y0 + y1) / 2 ELSE cy / (c * 3) END, 4) AS centre_y,
      round(CASE WHEN p <= 1e-9 THEN 0 ELSE least(1, abs(c) / 2 * 4 * pi() / (p * p)) END, 6) AS roundness FROM s""",
    "bounds_iou": f"""{_G}, {_MASK}, b AS (SELECT image_id, min_x AS x, min_y AS y, max_x - min_x + 1 AS w, max_y - min_y + 1 AS h FROM mask WHERE foreground > 0),
      p AS (SELECT a.image_id, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s FROM b a JOIN b ON b.image_id = a.image_id + 1)
      SELECT image_id, CAST(i AS double) AS intersection, round(CAST(i AS double) / (s - i), 6) AS iou FROM p""",
    "nearest_cluster": """WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS double)) AS v FROM embeddings), e AS (SELECT label, unnest(generate_series(1, len(v))) AS j, unnest(v) AS x FROM v), m AS (SELECT label, j, round(avg(x), 9) AS m FROM e GROUP BY 1, 2),
      c AS (SELECT label AS center, list(m ORDER BY j) AS c FROM m GROUP BY 1), d AS (SELECT id, center, round(list_distance(v, c), 6) AS distance FROM v, c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, center) AS place FROM d) SELECT id, center, distance FROM r WHERE place = 1 AND distance < 1.05e0""",
}
