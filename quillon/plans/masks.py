"""Queries over masks and neighbourhoods of image cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imaging as I
from ..operators import masks as M
from ..operators.boundary import distances
from ..sources.tables import SQL_GRID, derived, given, grid, sql_of


def _counted(cells):
    return cells.groupBy("image_id").agg(F.count_if("mask").alias("foreground"), F.sum(F.when(F.col("mask"), F.col("i") + 1).otherwise(0)).alias("check"))


def mask_dilate(spark, sf):
    return _counted(M.dilated(grid(spark, sf)))


def mask_erode(spark, sf):
    return _counted(M.eroded(grid(spark, sf)))


def mask_without_small_parts(spark, sf):
    return _counted(M.without_small_parts(grid(spark, sf), 0.05))


def mask_filled(spark, sf):
    return _counted(M.filled(grid(spark, sf)))


def mask_parts_by_size(spark, sf):
    """The parts of each mask by the steps to the sides, the largest first."""
    from pyspark.sql import Window as W

    order = W.partitionBy("image_id").orderBy(F.desc("area"), "label")
    return I.components(grid(spark, sf), diagonal=False).select("image_id", "label", "area", F.row_number().over(order).alias("place"))


def mask_support(spark, sf):
    """What a soft mask keeps where a hard one, by another threshold, supports it."""
    soft = F.floor(F.col("lum") * 255)
    return grid(spark, sf).groupBy("image_id").agg(F.count_if(soft >= 100).alias("hard"), F.sum(F.when(soft >= 100, soft).otherwise(0)).alias("kept"))


def mask_distance(spark, sf):
    return distances(grid(spark, sf), "mask", 3).select("image_id", "x", "y", F.round("distance", 6).alias("distance"))


def mask_overlap(spark, sf):
    """How each mask compares with that of the image before."""
    before = grid(spark, sf).withColumn("image_id", F.col("image_id") + 1)
    return M.overlap(grid(spark, sf), before).withColumns({c: F.round(c, 6) for c in ("iou", "size_ratio")})


def pixel_gradient(spark, sf):
    return M.gradients(grid(spark, sf)).select("image_id", "x", "y", F.round("gradient", 6).alias("gradient"))


def local_texture(spark, sf):
    return M.textures(grid(spark, sf)).select("image_id", "x", "y", F.round("texture", 5).alias("texture"))


def robust_color(spark, sf):
    return M.robust_colors(derived(spark, sf, "pixels"))


def closest_clusters(spark, sf):
    """The two labels whose mean vectors are nearest to one another."""
    rows = given(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("j", "x")).groupBy("label", "j").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    centers = rows.groupBy(F.col("label").alias("center")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda p: p["m"]).alias("c"))
    return M.closest_pair(centers)


def mask_boundary(spark, sf):
    return M.boundaries(grid(spark, sf), 8, 8)


def spread_points(spark, sf):
    """Four points of the foreground of each image that are sure and far from one another."""
    return M.spread_points(grid(spark, sf).where("mask").select("image_id", "i", "x", "y", F.round("lum", 6).alias("confidence")), 4, 8, 8)


QUERIES = {f.__name__: f for f in (
    mask_boundary, spread_points, mask_dilate, mask_erode, mask_without_small_parts, mask_filled, mask_parts_by_size, mask_support, mask_distance, mask_overlap, pixel_gradient, local_texture, robust_color, closest_clusters,
)}

_G = "WITH " + SQL_GRID


def _reach(value: str, near: str) -> str:
    return f"""RECURSIVE {SQL_GRID}, cell AS (SELECT image_id, i, x, y FROM grid WHERE {value}), reach(image_id, i, x, y, j) AS (SELECT image_id, i, x, y, i FROM cell UNION
  SELECT b.image_id, b.i, b.x, b.y, a.j FROM reach a JOIN cell b ON a.image_id = b.image_id AND {near}), lab AS (SELECT image_id, i, x, y, min(j) AS label FROM reach GROUP BY ALL)"""


_SIDES, _ALL = "abs(a.x - b.x) + abs(a.y - b.y) <= 1", "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1"
_SUM = "SELECT image_id, count(*) FILTER (WHERE m) AS foreground, CAST(coalesce(sum(i + 1) FILTER (WHERE m), 0) AS bigint) AS \"check\""
#: Where a walk round a mask goes from each cell and each side that it was come from, and the walk itself.
_WALK = f"""RECURSIVE {SQL_GRID}, fg AS (SELECT image_id, i, x, y FROM grid WHERE mask), around(k, dx, dy) AS (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1)),
  go AS (SELECT a.image_id, a.i, d.k AS back, (r.k - d.k + 7) % 8 AS turn, b.i AS to_i, e.k AS to_back FROM fg a JOIN around r ON TRUE JOIN fg b ON b.image_id = a.image_id AND b.x = a.x + r.dx AND b.y = a.y + r.dy JOIN around d ON TRUE
    JOIN around q ON q.k = (r.k + 7) % 8 JOIN around e ON e.dx = q.dx - r.dx AND e.dy = q.dy - r.dy),
  nx AS (SELECT image_id, i, back, arg_min(to_i, turn) AS to_i, arg_min(to_back, turn) AS to_back FROM go GROUP BY 1, 2, 3), st AS (SELECT image_id, min(i) AS i FROM fg GROUP BY 1),
  walk(image_id, n, i, back, start) AS (SELECT image_id, 0, i, 4, i FROM st UNION ALL SELECT w.image_id, w.n + 1, nx.to_i, nx.to_back, w.start FROM walk w JOIN nx ON nx.image_id = w.image_id AND nx.i = w.i AND nx.back = w.back WHERE NOT (nx.to_i = w.start AND nx.to_back = 4) AND w.n < 256)"""


def _spread() -> str:
    out = "c0 AS (SELECT image_id, i, x, y, round(lum, 6) AS c, CAST('inf' AS double) AS near FROM grid WHERE mask), "
    for turn in range(4):
        value = "round(c * 0.66e0 + least(1.0e0, near * 2.5e0) * 0.34e0, 9)" if turn else "c"
        out += f"p{turn} AS (SELECT image_id, i, x, y FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {value} DESC, c DESC, i) AS place FROM c{turn}) WHERE place = 1), "
        out += f"c{turn + 1} AS (SELECT c.image_id, c.i, c.x, c.y, c.c, least(c.near, sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) / sqrt(128)) AS near FROM c{turn} c JOIN p{turn} p ON p.image_id = c.image_id WHERE c.i <> p.i), "
    return out + "z AS (" + " UNION ALL ".join(f"SELECT image_id, {t} AS turn, i, x, y FROM p{t}" for t in range(4)) + ")"


ORACLES = {
    "mask_boundary": f"WITH {_WALK} SELECT w.image_id, w.n AS i, g.x, g.y FROM walk w JOIN grid g ON g.image_id = w.image_id AND g.i = w.i",
    "spread_points": f"{_G}, {_spread()} SELECT * FROM z",
    "mask_dilate": f"{_G}, d AS (SELECT g.image_id, g.i, bool_or(n.mask) AS m FROM grid g JOIN grid n ON n.image_id = g.image_id AND abs(n.x - g.x) <= 1 AND abs(n.y - g.y) <= 1 GROUP BY 1, 2) {_SUM} FROM d GROUP BY 1",
    "mask_erode": f"{_G}, d AS (SELECT g.image_id, g.i, count(*) FILTER (WHERE n.mask) = 9 AS m FROM grid g JOIN grid n ON n.image_id = g.image_id AND abs(n.x - g.x) <= 1 AND abs(n.y - g.y) <= 1 GROUP BY 1, 2) {_SUM} FROM d GROUP BY 1",
    "mask_without_small_parts": f"""WITH {_reach('mask', _ALL)}, c AS (SELECT image_id, label, count(*) AS area FROM lab GROUP BY 1, 2), k AS (SELECT image_id, label FROM (SELECT *, max(area) OVER (PARTITION BY image_id) AS most, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, label) AS place FROM c) WHERE place = 1 OR area >= 3 OR area / most >= 0.035e0),
      d AS (SELECT g.image_id, g.i, k.label IS NOT NULL AS m FROM grid g LEFT JOIN lab USING (image_id, i) LEFT JOIN k ON k.image_id = g.image_id AND k.label = lab.label) {_SUM} FROM d GROUP BY 1""",
    "mask_filled": f"""WITH {_reach('NOT mask', _SIDES)}, o AS (SELECT DISTINCT image_id, label FROM lab WHERE x IN (0, 7) OR y IN (0, 7)), r AS (SELECT image_id, i FROM lab JOIN o USING (image_id, label)),
      d AS (SELECT g.image_id, g.i, r.i IS NULL AS m FROM grid g LEFT JOIN r ON r.image_id = g.image_id AND r.i = g.i) {_SUM} FROM d GROUP BY 1""",
    "mask_parts_by_size": f"WITH {_reach('mask', _SIDES)}, c AS (SELECT image_id, CAST(label AS bigint) AS label, count(*) AS area FROM lab GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY area DESC, label) AS int) AS place FROM c",
    "mask_support": f"{_G} SELECT image_id, count(*) FILTER (WHERE floor(lum * 255) >= 100) AS hard, CAST(coalesce(sum(floor(lum * 255)) FILTER (WHERE floor(lum * 255) >= 100), 0) AS bigint) AS kept FROM grid GROUP BY 1",
    "mask_distance": f"""{_G}, d AS (SELECT g.image_id, g.x, g.y, min(greatest(abs(g.x - s.x), abs(g.y - s.y)) + (sqrt(2) - 1) * least(abs(g.x - s.x), abs(g.y - s.y))) AS d FROM grid g LEFT JOIN grid s ON s.image_id = g.image_id AND s.mask GROUP BY 1, 2, 3) SELECT image_id, x, y, round(least(3.0e0, coalesce(d, 3.0e0)), 6) AS distance FROM d""",
    "mask_overlap": f"""{_G}, s AS (SELECT a.image_id, count(*) FILTER (WHERE a.mask AND b.mask) AS intersection, count(*) FILTER (WHERE a.mask OR b.mask) AS "union", count(*) FILTER (WHERE a.mask) AS n, count(*) FILTER (WHERE b.mask) AS m FROM grid a JOIN grid b ON b.image_id = a.image_id - 1 AND b.i = a.i GROUP BY 1)
      SELECT image_id, intersection, "union", round(CASE WHEN "union" > 0 THEN intersection / "union" ELSE 0 END, 6) AS iou, round(CASE WHEN m > 0 THEN n / m ELSE 1 END, 6) AS size_ratio, m > 0 AND n / m < 0.45 AS collapsed, m > 0 AND n / m > 1.75 AS expanded FROM s""",
    "pixel_gradient": f"""{_G}, a AS (SELECT g.image_id, g.x, g.y, s.lum AS v, sign(CASE WHEN dx = -1 THEN -1 ELSE dx END) AS dx, dy FROM grid g, (SELECT unnest([-1, 0, 1]) AS dx) h, (SELECT unnest([-1, 0, 1]) AS dy) w JOIN grid s ON s.image_id = g.image_id AND s.x = least(7, greatest(0, g.x + dx)) AND s.y = least(7, greatest(0, g.y + dy))),
      p AS (SELECT image_id, x, y, max(v) FILTER (WHERE dx = -1 AND dy = 0) AS l, max(v) FILTER (WHERE dx = 1 AND dy = 0) AS r, max(v) FILTER (WHERE dx = 0 AND dy = -1) AS u, max(v) FILTER (WHERE dx = 0 AND dy = 1) AS d, max(v) FILTER (WHERE dx = -1 AND dy = -1) AS lu, max(v) FILTER (WHERE dx = 1 AND dy = 1) AS rd,
        max(v) FILTER (WHERE dx = 1 AND dy = -1) AS ru, max(v) FILTER (WHERE dx = -1 AND dy = 1) AS ld FROM a GROUP BY 1, 2, 3)
      SELECT image_id, x, y, round(least(1, sqrt((r - l) * (r - l) + (d - u) * (d - u) + 0.5e0 * (rd - lu) * (rd - lu) + 0.5e0 * (ld - ru) * (ld - ru)) / sqrt(3)), 6) AS gradient FROM p""",
    "local_texture": f"{_G} SELECT g.image_id, g.x, g.y, round(least(1, stddev_pop(n.lum) * 4), 5) AS texture FROM grid g JOIN grid n ON n.image_id = g.image_id AND abs(n.x - g.x) <= 1 AND abs(n.y - g.y) <= 1 GROUP BY 1, 2, 3",
    "robust_color": "WITH " + sql_of("pixels") + """, l AS (SELECT image_id, list_sort(list(CAST(r AS double))) AS r, list_sort(list(CAST(g AS double))) AS g, list_sort(list(CAST(b AS double))) AS b, count(*) AS n FROM pixels GROUP BY 1), k AS (SELECT *, CASE WHEN n < 8 THEN 0 ELSE CAST(floor(n * 0.12e0) AS bigint) END AS c FROM l)
      SELECT image_id, """ + ", ".join(f"list_median({c}) * 0.58e0 + list_avg({c}[c + 1 : n - c]) * (1 - 0.58e0) AS {c}" for c in "rgb") + " FROM k",
    "closest_clusters": """WITH e AS (SELECT label, unnest(generate_series(1, len(embedding))) AS j, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, j, round(avg(CAST(x AS double)), 9) AS m FROM e GROUP BY 1, 2)
      SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS distance FROM m a JOIN m b ON a.j = b.j AND a.label < b.label GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 1""",
}
