"""Queries over contours and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes as S
from ..sources.tables import given


def _contours(spark, sf, shift: int = 0):
    """A contour an embedding: its components in pairs, as points in a canvas of two hundred; shifted: that of another one."""
    rows = given(spark, sf, "embeddings").selectExpr(f"vec_id - {shift} AS contour", "embedding AS e")
    at = lambda i: F.round(F.col("e")[i].cast("double") * 100 + 100, 3)
    places = F.sequence(F.lit(0), (F.size("e") / 2).cast("int") - 1)
    return rows.select("contour", F.transform(places, lambda i: S.point(at(i * 2), at(i * 2 + 1))).alias("points"))


def _rounded(c: str, n: int = 4):
    return F.round(c, n).alias(c)


def point_in_polygon(spark, sf):
    """Whether the middle of the canvas is inside each contour, and a point of its own."""
    own = S.point((F.col("contour") % 40) * 5, F.lit(101.0))
    return _contours(spark, sf).select("contour", S.inside(S.point(F.lit(100.0), F.lit(100.0)), F.col("points")).alias("middle"), S.inside(own, F.col("points")).alias("own"))


def nearest_contour_point(spark, sf):
    rows = _contours(spark, sf)
    asked = rows.select("contour", S.point((F.col("contour") % 40) * 5, F.lit(101.0)).alias("p"))
    return S.nearest_points(asked, rows).select("contour", "seg", _rounded("x"), _rounded("y"), _rounded("distance"))


def contour_spread(spark, sf):
    """Points of a contour that stay when each has to be ten away from the one kept before."""
    kept = S.spread(F.col("points"), 10.0)
    return _contours(spark, sf).select("contour", F.size(kept).alias("kept"), F.round(F.aggregate(kept, F.lit(0.0), lambda a, p: a + p["x"] - p["y"]), 3).alias("check"))


def contour_resample(spark, sf):
    return S.resampled(_contours(spark, sf), 16).select("contour", "i", _rounded("x"), _rounded("y"))


def contour_order(spark, sf):
    """Sixteen samples of each contour, clockwise from the leftmost one."""
    return S.oriented(S.resampled(_contours(spark, sf), 16), 16).select("contour", "i", _rounded("x"), _rounded("y"))


def contour_similarity(spark, sf):
    """How alike each contour and the next one are."""
    return S.similarity(_contours(spark, sf), _contours(spark, sf, 1)).select("contour", *[_rounded(c) for c in ("average", "most", "least", "similarity")])


def contour_smooth(spark, sf):
    points = S.smoothed(F.col("points"))
    return _contours(spark, sf).select("contour", F.size(points).alias("n"), F.round(F.aggregate(points, F.lit(0.0), lambda a, p: a + p["x"] * 2 - p["y"]), 3).alias("check"))


def contour_simplify(spark, sf):
    return S.simplified(_contours(spark, sf), 20.0).select("contour", "kept", F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"] - p["y"]), 3).alias("check"))


def contour_paths(spark, sf):
    return _contours(spark, sf).select("contour", S.path_text(F.slice("points", 1, 3)).alias("path"))


def contour_moves(spark, sf):
    """The first point of each contour turned, stretched and mapped from the canvas into a box, and the middle of a curve."""
    p = [F.col("points")[i] for i in range(4)]
    turned, wide, mid = S.rotated(p[0], 30, 100, 100), S.scaled(p[0], 2, 0.5, 100, 100), S.curve(*p, F.lit(0.25))
    boxed = S.point(p[0]["x"] / 200 * 50 + 10, p[0]["y"] / 200 * 20 + 5)
    return _contours(spark, sf).select("contour", *[F.round(q[c], 9).alias(f"{n}_{c}") for n, q in (("turned", turned), ("wide", wide), ("curve", mid), ("boxed", boxed)) for c in "xy"])


def _boxes(spark, sf):
    return given(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey % 50 AS x", "l_suppkey % 40 AS y", "1 + l_partkey % 7 AS w", "1 + l_suppkey % 9 AS h")


def box_relations(spark, sf):
    """Boxes against one in the middle: whether they meet it and whether their corner is in it, with two to spare."""
    meets = ~((F.col("x") + F.col("w") < 20) | (F.lit(30) < F.col("x")) | (F.col("y") + F.col("h") < 15) | (F.lit(25) < F.col("y")))
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", "x", "y", meets.alias("meets"), (F.col("x").between(18, 32) & F.col("y").between(13, 27)).alias("corner_inside"))


def box_union(spark, sf):
    return _boxes(spark, sf).groupBy("l_orderkey").agg(*S.merged("x", "y", "w", "h"))


QUERIES = {f.__name__: f for f in (
    point_in_polygon, nearest_contour_point, contour_spread, contour_resample, contour_order, contour_similarity, contour_smooth, contour_simplify, contour_paths, contour_moves, box_relations, box_union,
)}


def _points(shift: int = 0, name: str = "p") -> str:
    return f"""{name} AS (SELECT vec_id - {shift} AS contour, i, round(CAST(embedding[2 * i + 1] AS double) * 100 + 100, 3) AS x, round(CAST(embedding[2 * i + 2] AS double) * 100 + 100, 3) AS y, len(embedding) // 2 AS n
      FROM (SELECT vec_id, embedding, unnest(generate_series(0, len(embedding) // 2 - 1)) AS i FROM embeddings))"""


def _sides(of: str, name: str) -> str:
    return f"{name} AS (SELECT a.contour, a.i, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM {of} a JOIN {of} b ON b.contour = a.contour AND b.i = (a.i + 1) % a.n)"


def _samples(of: str, name: str, count: int) -> str:
    """By looking for the segment of each sample, the other way round than the query does."""
    return f"""{name}_l AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM {of}), {name}_c AS (SELECT *, sum(len) OVER (PARTITION BY contour ORDER BY i ROWS UNBOUNDED PRECEDING) AS hi, sum(len) OVER (PARTITION BY contour) AS total FROM {name}_l WHERE len > 1e-6),
      {name}_k AS (SELECT DISTINCT contour, total, unnest(generate_series(0, {count - 1})) AS k FROM {name}_c),
      {name} AS (SELECT contour, k AS i, {count} AS n, x0 + (x1 - x0) * t AS x, y0 + (y1 - y0) * t AS y FROM (SELECT c.*, k.k, row_number() OVER (PARTITION BY c.contour, k.k ORDER BY c.i) AS turn, least(1.0e0, greatest(0.0e0, (k.k / {count}.0e0 * c.total - (c.hi - c.len)) / c.len)) AS t
        FROM {name}_c c JOIN {name}_k k ON k.contour = c.contour AND round(c.hi / c.total * {count}, 9) >= k.k) WHERE turn = 1)"""


def _oriented(of: str, name: str, count: int) -> str:
    return f"""{name}_r AS (SELECT contour, i, n, round(x, 9) AS x, round(y, 9) AS y FROM {of}), {_sides(f'{name}_r', f'{name}_s')}, {name}_a AS (SELECT contour, sum(x0 * y1 - x1 * y0) AS area FROM {name}_s GROUP BY 1),
      {name}_f AS (SELECT contour, i AS start FROM (SELECT *, row_number() OVER (PARTITION BY contour ORDER BY x, y, i) AS turn FROM {name}_r) WHERE turn = 1),
      {name} AS (SELECT r.contour, CASE WHEN area > 0 THEN (r.i - start + {count}) % {count} ELSE (start - r.i + {count}) % {count} END AS i, x, y FROM {name}_r r JOIN {name}_a USING (contour) JOIN {name}_f USING (contour))"""


def _unit(of: str, name: str) -> str:
    return f"{name} AS (SELECT contour, i, n, (x - min(x) OVER w) / greatest(1e-6, max(x) OVER w - min(x) OVER w) AS x, (y - min(y) OVER w) / greatest(1e-6, max(y) OVER w - min(y) OVER w) AS y FROM {of} WINDOW w AS (PARTITION BY contour))"


_P = "WITH " + _points()
_CROSS = "(y1 > {y}) <> (y0 > {y}) AND {x} < (x0 - x1) * ({y} - y1) / (y0 - y1 + 1e-6) + x1"
ORACLES = {
    "point_in_polygon": f"{_P}, {_sides('p', 's')} SELECT contour, count(*) FILTER (WHERE {_CROSS.format(x='100', y='100')}) % 2 = 1 AS middle, count(*) FILTER (WHERE {_CROSS.format(x='(contour % 40) * 5', y='101')}) % 2 = 1 AS own FROM s GROUP BY 1",
    "nearest_contour_point": f"""{_P}, {_sides('p', 's')}, t AS (SELECT *, (contour % 40) * 5.0e0 AS px, 101.0e0 AS py, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS q FROM s), u AS (SELECT *, CASE WHEN q <= 1e-6 THEN 0.0e0 ELSE least(1.0e0, greatest(0.0e0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / q)) END AS t FROM t),
      v AS (SELECT *, x0 + (x1 - x0) * t AS x, y0 + (y1 - y0) * t AS y FROM u), d AS (SELECT *, round(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 9) AS distance FROM v)
      SELECT contour, CAST(i AS int) AS seg, round(x, 4) AS x, round(y, 4) AS y, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY contour ORDER BY distance, i) AS turn FROM d) WHERE turn = 1""",
    "contour_spread": f"""WITH RECURSIVE {_points()}, k(contour, i, n, lx, ly, fx, fy, kept, s) AS (SELECT contour, i, n, x, y, x, y, 1, x - y FROM p WHERE i = 0 UNION ALL
      SELECT k.contour, p.i, k.n, CASE WHEN f THEN p.x ELSE k.lx END, CASE WHEN f THEN p.y ELSE k.ly END, k.fx, k.fy, k.kept + CASE WHEN f THEN 1 ELSE 0 END, k.s + CASE WHEN f THEN p.x - p.y ELSE 0 END
      FROM k JOIN p ON p.contour = k.contour AND p.i = k.i + 1, LATERAL (SELECT sqrt((p.x - k.lx) * (p.x - k.lx) + (p.y - k.ly) * (p.y - k.ly)) >= 10 AS f)), e AS (SELECT *, kept > 2 AND sqrt((lx - fx) * (lx - fx) + (ly - fy) * (ly - fy)) < 10 AS drop FROM k WHERE i = n - 1)
      SELECT contour, kept - CASE WHEN drop THEN 1 ELSE 0 END AS kept, round(s - CASE WHEN drop THEN lx - ly ELSE 0 END, 3) AS check FROM e""".replace("AS drop", "AS dropped").replace("WHEN drop ", "WHEN dropped ").replace("AS check", 'AS "check"'),
    "contour_resample": f"{_P}, {_sides('p', 's')}, {_samples('s', 'r', 16)} SELECT contour, CAST(i AS int) AS i, round(x, 4) AS x, round(y, 4) AS y FROM r",
    "contour_order": f"{_P}, {_sides('p', 's')}, {_samples('s', 'r', 16)}, {_oriented('r', 'o', 16)} SELECT contour, CAST(i AS int) AS i, round(x, 4) AS x, round(y, 4) AS y FROM o",
    "contour_similarity": f"""{_P}, {_points(1, 'p2')}, {_unit('p', 'u')}, {_unit('p2', 'u2')}, {_sides('u', 's')}, {_sides('u2', 's2')}, {_samples('s', 'r', 96)}, {_samples('s2', 'r2', 96)}, {_oriented('r', 'o', 96)}, {_oriented('r2', 'o2', 96)},
      d AS (SELECT o.contour, sqrt((o.x - o2.x) * (o.x - o2.x) + (o.y - o2.y) * (o.y - o2.y)) AS d FROM o JOIN o2 USING (contour, i))
      SELECT contour, round(avg(d), 4) AS average, round(max(d), 4) AS most, round(min(d), 4) AS least, round(least(1, greatest(0, 1 - avg(d) / sqrt(2))), 4) AS similarity FROM d GROUP BY 1""",
    "contour_smooth": f"{_P}, {_sides('p', 's')} SELECT contour, CAST(2 * count(*) AS int) AS n, round(sum(2 * (x0 + x1) - (y0 + y1)), 3) AS \"check\" FROM s GROUP BY 1",
    "contour_paths": f"{_P} SELECT contour, 'M ' || string_agg(regexp_replace(regexp_replace(printf('%.2f', round(x * 100) / 100), '0+$', ''), '\\.$', '') || ' ' || regexp_replace(regexp_replace(printf('%.2f', round(y * 100) / 100), '0+$', ''), '\\.$', ''), ' L ' ORDER BY i) || ' Z' AS path FROM p WHERE i < 3 GROUP BY 1",
    "contour_moves": f"""{_P}, q AS (SELECT contour, max(x) FILTER (WHERE i = 0) AS x0, max(y) FILTER (WHERE i = 0) AS y0, sum(x * CASE i WHEN 0 THEN 27 WHEN 1 THEN 27 WHEN 2 THEN 9 ELSE 1 END) / 64 AS cx, sum(y * CASE i WHEN 0 THEN 27 WHEN 1 THEN 27 WHEN 2 THEN 9 ELSE 1 END) / 64 AS cy FROM p WHERE i < 4 GROUP BY 1)
      SELECT contour, round((x0 - 100) * cos(radians(30)) - (y0 - 100) * 0.5e0 + 100, 9) AS turned_x, round((x0 - 100) * 0.5e0 + (y0 - 100) * cos(radians(30)) + 100, 9) AS turned_y, round((x0 - 100) * 2 + 100, 9) AS wide_x, round((y0 - 100) / 2 + 100, 9) AS wide_y, round(cx, 9) AS curve_x, round(cy, 9) AS curve_y,
      round(x0 / 4 + 10, 9) AS boxed_x, round(y0 / 10 + 5, 9) AS boxed_y FROM q""",
    "box_relations": "WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS x, l_suppkey % 40 AS y, 1 + l_partkey % 7 AS w, 1 + l_suppkey % 9 AS h FROM lineitem) SELECT l_orderkey, l_linenumber, x, y, x + w >= 20 AND x <= 30 AND y + h >= 15 AND y <= 25 AS meets, x >= 18 AND x <= 32 AND y >= 13 AND y <= 27 AS corner_inside FROM b",
    "box_union": "WITH b AS (SELECT l_orderkey, l_partkey % 50 AS x, l_suppkey % 40 AS y, 1 + l_partkey % 7 AS w, 1 + l_suppkey % 9 AS h FROM lineitem) SELECT l_orderkey, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM b GROUP BY 1",
}
