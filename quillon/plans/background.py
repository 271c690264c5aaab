"""Queries over the background of images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import background as B
from ..sources.shared import kept
from ..sources.tables import SQL_TINTED, tinted


def _cut(df, *columns):
    """Five digits, cut between two values that nine digits can have: both engines cut the same way."""
    return df.withColumns({c: F.floor(F.col(c) * 100000 + 0.00005) / 100000 for c in columns})


def _seeds(spark, sf):
    return kept(B.seeds(tinted(spark, sf)))


def background_seeds(spark, sf):
    """Cells near the border of an image that look like background."""
    return _cut(B.seeds(tinted(spark, sf)), "confidence").select("image_id", "place", "source", "x", "y", "confidence")


def background_clusters(spark, sf):
    """The colours of the background of each image."""
    return _cut(B.color_clusters(_seeds(spark, sf)), "l", "a", "b", "texture", "x", "y", "tolerance")


def background_likeness(spark, sf):
    """How much each cell is like its image's background."""
    return _cut(B.likeness(tinted(spark, sf), kept(B.color_clusters(_seeds(spark, sf)))), "background").select("image_id", "x", "y", "cluster", "background")


QUERIES = {f.__name__: f for f in (background_seeds, background_clusters, background_likeness)}

_FADE = "1 - least(1, {0} / {1}) * least(1, {0} / {1}) * (3 - 2 * least(1, {0} / {1}))".format
#: Images have eight cells a side: the border is two cells wide (a quarter of the side at most), a corner is one cell.
_SEEDS = f"""WITH RECURSIVE {SQL_TINTED},
turned AS (SELECT *, least(x, y, 7 - x, 7 - y) AS edge, CASE WHEN x = 0 AND y = 0 THEN 0 WHEN x = 7 AND y = 0 THEN 1 WHEN x = 7 AND y = 7 THEN 2 WHEN x = 0 AND y = 7 THEN 3
  WHEN y = 0 AND x % 2 = 0 THEN 4 WHEN x = 6 AND y % 2 = 0 THEN 5 WHEN y = 6 AND x % 2 = 0 THEN 6 WHEN x = 0 AND y % 2 = 0 THEN 7 WHEN x % 2 = 0 AND y % 2 = 0 AND alpha <= 0.16 THEN 8 END AS turn FROM tinted),
seeds AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY turn, y, x) AS int) AS place, CASE WHEN turn < 4 THEN 'corner' WHEN turn < 8 THEN 'border' ELSE 'low mask' END AS source, x, y, l, a, b, texture,
  round(0.30e0 * ({_FADE('alpha', '0.34e0')}) + 0.20e0 * ({_FADE('gradient', '0.24e0')}) + 0.14e0 * ({_FADE('texture', '0.22e0')}) + 0.10e0 * (1 - edge / 4.0e0) + 0.12e0
    + 0.14e0 * CASE WHEN turn < 4 THEN 1 WHEN turn < 8 THEN 0.92e0 ELSE 0.82e0 END, 9) AS confidence FROM turned WHERE turn IS NOT NULL AND alpha <= 0.34 AND gradient <= 0.24 AND texture <= 0.22)"""
_SUMS = ("l", "a", "b", "ll", "aa", "bb", "texture", "x", "y")


def _far(p: str, q: str) -> str:
    return "round(sqrt(" + " + ".join(f"({p}.{c} / {p}.n - {q}.{c} / {q}.n) * ({p}.{c} / {p}.n - {q}.{c} / {q}.n)" for c in "lab") + ") / sqrt(3.0e0), 9)"


def _plus(p: str, q: str) -> str:
    return "{" + ", ".join(f"'{c}': {p}.{c} + {q}.{c}" for c in ("n", *_SUMS)) + "}"


_KIND = "STRUCT(n BIGINT, " + ", ".join(f"{c} DOUBLE" for c in _SUMS) + ")[]"
_CLUSTERS = f"""{_SEEDS},
ordered AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, place) AS k, count(*) OVER (PARTITION BY image_id) AS every,
  {{'n': CAST(1 AS BIGINT), 'l': l, 'a': a, 'b': b, 'll': l * l, 'aa': a * a, 'bb': b * b, 'texture': texture, 'x': CAST(x AS DOUBLE), 'y': CAST(y AS DOUBLE)}} AS s FROM seeds),
fold(image_id, k, every, cl) AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT), every, CAST([] AS {_KIND}) FROM ordered
  UNION ALL SELECT image_id, k, every, CASE WHEN len(now) <= 5 THEN now ELSE [CASE WHEN i = m.i THEN {_plus('now[i]', 'now[m.j]')} ELSE now[i] END FOR i IN range(1, len(now) + 1) IF i <> m.j] END
  FROM (SELECT *, list_min(flatten([[{{'d': {_far('now[i]', 'now[j]')}, 'i': i, 'j': j}} FOR j IN range(i + 1, len(now) + 1)] FOR i IN range(1, len(now) + 1)])) AS m
    FROM (SELECT *, CASE WHEN near.d <= 0.115 THEN [CASE WHEN i = near.i THEN {_plus('cl[i]', 's')} ELSE cl[i] END FOR i IN range(1, len(cl) + 1)] ELSE list_append(cl, s) END AS now
      FROM (SELECT f.image_id, o.k, f.every, f.cl, o.s, list_min([{{'d': {_far('f.cl[i]', 'o.s')}, 'i': i}} FOR i IN range(1, len(f.cl) + 1)]) AS near FROM fold f JOIN ordered o ON o.image_id = f.image_id AND o.k = f.k + 1)))),
ends AS (SELECT image_id, every, unnest([{{'i': i, 'c': cl[i]}} FOR i IN range(1, len(cl) + 1)]) AS u FROM fold QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k DESC) = 1),
chosen AS (SELECT *, count(*) FILTER (u.c.n >= greatest(2, floor(every * 0.08e0))) OVER (PARTITION BY image_id) AS large FROM ends),
clusters AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY u.c.n DESC, u.i) - 1 AS INT) AS cluster, u.c.n AS n, {', '.join(f'round(u.c.{c} / u.c.n, 9) AS {c}' for c in ('l', 'a', 'b', 'texture', 'x', 'y'))},
  round(least(0.32e0, greatest(0.07e0, 0.13e0 + 2.1e0 * least(1.0e0, sqrt({' + '.join(f'greatest(0.0e0, u.c.{c}{c} / u.c.n - (u.c.{c} / u.c.n) * (u.c.{c} / u.c.n))' for c in 'lab')}) / sqrt(3.0e0)))), 9) AS tolerance
  FROM chosen WHERE large = 0 OR u.c.n >= greatest(2, floor(every * 0.08e0)))"""
_FIVE = "floor({0} * 100000 + 0.00005e0) / 100000 AS {0}".format

ORACLES = {
    "background_seeds": f"{_SEEDS} SELECT image_id, place, source, x, y, {_FIVE('confidence')} FROM seeds",
    "background_clusters": f"{_CLUSTERS} SELECT image_id, cluster, n, {', '.join(_FIVE(c) for c in ('l', 'a', 'b', 'texture', 'x', 'y', 'tolerance'))} FROM clusters",
    "background_likeness": f"""{_CLUSTERS}, d AS (SELECT t.image_id, t.x, t.y, c.cluster, c.tolerance, round(sqrt((t.l - c.l) * (t.l - c.l) + (t.a - c.a) * (t.a - c.a) + (t.b - c.b) * (t.b - c.b)) / sqrt(3.0e0), 9) AS d FROM tinted t LEFT JOIN clusters c ON c.image_id = t.image_id),
      n AS (SELECT *, coalesce(round({_FADE('d', 'tolerance')}, 9), 0) AS background FROM d QUALIFY row_number() OVER (PARTITION BY image_id, x, y ORDER BY d, cluster) = 1) SELECT image_id, x, y, cluster, {_FIVE('background')} FROM n""",
}
