"""Queries over the colour model of what an image shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boundary as B
from ..operators import foreground as M
from ..sources.shared import kept
from ..sources.tables import SQL_TINTED, soft_grid, tinted
from .boundary import _BASE, _CLASSES, _vote

#: The images are small: every sample counts, and two make a region.
DEPTH, SAMPLES = 0.0, 2


def _cut(df, *columns):
    """Five digits, cut between two values that nine digits can have: both engines cut the same way."""
    return df.withColumns({c: F.floor(F.col(c) * 100000 + 0.00005) / 100000 for c in columns})


def _cells(spark, sf):
    colors = tinted(spark, sf).selectExpr("image_id", "x", "y", "l AS r", "a AS g", "b")
    rows = B.features(soft_grid(spark, sf)).select("image_id", "x", "y", "alpha", "lum", "main", "boundary_distance")
    return kept(rows.join(colors, ["image_id", "x", "y"]))


def foreground_prototypes(spark, sf):
    """The colours of the foreground and the background of each image, and how far apart they are."""
    rows = kept(M.prototypes(_cells(spark, sf), DEPTH))
    flat = [F.col(f"{name}.{c}").alias(f"{name[:4]}_{c}") for name in ("foreground", "background") for c in ("n", "r", "h", "lab_l", "variance", "confidence")]
    numbers = [f"{n}_{c}" for n in ("fore", "back") for c in ("r", "h", "lab_l", "variance", "confidence")]
    return _cut(rows.select("image_id", *flat, "separation", "usable", "radius"), *numbers, "separation")


def foreground_regions(spark, sf):
    """The regions of each image's foreground."""
    cells = _cells(spark, sf)
    models = kept(M.prototypes(cells, DEPTH))
    rows = M.regions_of(cells, models, M.region_seeds(cells, models, DEPTH), DEPTH, SAMPLES)
    return _cut(rows.select("image_id", "region", "x", "y", F.col("prototype.n").alias("n"), "reliable", "alpha", F.col("prototype.confidence").alias("confidence")), "reliable", "alpha", "confidence")


def foreground_similarity(spark, sf):
    """How alike each cell is to its image's foreground, as a whole and nearby, and to its background."""
    cells = _cells(spark, sf)
    models = kept(M.prototypes(cells, DEPTH))
    regions = kept(M.regions_of(cells, models, M.region_seeds(cells, models, DEPTH), DEPTH, SAMPLES))
    names = ("fg_rgb", "fg_hsv", "fg_lab", "bg_rgb", "bg_hsv", "bg_lab", "local_fg", "all_fg", "all_bg")
    return _cut(M.similarities(cells, models, regions), *names).select("image_id", "x", "y", *names)


def refined_masks(spark, sf):
    """The whole way: features of the edge, the colour model of what is inside, classes by both, and two votes of the neighbours."""
    colors = tinted(spark, sf).selectExpr("image_id", "x", "y", "l AS r", "a AS g", "b")
    plain = soft_grid(spark, sf).select("image_id", "x", "y", "alpha", "lum", "gradient", "direction", "touches")
    cells = kept(B.features(plain).join(colors, ["image_id", "x", "y"]))
    models = kept(M.prototypes(cells, DEPTH))
    regions = kept(M.regions_of(cells, models, M.region_seeds(cells, models, DEPTH), DEPTH, SAMPLES))
    classes = B.classified(M.similarities(cells, models, regions)).withColumn("alpha", F.col("refined"))
    rows, _ = B.voted(kept(classes.select("image_id", "x", "y", "alpha", "class", "confidence", "active", "main", "continuity", "support", "agreement")), cut=kept)
    return _cut(rows, "alpha", "confidence").select("image_id", "x", "y", "class", "alpha", "confidence")


QUERIES = {f.__name__: f for f in (foreground_prototypes, foreground_regions, foreground_similarity, refined_masks)}

_U = "least(1.0e0, greatest(0.0e0, {}))".format
_FIVE = "floor({0} * 100000 + 0.00005e0) / 100000 AS {0}".format


def _colored(source: str, name: str) -> str:
    """The table `source` with h, s, v and the lightness and opponent values of its r, g and b."""
    line = lambda c: f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92e0 ELSE pow(({c} + 0.055e0) / 1.055e0, 2.4e0) END"
    return f"""{name}1 AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS dl, {line('r')} AS lr, {line('g')} AS lg, {line('b')} AS lb FROM {source}),
{name}2 AS (SELECT *, CASE WHEN dl = 0 THEN 0 WHEN mx = r THEN (g - b) / dl WHEN mx = g THEN (b - r) / dl + 2 ELSE (r - g) / dl + 4 END / 6 AS hue,
  [CASE WHEN q > 0.008856e0 THEN cbrt(q) ELSE q * 7.787e0 + 16 / 116.0e0 END FOR q IN [(lr * 0.4124564e0 + lg * 0.3575761e0 + lb * 0.1804375e0) / 0.95047e0, lr * 0.2126729e0 + lg * 0.7151522e0 + lb * 0.0721750e0, (lr * 0.0193339e0 + lg * 0.1191920e0 + lb * 0.9503041e0) / 1.08883e0]] AS f FROM {name}1),
{name} AS (SELECT * EXCLUDE (mx, dl, lr, lg, lb, hue, f), round(CASE WHEN hue < 0 THEN hue + 1 ELSE hue END, 9) AS h, round(CASE WHEN mx = 0 THEN 0 ELSE dl / mx END, 9) AS s, round(mx, 9) AS v, round({_U('(f[2] * 116 - 16) / 100')}, 9) AS lab_l,
  round(least(1, greatest(-1, (f[1] - f[2]) * 500 / 128)), 9) AS lab_a, round(least(1, greatest(-1, (f[2] - f[3]) * 200 / 128)), 9) AS lab_b FROM {name}2)"""


def _prototype(name: str, source: str, keys: str, where: str, more: str = "", having: str = "n > 0") -> str:
    """A prototype of the cells of `source` for each of `keys`."""
    return f"""{name}0 AS (SELECT {keys}, count(*) FILTER ({where}) AS n, round(avg(r) FILTER ({where}), 9) AS r, round(avg(g) FILTER ({where}), 9) AS g, round(avg(b) FILTER ({where}), 9) AS b, round(avg(lum) FILTER ({where}), 9) AS lum, avg(lum * lum) FILTER ({where}) AS squares{more} FROM {source} GROUP BY {keys}),
{name}9 AS (SELECT *, round({_U('squares - lum * lum')}, 9) AS variance FROM {name}0 WHERE {having}), {_colored(name + '9', name + 'c')},
{name} AS (SELECT *, round({_U('log2(n + 1) / 12')} * 0.55e0 + {_U('1 - sqrt(greatest(0.000001e0, variance))')} * 0.45e0, 9) AS confidence FROM {name}c)"""


def _far(p: str, q: str) -> dict[str, str]:
    turn = f"abs({p}.h - {q}.h)"
    weight = f"(0.15e0 + ({p}.s + {q}.s) / 2 * 0.35e0)"
    root = lambda *d: "least(1.0e0, sqrt(" + " + ".join(f"({x}) * ({x})" for x in d) + ") / sqrt(3.0e0))"
    return {
        "rgb": root(*[f"{p}.{c} - {q}.{c}" for c in "rgb"]), "lab": root(f"{p}.lab_l - {q}.lab_l", f"({p}.lab_a - {q}.lab_a) / 2", f"({p}.lab_b - {q}.lab_b) / 2"),
        "hsv": f"least(1.0e0, least({turn}, 1 - {turn}) * 2 * {weight} + abs({p}.s - {q}.s) * 0.22e0 + abs({p}.v - {q}.v) * (1 - {weight} - 0.22e0))",
    }


def _alike(p: str, q: str) -> dict[str, str]:
    far = _far(p, q) | {"light": _U(f"abs({p}.lum - {q}.lum) / greatest(0.05e0, sqrt(greatest(0.000001e0, {q}.variance)) * 2.5e0)")}
    out = {k: f"exp(-({far[k]}) * ({far[k]}) * {s})" for k, s in (("rgb", "4.5e0"), ("hsv", "4.0e0"), ("lab", "5.0e0"), ("light", "2.5e0"))}
    return out | {"all": _U(f"({out['rgb']} * 0.24e0 + {out['hsv']} * 0.18e0 + {out['lab']} * 0.42e0 + {out['light']} * 0.16e0) * (0.72e0 + {q}.confidence * 0.28e0)")}


_APART = _far("f", "k")
_FRONT, _BACK = "WHERE main AND alpha >= 0.82 AND boundary_distance >= 0", "WHERE NOT main AND alpha <= 0.08"
_MODEL = f"""WITH {_BASE}, {SQL_TINTED},
cells0 AS (SELECT s.image_id, s.x, s.y, s.alpha, s.lum, s.main, s.boundary_distance, t.l AS r, t.a AS g, t.b AS b FROM base s JOIN tinted t ON t.image_id = s.image_id AND t.x = s.x AND t.y = s.y), {_colored('cells0', 'cells')},
{_prototype('fore', 'cells0', 'image_id', _FRONT)}, {_prototype('back', 'cells0', 'image_id', _BACK)},
boxes AS (SELECT image_id, coalesce(max(x) FILTER (main) - min(x) FILTER (main) + 1, 8) AS mw, coalesce(max(y) FILTER (main) - min(y) FILTER (main) + 1, 8) AS mh FROM cells0 GROUP BY 1),
model AS (SELECT m.image_id, greatest(2, CAST(floor(least(mw, mh) * 0.09e0 + 0.5e0) AS INT)) AS radius, sqrt(mw * mw + mh * mh) AS across, f.image_id IS NOT NULL AND k.image_id IS NOT NULL AS both_there,
  coalesce(round({_U(f"{_U(_APART['rgb'] + ' * 0.24e0 + ' + _APART['hsv'] + ' * 0.2e0 + ' + _APART['lab'] + ' * 0.42e0 + abs(f.lum - k.lum) * 0.14e0')} * (0.7e0 + 0.3e0 * sqrt(f.confidence * k.confidence))")}, 9), 0) AS separation
  FROM boxes m LEFT JOIN fore f ON f.image_id = m.image_id LEFT JOIN back k ON k.image_id = m.image_id),
samples AS (SELECT c.image_id, c.x, c.y, c.alpha, c.boundary_distance AS depth, m.radius, m.across FROM cells0 c JOIN model m ON m.image_id = c.image_id {_FRONT.replace('WHERE', 'AND')}),
turns(image_id, n, seeds) AS (SELECT image_id, 1, [arg_max({{'x': x, 'y': y}}, row(depth, -y, -x))] FROM samples GROUP BY 1
  UNION ALL SELECT image_id, n + 1, list_append(any_value(seeds), arg_max({{'x': x, 'y': y}}, row(round({_U('near / greatest(1, across)')} * 0.58e0 + {_U('depth / greatest(1, radius * 2)')} * 0.30e0 + alpha * 0.12e0, 9), -y, -x)))
  FROM (SELECT t.n, t.seeds, s.*, list_min([sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) FOR p IN t.seeds]) AS near FROM turns t JOIN samples s ON s.image_id = t.image_id WHERE t.n < 8) WHERE near >= greatest(2, radius * 0.75e0) GROUP BY image_id, n),
seeded AS (SELECT image_id, unnest([{{'i': i, 'p': seeds[i]}} FOR i IN range(1, len(seeds) + 1)]) AS u FROM turns QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC) = 1),
discs AS (SELECT c.*, CAST(s.u.i - 1 AS INT) AS region, s.u.p.x AS sx, s.u.p.y AS sy, m.radius FROM seeded s JOIN model m ON m.image_id = s.image_id JOIN cells0 c ON c.image_id = s.image_id AND (c.x - s.u.p.x) * (c.x - s.u.p.x) + (c.y - s.u.p.y) * (c.y - s.u.p.y) <= m.radius * m.radius),
{_prototype('regs', 'discs', 'image_id, region, sx, sy, radius', _FRONT, ', count(*) AS every, round(avg(alpha), 9) AS mean_alpha', 'n >= 2')},
regions AS (SELECT * EXCLUDE (confidence), round(n / every, 9) AS reliable, round({_U('0.55e0 * confidence + 0.25e0 * round(n / every, 9) + 0.2e0 * mean_alpha + 0.1e0 * least(1.0e0, n / 512)')}, 9) AS confidence FROM regs)"""
_F, _B, _R = _alike("c", "f"), _alike("c", "k"), _alike("c", "q")
_NAMES = ("fg_rgb", "fg_hsv", "fg_lab", "bg_rgb", "bg_hsv", "bg_lab", "local_fg", "all_fg", "all_bg")
_ONE = ", ".join(f"{t}.{c} AS {n}_{c}" if c == "n" else f"floor({t}.{c} * 100000 + 0.00005e0) / 100000 AS {n}_{c}" for t, n in (("f", "fore"), ("k", "back")) for c in ("n", "r", "h", "lab_l", "variance", "confidence"))
_LIKENESS = f"""{_MODEL}, near AS (SELECT c.image_id, c.x, c.y, q.region, q.confidence, q.reliable, q.mean_alpha, round(sqrt((c.x - q.sx) * (c.x - q.sx) + (c.y - q.sy) * (c.y - q.sy)), 9) AS d, q.radius, {_R['all']} AS alike FROM cells c JOIN regions q ON q.image_id = c.image_id),
weighed AS (SELECT *, CASE WHEN exp(-(d / radius) * (d / radius) * 0.65e0) >= 0.001 THEN exp(-(d / radius) * (d / radius) * 0.65e0) * greatest(0.05e0, 0.5e0 * confidence + 0.3e0 * reliable + 0.2e0 * mean_alpha) ELSE 0 END AS w FROM near),
locals AS (SELECT image_id, x, y, CASE WHEN sum(w) > 0.000001 THEN sum(w * alike) / sum(w) ELSE arg_min(alike, row(d, -confidence, region)) END AS l, arg_min(confidence, row(d, -confidence, region)) > 0 AS here FROM weighed GROUP BY 1, 2, 3),
each AS (SELECT c.image_id, c.x, c.y, m.separation, coalesce({_F['rgb']}, 0) AS fg_rgb, coalesce({_F['hsv']}, 0) AS fg_hsv, coalesce({_F['lab']}, 0) AS fg_lab, coalesce({_F['all']}, 0) AS fa, coalesce({_B['rgb']}, 0) AS bg_rgb, coalesce({_B['hsv']}, 0) AS bg_hsv, coalesce({_B['lab']}, 0) AS bg_lab, coalesce({_B['all']}, 0) AS all_bg
FROM cells c JOIN model m ON m.image_id = c.image_id LEFT JOIN fore f ON f.image_id = c.image_id LEFT JOIN back k ON k.image_id = c.image_id),
done AS (SELECT e.*, {_U(_U('CASE WHEN coalesce(here, FALSE) THEN 0.62e0 * l + 0.38e0 * fa ELSE fa END') + ' * (0.55e0 + 0.45e0 * separation)')} AS local_fg, {_U('fa * (0.55e0 + 0.45e0 * separation)')} AS all_fg FROM each e LEFT JOIN locals o ON o.image_id = e.image_id AND o.x = e.x AND o.y = e.y)"""

ORACLES = {
    "foreground_prototypes": f"{_MODEL} SELECT m.image_id, {_ONE}, {_FIVE('separation')}, both_there AND separation >= 0.08 AS usable, radius FROM model m LEFT JOIN fore f ON f.image_id = m.image_id LEFT JOIN back k ON k.image_id = m.image_id",
    "foreground_regions": f"{_MODEL} SELECT image_id, region, sx AS x, sy AS y, n, {_FIVE('reliable')}, floor(mean_alpha * 100000 + 0.00005e0) / 100000 AS alpha, {_FIVE('confidence')} FROM regions",
    "foreground_similarity": f"{_LIKENESS} SELECT image_id, x, y, {', '.join(f'floor(round({n}, 9) * 100000 + 0.00005e0) / 100000 AS {n}' for n in _NAMES)} FROM done",
    "refined_masks": f"""{_LIKENESS}, featured AS (SELECT s.* EXCLUDE ({', '.join(_NAMES)}), {', '.join(f'round({n}, 9) AS {n}' for n in ('d.' + n for n in _NAMES)).replace('AS d.', 'AS ')} FROM feature s JOIN done d ON d.image_id = s.image_id AND d.x = s.x AND d.y = s.y)
      {_CLASSES.replace('FROM feature)', 'FROM featured)')}, ballots AS (SELECT image_id, i, x, y, active, main, continuity, support, agreement, class AS k, refined AS alpha, confidence AS c, TRUE AS going FROM classes){_vote(0, 'ballots')}{_vote(1, 'state0')}
      SELECT image_id, x, y, k AS class, {_FIVE('alpha')}, floor(c * 100000 + 0.00005e0) / 100000 AS confidence FROM state1""",
}
