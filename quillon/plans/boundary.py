"""Queries over the edges of masks: distances, features, classes and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boundary as B
from ..sources.shared import kept
from ..sources.tables import SQL_SOFT, soft_grid

FEATURES = ("boundary_distance", "main_distance", "mean", "variance", "texture", "contrast", "foreground_ratio", "background_ratio", "agreement", "continuity", "support")


def _rounded(df, *columns):
    """Five digits, cut between two values that nine digits can have: both engines cut the same way."""
    return df.withColumns({c: F.floor(F.col(c) * 100000 + 0.00005) / 100000 for c in columns})


def boundary_distance(spark, sf):
    """How far each cell is from the edge of its mask, as far as the image goes."""
    cells = B.with_boundary(soft_grid(spark, sf).withColumn("alpha", F.when(F.col("alpha") > 0.97, 1.0).otherwise(0.0)))
    return _rounded(B.distances(cells, "boundary", 11), "distance").select("image_id", "x", "y", "distance")


def boundary_features(spark, sf):
    return _rounded(B.features(soft_grid(spark, sf)), *FEATURES).select("image_id", "x", "y", "main", "active", *FEATURES)


def pixel_classes(spark, sf):
    rows = B.classified(B.features(soft_grid(spark, sf)))
    return _rounded(rows, "foreground_score", "background_score", "confidence", "refined").select("image_id", "x", "y", "foreground_score", "background_score", "confidence", "class", "refined")


def _ballots(spark, sf):
    return kept(B.classified(B.features(soft_grid(spark, sf))).withColumn("alpha", F.col("refined")).select("image_id", "x", "y", "alpha", "class", "confidence", "active", "main", "continuity", "support", "agreement"))


def confidence_votes(spark, sf):
    """The classes after two votes of the neighbours."""
    cells, _ = B.voted(_ballots(spark, sf), cut=kept)
    return _rounded(cells, "alpha", "confidence").select("image_id", "x", "y", "class", "alpha", "confidence")


def voting_passes(spark, sf):
    _, said = B.voted(_ballots(spark, sf), cut=kept)
    return _rounded(said, "confidence")


QUERIES = {f.__name__: f for f in (boundary_distance, boundary_features, pixel_classes, confidence_votes, voting_passes)}

_CUT = "floor({} * 100000 + 0.00005e0) / 100000".format
_ROOT = "1.4142135623730951e0"
_U = "least(1.0e0, greatest(0.0e0, {}))".format


def _distance(name: str, seeds: str, most: str) -> str:
    steps = f"greatest(abs(g.x - s.x), abs(g.y - s.y)) - least(abs(g.x - s.x), abs(g.y - s.y)) + {_ROOT} * least(abs(g.x - s.x), abs(g.y - s.y))"
    return f"{name} AS (SELECT g.image_id, g.i, least({most}, coalesce(min({steps}), {most})) AS {name} FROM soft g LEFT JOIN {seeds} s ON s.image_id = g.image_id GROUP BY 1, 2)"


def _edges(alpha: str = "alpha") -> str:
    """Cells in transition, of another side than a neighbour or of a clearly different alpha, or inside at the image's border."""
    return f"""edges AS (SELECT g.image_id, g.i, g.x, g.y FROM (SELECT image_id, i, x, y, {alpha} AS alpha FROM soft) g LEFT JOIN (SELECT image_id, x, y, {alpha} AS alpha FROM soft) n
    ON n.image_id = g.image_id AND abs(n.x - g.x) + abs(n.y - g.y) = 1 GROUP BY 1, 2, 3, 4, g.alpha
  HAVING g.alpha BETWEEN 0.08 AND 0.92 OR bool_or((n.alpha >= 0.5) <> (g.alpha >= 0.5) OR abs(n.alpha - g.alpha) >= 0.25) OR g.alpha >= 0.5 AND count(*) < 4)"""


_BASE = f"""RECURSIVE {SQL_SOFT}, cell AS (SELECT image_id, i, x, y FROM soft WHERE alpha >= 0.5),
reach(image_id, i, x, y, j) AS (SELECT image_id, i, x, y, i FROM cell
  UNION SELECT b.image_id, b.i, b.x, b.y, a.j FROM reach a JOIN cell b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) <= 1),
parts AS (SELECT image_id, i, x, y, min(j) AS label FROM reach GROUP BY ALL),
largest AS (SELECT image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, label) AS place FROM parts GROUP BY 1, 2),
mains AS (SELECT p.* FROM parts p JOIN largest l ON l.image_id = p.image_id AND l.label = p.label AND l.place = 1),
{_edges()}, {_distance("boundary_distance", "edges", "12.0e0")}, {_distance("main_distance", "mains", "24.0e0")},
base AS (SELECT g.*, m.i IS NOT NULL AS main, b.boundary_distance, d.main_distance, e.i IS NOT NULL OR g.alpha BETWEEN 0.08 AND 0.92 OR b.boundary_distance <= 6 AND d.main_distance <= 24 AS active
  FROM soft g JOIN boundary_distance b USING (image_id, i) JOIN main_distance d USING (image_id, i) LEFT JOIN edges e USING (image_id, i) LEFT JOIN mains m ON m.image_id = g.image_id AND m.i = g.i),
around AS (SELECT g.image_id, g.i, n.i = g.i AS own, n.alpha, n.lum, n.gradient, g.lum AS c_lum, g.gradient AS c_gradient,
    (n.x - g.x) * (n.x - g.x) + (n.y - g.y) * (n.y - g.y) <= 4 AND n.i <> g.i AS in_disc, 1 - least(1.0e0, abs(n.gradient - g.gradient)) AS alike,
    abs((g.direction - pi() * floor(g.direction / pi())) - (n.direction - pi() * floor(n.direction / pi()))) AS turn
  FROM base g JOIN soft n ON n.image_id = g.image_id AND abs(n.x - g.x) <= 2 AND abs(n.y - g.y) <= 2 WHERE g.active),
disc AS (SELECT image_id, i, c_gradient AS c, count(*) AS n, count(*) FILTER (WHERE gradient >= 0.06) AS edges, count(*) FILTER (WHERE gradient >= 0.06 AND gradient >= c_gradient * 0.65) AS strong,
    avg(alike) FILTER (WHERE gradient >= 0.06) AS alike, avg(coalesce(1 - {_U('least(turn, pi() - turn) / (pi() / 2)')}, alike)) FILTER (WHERE gradient >= 0.06) AS turned
  FROM around WHERE in_disc GROUP BY ALL),
local0 AS (SELECT image_id, i, {_U('avg(lum)')} AS mean, avg(lum * lum) AS squares, {_U('avg(abs(lum - c_lum)) FILTER (WHERE NOT own)')} AS texture, max(lum) - min(lum) AS contrast,
    avg(CASE WHEN alpha >= 0.68 THEN 1.0e0 ELSE 0 END) FILTER (WHERE NOT own) AS fr, avg(CASE WHEN alpha <= 0.18 THEN 1.0e0 ELSE 0 END) FILTER (WHERE NOT own) AS br FROM around GROUP BY 1, 2),
local1 AS (SELECT b.*, l.mean, {_U('squares - mean * mean')} AS variance, texture, contrast, fr, br, {_U('CASE WHEN b.alpha >= 0.5 THEN fr ELSE br END + 0.35e0 * ' + _U('1 - fr - br'))} AS agreement,
    CASE WHEN c < 0.06 THEN c * 0.25e0 WHEN edges = 0 THEN c * 0.2e0 ELSE {_U('c * 0.28e0 + 0.22e0 * edges / n + 0.18e0 * strong / edges + 0.22e0 * turned + 0.10e0 * alike')} END AS continuity
  FROM base b LEFT JOIN local0 l USING (image_id, i) LEFT JOIN disc d USING (image_id, i)),
local2 AS (SELECT *, {_U('0.48e0 * CASE WHEN main THEN 1 ELSE 1 - ' + _U('main_distance / 24') + ' END + 0.30e0 * fr + 0.22e0 * continuity + CASE WHEN main THEN 0.22e0 ELSE 0 END')} AS support0 FROM local1),
feature AS (SELECT * EXCLUDE (mean, variance, texture, contrast, agreement, continuity, fr, br, support0), coalesce(round(mean, 9), 0) AS mean, coalesce(round(variance, 9), 0) AS variance, coalesce(round(texture, 9), 0) AS texture,
    coalesce(round(contrast, 9), 0) AS contrast, coalesce(round(fr, 9), 0) AS foreground_ratio, coalesce(round(br, 9), 0) AS background_ratio, coalesce(round(agreement, 9), 0) AS agreement, coalesce(round(continuity, 9), 0) AS continuity,
    coalesce(round(CASE WHEN active THEN support0 END, 9), 0) AS support, max(boundary_distance) FILTER (WHERE active) OVER (PARTITION BY image_id) AS most_distance FROM local2)"""

_CLASSES = f""",
given0 AS (SELECT *, main OR main_distance <= greatest(2, coalesce(most_distance, 0)) AS near_main, main AND alpha >= 0.86 AS core, {_U('1 - foreground_ratio - background_ratio')} AS unclear, {_U('(alpha - 0.08e0) / 0.78e0')} AS of_alpha,
    CASE WHEN main THEN 1.0e0 ELSE {_U('1 - main_distance / greatest(2, 2 * boundary_distance + 4)')} END AS of_distance FROM feature),
score0 AS (SELECT *, round((1.35e0 * of_alpha + 0.75e0 * fg_rgb + 0.6e0 * fg_hsv + 1.15e0 * fg_lab + 1.3e0 * local_fg + 1.25e0 * (1 - {_U('0.24e0 * bg_rgb + 0.18e0 * bg_hsv + 0.38e0 * bg_lab + 0.2e0 * all_bg')})
      + 0.45e0 * (0.4e0 * exp(-pow((texture - 0.18e0) / 0.42e0, 2)) + 0.3e0 * exp(-pow((variance - 0.12e0) / 0.38e0, 2)) + 0.3e0 * continuity) + 0.55e0 * (0.45e0 * contrast + 0.25e0 * gradient + 0.3e0 * continuity)
      + 0.7e0 * (0.5e0 * gradient + 0.35e0 * continuity + 0.15e0 * contrast) + continuity + 1.15e0 * {_U('0.52e0 * foreground_ratio + 0.18e0 * unclear + 0.3e0 * agreement')}
      + 1.35e0 * {_U('0.48e0 * CASE WHEN main THEN 1 WHEN near_main THEN 0.7e0 ELSE 0.15e0 END + 0.37e0 * support + 0.15e0 * agreement')} + 0.9e0 * of_distance) / 12.5e0, 9) AS s,
    0.46e0 * {_U('0.45e0 * local_fg + 0.25e0 * all_fg + 0.3e0 * (1 - all_bg)')} + 0.31e0 * {_U('0.55e0 * continuity + 0.25e0 * gradient + 0.2e0 * contrast')} + 0.23e0 * {_U('0.55e0 * foreground_ratio + 0.45e0 * agreement')} AS visual FROM given0),
score1 AS (SELECT *, greatest(s, CASE WHEN core THEN 0.92e0 ELSE 0 END, CASE WHEN support >= 0.72 AND agreement >= 0.76 THEN 0.76e0 ELSE 0 END, CASE WHEN continuity >= 0.68 AND gradient >= 0.48 AND local_fg >= 0.45 THEN 0.66e0 ELSE 0 END)
    * CASE WHEN NOT near_main AND visual < 0.58 THEN 0.42e0 ELSE 1 END * CASE WHEN touches AND NOT main AND support < 0.55 THEN 0.72e0 ELSE 1 END * CASE WHEN all_bg >= 0.76 AND local_fg < 0.62 THEN 0.62e0 ELSE 1 END AS fg FROM score0),
score2 AS (SELECT *, greatest(0.33e0 * {_U('0.22e0 * bg_rgb + 0.18e0 * bg_hsv + 0.36e0 * bg_lab + 0.24e0 * all_bg')} + 0.24e0 * (1 - of_alpha) + 0.19e0 * {_U('0.62e0 * background_ratio + 0.18e0 * (1 - agreement) + 0.2e0 * unclear')}
      + 0.16e0 * {_U('1 - 0.55e0 * support - 0.45e0 * CASE WHEN main THEN 1 WHEN near_main THEN 0.58e0 ELSE 0 END')} + 0.08e0 * {_U('1 - 0.55e0 * continuity - 0.25e0 * gradient - 0.2e0 * contrast')},
      CASE WHEN NOT main AND alpha <= 0.08 THEN 0.88e0 ELSE 0 END, CASE WHEN all_bg >= 0.72 AND local_fg <= 0.32 THEN 0.78e0 ELSE 0 END)
    * CASE WHEN main THEN 0.3e0 ELSE 1 END * CASE WHEN support >= 0.72 AND continuity >= 0.68 THEN 0.62e0 ELSE 1 END * (1 - 0.22e0 * {_U('fg - 0.5e0')}) AS bg FROM score1),
score3 AS (SELECT * EXCLUDE (fg, bg), round({_U('fg')}, 9) AS fg, round({_U('bg')}, 9) AS bg FROM score2),
score4 AS (SELECT *, round({_U('0.3e0 * greatest(fg, bg) + 0.36e0 * ' + _U('abs(fg - bg) / 0.18e0') + ' + 0.2e0 * ' + _U('0.38e0 * support + 0.3e0 * agreement + 0.2e0 * continuity + 0.12e0 * gradient') + ' + 0.14e0 * abs(local_fg - all_bg)')}, 9) AS c,
    CASE WHEN core THEN 1 WHEN fg >= 0.58 AND fg - bg > 0.09 THEN 1 WHEN bg >= 0.58 AND fg - bg < -0.09 THEN 2 WHEN abs(fg - bg) <= 0.09 THEN 3 WHEN fg > bg THEN 1 ELSE 2 END AS k FROM score3),
score5 AS (SELECT *, CASE WHEN core THEN 0.0e0 WHEN k = 1 THEN {_U('0.38e0 + 0.48e0 * c')} WHEN k = 2 AND continuity >= 0.68 AND local_fg >= 0.48 THEN {_U('0.2e0 + 0.28e0 * c')} WHEN k = 2 THEN {_U('0.42e0 + 0.48e0 * c')} ELSE {_U('0.12e0 + 0.16e0 * c')} END AS share,
    CASE WHEN k = 1 THEN greatest(alpha, {_U('0.72e0 * fg + 0.12e0 * support + 0.1e0 * agreement + 0.06e0 * continuity')}) WHEN k = 2 THEN least(alpha, {_U('0.55e0 * (1 - bg) + 0.2e0 * fg + 0.1e0 * continuity')}) ELSE {_U('fg / greatest(0.000001e0, fg + bg)')} END AS target FROM score4),
classes AS (SELECT image_id, i, x, y, active, main, continuity, support, agreement, CASE WHEN active THEN fg ELSE 0 END AS foreground_score, CASE WHEN active THEN bg ELSE 0 END AS background_score, CASE WHEN active THEN c ELSE 0 END AS confidence,
    CASE WHEN active THEN k ELSE 0 END AS class, CASE WHEN NOT active THEN alpha WHEN core THEN greatest(alpha, 0.94e0) ELSE round({_U('alpha * (1 - share) + target * share')}, 9) END AS refined FROM score5)"""


def _vote(n: int, before: str) -> str:
    """One pass over the state `before` (class k, alpha, confidence c, going), as the table state{n} and what it says."""
    return f""",
seen{n} AS (SELECT g.image_id, g.i, n.k, n.c, n.c / sqrt((n.x - g.x) * (n.x - g.x) + (n.y - g.y) * (n.y - g.y)) * CASE WHEN n.active THEN 1 ELSE 0.65e0 END * (0.75e0 + 0.25e0 * n.continuity) AS w
  FROM {before} g JOIN {before} n ON n.image_id = g.image_id AND n.i <> g.i AND abs(n.x - g.x) <= 1 AND abs(n.y - g.y) <= 1 AND n.k > 0 AND n.c >= 0.42 WHERE g.active AND g.going),
votes{n} AS (SELECT image_id, i, count(*) AS n, count(*) FILTER (WHERE k = 1) AS n1, coalesce(sum(w) FILTER (WHERE k = 1), 0) AS w1, coalesce(sum(w) FILTER (WHERE k = 2), 0) AS w2, coalesce(sum(w) FILTER (WHERE k = 3), 0) AS w3, avg(c) AS mean FROM seen{n} WHERE w > 0.000001 GROUP BY 1, 2),
with{n} AS (SELECT g.*, coalesce(n, 0) AS n, coalesce(w1, 0) AS w1, coalesce(w2, 0) AS w2, coalesce(w3, 0) AS w3, coalesce(mean, 0) AS mean, 0.85e0 * (0.4e0 + 0.6e0 * c) AS own, {_U('0.58e0 * continuity + 0.42e0 * support')} AS visual,
    main AND alpha >= 0.88 OR support >= 0.74 AND continuity >= 0.70 AND agreement >= 0.76 AS guarded,
    k = 1 AND coalesce(n, 0) >= 2 AND coalesce(n1, 0) / greatest(1, coalesce(n, 0)) <= 0.18 AND NOT main AND support < 0.5 AND continuity < 0.52 AS alone FROM {before} g LEFT JOIN votes{n} v USING (image_id, i)),
sums{n} AS (SELECT *, (CASE WHEN k = 1 THEN own ELSE 0 END + w1 + CASE WHEN main THEN 0.75e0 * (0.55e0 + 0.45e0 * visual) ELSE 0 END + CASE WHEN k = 1 AND alpha >= 0.5 THEN 0.75e0 * 0.75e0 * visual ELSE 0 END + CASE WHEN guarded THEN 2.5e0 ELSE 0 END) * CASE WHEN alone THEN 0.45e0 ELSE 1 END AS f0,
    (CASE WHEN k = 2 THEN own ELSE 0 END + w2 + CASE WHEN k = 2 AND alpha <= 0.06 AND support < 0.35 THEN 0.75e0 * (1 - visual) ELSE 0 END) * CASE WHEN guarded THEN 0.25e0 ELSE 1 END + CASE WHEN alone THEN 1.75e0 ELSE 0 END AS b0,
    (CASE WHEN k = 3 THEN own ELSE 0 END + 0.55e0 * w3) * CASE WHEN guarded THEN 0.4e0 ELSE 1 END AS u0 FROM with{n}),
shares{n} AS (SELECT *, round(f0 / greatest(0.000001e0, f0 + b0 + u0), 9) AS f, round(b0 / greatest(0.000001e0, f0 + b0 + u0), 9) AS b, round(u0 / greatest(0.000001e0, f0 + b0 + u0), 9) AS u FROM sums{n}),
won{n} AS (SELECT *, CASE WHEN guarded THEN 1 WHEN f >= 0.6 AND f > b THEN 1 WHEN b >= 0.6 AND b > f THEN 2 ELSE 3 END AS nk FROM shares{n}),
sure{n} AS (SELECT *, round({_U('0.18e0 * c + 0.22e0 * greatest(f, b, u) + 0.22e0 * abs(f - b) + 0.16e0 * CASE nk WHEN 1 THEN f WHEN 2 THEN b ELSE u END + 0.1e0 * mean + 0.04e0 * least(1.0e0, n / greatest(2, n)) + 0.08e0 * ' + _U('0.45e0 * continuity + 0.55e0 * support') + ' - 0.35e0 * u')}, 9) AS nc FROM won{n}),
to{n} AS (SELECT *, CASE WHEN nk = 1 THEN greatest(alpha, {_U('0.58e0 * f + 0.24e0 * support + 0.18e0 * continuity')}) WHEN nk = 2 THEN least(alpha, {_U('0.28e0 * (1 - b) + 0.12e0 * f + 0.1e0 * visual')}) ELSE {_U('0.7e0 * f / greatest(0.000001e0, f + b) + 0.15e0 * continuity + 0.15e0 * support')} END AS target,
    CASE WHEN nk = 1 AND k = 1 THEN {_U('0.18e0 + 0.34e0 * nc')} WHEN nk = 1 THEN {_U('0.3e0 + 0.48e0 * nc')} WHEN nk = 3 THEN {_U('0.08e0 + 0.18e0 * nc')} ELSE CASE WHEN k = 2 THEN {_U('0.22e0 + 0.4e0 * nc')} ELSE {_U('0.38e0 + 0.48e0 * nc')} END * CASE WHEN continuity >= 0.7 OR support >= 0.74 THEN 0.55e0 ELSE 1 END END AS share FROM sure{n}),
new{n} AS (SELECT *, CASE WHEN guarded THEN greatest(alpha, 0.94e0) ELSE round({_U('alpha * (1 - share) + target * share')}, 9) END AS na, active AND going AS votes FROM to{n}),
said{n} AS (SELECT image_id, {n} AS pass, count(*) FILTER (WHERE nk <> k OR abs(na - alpha) > 0.0005) AS changed, count(*) FILTER (WHERE k <> 1 AND nk = 1) AS promoted, count(*) FILTER (WHERE k = 1 AND nk = 2) AS rejected, count(*) FILTER (WHERE k = 3 AND nk <> 3) AS resolved,
    count(*) FILTER (WHERE nk = 3) AS uncertain, avg(nc) AS confidence FROM new{n} WHERE votes GROUP BY 1),
state{n} AS (SELECT s.image_id, i, x, y, active, main, continuity, support, agreement, CASE WHEN votes THEN nk ELSE k END AS k, CASE WHEN votes THEN na ELSE alpha END AS alpha, CASE WHEN votes THEN nc ELSE c END AS c, coalesce(d.changed, 0) > 0 AS going FROM new{n} s LEFT JOIN said{n} d USING (image_id))"""


_VOTED = f"""WITH {_BASE}{_CLASSES}, ballots AS (SELECT image_id, i, x, y, active, main, continuity, support, agreement, class AS k, refined AS alpha, confidence AS c, TRUE AS going FROM classes){_vote(0, 'ballots')}{_vote(1, 'state0')}"""

_FIVE = ", ".join(f"{_CUT(c)} AS {c}" for c in FEATURES)

ORACLES = {
    "boundary_distance": f"WITH {SQL_SOFT}, {_edges('CASE WHEN alpha > 0.97 THEN 1.0e0 ELSE 0.0e0 END')}, {_distance('distance', 'edges', '11.0e0')} SELECT d.image_id, s.x, s.y, {_CUT('d.distance')} AS distance FROM distance d JOIN soft s USING (image_id, i)",
    "boundary_features": f"WITH {_BASE} SELECT image_id, x, y, main, active, {_FIVE} FROM feature",
    "pixel_classes": f"WITH {_BASE}{_CLASSES} SELECT image_id, x, y, {', '.join(f'{_CUT(c)} AS {c}' for c in ('foreground_score', 'background_score', 'confidence', 'refined'))}, class FROM classes",
    "confidence_votes": f"{_VOTED} SELECT image_id, x, y, k AS class, {_CUT('alpha')} AS alpha, {_CUT('c')} AS confidence FROM state1",
    "voting_passes": f"{_VOTED} SELECT image_id, pass, changed, promoted, rejected, resolved, uncertain, {_CUT('confidence')} AS confidence FROM (SELECT * FROM said0 UNION ALL SELECT * FROM said1)",
}
