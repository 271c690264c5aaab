"""Queries over wardrobes, looks and their colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import outfits as O
from ..sources.shared import spread
from ..sources.tables import COLORS, derived, sql_of

SLOTS = ("top", "bottom", "shoes", "jacket")
_KEYS = ("order_key", "line_no", "part_key", "supp_key")


def wardrobe_newest(spark, sf):
    return O.newest(derived(spark, sf, "wardrobe"), 3)


def wardrobe_search(spark, sf):
    return O.found(derived(spark, sf, "wardrobe"), " RED ", "All")


def wardrobe_category(spark, sf):
    return O.found(derived(spark, sf, "wardrobe"), "", "Shoes")


def wardrobe_exclude(spark, sf):
    items = derived(spark, sf, "wardrobe")
    return O.without(items, items.where("favorite"))


def wardrobe_stats(spark, sf):
    return O.wardrobe_counts(derived(spark, sf, "wardrobe"), "owner_id")


def wardrobe_latest_job_join(spark, sf):
    return O.latest_jobs(derived(spark, sf, "wardrobe"), derived(spark, sf, "jobs"))


def color_matches(spark):
    return spark.createDataFrame([(c, m) for c in COLORS for m in C.MATCHES[c]], "color string, other string")


def best_match_items(spark, sf):
    items = derived(spark, sf, "wardrobe")
    return O.best_matches(items, items.where("favorite"), color_matches(spark))


def preference_top5(spark, sf):
    looks = spread(derived(spark, sf, "outfits")).withColumn("favorite", F.col("part_key") % 7 == 0)
    return O.preferences(looks, "supp_key", {"color": list(SLOTS), "occasion": ["occasion"], "weather": ["weather"], "season": ["season"]})


def color_normalize(spark, sf):
    rows = derived(spark, sf, "wardrobe")
    free = F.concat(F.when(F.col("id") % 3 == 0, "Dark ").when(F.col("id") % 3 == 1, "  off-").otherwise(""), F.col("color"))
    rows = rows.select("id", free.alias("free"))
    names = rows.select(F.col("free").alias("text")).distinct().withColumn("normalized", C.normalize(F.col("text")))  # each text once
    names = names.select("text", "normalized", C.brightness(F.col("text"), F.col("normalized")).alias("brightness"), C.saturation(F.col("text"), F.col("normalized")).alias("saturation"))
    return rows.join(names, F.col("free").eqNullSafe(F.col("text")), "left").select("id", "normalized", "brightness", "saturation")


def pair_color_matrix(spark, sf):
    """Every pair of colours that items of one owner have, with its score and how many pairs of items have it."""
    items = derived(spark, sf, "wardrobe").groupBy("owner_id", "color").count()
    rows = items.alias("a").join(items.alias("b"), "owner_id").groupBy(F.col("a.color").alias("first"), F.col("b.color").alias("second")).agg(F.sum(F.col("a.count") * F.col("b.count")).alias("n"))
    for c in ("first", "second"):
        rows = rows.withColumn(f"{c}_c", C.normalize(F.col(c))).withColumn(f"{c}_b", C.brightness(F.col(c), F.col(f"{c}_c")))
    return rows.select("first", "second", "n", C.pair_score(F.col("first_c"), F.col("first_b"), F.col("second_c"), F.col("second_b")).alias("score"))


def color_score_outfit(spark, sf):
    return O.color_scores(spread(derived(spark, sf, "outfits")), SLOTS).drop("top", "bottom", "shoes", "jacket", "occasion")


def color_score_by_style(spark, sf):
    return color_score_outfit(spark, sf).groupBy("style").agg(F.count("*").alias("looks"), F.max("color_score").alias("best"), F.min("color_score").alias("worst"), F.sum("color_score").alias("total"))


def dominant_color(spark, sf):
    return O.classified(O.dominant_color(derived(spark, sf, "pixels")))


def classify_color(spark, sf):
    return O.classified(derived(spark, sf, "pixels")).groupBy("image_id", "color", "shade").agg(F.count("*").alias("pixels"))


def color_distances(spark, sf):
    rows = derived(spark, sf, "pixels")
    light, a, b = C.lab(F.col("r"), F.col("g"), F.col("b"))
    rgb = F.sqrt((F.col("r") - 128.0) ** 2 + (F.col("g") - 128.0) ** 2 + (F.col("b") - 128.0) ** 2)
    luma = (F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722) / 255
    rows = rows.withColumns({"L": light, "A": a, "B": b, "d": rgb, "y": luma})
    mean = lambda c: F.round(F.avg(c), 4).alias(f"mean_{c.lower()}")
    return rows.groupBy("image_id").agg(mean("L"), mean("A"), F.round(F.avg("B"), 4).alias("mean_b_star"), mean("d"), mean("y"))


def hsv_distances(spark, sf):
    """Mean hue, saturation and value of an image's pixels, and their mean distance from a dark orange."""
    rows = derived(spark, sf, "pixels")
    h, s, v = C.hsv(F.col("r"), F.col("g"), F.col("b"))
    far = C.hsv_distance((h, s, v), C.hsv(F.lit(200.0), F.lit(90.0), F.lit(20.0)))
    rows = rows.select("image_id", h.alias("h"), s.alias("s"), v.alias("v"), far.alias("d"))
    return rows.groupBy("image_id").agg(*[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in "hsvd"])


QUERIES = {f.__name__: f for f in (
    hsv_distances, wardrobe_newest, wardrobe_search, wardrobe_category, wardrobe_exclude, wardrobe_stats, wardrobe_latest_job_join, best_match_items, preference_top5, color_normalize, pair_color_matrix,
    color_score_outfit, color_score_by_style, dominant_color, classify_color, color_distances,
)}

_W = "WITH " + sql_of("wardrobe")
_LIST = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_MATCHES = "m(color, other) AS (VALUES " + ", ".join(f"('{c}', '{m}')" for c in COLORS for m in C.MATCHES[c]) + ")"
_KINDS = f"bright(color, b) AS (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {chr(39)}{C.BRIGHTNESS[c]}{chr(39)})' for c in COLORS)})"


def _pairs() -> str:
    """All pairs of plain colour names; Cream means White, as a name and in brightness lists."""
    key = "least(x.n, y.n) || '|' || greatest(x.n, y.n)"
    return f"""{_MATCHES}, {_KINDS}, plain AS (SELECT color AS name, CASE color WHEN 'Cream' THEN 'White' ELSE color END AS n FROM bright), p0 AS (SELECT plain.name, plain.n, bright.b FROM plain JOIN bright ON bright.color = plain.n),
  pairs AS (SELECT x.name AS first, y.name AS second, CASE WHEN x.n = y.n THEN CASE WHEN x.b <> y.b THEN 94 ELSE 86 END WHEN {key} IN {_LIST(C.canonical_pairs(C.EXCELLENT))} THEN 98
   WHEN EXISTS (SELECT 1 FROM m WHERE (m.color = x.n AND m.other = y.n) OR (m.color = y.n AND m.other = x.n)) THEN 91 WHEN x.n IN {_LIST(C.NEUTRAL)} AND y.n IN {_LIST(C.NEUTRAL)} THEN 89 WHEN x.n IN {_LIST(C.NEUTRAL)} OR y.n IN {_LIST(C.NEUTRAL)} THEN 83
   WHEN (x.b = 'light' AND y.b = 'dark') OR (x.b = 'dark' AND y.b = 'light') THEN 79 WHEN (x.n IN {_LIST(C.WARM)} AND y.n IN {_LIST(C.WARM)}) OR (x.n IN {_LIST(C.COOL)} AND y.n IN {_LIST(C.COOL)}) THEN 74
   WHEN {key} IN {_LIST(C.canonical_pairs(C.RISKY))} THEN 42 ELSE 64 END AS score FROM p0 x, p0 y)"""


def _of(names) -> str:
    return f"len(list_filter(cs, lambda c: c IN {_LIST(names)}))"


_LOOKS = "WITH " + sql_of("outfits") + ", " + _pairs() + f""", l0 AS (SELECT o.*, list_filter([top, bottom, shoes, jacket], lambda c: c IS NOT NULL) AS names FROM outfits o),
  l1 AS (SELECT *, list_transform(names, lambda c: CASE c WHEN 'Cream' THEN 'White' ELSE c END) AS cs FROM l0),
  l2 AS (SELECT *, list_transform(cs, lambda c: CASE {' '.join(f"WHEN c = '{c}' THEN '{b}'" for c, b in C.BRIGHTNESS.items())} END) AS gs, len(list_distinct(cs)) AS k FROM l1),
  l3 AS (SELECT l2.*, list_filter(gs, lambda g: g NOT IN ('unknown', 'metallic')) AS pg, {_of(C.LIGHT)} AS li, {_of(C.DARK)} AS da, {_of(C.NEUTRAL)} AS ne, {_of(C.STRONG)} AS st, {_of(C.SPRING)} AS sp, {_of(C.RAIN)} AS ra, {_of(C.SPORT)} AS so,
   tb.score AS tb, bs.score AS bs, ts.score AS ts, jt.score AS jt FROM l2 LEFT JOIN pairs tb ON tb.first = top AND tb.second = bottom LEFT JOIN pairs bs ON bs.first = bottom AND bs.second = shoes
   LEFT JOIN pairs ts ON ts.first = top AND ts.second = shoes LEFT JOIN pairs jt ON jt.first = jacket AND jt.second = top),
  l4 AS (SELECT *, len(list_filter(pg, lambda g: g = 'light')) AS gl, len(list_filter(pg, lambda g: g = 'medium')) AS gm, len(list_filter(pg, lambda g: g = 'dark')) AS gd,
   (coalesce(tb * 35, 0) + coalesce(bs * 25, 0) + coalesce(ts * 15, 0) + coalesce(jt * 20, 0)) AS hs, CASE WHEN tb IS NULL THEN 0 ELSE 35 END + CASE WHEN bs IS NULL THEN 0 ELSE 25 END + CASE WHEN ts IS NULL THEN 0 ELSE 15 END + CASE WHEN jt IS NULL THEN 0 ELSE 20 END AS hw,
   cs[1] AS c_top, CASE WHEN bottom = 'Cream' THEN 'White' ELSE bottom END AS c_bottom, CASE WHEN shoes = 'Cream' THEN 'White' ELSE shoes END AS c_shoes, CASE WHEN jacket = 'Cream' THEN 'White' ELSE jacket END AS c_jacket FROM l3),
  l5 AS (SELECT *, CASE WHEN hw = 0 THEN 55 ELSE CAST(floor(CAST(hs AS double) / hw + 0.5e0) AS int) END AS pair_harmony,
   CASE WHEN k = 0 THEN 45 WHEN k = 1 THEN 86 WHEN k = 2 THEN 100 WHEN k = 3 THEN 96 WHEN k = 4 THEN CASE style WHEN 'Streetwear' THEN 88 WHEN 'Sport' THEN 82 ELSE 66 END ELSE CASE style WHEN 'Streetwear' THEN 64 ELSE 38 END END AS color_count,
   CASE WHEN len(pg) = 0 THEN 55 WHEN gl > 0 AND gd > 0 THEN 100 WHEN gm > 0 AND (gl > 0 OR gd > 0) THEN 91 WHEN gd = len(pg) THEN CASE WHEN style IN ('Luxury', 'Classic') THEN 88 ELSE 76 END
    WHEN gl = len(pg) THEN CASE WHEN style IN ('Minimal', 'Sport') THEN 84 ELSE 72 END ELSE 78 END AS light_dark,
   CASE WHEN st = 0 THEN CASE WHEN ne > 0 THEN 92 ELSE 68 END WHEN st = 1 AND ne >= 1 THEN 100 WHEN st = 2 AND ne >= 2 THEN 82 WHEN st >= 3 THEN 42 ELSE 70 END AS neutral,
   least(100, greatest(0, 68 + CASE WHEN c_jacket = c_shoes THEN 12 ELSE 0 END + CASE WHEN c_top = c_shoes THEN 12 ELSE 0 END + CASE WHEN c_bottom = c_jacket THEN 10 ELSE 0 END + CASE WHEN k BETWEEN 2 AND 3 THEN 8 ELSE 0 END - CASE WHEN k >= 5 THEN 28 ELSE 0 END)) AS distribution,
   least(100, greatest(0, 72 + CASE WHEN coalesce(weather = 'Hot', FALSE) OR coalesce(season = 'Summer', FALSE) THEN li * 6 - da * 2 ELSE 0 END + CASE WHEN weather = 'Mild' THEN ne * 2 + CASE WHEN li > 0 AND da > 0 THEN 6 ELSE 0 END ELSE 0 END
    + CASE WHEN season = 'Spring' THEN sp * 4 ELSE 0 END + CASE WHEN weather = 'Rainy' AND list_contains(cs, 'White') THEN -8 ELSE 0 END + CASE WHEN weather = 'Rainy' AND ra > 0 THEN 12 ELSE 0 END
    + CASE WHEN style IN ('Minimal', 'Classic', 'Luxury') THEN ne * 4 ELSE 0 END + CASE WHEN style = 'Streetwear' AND st BETWEEN 1 AND 2 THEN 10 ELSE 0 END + CASE WHEN style = 'Sport' AND so > 0 THEN 10 ELSE 0 END)) AS context FROM l4),
  looks AS (SELECT order_key, line_no, part_key, supp_key, style, weather, season, pair_harmony, color_count, light_dark, neutral, CAST(distribution AS int) AS distribution, CAST(context AS int) AS context,
   CAST(least(100, greatest(0, floor(pair_harmony * 0.45e0 + color_count * 0.15e0 + light_dark * 0.15e0 + neutral * 0.1e0 + distribution * 0.1e0 + context * 0.05e0 + 0.5e0))) AS int) AS color_score FROM l5)"""
_HSL = """hsl AS (SELECT *, CASE WHEN mx = mn THEN 0.0e0 WHEN mx = rr THEN (gg - bb) / (mx - mn) + CASE WHEN gg < bb THEN 6 ELSE 0 END WHEN mx = gg THEN (bb - rr) / (mx - mn) + 2 ELSE (rr - gg) / (mx - mn) + 4 END * 60 AS h,
  CASE WHEN mx = mn THEN 0.0e0 WHEN (mx + mn) / 2 > 0.5e0 THEN (mx - mn) / (2 - mx - mn) ELSE (mx - mn) / (mx + mn) END AS s, (mx + mn) / 2 AS l
  FROM (SELECT *, greatest(rr, gg, bb) AS mx, least(rr, gg, bb) AS mn FROM (SELECT *, r / 255.0e0 AS rr, g / 255.0e0 AS gg, b / 255.0e0 AS bb FROM {0})))"""
#: The bands of hue and the shades written out, without the tables and the text that the query uses.
_NAMED = """named AS (SELECT *, CASE WHEN s < 0.08 THEN CASE WHEN l < 0.18 THEN 'Black' WHEN l > 0.86 THEN 'White' WHEN l > 0.68 THEN 'Silver' ELSE 'Gray' END
  WHEN h < 12 OR h >= 345 THEN CASE WHEN l < 0.42 THEN 'Burgundy' WHEN l > 0.68 AND s < 0.65 THEN 'Pink' ELSE 'Red' END WHEN h < 32 THEN CASE WHEN l < 0.36 THEN 'Brown' WHEN s < 0.45 AND l > 0.55 THEN 'Camel' ELSE 'Orange' END
  WHEN h < 52 THEN CASE WHEN l > 0.72 AND s < 0.38 THEN 'Cream' WHEN l > 0.56 AND s < 0.45 THEN 'Beige' WHEN l < 0.42 THEN 'Brown' ELSE 'Camel' END WHEN h < 72 THEN CASE WHEN s < 0.35 THEN 'Khaki' WHEN l < 0.45 THEN 'Gold' ELSE 'Yellow' END
  WHEN h < 165 THEN CASE WHEN s < 0.42 OR l < 0.36 THEN 'Olive' ELSE 'Green' END WHEN h < 195 THEN CASE WHEN l > 0.72 THEN 'Blue' ELSE 'Green' END WHEN h < 245 THEN CASE WHEN l < 0.32 THEN 'Navy' WHEN s < 0.48 AND l < 0.62 THEN 'Denim' ELSE 'Blue' END
  WHEN h < 285 THEN CASE WHEN l < 0.35 THEN 'Navy' ELSE 'Purple' END ELSE CASE WHEN l > 0.58 THEN 'Pink' ELSE 'Purple' END END AS color FROM hsl),
  shaded AS (SELECT *, CASE WHEN color IN ('Gold', 'Silver') THEN color WHEN l < 0.32 THEN CASE color WHEN 'Gray' THEN 'Dark Gray' WHEN 'Blue' THEN 'Dark Blue' WHEN 'Navy' THEN 'Dark Navy' WHEN 'Denim' THEN 'Dark Denim' WHEN 'Camel' THEN 'Dark Camel' WHEN 'Brown' THEN 'Dark Brown' WHEN 'Green' THEN 'Dark Green'
    WHEN 'Red' THEN 'Dark Red' WHEN 'Purple' THEN 'Dark Purple' ELSE color END
  WHEN l > 0.7 THEN CASE color WHEN 'White' THEN 'Cream' WHEN 'Gray' THEN 'Light Gray' WHEN 'Blue' THEN 'Light Blue' WHEN 'Denim' THEN 'Light Denim' WHEN 'Camel' THEN 'Light Camel' WHEN 'Cream' THEN 'Cream' WHEN 'Brown' THEN 'Light Brown' WHEN 'Pink' THEN 'Light Pink' WHEN 'Khaki' THEN 'Light Khaki' ELSE color END
  ELSE color END AS shade FROM named)"""
_CELLS = "WITH " + sql_of("pixels") + """, cells AS (SELECT image_id, CAST(floor(r / 24.0e0 + 0.5e0) AS bigint) AS cr, CAST(floor(g / 24.0e0 + 0.5e0) AS bigint) AS cg, CAST(floor(b / 24.0e0 + 0.5e0) AS bigint) AS cb, count(*) AS n, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM pixels
  WHERE NOT (((r + g + b) / 3.0e0 > 232 AND greatest(r, g, b) - least(r, g, b) < 28) OR (r + g + b) / 3.0e0 < 18) GROUP BY 1, 2, 3, 4),
  best AS (SELECT image_id, CAST(floor(r / n + 0.5e0) AS bigint) AS r, CAST(floor(g / n + 0.5e0) AS bigint) AS g, CAST(floor(b / n + 0.5e0) AS bigint) AS b, n AS pixels FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, cr, cg, cb) AS place FROM cells) WHERE place = 1)"""


def _free_sql() -> str:
    """Normalised names of 'Dark X', '  off-X' and 'X', worked out by the rule in plain Python for the 63 texts there are."""
    rows = []
    for c in COLORS:
        for kind, free in enumerate((f"dark {c}", f"off {c}", c)):
            t = free.lower()
            exact = next((k for k in COLORS if t == k.lower() or t in map(str.lower, C.SHADES[k])), None)
            name = exact or next((k for k in COLORS if any(s.lower() in t or t in s.lower() for s in C.SHADES[k])), C.UNKNOWN)
            bright = "unknown" if name == C.UNKNOWN else next((g for g, words in C.BRIGHTNESS_WORDS if any(w in t for w in words)), C.BRIGHTNESS.get(name))
            full = "unknown" if name == C.UNKNOWN else next((g for g, words in C.SATURATION_WORDS if any(w in t for w in words)), C.SATURATION.get(name))
            rows.append(f"('{c}', {kind}, '{name}', '{bright}', '{full}')")
    return "free(color, kind, normalized, brightness, saturation) AS (VALUES " + ", ".join(rows) + ")"


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0e0 <= 0.04045e0 THEN {c} / 255.0e0 / 12.92e0 ELSE pow(({c} / 255.0e0 + 0.055e0) / 1.055e0, 2.4e0) END"


_HSV = """p AS (SELECT image_id, r / 255.0e0 AS rr, g / 255.0e0 AS gg, b / 255.0e0 AS bb, 200 / 255.0e0 AS r2, 90 / 255.0e0 AS g2, 20 / 255.0e0 AS b2 FROM pixels), x AS (SELECT *, greatest(rr, gg, bb) AS mx, greatest(rr, gg, bb) - least(rr, gg, bb) AS d FROM p),
  y AS (SELECT *, CASE WHEN d = 0 THEN 0.0e0 WHEN mx = rr THEN CASE WHEN gg < bb THEN (gg - bb) / d / 6 + 1 ELSE (gg - bb) / d / 6 END WHEN mx = gg THEN ((bb - rr) / d + 2) / 6 ELSE ((rr - gg) / d + 4) / 6 END AS h, CASE WHEN mx = 0 THEN 0.0e0 ELSE d / mx END AS s, mx AS v,
    (g2 - b2) / (r2 - b2) / 6 AS h2, (r2 - b2) / r2 AS s2 FROM x),
  z AS (SELECT *, 0.15e0 + (s + s2) / 2 * 0.35e0 AS w, least(abs(h - h2), 1 - abs(h - h2)) * 2 AS hd FROM y)"""
ORACLES = {
    "hsv_distances": "WITH " + sql_of("pixels") + f", {_HSV} SELECT image_id, round(avg(h), 4) AS mean_h, round(avg(s), 4) AS mean_s, round(avg(v), 4) AS mean_v, round(avg(least(1.0e0, hd * w + abs(s - s2) * 0.22e0 + abs(v - r2) * (1 - w - 0.22e0))), 4) AS mean_d FROM z GROUP BY 1",
    "wardrobe_newest": _W + " SELECT * FROM wardrobe WHERE owner_id = 3 ORDER BY created_seq DESC, id",
    "wardrobe_search": _W + " SELECT * FROM wardrobe WHERE contains(lower(category), 'red') OR contains(lower(name), 'red') OR contains(lower(color), 'red')",
    "wardrobe_category": _W + " SELECT * FROM wardrobe WHERE category = 'Shoes'",
    "wardrobe_exclude": _W + " SELECT * FROM wardrobe WHERE NOT favorite",
    "wardrobe_stats": _W + """ SELECT owner_id, count(*) FILTER (WHERE category = 'Tops') AS tops, count(*) FILTER (WHERE category IN ('Pants', 'Shorts')) AS pants, count(*) FILTER (WHERE category = 'Shoes') AS shoes,
      count(*) FILTER (WHERE category = 'Jackets') AS jackets, count(*) FILTER (WHERE category = 'Accessories') AS accessories, count(*) FILTER (WHERE favorite) AS favorites FROM wardrobe GROUP BY 1""",
    "wardrobe_latest_job_join": _W + ", " + sql_of("jobs") + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_ms DESC, job_id) AS place FROM jobs) WHERE place = 1),
      d AS (SELECT w.id, w.owner_id, l.job_id, l.progress, CASE WHEN l.status IS NULL OR l.status = 'completed' THEN 'ready' WHEN l.status IN ('failed', 'cancelled') THEN 'failed' ELSE 'pending' END AS display_status FROM wardrobe w LEFT JOIN l ON l.item_id = w.id)
      SELECT id, owner_id, job_id, display_status, CASE WHEN display_status = 'pending' THEN CAST(floor(progress * 100 + 0.5e0) AS int) END AS display_progress FROM d""",
    "best_match_items": _W + f""", {_MATCHES}, r AS (SELECT d.id AS draft_id, w.id, row_number() OVER (PARTITION BY d.id ORDER BY w.created_seq DESC, w.id) AS rank FROM wardrobe d JOIN m ON m.color = d.color JOIN wardrobe w ON w.owner_id = d.owner_id AND w.color = m.other
      AND w.category <> d.category AND w.id <> d.id WHERE d.favorite) SELECT draft_id, CAST(rank AS int) AS rank, id FROM r WHERE rank <= 4""",
    "preference_top5": "WITH " + sql_of("outfits") + """, e AS (SELECT supp_key, CASE WHEN part_key % 7 = 0 THEN 3 ELSE 1 END AS w, unnest(['color', 'color', 'color', 'color', 'occasion', 'weather', 'season']) AS dimension, unnest([top, bottom, shoes, jacket, occasion, weather, season]) AS value FROM outfits),
      c AS (SELECT supp_key, dimension, value, CAST(sum(w) AS bigint) AS n FROM e WHERE value IS NOT NULL GROUP BY 1, 2, 3) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY supp_key, dimension ORDER BY n DESC, value) AS int) AS rank FROM c) WHERE rank <= 5""",
    "color_normalize": f"{_W}, {_free_sql()} SELECT id, normalized, brightness, saturation FROM wardrobe JOIN free ON free.color = wardrobe.color AND free.kind = id % 3",
    "pair_color_matrix": f"{_W}, {_pairs()}, n AS (SELECT a.color AS first, b.color AS second, count(*) AS n FROM wardrobe a JOIN wardrobe b USING (owner_id) GROUP BY 1, 2) SELECT first, second, n, score FROM n JOIN pairs USING (first, second)",
    "color_score_outfit": _LOOKS + " SELECT * FROM looks",
    "color_score_by_style": _LOOKS + " SELECT style, count(*) AS looks, max(color_score) AS best, min(color_score) AS worst, CAST(sum(color_score) AS bigint) AS total FROM looks GROUP BY 1",
    "dominant_color": f"{_CELLS}, {_HSL.format('best')}, {_NAMED} SELECT image_id, r, g, b, pixels, color, shade FROM shaded",
    "classify_color": f"WITH {sql_of('pixels')}, {_HSL.format('pixels')}, {_NAMED} SELECT image_id, color, shade, count(*) AS pixels FROM shaded GROUP BY 1, 2, 3",
    "color_distances": f"""WITH {sql_of('pixels')}, k AS (SELECT *, {_linear('r')} AS x, {_linear('g')} AS y, {_linear('b')} AS z FROM pixels),
      v AS (SELECT *, (x * 0.4124564e0 + y * 0.3575761e0 + z * 0.1804375e0) / 0.95047e0 AS vx, x * 0.2126729e0 + y * 0.7151522e0 + z * 0.0721750e0 AS vy, (x * 0.0193339e0 + y * 0.1191920e0 + z * 0.9503041e0) / 1.08883e0 AS vz FROM k),
      f AS (SELECT *, CASE WHEN vx > 0.008856e0 THEN cbrt(vx) ELSE vx * 7.787e0 + 16 / 116.0e0 END AS fx, CASE WHEN vy > 0.008856e0 THEN cbrt(vy) ELSE vy * 7.787e0 + 16 / 116.0e0 END AS fy, CASE WHEN vz > 0.008856e0 THEN cbrt(vz) ELSE vz * 7.787e0 + 16 / 116.0e0 END AS fz FROM v)
      SELECT image_id, round(avg(fy * 116 - 16), 4) AS mean_l, round(avg((fx - fy) * 500), 4) AS mean_a, round(avg((fy - fz) * 200), 4) AS mean_b_star, round(avg(sqrt((r - 128.0e0) ** 2 + (g - 128.0e0) ** 2 + (b - 128.0e0) ** 2)), 4) AS mean_d,
      round(avg((r * 0.2126e0 + g * 0.7152e0 + b * 0.0722e0) / 255), 4) AS mean_y FROM f GROUP BY 1""",
}
