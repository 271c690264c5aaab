"""Queries that evaluate looks by all rules."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import look_rules as L
from ..functions.num import compiled_apart
from ..operators import outfits as O
from ..operators import ranking as R
from ..sources.shared import kept, spread
from ..sources.tables import derived, sql_of
from .styling import _LOOKS, SLOTS

#: What is written about the items of a look, derived from its keys; both engines take these expressions.
TEXTS = {
    "is_dress": "part_key % 11 = 6",
    "top_t": "lower(concat(CASE WHEN part_key % 11 = 6 THEN 'Evening dress' ELSE CASE part_key % 6 WHEN 0 THEN 'T-Shirt' WHEN 1 THEN 'Shirt' WHEN 2 THEN 'Polo' WHEN 3 THEN 'Hoodie' WHEN 4 THEN 'Sweater' ELSE 'Blouse' END END, ' ', top))",
    "bottom_t": "CASE WHEN bottom IS NULL THEN NULL ELSE lower(concat(CASE supp_key % 6 WHEN 0 THEN 'Formal pants' WHEN 1 THEN 'Jeans' WHEN 2 THEN 'Cargo' WHEN 3 THEN 'Joggers' WHEN 4 THEN 'Shorts' ELSE 'Skirt' END, ' ', bottom)) END",
    "shoes_t": "lower(concat(CASE order_key % 5 WHEN 0 THEN 'Sneakers' WHEN 1 THEN 'Boots' WHEN 2 THEN 'Loafers' WHEN 3 THEN 'Sandals' ELSE 'Heels' END, ' ', shoes))",
    "jacket_t": "CASE WHEN jacket IS NULL THEN NULL ELSE lower(concat(CASE line_no % 4 WHEN 0 THEN 'Blazer' WHEN 1 THEN 'Coat' WHEN 2 THEN 'Sport jacket' ELSE 'Bomber' END, ' ', jacket)) END",
    "accessory_t": "CAST(NULL AS varchar(9))",
    "accessory": "CAST(NULL AS varchar(9))",
}
_FAVORITES = "CAST(floor(100.0e0 * (CASE WHEN part_key % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN bottom IS NOT NULL AND supp_key % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN order_key % 4 = 0 THEN 1 ELSE 0 END) / (2 + CASE WHEN bottom IS NULL THEN 0 ELSE 1 END + CASE WHEN jacket IS NULL THEN 0 ELSE 1 END) + 0.5e0) AS int)"
_SCORES = {"style_score": L.style_score(), "occasion_score": L.occasion_score(), "weather_score": L.weather_score(), "season_score": L.weather_score("season"), "accessory_score": L.accessory_score(), "favorite_score": _FAVORITES}
_FINAL = "CAST(least(100, greatest(0, floor(color_score * 0.3e0 + style_score * 0.25e0 + occasion_score * 0.15e0 + weather_score * 0.1e0 + season_score * 0.1e0 + accessory_score * 0.05e0 + favorite_score * 0.05e0 + 0.5e0))) AS int)"
_KEYS = ("order_key", "line_no", "part_key", "supp_key")


def _texts(rows):
    for name, sql in TEXTS.items():
        rows = rows.withColumn(name, F.expr(sql))
    return _with(rows, L.kinds())


def _with(rows, columns):
    """rows with columns by their SQL, which is too much of it for one function (see compiled_apart)."""
    first, *others = rows.columns
    return rows.select(compiled_apart(F.col(first)).alias(first), *others, *[F.expr(sql).alias(name) for name, sql in columns.items()])


def _scored(rows):
    """The scores of _SCORES, of looks with kinds."""
    return _with(_with(rows, L.prepared()), _SCORES)


def hard_rejections(spark, sf):
    rows = _texts(spread(derived(spark, sf, "outfits")))
    reasons = F.array_compact(F.array(*[F.when(F.expr(sql), F.lit(reason)) for sql, reason in L.rejections()]))
    return rows.select(*_KEYS, F.concat_ws(" ", reasons).alias("reasons"), F.size(reasons).cast("long").alias("n_reasons"))


def rule_scores(spark, sf):
    return _scored(_texts(spread(derived(spark, sf, "outfits")))).select(*_KEYS, *_SCORES)


def _evaluated(spark, sf):
    rows = _texts(O.color_scores(spread(derived(spark, sf, "outfits")), SLOTS))
    rejected = F.lit(False)
    for sql, _ in L.rejections():
        rejected = rejected | F.coalesce(F.expr(sql), F.lit(False))
    rows = _scored(rows).withColumn("final_score", F.expr(_FINAL))
    return rows.withColumn("accepted", ~rejected & (F.col("final_score") >= F.expr(L.least_score())))


def outfit_evaluation(spark, sf):
    return _evaluated(spark, sf).select(*_KEYS, "color_score", "style_score", "final_score", "accepted")


def outfit_evaluation_topk(spark, sf):
    """The ten best accepted looks of each supplier's wardrobe."""
    # a filter before the ranking would be pushed below the scores and work them out twice
    rows = _evaluated(spark, sf).withColumn("worth", F.when(F.col("accepted"), F.col("final_score")).otherwise(-1)).withColumn("ordinal", F.struct("order_key", "line_no", "part_key"))
    return R.best(rows, "supp_key", "worth", 10).where("worth >= 0").select("supp_key", "rank", "order_key", "line_no", "part_key", "final_score")


def match_scores(spark, sf):
    """What is shown of a look: how its colours match, how it suits its style and the weather, and its score; 0 without a top or shoes.

    The colours are judged as in a Minimal look of no weather, and no occasion counts."""
    looks = spread(derived(spark, sf, "outfits")).withColumns({"shoes": F.when(F.col("order_key") % 13 != 0, F.col("shoes")), "occasion": F.lit(None).cast("string")})
    looks = O.with_codes(looks, SLOTS)  # once for both
    none = F.lit(None).cast("string")
    own = {c: f"own {c}" for c in ("style", "weather", "season")}
    plain = O.color_scores(looks.withColumnsRenamed(own).withColumns({"style": F.lit("Minimal"), "weather": none, "season": none}), SLOTS)
    rows = plain.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in looks.columns], F.col("color_score").alias("color_match"))
    rows = _scored(_texts(O.color_scores(rows, SLOTS))).withColumn("final_score", F.expr(_FINAL))
    shown = lambda c: F.when(F.col("top").isNotNull() & F.col("shoes").isNotNull(), F.col(c)).otherwise(0)
    return rows.select(*_KEYS, shown("color_match").alias("color_match"), shown("style_score").alias("style_match"), shown("weather_score").alias("weather_match"), shown("final_score").alias("total"))


#: What accessories are called, so that there are watches and caps among them; both engines take this expression.
ITEM_NAME = "CASE WHEN category = 'Accessories' AND id % 3 = 0 THEN 'Steel watch' WHEN category = 'Accessories' AND id % 3 = 1 THEN 'Wool cap' WHEN category = 'Tops' AND id % 4 = 0 THEN 'Shirt' WHEN category = 'Tops' AND id % 4 = 1 THEN 'T-Shirt' WHEN category = 'Pants' AND id % 2 = 0 THEN 'Formal pants' WHEN category = 'Pants' THEN 'Jeans' WHEN category = 'Shoes' AND id % 3 = 0 THEN 'Loafers' WHEN category = 'Shoes' THEN 'Sneakers' ELSE name END"
_FILLED = ("bag", "cap", "watch", "accessory")


def _owners(spark, sf, extra=None):
    """Each owner's wardrobe, with what is worked out once an item."""
    return kept(R.wardrobes(derived(spark, sf, "wardrobe").withColumn("name", F.expr(ITEM_NAME)), extra=extra))


def accessory_fill(spark, sf):
    """The accessories that each different look gets."""
    owners = _owners(spark, sf)
    return R.dressed(R.unique_looks(owners)).select("owner_id", "ordinal", *[F.col(f"{s}.id").alias(s) for s in _FILLED])


def rank_looks(looks):
    """The ten best of an owner's looks, whose pieces have kinds and code: for a Minimal look at work on a mild spring day. Rejected
    ones and those under the least score don't count; of equals the earlier one is first."""
    worn = lambda s: F.col(f"{s}.id").isNotNull()
    count = lambda slots: sum((worn(s).cast("int") for s in slots), F.lit(0))
    favorites = sum((F.when(F.col(f"{s}.favorite"), 1).otherwise(0) for s in R.WORN), F.lit(0)) * 100 / count(R.WORN)
    bits = {s: F.col(f"{s}.kinds") for s in L.SLOTS[:4]} | {"accessory": functools.reduce(lambda a, b: a.bitwiseOR(b), [F.coalesce(F.col(f"{s}.kinds"), F.lit(0)) for s in _FILLED])}
    there = {s: worn(s) for s in L.SLOTS[:4]} | {"accessory": count(_FILLED) > 0}
    flat = looks.select(
        compiled_apart(F.col("owner_id")).alias("owner_id"), "ordinal", F.concat_ws("|", *[F.coalesce(F.col(f"{s}.id").cast("string"), F.lit("none")) for s in R.WORN]).alias("identity"), *[F.col(f"{s}.color").alias(s) for s in R.WORN], *[F.col(f"{s}.code").alias(f"{s}_code") for s in R.WORN],
        *[F.when(there[s], F.lit("")).alias(f"{s}_t") for s in L.SLOTS], *[F.coalesce(b, F.lit(0)).alias(f"{s}_kinds") for s, b in bits.items()], "is_dress", F.when(count(_FILLED) > 3, 10).otherwise(0).alias("crowded"), F.floor(favorites + 0.5).cast("int").alias("favorite_score"),
        F.lit("Minimal").alias("style"), F.lit("Work").alias("occasion"), F.lit("Mild").alias("weather"), F.lit("Spring").alias("season"),
    )
    rejected = F.lit(False)
    for sql, _ in L.rejections():
        rejected = rejected | F.coalesce(F.expr(sql), F.lit(False))
    rows = _with(O.color_scores(flat.where(~rejected), R.WORN), L.prepared(R.WORN))  # what rejects a look are a few bits; its scores take longer
    scores = {"style_score": L.style_score(), "occasion_score": L.occasion_score(), "weather_score": L.weather_score(), "season_score": L.weather_score("season"), "accessory_score": f"greatest(0, {L.accessory_score()} - crowded)"}
    rows = _with(rows, scores).withColumn("final_score", F.expr(_FINAL))
    rows = rows.withColumn("worth", F.when(F.col("final_score") >= F.expr(L.least_score()), F.col("final_score")).otherwise(-1))
    return R.best(rows, "owner_id", "worth", 10).where("worth >= 0").select("owner_id", "rank", "identity", "color_score", "style_score", "final_score")


def of_item() -> dict:
    """What the ranking needs of an item, worked out before any look is made: the kinds that its texts name, and its colour's code."""
    color = C.normalize(F.col("color"))
    return {"kinds": F.expr(L.kind_bits("lower(concat_ws(' ', category, name, color))")), "code": F.when(F.col("color").isNotNull(), C.code(color, C.brightness(F.col("color"), color)))}


def outfit_rank_full(spark, sf):
    """The ten best looks of each wardrobe by the full evaluation."""
    owners = _owners(spark, sf, of_item())
    return rank_looks(R.dressed(R.unique_looks(owners)))


QUERIES = {f.__name__: f for f in (match_scores, accessory_fill, outfit_rank_full, hard_rejections, rule_scores, outfit_evaluation, outfit_evaluation_topk)}

_TEXT_SQL = ", ".join(f"{sql} AS {name}" for name, sql in TEXTS.items())


def _in(names: str) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names.split()) + ")"


def _of(names: str) -> str:
    return f"len(list_filter(cl, lambda c: c IN {_in(names)}))"


def _rated(base: str) -> str:
    return f"CAST(least(100, greatest(0, floor({base} + 0.5e0))) AS int)"


def _style(good: str, bad: str, wrong: int, most: int, few: int, many: int, jacket: int, points: str) -> str:
    return _rated(f"60 + 5 * {_of(good)} - {wrong} * {_of(bad) if bad else 0} + CASE WHEN len(list_distinct(cl)) <= {most} THEN {few} ELSE -{many} END + CASE WHEN j THEN {jacket} ELSE 0 END + {points} + (pair - 70) * 0.25e0")


def _if(*rules) -> str:
    return " + ".join(f"CASE {' '.join(f'WHEN {w} THEN {n}' for w, n in zip(r[::2], r[1::2], strict=True))} ELSE 0 END" for r in rules)


#: Written out rule by rule from the rules' description, without the tables and the text that the queries use.
_RULES = f"""{_LOOKS}, tx AS (SELECT l5.*, {_TEXT_SQL} FROM l5),
  fam(k) AS (VALUES {', '.join(f"('{c}>{m}')" for c, names in L.FAMILIES.items() for m in names)}),
  kd AS (SELECT *, list_filter([top, bottom, shoes, jacket], lambda c: c IS NOT NULL) AS cl, regexp_matches(top_t, 'tshirt|t-shirt|tee') AS tee, contains(top_t, 'shirt') AND NOT regexp_matches(top_t, 'tshirt|t-shirt|tee') AS shirt, contains(top_t, 'polo') AS polo, contains(top_t, 'hoodie') AS hoodie, contains(top_t, 'sweater') AS sweater,
    coalesce(regexp_matches(bottom_t, 'shorts|short pants'), FALSE) AS short, coalesce(contains(bottom_t, 'skirt'), FALSE) AS skirt, coalesce(contains(bottom_t, 'formal'), FALSE) AS formal, coalesce(regexp_matches(bottom_t, 'jeans|denim'), FALSE) AS jeans, coalesce(contains(bottom_t, 'cargo'), FALSE) AS cargo, coalesce(regexp_matches(bottom_t, 'jogger|sweatpants'), FALSE) AS jog,
    contains(shoes_t, 'sneaker') AS sneak, contains(shoes_t, 'boot') AS boot, contains(shoes_t, 'loafer') AS loafer, contains(shoes_t, 'sandal') AS sandal, contains(shoes_t, 'sport') AS sporty, jacket_t IS NOT NULL AS j, coalesce(contains(jacket_t, 'coat'), FALSE) AS coat, coalesce(contains(jacket_t, 'sport'), FALSE) AS jsport,
    coalesce(top, 'Black') AS pa, coalesce(bottom, 'Black') AS pb FROM tx),
  pr AS (SELECT *, CASE WHEN pa = pb THEN 88 WHEN pa IN {_in('Black White Gray Beige Brown Navy Cream')} AND pb IN {_in('Black White Gray Beige Brown Navy Cream')} THEN 95 WHEN concat(pa, '>', pb) IN (SELECT k FROM fam) OR concat(pb, '>', pa) IN (SELECT k FROM fam) THEN 92
    WHEN least(pa, pb) || greatest(pa, pb) IN ('GreenRed', 'PurpleYellow', 'OrangePink', 'OrangeRed', 'GreenPurple') THEN 45 ELSE 70 END AS pair FROM kd),
  rj AS (SELECT *, list_filter([CASE WHEN NOT is_dress AND bottom_t IS NULL THEN 'Missing bottom.' END,
    CASE WHEN style = 'Luxury' AND short THEN 'Luxury outfits do not use shorts.' END, CASE WHEN style = 'Luxury' AND hoodie THEN 'Hoodies are not suitable for the selected Luxury style.' END, CASE WHEN style = 'Luxury' AND (cargo OR jog) THEN 'Cargo and joggers are not suitable for Luxury outfits.' END, CASE WHEN style = 'Luxury' AND sandal THEN 'Sandals are not suitable for Luxury outfits.' END,
    CASE WHEN style = 'Classic' AND short THEN 'Classic outfits do not use shorts.' END, CASE WHEN style = 'Classic' AND (cargo OR jog) THEN 'Cargo and joggers are not suitable for Classic outfits.' END, CASE WHEN style = 'Classic' AND hoodie THEN 'Hoodies are not suitable for Classic outfits.' END, CASE WHEN style = 'Classic' AND sandal THEN 'Sandals are not suitable for Classic outfits.' END,
    CASE WHEN style = 'Sport' AND j AND NOT jsport THEN 'This jacket is not suitable for a Sport outfit.' END, CASE WHEN style = 'Sport' AND (loafer OR boot) THEN 'Loafers and boots are not suitable for this Sport outfit.' END,
    CASE WHEN occasion = 'Work' AND short THEN 'Shorts are not suitable for Work.' END, CASE WHEN occasion = 'Work' AND (hoodie OR tee) THEN 'This top is too casual for Work.' END, CASE WHEN occasion = 'Work' AND sandal THEN 'Sandals are not suitable for Work.' END,
    CASE WHEN occasion = 'Date' AND short THEN 'Shorts are not suitable for this Date outfit.' END, CASE WHEN occasion = 'Date' AND jog THEN 'Joggers are too casual for this Date outfit.' END, CASE WHEN occasion = 'Party' AND jog THEN 'Joggers are not suitable for this Party outfit.' END,
    CASE WHEN occasion = 'Sport' AND NOT sneak AND NOT sporty THEN 'Sport outfits require sneakers.' END, CASE WHEN occasion = 'Summer' AND j THEN 'Summer outfits should not include a jacket.' END, CASE WHEN occasion = 'Summer' AND boot THEN 'Boots are not suitable for Summer.' END,
    CASE WHEN weather = 'Hot' AND j THEN 'Hot weather outfits should not include a jacket.' END, CASE WHEN weather = 'Hot' AND boot THEN 'Boots are not suitable for hot weather.' END, CASE WHEN weather = 'Rainy' AND sandal THEN 'Sandals are not suitable for rainy weather.' END, CASE WHEN season = 'Summer' AND coat THEN 'A coat is not suitable for Summer.' END],
    lambda r: r IS NOT NULL) AS rs FROM pr),
  sc AS (SELECT *, CASE style
    WHEN 'Minimal' THEN {_style('Black White Gray Beige Brown Navy', 'Yellow Orange Pink Purple', 15, 3, 15, 25, 4, _if((f"len(cl) = {_of('Black White Gray Beige Brown Navy Cream')}", 20), ('tee OR shirt OR polo', 10), ('jeans OR formal', 10), ('sneak', 8)))}
    WHEN 'Classic' THEN {_style('Black White Gray Navy Brown Beige', 'Pink Orange Yellow Purple', 20, 3, 20, 30, 18, _if(('shirt OR polo OR sweater', 22), ('formal OR jeans', 18), ('loafer OR boot', 20), ('j', 12)))}
    WHEN 'Luxury' THEN {_style('Black White Gray Navy Brown Beige', 'Yellow Orange Pink Purple Green', 25, 3, 25, 35, 25, _if(('shirt OR polo', 25), ('formal', 25, 'jeans', 10), ('loafer', 25, 'boot', 15, 'sneak', -8), ('j', 20)))}
    WHEN 'Streetwear' THEN {_style('Black White Gray Green Blue Red', '', 8, 5, 15, 10, 10, _if(('hoodie OR tee', 22), ('cargo OR jeans', 22), ('sneak', 25)))}
    ELSE {_style('Black White Blue Gray', 'Brown Purple', 10, 4, 15, 15, -10, _if(('tee OR hoodie', 20), ('short OR jog', 25), ('sneak', 30)))} END AS style_score,
    CASE occasion WHEN 'Casual' THEN {_rated(f"65 + 5 * {_of('Black White Gray Blue Green Brown Beige')} + " + _if(('tee OR polo OR hoodie', 15), ('jeans OR cargo OR short', 15), ('sneak', 15)))}
    WHEN 'Work' THEN {_rated(f"65 + 5 * {_of('Black White Gray Navy Brown Beige')} + " + _if(('shirt OR polo', 25), ('formal', 25), ('loafer', 20), ('j', 10)))}
    WHEN 'Date' THEN {_rated(f"65 + 5 * {_of('Black White Gray Navy Brown Beige Red')} + " + _if(('shirt OR polo OR sweater', 18), ('formal OR jeans', 18), ('loafer OR boot', 16)))}
    WHEN 'Party' THEN {_rated(f"65 + 5 * {_of('Black White Gray Red Navy')} + " + _if(('shirt OR polo OR tee', 15), ('jeans OR formal', 15), ('sneak OR loafer', 15)))}
    WHEN 'Sport' THEN {_rated(f"65 + 5 * {_of('Black White Blue Gray')} + " + _if(('tee OR hoodie', 20), ('short OR jog', 25), ('sneak', 25)))}
    WHEN 'Summer' THEN {_rated(f"65 + 5 * {_of('White Beige Blue Gray Green')} + " + _if(('tee OR polo', 15), ('short OR skirt', 20), ('sneak OR sandal', 15), ('NOT j', 10)))} ELSE 75 END AS occasion_score,
    CASE weather WHEN 'Hot' THEN {_rated(f"65 + 5 * {_of('White Beige Blue Gray Green')} + " + _if(('NOT j', 20), ('short OR skirt', 15), ('sandal OR sneak', 10)))}
    WHEN 'Mild' THEN {_rated(f"80 + 5 * {_of('Black White Gray Brown Beige Blue')} + " + _if(('j AND NOT coat', 5)))}
    WHEN 'Rainy' THEN {_rated(f"65 + 5 * {_of('Black Gray Brown Navy')} - 10 * {_of('White')} + " + _if(('j', 15, 'TRUE', 5), ('boot', 20), ('sandal', -40)))} ELSE 75 END AS weather_score,
    CASE season WHEN 'Spring' THEN {_rated(f"65 + 5 * {_of('White Blue Green Gray Beige')} + " + _if((f"{_of('White Blue Green Beige Gray')} > 0", 15), ('j AND NOT coat', 5)))}
    WHEN 'Summer' THEN {_rated(f"65 + 5 * {_of('White Beige Blue Gray Green')} + " + _if(('NOT j', 20), ('short OR skirt', 15), (f"{_of('White Beige Cream Gray')} > 0 OR list_contains(cl, 'Light Blue')", 10)))} ELSE 75 END AS season_score,
    65 AS accessory_score, {_FAVORITES} AS favorite_score,
    CAST(least(100, greatest(0, floor(pair_harmony * 0.45e0 + color_count * 0.15e0 + light_dark * 0.15e0 + neutral * 0.1e0 + distribution * 0.1e0 + context * 0.05e0 + 0.5e0))) AS int) AS color_score FROM rj),
  ev AS (SELECT *, CAST(least(100, greatest(0, floor(color_score * 0.3e0 + style_score * 0.25e0 + occasion_score * 0.15e0 + weather_score * 0.1e0 + season_score * 0.1e0 + accessory_score * 0.05e0 + favorite_score * 0.05e0 + 0.5e0))) AS int) AS final_score FROM sc),
  ac AS (SELECT *, len(rs) = 0 AND final_score >= CASE style WHEN 'Minimal' THEN 78 WHEN 'Classic' THEN 82 WHEN 'Luxury' THEN 85 ELSE 72 END AS accepted FROM ev)"""
_K = ", ".join(_KEYS)


def _rules_of(**columns: str) -> str:
    """The rules for looks whose columns are replaced."""
    table = sql_of("outfits")
    changed = ", ".join(f"{sql} AS {c}" for c, sql in columns.items())
    return _RULES.replace(table, f"given0 AS (WITH {table} SELECT * FROM outfits), outfits AS (SELECT * REPLACE ({changed}) FROM given0)")


_SHOES, _NONE = "CASE WHEN order_key % 13 <> 0 THEN shoes END", "CAST(NULL AS varchar)"
_POOL = "CASE WHEN lower(trim(category)) IN ('bag', 'bags') THEN 'bag' WHEN regexp_matches(lower(category || ' ' || coalesce(nm, '')), 'handbag|backpack') THEN 'bag' WHEN regexp_matches(lower(category || ' ' || coalesce(nm, '')), 'cap|hat') THEN 'cap' WHEN contains(lower(coalesce(nm, '')), 'watch') THEN 'watch' ELSE 'other' END"
ORACLES = {
    "match_scores": f"""WITH c AS ({_rules_of(shoes=_SHOES, occasion=_NONE, style="'Minimal'", weather=_NONE, season=_NONE)} SELECT DISTINCT {_K}, color_score FROM sc), e AS ({_rules_of(shoes=_SHOES, occasion=_NONE)} SELECT * FROM ev)
      SELECT {', '.join('e.' + k for k in _KEYS)}, {', '.join(f'CASE WHEN e.top IS NOT NULL AND e.shoes IS NOT NULL THEN {x} ELSE 0 END AS {n}' for x, n in (('c.color_score', 'color_match'), ('e.style_score', 'style_match'), ('e.weather_score', 'weather_match'), ('e.final_score', 'total')))} FROM e JOIN c USING ({_K})""",
    "accessory_fill": "WITH RECURSIVE " + sql_of("wardrobe") + f""", i AS (SELECT *, {ITEM_NAME} AS nm, CASE WHEN category = 'Tops' THEN 'T' WHEN category IN ('Pants', 'Shorts', 'Skirts') THEN 'B' WHEN category IN ('Shoes', 'Heels') THEN 'S' WHEN category = 'Jackets' THEN 'J' WHEN category = 'Dresses' THEN 'D' ELSE 'A' END AS role FROM wardrobe),
      a AS (SELECT *, {_POOL} AS slot FROM i WHERE role = 'A'), o AS (SELECT DISTINCT owner_id FROM i), jo AS (SELECT owner_id, CAST(NULL AS bigint) AS id FROM o UNION ALL SELECT owner_id, id FROM i WHERE role = 'J'), ao AS (SELECT owner_id, CAST(NULL AS bigint) AS id, 'other' AS slot FROM o UNION ALL SELECT owner_id, id, slot FROM a),
      c AS (SELECT t.owner_id, 0 AS part, t.id AS top, b.id AS bottom, s.id AS shoes, j.id AS jacket, x.id AS acc, x.slot FROM i t JOIN i b ON b.owner_id = t.owner_id AND b.role = 'B' JOIN i s ON s.owner_id = t.owner_id AND s.role = 'S' JOIN jo j ON j.owner_id = t.owner_id JOIN ao x ON x.owner_id = t.owner_id WHERE t.role = 'T'
        UNION ALL SELECT t.owner_id, 1, t.id, NULL, s.id, j.id, x.id, x.slot FROM i t JOIN i s ON s.owner_id = t.owner_id AND s.role = 'S' JOIN jo j ON j.owner_id = t.owner_id JOIN ao x ON x.owner_id = t.owner_id WHERE t.role = 'D'),
      n AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY part, top, bottom NULLS FIRST, shoes, jacket NULLS FIRST, acc NULLS FIRST) AS step, dense_rank() OVER (PARTITION BY owner_id ORDER BY part, top, bottom NULLS FIRST, shoes, jacket NULLS FIRST) AS combo FROM c),
      p AS (SELECT owner_id, list(id ORDER BY id) FILTER (WHERE slot = 'bag') AS bags, list(id ORDER BY id) FILTER (WHERE slot = 'cap') AS caps, list(id ORDER BY id) FILTER (WHERE slot = 'watch') AS watches, list(id ORDER BY id) FILTER (WHERE slot = 'other') AS others FROM a GROUP BY 1),
      loop(owner_id, step, combo, n, before, seen, bag, cap, watch, other, fresh) AS (SELECT DISTINCT owner_id, CAST(0 AS bigint), CAST(0 AS bigint), CAST(0 AS bigint), CAST(0 AS bigint), CAST([] AS varchar[]), CAST(NULL AS bigint), CAST(NULL AS bigint), CAST(NULL AS bigint), CAST(NULL AS bigint), FALSE FROM n
        UNION ALL SELECT owner_id, step, combo, n + CASE WHEN fresh THEN 1 ELSE 0 END, n, CASE WHEN fresh THEN list_append(old, look) ELSE old END, bag, cap, watch, other, fresh FROM (SELECT *, NOT list_contains(old, look) AS fresh FROM (SELECT *, concat_ws('|', coalesce(CAST(bag AS varchar), '-'), coalesce(CAST(cap AS varchar), '-'), coalesce(CAST(watch AS varchar), '-'), coalesce(CAST(other AS varchar), '-')) AS look FROM (
          SELECT l.owner_id, n.step, n.combo, l.n, CASE WHEN n.combo = l.combo THEN l.seen ELSE CAST([] AS varchar[]) END AS old, coalesce(CASE WHEN slot = 'bag' THEN acc END, bags[l.n % len(bags) + 1]) AS bag, coalesce(CASE WHEN slot = 'cap' THEN acc END, caps[(l.n + 1) % len(caps) + 1]) AS cap,
            coalesce(CASE WHEN slot = 'watch' THEN acc END, watches[(l.n + 2) % len(watches) + 1]) AS watch, coalesce(CASE WHEN slot = 'other' THEN acc END, others[(l.n + 3) % len(others) + 1]) AS other
          FROM loop l JOIN n ON n.owner_id = l.owner_id AND n.step = l.step + 1 LEFT JOIN p ON p.owner_id = l.owner_id WHERE l.n < 50000))))
      SELECT owner_id, before AS ordinal, bag, cap, watch, other AS accessory FROM loop WHERE fresh""",
    "hard_rejections": f"{_RULES} SELECT {_K}, array_to_string(rs, ' ') AS reasons, len(rs) AS n_reasons FROM rj",
    "rule_scores": f"{_RULES} SELECT {_K}, style_score, occasion_score, weather_score, season_score, accessory_score, favorite_score FROM sc",
    "outfit_evaluation": f"{_RULES} SELECT {_K}, color_score, style_score, final_score, accepted FROM ac",
    "outfit_evaluation_topk": f"{_RULES} SELECT supp_key, CAST(rank AS int) AS rank, order_key, line_no, part_key, final_score FROM (SELECT *, row_number() OVER (PARTITION BY supp_key ORDER BY final_score DESC, order_key, line_no, part_key) AS rank FROM ac WHERE accepted) WHERE rank <= 10",
}
