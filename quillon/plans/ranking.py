"""Queries over candidate looks, clothes and streams."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import wear
from ..functions.color import MATCHES
from ..operators import ranking as R
from ..sources.tables import _SPARK_MS, COLORS, DERIVED, derived, given, sql_of
from ..streaming import upserts
from .transitions import ORACLES as _TRANSITIONS

JOB_TRANSITIONS = _TRANSITIONS["job_transitions"]  # the stream has the rows of the batch query


def _looks(spark, sf):
    return R.candidates(derived(spark, sf, "wardrobe"))


def outfit_candidates(spark, sf):
    return _looks(spark, sf).select("owner_id", "ordinal", *[F.col(f"{s}.id").alias(s) for s in ("top", "bottom", "shoes", "jacket", "accessory")])


def outfit_identity_distinct(spark, sf):
    return R.distinct_looks(_looks(spark, sf))


def _scored(spark, sf):
    c = lambda s: F.col(f"{s}.color")
    parts = wear.older_score(c("top"), c("bottom"), c("shoes"), c("jacket"), c("accessory"), F.lit(30), F.lit("Hot"), F.lit("Summer"), F.lit("Casual"))
    return _looks(spark, sf).select("owner_id", "ordinal", R.identity().alias("identity"), *parts)


def outfit_rank_topk(spark, sf):
    return R.best(_scored(spark, sf), "owner_id", "ai_overall", 10).select("owner_id", "rank", "identity", "ai_overall")


def outfit_rank_summary(spark, sf):
    return _scored(spark, sf).groupBy("owner_id").agg(F.count("*").alias("looks"), F.max("ai_overall").alias("best"), F.count_if(F.col("ai_overall") >= 85).alias("suitable"))


def ai_score_legacy(spark, sf):
    rows = derived(spark, sf, "outfits")
    degrees = (F.col("part_key") % 40 - 5).cast("int")
    parts = wear.older_score(*[F.col(s) for s in ("top", "bottom", "shoes", "jacket")], F.lit(None).cast("string"), degrees, F.col("weather"), F.col("season"), F.col("occasion"))
    return rows.select("order_key", "line_no", "part_key", "supp_key", *parts)


def preference_bonus(spark, sf):
    items = derived(spark, sf, "wardrobe")
    liked = items.where("favorite").groupBy("owner_id").agg(F.collect_set("color").alias("colors"), F.collect_set("category").alias("categories"))
    bonus = lambda c, of, n: F.when(F.coalesce(F.array_contains(of, F.col(c)), F.lit(False)), n).otherwise(0)
    return items.join(liked, "owner_id", "left").select("id", (bonus("color", "colors", 8) + bonus("category", "categories", 6)).alias("bonus"))


_SUB = "CASE id % 5 WHEN 0 THEN 'Boots' WHEN 1 THEN 'Hoodie' WHEN 2 THEN 'Cap' WHEN 3 THEN 'SummerDress' END"


def category_knowledge(spark, sf):
    rows = derived(spark, sf, "wardrobe").withColumn("sub", F.expr(_SUB))
    seasons = wear.seasons(F.col("category"), F.col("sub"))
    return rows.select("id", wear.role(F.col("category"), F.col("sub")).alias("role"), wear.engine_role(F.col("category")).alias("engine_role"), F.concat_ws(",", seasons).alias("seasons"), wear.suits(seasons, F.lit("Summer")).alias("summer"))


def calendar_season(spark, sf):
    return given(spark, sf, "orders").groupBy(wear.calendar_season(F.col("o_orderdate")).alias("season")).agg(F.count("*").alias("orders"))


def weather_class(spark, sf):
    rows = given(spark, sf, "events").select("event_id", F.element_at(F.array(*[F.lit(w) for w in ("Light rain", "hot", "cloudy", "Thunderstorm", None)]), (F.col("event_id") % 5 + 1).cast("int")).alias("w"), (F.col("event_id") % 41 - 3).cast("double").alias("c"))
    return rows.select("event_id", wear.weather_class(F.col("w"), F.col("c")).alias("weather"), wear.temperature(F.col("c"), "F").alias("fahrenheit"))


def _stream(spark, sf, name):
    """A derived table as a stream: its files, one or many, are read as they are found."""
    table, columns = DERIVED[name]
    schema = given(spark, sf, table).schema
    source = spark.readStream.schema(schema).parquet(f"{sf}/{table}.parque[t]")
    return source.selectExpr(*[f"{re.sub(r'{ms:(.*?)}', _SPARK_MS, e)} AS {c}" for c, e in columns])


def stream_counting_upsert(spark, sf):
    return upserts.counting_upsert(_stream(spark, sf, "issue_clicks"))


def stream_queue_machine(spark, sf):
    return upserts.job_states(_stream(spark, sf, "queue_events"))


def stream_job_transitions(spark, sf):
    return upserts.job_transitions(_stream(spark, sf, "job_events"))


QUERIES = {f.__name__: f for f in (
    stream_job_transitions, outfit_candidates, outfit_identity_distinct, outfit_rank_topk, outfit_rank_summary, ai_score_legacy, preference_bonus, category_knowledge, calendar_season, weather_class, stream_counting_upsert, stream_queue_machine,
)}

_M = "m(k) AS (VALUES " + ", ".join(f"('{c}>{m}')" for c in COLORS for m in MATCHES[c]) + ")"
_ITEMS = "WITH " + sql_of("wardrobe") + """, it AS (SELECT *, CASE WHEN category = 'Tops' THEN 'Tops' WHEN category IN ('Pants', 'Shorts', 'Skirts') THEN 'Bottoms' WHEN category IN ('Shoes', 'Heels') THEN 'Shoes' WHEN category = 'Jackets' THEN 'Jackets' WHEN category = 'Dresses' THEN 'Dresses' ELSE 'Accessories' END AS role FROM wardrobe),
  opt AS (SELECT owner_id, id, color, role FROM it UNION ALL SELECT DISTINCT owner_id, CAST(NULL AS bigint), CAST(NULL AS varchar), 'Jackets' FROM it UNION ALL SELECT DISTINCT owner_id, CAST(NULL AS bigint), CAST(NULL AS varchar), 'Accessories' FROM it),
  lk AS (SELECT t.owner_id, 0 AS kind, t.id AS top, b.id AS bottom, s.id AS shoes, j.id AS jacket, a.id AS accessory, t.color AS tc, b.color AS bc, s.color AS sc, j.color AS jc, a.color AS ac FROM it t JOIN it b USING (owner_id) JOIN it s USING (owner_id) JOIN opt j USING (owner_id) JOIN opt a USING (owner_id)
   WHERE t.role = 'Tops' AND b.role = 'Bottoms' AND s.role = 'Shoes' AND j.role = 'Jackets' AND a.role = 'Accessories'
   UNION ALL SELECT t.owner_id, 1, t.id, NULL, s.id, j.id, a.id, t.color, NULL, s.color, j.color, a.color FROM it t JOIN it s USING (owner_id) JOIN opt j USING (owner_id) JOIN opt a USING (owner_id) WHERE t.role = 'Dresses' AND s.role = 'Shoes' AND j.role = 'Jackets' AND a.role = 'Accessories'),
  looks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY kind, top, bottom, shoes, jacket NULLS FIRST, accessory NULLS FIRST) - 1 AS ordinal,
   concat_ws('|', top, coalesce(CAST(bottom AS varchar), 'none'), shoes, coalesce(CAST(jacket AS varchar), 'none'), coalesce(CAST(accessory AS varchar), 'none')) AS identity FROM lk) WHERE ordinal < 50000)"""


def _ai(top: str, bottom: str, shoes: str, jacket: str, accessory: str, degrees: str, weather: str, season: str, occasion: str) -> str:
    go = lambda a, b: f"coalesce({a} = {b} OR ({a} || '>' || {b}) IN (SELECT k FROM m), FALSE)"
    on = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
    worn, bare = f"{jacket} IS NOT NULL", f"{jacket} IS NULL"
    color = " + ".join(["60", on(go(top, bottom), 15), on(go(bottom, shoes), 10), on(go(top, shoes), 8), on(go(top, jacket), 5)])
    air = " + ".join(["80", on(f"{degrees} >= 28 AND {bare}", 15), on(f"{degrees} >= 28 AND {worn}", -20), on(f"{degrees} <= 15 AND {worn}", 15), on(f"{degrees} <= 15 AND {bare}", -20), on(f"{weather} = 'Rainy' AND {worn}", 12), on(f"{weather} = 'Rainy' AND {bare}", -15)])
    time = " + ".join(["80", on(f"{season} = 'Summer' AND {bare}", 15), on(f"{season} = 'Summer' AND {worn}", -20), on(f"{season} = 'Winter' AND {worn}", 15), on(f"{season} = 'Winter' AND {bare}", -15)])
    style = " + ".join(["80", on(f"{top} IS NOT NULL AND {bottom} IS NOT NULL AND {shoes} IS NOT NULL", 8), on(f"{accessory} IS NOT NULL", 4), on(f"{occasion} = 'Work' AND {worn}", 6), on(f"{occasion} = 'Date' AND {accessory} IS NOT NULL", 6), on(f"{occasion} = 'Casual'", 4)])
    return ", ".join(f"CAST(least(100, greatest(0, {x})) AS int) AS ai_{n}" for x, n in ((color, "color"), (air, "weather"), (time, "season"), (style, "style")))


_BLEND = "CAST(floor(ai_color * 0.3e0 + ai_weather * 0.25e0 + ai_season * 0.25e0 + ai_style * 0.2e0 + 0.5e0) AS int) AS ai_overall"
_RANKED = f"{_ITEMS}, {_M}, p AS (SELECT owner_id, ordinal, identity, {_ai('tc', 'bc', 'sc', 'jc', 'ac', '30', chr(39) + 'Hot' + chr(39), chr(39) + 'Summer' + chr(39), chr(39) + 'Casual' + chr(39))} FROM looks), sc AS (SELECT *, {_BLEND} FROM p)"
_NULL = "CAST(NULL AS varchar)"
_QUEUE = "WITH " + sql_of("queue_events")
_ONLY = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
ORACLES = {
    "stream_job_transitions": JOB_TRANSITIONS,
    "outfit_candidates": _ITEMS + " SELECT owner_id, ordinal, top, bottom, shoes, jacket, accessory FROM looks",
    "outfit_identity_distinct": _ITEMS + " SELECT owner_id, identity, min(ordinal) AS ordinal FROM looks GROUP BY 1, 2",
    "outfit_rank_topk": _RANKED + " SELECT owner_id, CAST(rank AS int) AS rank, identity, ai_overall FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY ai_overall DESC, ordinal) AS rank FROM sc) WHERE rank <= 10",
    "outfit_rank_summary": _RANKED + " SELECT owner_id, count(*) AS looks, max(ai_overall) AS best, count(*) FILTER (WHERE ai_overall >= 85) AS suitable FROM sc GROUP BY 1",
    "ai_score_legacy": f"WITH {sql_of('outfits')}, {_M}, p AS (SELECT order_key, line_no, part_key, supp_key, {_ai('top', 'bottom', 'shoes', 'jacket', _NULL, '(part_key % 40 - 5)', 'weather', 'season', 'occasion')} FROM outfits) SELECT *, {_BLEND} FROM p",
    "preference_bonus": "WITH " + sql_of("wardrobe") + """ SELECT w.id, CASE WHEN EXISTS (SELECT 1 FROM wardrobe f WHERE f.favorite AND f.owner_id = w.owner_id AND f.color = w.color) THEN 8 ELSE 0 END
      + CASE WHEN EXISTS (SELECT 1 FROM wardrobe f WHERE f.favorite AND f.owner_id = w.owner_id AND f.category = w.category) THEN 6 ELSE 0 END AS bonus FROM wardrobe w""",
    "category_knowledge": _ITEMS + f""", k AS (SELECT *, {_SUB} AS sub FROM it), s AS (SELECT *, CASE WHEN sub IN {_ONLY(wear.SUMMER_ONLY)} THEN 'Summer' WHEN sub IN {_ONLY(wear.WINTER_ONLY)} THEN 'Winter' WHEN sub IN {_ONLY(wear.AUTUMN_WINTER)} THEN 'Autumn,Winter'
      WHEN category = 'Shorts' THEN 'Summer' WHEN category = 'Jackets' THEN 'Autumn,Winter' WHEN category = 'Dresses' THEN 'Summer,Autumn' ELSE 'Summer,Autumn,Winter' END AS seasons FROM k)
      SELECT id, CASE category {' '.join(f"WHEN '{c}' THEN '{r}'" for c, r in wear.ROLES.items())} ELSE CASE sub WHEN 'Cap' THEN 'Headwear' ELSE 'Accessory' END END AS role, role AS engine_role, seasons, contains(seasons, 'Summer') AS summer FROM s""",
    "calendar_season": "SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring' WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Autumn' END AS season, count(*) AS orders FROM orders GROUP BY 1",
    "weather_class": """SELECT event_id, CASE WHEN event_id % 5 IN (0, 3) THEN 'Rainy' WHEN event_id % 5 = 1 OR event_id % 41 - 3 >= 28 THEN 'Hot' ELSE 'Mild' END AS weather,
      CAST(floor((event_id % 41 - 3) * 9.0e0 / 5 + 32 + 0.5e0) AS int) AS fahrenheit FROM events""",
    "stream_counting_upsert": "WITH " + sql_of("issue_clicks") + """ SELECT user_id, issue_key, count(*) AS report_count, min(ms) AS first_reported_ms, max(ms) AS last_reported_ms, arg_max(platform, row(ms, click_id)) AS platform,
      arg_max(app_version, row(ms, click_id)) FILTER (WHERE app_version IS NOT NULL) AS app_version FROM issue_clicks GROUP BY 1, 2""",
    "stream_queue_machine": _QUEUE + """, r AS (SELECT job_id, max(CASE type WHEN 'job-added' THEN 1 WHEN 'job-progress' THEN 2 WHEN 'job-failed' THEN 3 WHEN 'job-completed' THEN 4 ELSE 0 END) AS n, count(*) AS events, max(ms) AS last_ms FROM queue_events WHERE job_id IS NOT NULL GROUP BY 1)
      SELECT job_id, CASE n WHEN 1 THEN 'added' WHEN 2 THEN 'progress' WHEN 3 THEN 'failed' WHEN 4 THEN 'completed' ELSE 'unknown' END AS state, events, last_ms FROM r""",
}
