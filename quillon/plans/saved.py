"""Queries over saved looks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import saved as S
from ..sources.tables import OCCASIONS, derived, given, sql_of

DAY = "1998-08-02"
#: What is said of no, one and several looks of the style Minimal, in English and Italian.
MESSAGES = (
    ("You don't currently have enough suitable pieces to create a high-quality Minimal outfit.", "You currently have 1 suitable Minimal outfit.", "You currently have %d suitable Minimal outfits."),
    ("Al momento non hai abbastanza capi adatti per creare un outfit Minimal di alta qualità.", "Al momento hai 1 outfit Minimal adatto.", "Al momento hai %d outfit Minimal adatti."),
)


def _rows(spark, sf):
    return derived(spark, sf, "saved_looks")


def _documents(spark, sf):
    """The looks as stored; each tenth document is damaged."""
    rows = S.as_documents(_rows(spark, sf))
    return rows.withColumn("look", F.when(F.col("id") % 10 == 3, F.lit("{broken")).when(F.col("id") % 10 == 4, F.lit(None)).otherwise(F.col("look")))


def saved_newest(spark, sf):
    return S.newest_first(_rows(spark, sf)).select("user_id", "place", "id", "favorite")


def saved_by_id(spark, sf):
    """Customers' ids looked up among the saved looks: a row where one has it, nulls where none has."""
    keys = given(spark, sf, "customer").selectExpr("c_custkey AS id")
    return S.found(keys, _rows(spark, sf).select("id", "user_id", "created_ms"))


def saved_documents(spark, sf):
    """What is read back of the stored documents; a damaged one is an empty look."""
    return S.parsed(_documents(spark, sf)).select("id", *[F.col(f"look.{c}").alias(c) for c in ("top", "shoes", "occasion", "score")])


def saved_cleaned(spark, sf):
    return S.cleaned(S.parsed(S.as_documents(_rows(spark, sf)))).select("id", *[F.col(f"look.{c}").alias(c) for c in ("top", "jacket", "season", "weather")])


def saved_facets(spark, sf):
    """How many of a user's looks each facet shows."""
    rows = S.parsed(S.as_documents(_rows(spark, sf)))
    facets = (*S.FACETS, *[o for o in OCCASIONS if o not in S.FACETS])
    counts = rows.groupBy("user_id").agg(*[F.count_if(S.shown_by(f)).alias(f) for f in facets])
    return counts.select("user_id", F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("looks")) for f in facets])).alias("x")).select("user_id", "x.*")


def best_scores(spark, sf):
    return S.best_scores(_rows(spark, sf))


def latest_outfit(spark, sf):
    return S.latest(_rows(spark, sf))


def complete_looks(spark, sf):
    """Looks with a top, shoes, and a bottom unless the top is a dress."""
    rows = _rows(spark, sf)
    return rows.select("id", (F.col("top").isNotNull() & F.col("shoes").isNotNull() & (F.col("dress_look") | F.col("bottom").isNotNull())).alias("complete"))


def outfit_of_day(spark, sf):
    return S.draw(_rows(spark, sf), ["user_id"], F.concat_ws("-", F.col("user_id").cast("string"), F.lit(DAY)))


def random_item_per_category(spark, sf):
    return S.draw(derived(spark, sf, "wardrobe"), ["owner_id", "category"], F.concat_ws("-", F.col("owner_id").cast("string"), "category"))


def other_outfit(spark, sf):
    """A look of a user's ten newest other than the newest, which is shown already."""
    rows = S.newest_first(_rows(spark, sf)).withColumnRenamed("place", "rank")
    shown = rows.where("rank = 1").select("user_id", F.col("id").alias("shown"))
    return S.draw_other(rows.join(shown, "user_id"), "user_id", F.col("shown"), F.col("user_id").cast("string"))


def builder_scores(spark, sf):
    """The score of a look in the builder: the older score and what its pieces add by preference, 99 at most."""
    rows, items = _rows(spark, sf).where("bottom IS NOT NULL AND shoes IS NOT NULL"), derived(spark, sf, "wardrobe").selectExpr("id AS item", "CASE WHEN favorite THEN 8 ELSE 0 END + CASE WHEN category = 'Tops' THEN 6 ELSE 0 END AS bonus")
    for slot in ("top", "bottom", "shoes"):
        rows = rows.join(items.select(F.col("item").alias(slot), F.col("bonus").alias(f"{slot}_bonus")), slot, "left")
    bonus = sum((F.coalesce(f"{slot}_bonus", F.lit(0)) for slot in ("top", "bottom", "shoes")), F.lit(0))
    return rows.select("id", F.least(F.coalesce("ai_score", F.lit(0)) + bonus, F.lit(99)).cast("int").alias("style_score"))


def accessory_choice(spark, sf):
    """A look before its accessories are chosen: a watch stays, also where it is worn as the accessory, and the rest goes."""
    rows = derived(spark, sf, "clothes").selectExpr("id", "CASE WHEN id % 3 = 0 THEN id ELSE NULL END AS watch", "sub_category AS accessory")
    worn = F.lower(F.trim("accessory")) == "watch"
    return rows.select("id", F.coalesce("watch", F.when(worn, F.col("id"))).alias("watch"), F.lit(None).cast("long").alias("bag"), F.lit(None).cast("long").alias("accessory"))


def result_messages(spark, sf):
    """What a user is told about the number of looks, in two languages."""
    n = F.count("*")
    rows = _rows(spark, sf).where("score > 50").groupBy("user_id").agg(n.alias("n"))
    users = given(spark, sf, "customer").selectExpr("c_custkey AS user_id").join(rows, "user_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    say = lambda none, one, many: F.when(F.col("n") == 0, none).when(F.col("n") == 1, one).otherwise(F.format_string(many, "n"))
    english, italian = (say(*texts) for texts in MESSAGES)
    return users.select("user_id", english.alias("english"), italian.alias("italian"))


QUERIES = {f.__name__: f for f in (
    saved_newest, saved_by_id, saved_documents, saved_cleaned, saved_facets, best_scores, latest_outfit, complete_looks, outfit_of_day, random_item_per_category, other_outfit, builder_scores, accessory_choice, result_messages,
)}

_S = "WITH " + sql_of("saved_looks")
_WEATHER = "CASE lower(trim(weather)) WHEN 'hot' THEN 'Hot' WHEN 'rain' THEN 'Rainy' WHEN 'rainy' THEN 'Rainy' ELSE 'Mild' END"
_FACET = {"All": "TRUE", "Favorites": "favorite", "Hot": f"{_WEATHER} = 'Hot'", "Mild": f"{_WEATHER} = 'Mild'", "Rainy": f"{_WEATHER} = 'Rainy'", "Summer": "TRUE"} | {o: f"lower(trim(occasion)) = '{o.lower()}'" for o in ("Casual", "Work", "Date", "Party", "Sport")}
ORACLES = {
    "saved_newest": _S + " SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, id) AS int) AS place, id, favorite FROM saved_looks",
    "saved_by_id": _S + " SELECT c_custkey AS id, user_id, created_ms FROM customer LEFT JOIN saved_looks ON id = c_custkey",
    "saved_documents": _S + " SELECT id, CASE WHEN ok THEN top END AS top, CASE WHEN ok THEN shoes END AS shoes, CASE WHEN ok THEN occasion END AS occasion, CASE WHEN ok THEN score END AS score FROM (SELECT *, id % 10 NOT IN (3, 4) AS ok FROM saved_looks)",
    "saved_cleaned": _S + f" SELECT id, top, CAST(NULL AS bigint) AS jacket, 'Summer' AS season, {_WEATHER} AS weather FROM saved_looks",
    "saved_facets": _S + " " + " UNION ALL ".join(f"SELECT user_id, '{f}' AS facet, count(*) FILTER (WHERE {c}) AS looks FROM saved_looks GROUP BY 1" for f, c in _FACET.items()),
    "best_scores": _S + " SELECT user_id, CAST(max(CASE WHEN score <> 0 THEN score WHEN ai_score <> 0 THEN ai_score ELSE 0 END) AS bigint) AS best_match, CAST(max(coalesce(color_score, 0)) AS bigint) AS best_color FROM saved_looks GROUP BY 1",
    "latest_outfit": _S + " SELECT user_id, id, created_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, id) AS place FROM saved_looks WHERE created_ms <> 0) WHERE place = 1",
    "complete_looks": _S + " SELECT id, top IS NOT NULL AND shoes IS NOT NULL AND (dress_look OR bottom IS NOT NULL) AS complete FROM saved_looks",
    "outfit_of_day": _S + f" SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || '-{DAY}-' || id), id) AS place FROM saved_looks) WHERE place = 1",
    "random_item_per_category": "WITH " + sql_of("wardrobe") + " SELECT owner_id, category, id FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, category ORDER BY md5(owner_id || '-' || category || '-' || id), id) AS place FROM wardrobe) WHERE place = 1",
    "other_outfit": _S + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, id) AS place FROM saved_looks)
      SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place = 1, md5(user_id || '-' || id), id) AS turn FROM r WHERE place <= 10) WHERE turn = 1""",
    "builder_scores": _S + ", " + sql_of("wardrobe") + """, b AS (SELECT id AS item, (CASE WHEN favorite THEN 8 ELSE 0 END) + (CASE WHEN category = 'Tops' THEN 6 ELSE 0 END) AS bonus FROM wardrobe)
      SELECT s.id, CAST(least(99, coalesce(s.ai_score, 0) + coalesce(t.bonus, 0) + coalesce(m.bonus, 0) + coalesce(h.bonus, 0)) AS int) AS style_score FROM saved_looks s LEFT JOIN b t ON t.item = s.top LEFT JOIN b m ON m.item = s.bottom LEFT JOIN b h ON h.item = s.shoes
      WHERE s.bottom IS NOT NULL AND s.shoes IS NOT NULL""",
    "accessory_choice": "WITH " + sql_of("clothes") + " SELECT id, CASE WHEN id % 3 = 0 OR trim(lower(sub_category)) = 'watch' THEN id END AS watch, CAST(NULL AS bigint) AS bag, CAST(NULL AS bigint) AS accessory FROM clothes",
    "result_messages": _S + """, n AS (SELECT user_id, count(*) AS n FROM saved_looks WHERE score > 50 GROUP BY 1), u AS (SELECT c_custkey AS user_id, coalesce(n, 0) AS n FROM customer LEFT JOIN n ON user_id = c_custkey)
      SELECT user_id, CASE n WHEN 0 THEN 'You don''t currently have enough suitable pieces to create a high-quality Minimal outfit.' WHEN 1 THEN 'You currently have 1 suitable Minimal outfit.' ELSE 'You currently have ' || n || ' suitable Minimal outfits.' END AS english,
        CASE n WHEN 0 THEN 'Al momento non hai abbastanza capi adatti per creare un outfit Minimal di alta qualità.' WHEN 1 THEN 'Al momento hai 1 outfit Minimal adatto.' ELSE 'Al momento hai ' || n || ' outfit Minimal adatti.' END AS italian FROM u""",
}
