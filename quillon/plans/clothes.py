"""Queries over clothes as they are written, and over the catalogue of templates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import catalogue as C
from ..functions import text
from ..sources.tables import derived, given, sql_of

SEASON = "Winter"


def _named(spark, sf):
    return C.with_names(derived(spark, sf, "clothes"))


def category_names(spark, sf):
    """What categories and subcategories are called in the catalogue."""
    return _named(spark, sf).select("id", "kind", "sub_kind")


def clothing_knowledge(spark, sf):
    """Role, seasons, styles, occasions, warmth and formality of every item."""
    kind, sub = F.col("kind"), F.coalesce("sub_kind", F.lit(""))
    lists = [F.concat_ws(" ", x).alias(n) for x, n in zip([C.default_seasons(kind, sub), *C.knowledge(kind, sub)[:2]], ("seasons", "styles", "occasions"), strict=True)]
    return _named(spark, sf).select("id", C.role(kind, sub).alias("role"), *lists, *C.knowledge(kind, sub)[2:])


def item_seasons(spark, sf):
    """The seasons written of an item, in English or Italian, and whether it suits the season asked for: its own seasons
    count, and where none is known those of its kind."""
    kind, sub = F.col("kind"), F.coalesce("sub_kind", F.lit(""))
    own = C.seasons(F.col("season_1"), F.col("season_2"))
    used = F.when(F.size(own) > 0, own).otherwise(C.default_seasons(kind, sub))
    return _named(spark, sf).select("id", F.concat_ws(" ", own).alias("seasons"), F.array_contains(used, SEASON).alias("suitable"))


def category_families(spark, sf):
    rows = _named(spark, sf).withColumn("role", C.role(F.col("kind"), F.coalesce("sub_kind", F.lit(""))))
    return rows.select("id", *C.families(F.col("kind"), F.col("role")))


def accessory_types(spark, sf):
    return derived(spark, sf, "clothes").select("id", *C.accessory_types(F.col("category"), F.col("sub_category"), F.col("name")))


def summer_wardrobe(spark, sf):
    """The wardrobe without jackets, by exact names on the shelf and by any case before looks are made, with flags of items
    that wait or have failed."""
    rows = derived(spark, sf, "clothes")
    shown, eligible = ~text.trimmed(F.col("category")).isin("Jacket", "Jackets"), ~F.lower(text.trimmed(F.col("category"))).isin("jacket", "jackets")
    state = F.coalesce("state", F.lit(""))
    return rows.select("id", shown.alias("shown"), eligible.alias("eligible"), state.isin("queued", "processing").alias("pending"), state.isin("failed", "cancelled").alias("failed"))


def storage_paths(spark, sf):
    """The path of an item's image in the store, without the query and with its escapes undone, and the image's format."""
    rows = derived(spark, sf, "clothes").select("id", "image")
    marker = "/storage/v1/object/public/wardrobe/"
    path = F.when(F.col("image").contains(marker), F.url_decode(F.substring_index(F.substring_index("image", marker, -1), "?", 1)))
    return rows.select("id", path.alias("path"), text.image_format(F.col("image")).alias("format"))


def engine_colors(spark, sf):
    """Colours as the style engine names them: Black where none is, Gray for grey, Navy for dark blue, words with capitals."""
    rows = derived(spark, sf, "clothes")
    written = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 == 1, F.lit(" GREY ")).when(F.col("id") % 5 == 2, F.lit("dark Blue")).when(F.col("id") % 5 == 3, F.concat(F.lit("light "), F.upper("color"))).otherwise(F.col("color"))
    t = text.trimmed(F.coalesce(written, F.lit("Black")))
    named = F.when(F.lower(t) == "grey", "Gray").when(F.lower(t) == "dark blue", "Navy").otherwise(F.initcap(t))
    return rows.select("id", named.alias("color"))


def first_of_each(spark, sf):
    """Of items with the same category, colour and name in a wardrobe the first one."""
    rows = derived(spark, sf, "clothes").withColumn("identity", F.concat_ws("|", text.cleaned(F.col("category")), F.lower("color")))
    place = F.row_number().over(W.partitionBy("owner_id", "identity").orderBy("id"))
    return rows.withColumn("place", place).where("place = 1").select("owner_id", "identity", "id")


def item_templates(spark, sf):
    """The template of each item: that of its own id where the catalogue has it, else the default one."""
    ids = [t[0] for t in C.TEMPLATES] + ["female-dress", "unknown"]
    wanted = F.element_at(F.array(*map(F.lit, ids)), (F.col("id") % len(ids) + 1).cast("int"))
    rows = derived(spark, sf, "clothes").select("id", wanted.alias("template"))
    of = F.broadcast(spark.createDataFrame(C.TEMPLATES, "template string, label string, gender string, template_category string"))
    default = next(t for t in C.TEMPLATES if t[0] == C.DEFAULT_TEMPLATE)
    found = F.col("label").isNotNull()
    return rows.join(of, "template", "left").select("id", found.alias("known"), F.when(found, F.col("template")).otherwise(default[0]).alias("template"), F.coalesce("label", F.lit(default[1])).alias("label"), F.coalesce("template_category", F.lit(default[3])).alias("category"))


def template_counts(spark, sf):
    """How many items use each template of a group, in the group's order; templates of another gender are left out."""
    groups = spark.createDataFrame([(g, i, t) for g, ts in C.TEMPLATE_GROUPS.items() for i, t in enumerate(ts)], "group_id string, place int, template string")
    of = spark.createDataFrame(C.TEMPLATES, "template string, label string, gender string, category string").where("gender = 'male'")
    shown = F.broadcast(groups.join(F.broadcast(of.select("template", "category")), "template"))
    used = item_templates(spark, sf).where("known").groupBy("template").agg(F.count("*").alias("items"))
    return shown.join(used, "template", "left").select("group_id", "place", "template", "category", F.coalesce("items", F.lit(0)).alias("items"))


#: Kinds of weather that have a text of their own.
SAID_WEATHER = ("sunny", "cold", "fresh", "cloudy", "hot", "mild", "rainy")


def translation_keys(spark, sf):
    """The keys of the texts for a season and for a kind of weather; autumn and unknown stand for all others."""
    rows = derived(spark, sf, "saved_looks").withColumn("season", F.element_at(F.array(*map(F.lit, ("Winter", "Spring", "Summer", "Autumn", "Monsoon"))), (F.col("id") % 5 + 1).cast("int")))
    weather = F.lower(text.trimmed(F.coalesce("weather", F.lit(""))))
    key = lambda kind, known, other: F.concat(F.lit(f"weatherContext.{kind}."), F.when(known, F.lower(F.col("season") if kind == "season" else weather)).otherwise(other))
    return rows.select("id", key("season", F.col("season").isin("Winter", "Spring", "Summer"), "autumn").alias("season_key"), key("weather", weather.isin(*SAID_WEATHER), "unknown").alias("weather_key"))


def option_violations(spark, sf):
    """How many of the proposed issues break each rule of the list: form of the key, lengths of title and text, order."""
    rows = given(spark, sf, "part").selectExpr(*[f"{sql} AS {name}" for name, sql in PROPOSED.items()])
    rules = {
        "key_format": ~F.col("issue_key").rlike("^[a-z0-9]+(?:_[a-z0-9]+)*$"), "title_length": ~F.length(F.trim("title")).between(3, 120), "text_length": ~F.length(F.trim("text")).between(3, 500), "order_positive": F.col("display_order") <= 0,
    }
    return rows.select(F.explode(F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


#: Proposed issues, derived from parts; both engines take these expressions.
PROPOSED = {
    "issue_key": "CASE p_partkey % 5 WHEN 0 THEN concat('part_', CAST(p_partkey AS varchar(9))) WHEN 1 THEN concat('Part', CAST(p_partkey AS varchar(9))) WHEN 2 THEN concat('a__', CAST(p_partkey AS varchar(9))) WHEN 3 THEN 'broken' ELSE 'x_' END",
    "title": "CASE WHEN p_partkey % 7 = 0 THEN '  ab ' ELSE p_name END", "text": "CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 11 = 1 THEN repeat(p_name, 40) ELSE p_name END", "display_order": "p_size - 5",
}


QUERIES = {f.__name__: f for f in (translation_keys, option_violations, category_names, clothing_knowledge, item_seasons, category_families, accessory_types, summer_wardrobe, storage_paths, engine_colors, first_of_each, item_templates, template_counts)}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_CLEAN = "trim(regexp_replace(lower(coalesce({0}, '')), '[\\s_-]+', ' ', 'g'))"
_N = "WITH " + sql_of("clothes") + f""", words(c, kind) AS (VALUES {_values(C.category_words())}), subs(s, sub) AS (VALUES {_values(C.sub_words())}),
  n AS (SELECT k.*, coalesce(w.kind, 'Accessories') AS kind, CASE WHEN {_CLEAN.format('k.sub_category')} = '' THEN NULL ELSE coalesce(u.sub, trim(k.sub_category)) END AS sub_kind
  FROM clothes k LEFT JOIN words w ON w.c = {_CLEAN.format('k.category')} LEFT JOIN subs u ON u.s = {_CLEAN.format('k.sub_category')}),
  r AS (SELECT *, coalesce(sub_kind, '') AS sk, CASE WHEN kind = 'Tops' THEN 'UpperBody' WHEN kind IN ('Pants', 'Shorts', 'Skirts') THEN 'LowerBody' WHEN kind = 'Dresses' THEN 'FullBody' WHEN kind IN ('Shoes', 'Heels') THEN 'Footwear' WHEN kind = 'Jackets' THEN 'Outerwear'
    WHEN kind = 'Bags' OR sub_kind IN ('Backpack', 'Handbag') THEN 'Bag' WHEN sub_kind = 'Cap' THEN 'Headwear' WHEN sub_kind = 'Watch' THEN 'Watch' ELSE 'Accessory' END AS role FROM n),
  d AS (SELECT *, CASE WHEN sk IN {_in(C.SUMMER_ONLY)} THEN ['Summer'] WHEN sk IN {_in(C.WINTER_ONLY)} THEN ['Winter'] WHEN sk IN {_in(C.AUTUMN_WINTER)} THEN ['Autumn', 'Winter'] WHEN kind = 'Shorts' THEN ['Summer'] WHEN kind = 'Jackets' THEN ['Autumn', 'Winter']
    WHEN kind = 'Dresses' THEN ['Summer', 'Autumn'] ELSE ['Summer', 'Autumn', 'Winter'] END AS seasons0 FROM r)"""
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_SEASON = "CASE WHEN {0} IN ('summer', 'estate') THEN 'Summer' WHEN {0} IN ('autumn', 'fall', 'autunno') THEN 'Autumn' WHEN {0} IN ('winter', 'inverno') THEN 'Winter' END"
_TEMPLATE_IDS = [t[0] for t in C.TEMPLATES] + ["female-dress", "unknown"]
_TEMPLATES = f"t(template, label, gender, category) AS (VALUES {_values(C.TEMPLATES)}), u AS (SELECT id, [{', '.join(repr(t) for t in _TEMPLATE_IDS)}][id % {len(_TEMPLATE_IDS)} + 1] AS template FROM clothes)"
ORACLES = {
    "translation_keys": "WITH " + sql_of("saved_looks") + f""" SELECT id, 'weatherContext.season.' || CASE id % 5 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'autumn' END AS season_key,
      'weatherContext.weather.' || CASE WHEN lower(trim(weather)) IN {_in(SAID_WEATHER)} THEN lower(trim(weather)) ELSE 'unknown' END AS weather_key FROM saved_looks""",
    "option_violations": "WITH o AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in PROPOSED.items()) + """ FROM part), v AS (SELECT unnest([CASE WHEN NOT regexp_full_match(issue_key, '[a-z0-9]+(_[a-z0-9]+)*') THEN 'key_format' END, CASE WHEN length(trim(title)) NOT BETWEEN 3 AND 120 THEN 'title_length' END,
      CASE WHEN length(trim(text)) NOT BETWEEN 3 AND 500 THEN 'text_length' END, CASE WHEN display_order <= 0 THEN 'order_positive' END]) AS rule FROM o) SELECT rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY 1""",
    "category_names": f"{_N} SELECT id, kind, sub_kind FROM n",
    "clothing_knowledge": f"""{_N}, s AS (SELECT *, CASE WHEN sk IN {_in(C.SPORT)} THEN 'sport' WHEN sk IN {_in(C.FORMAL)} THEN 'formal' WHEN sk IN {_in(C.SMART_CASUAL)} THEN 'smart' ELSE 'plain' END AS way, sk IN {_in(C.STREETWEAR)} AS street, sk IN {_in(C.LUXURY)} AS lux FROM d),
      l AS (SELECT *, list_concat(CASE way WHEN 'sport' THEN ['Sport', 'Casual'] WHEN 'formal' THEN ['Classic', 'Elegant', 'Luxury', 'Business'] WHEN 'smart' THEN ['SmartCasual', 'Classic', 'Minimal'] ELSE ['Casual', 'Minimal'] END,
        list_concat(CASE WHEN street THEN ['Streetwear', 'Casual'] ELSE [] END, CASE WHEN lux THEN ['Luxury', 'Elegant'] ELSE [] END)) AS st,
        list_concat(CASE way WHEN 'sport' THEN ['Sport', 'Casual'] WHEN 'formal' THEN ['Work', 'Party', 'Date'] WHEN 'smart' THEN ['Casual', 'Work', 'Date'] ELSE ['Casual'] END, list_concat(CASE WHEN street THEN ['Casual'] ELSE [] END, CASE WHEN lux THEN ['Party', 'Date'] ELSE [] END)) AS oc,
        CASE way WHEN 'sport' THEN 1 WHEN 'formal' THEN 5 WHEN 'smart' THEN 3 ELSE 2 END AS f FROM s)
      SELECT id, role, array_to_string(seasons0, ' ') AS seasons, array_to_string({_FIRST.format('st')}, ' ') AS styles, array_to_string({_FIRST.format('oc')}, ' ') AS occasions,
        CASE WHEN sk IN {_in(C.VERY_WARM)} THEN 5 WHEN sk IN {_in(C.WARM)} THEN 4 WHEN sk IN {_in(C.LIGHT)} THEN 1 WHEN kind IN ('Jackets', 'Pants') THEN 3 ELSE 2 END AS warmth, CASE WHEN street THEN least(f, 2) ELSE f END AS formality FROM l""",
    "item_seasons": f"""{_N}, s AS (SELECT *, list_filter([{_SEASON.format(_CLEAN.format('season_1'))}, {_SEASON.format(_CLEAN.format('season_2'))}], lambda x: x IS NOT NULL) AS o FROM d), o AS (SELECT *, {_FIRST.format('o')} AS own FROM s)
      SELECT id, array_to_string(own, ' ') AS seasons, list_contains(CASE WHEN len(own) > 0 THEN own ELSE seasons0 END, '{SEASON}') AS suitable FROM o""",
    "category_families": f"""{_N} SELECT id, kind IN ('Pants', 'Shorts', 'Skirts') AS is_bottom, kind = 'Dresses' AS is_full_body, kind = 'Tops' AS is_top, kind = 'Jackets' AS is_jacket, kind IN ('Accessories', 'Bags') AS is_accessory, kind IN ('Shoes', 'Heels') AS is_shoes,
      role = 'Bag' AS is_bag, role = 'Headwear' AS is_cap, role = 'Watch' AS is_watch FROM r""",
    "accessory_types": "WITH " + sql_of("clothes") + f""", t AS (SELECT id, {_CLEAN.format('category')} AS c, {_CLEAN.format('sub_category')} AS s, {_CLEAN.format('name')} AS n FROM clothes),
      e AS (SELECT *, concat_ws(' ', nullif(c, ''), nullif(s, ''), nullif(n, '')) AS every FROM t)
      SELECT id, s IN ('handbag', 'bag') OR c IN ('bags', 'bag') AS strict_handbag, s = 'backpack' AS strict_backpack, s = 'cap' AS strict_cap, s = 'watch' AS strict_watch, s IN ('handbag', 'bag') OR c IN ('bags', 'bag') OR every LIKE '%handbag%' AS loose_handbag,
      s = 'backpack' OR every LIKE '%backpack%' AS loose_backpack, s = 'cap' OR every LIKE '% cap%' OR every LIKE 'cap%' AS loose_cap, s = 'watch' OR every LIKE '%watch%' AS loose_watch FROM e""",
    "summer_wardrobe": "WITH " + sql_of("clothes") + """ SELECT id, trim(category) NOT IN ('Jacket', 'Jackets') AS shown, lower(trim(category)) NOT IN ('jacket', 'jackets') AS eligible, coalesce(state IN ('queued', 'processing'), FALSE) AS pending, coalesce(state IN ('failed', 'cancelled'), FALSE) AS failed FROM clothes""",
    "storage_paths": "WITH " + sql_of("clothes") + """ SELECT id, CASE WHEN contains(image, '/object/public/wardrobe/') THEN url_decode(split_part(split_part(image, '/storage/v1/object/public/wardrobe/', 2), '?', 1)) END AS path,
      CASE WHEN regexp_matches(lower(split_part(coalesce(image, ''), '?', 1)), '\\.png$') THEN 'png' WHEN regexp_matches(lower(split_part(coalesce(image, ''), '?', 1)), '\\.webp$') THEN 'webp' WHEN regexp_matches(lower(split_part(coalesce(image, ''), '?', 1)), '\\.heic$') THEN 'heic' ELSE 'jpg' END AS format FROM clothes""",
    "engine_colors": "WITH " + sql_of("clothes") + """ SELECT id, CASE id % 5 WHEN 0 THEN 'Black' WHEN 1 THEN 'Gray' WHEN 2 THEN 'Navy' WHEN 3 THEN 'Light ' || color ELSE color END AS color FROM clothes""",
    "first_of_each": "WITH " + sql_of("clothes") + f""", i AS (SELECT owner_id, {_CLEAN.format('category')} || '|' || lower(color) AS identity, id FROM clothes) SELECT owner_id, identity, min(id) AS id FROM i GROUP BY 1, 2""",
    "item_templates": "WITH " + sql_of("clothes") + f""", {_TEMPLATES} SELECT id, t.label IS NOT NULL AS known, coalesce(t.template, '{C.DEFAULT_TEMPLATE}') AS template, coalesce(t.label, 'T-Shirt Regular') AS label, coalesce(t.category, 'Tops') AS category FROM u LEFT JOIN t USING (template)""",
    "template_counts": "WITH " + sql_of("clothes") + f""", {_TEMPLATES}, g(group_id, place, template) AS (VALUES {_values([(g, i, t) for g, ts in C.TEMPLATE_GROUPS.items() for i, t in enumerate(ts)])}), n AS (SELECT template, count(*) AS items FROM u GROUP BY 1)
      SELECT group_id, place, g.template, t.category, coalesce(items, 0) AS items FROM g JOIN t USING (template) LEFT JOIN n USING (template) WHERE t.gender = 'male'""",
}
