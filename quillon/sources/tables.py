"""The given tables, and the catalogue, telemetry, queue and image tables that are derived from them.

A derived table is a list of (column, SQL expression) over one given table. The expressions mean the same in Spark and in the
SQL of the oracle; {ms:x} is the milliseconds of a timestamp since 1970.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ISSUES = (
    ("scan_item_not_completed", "Scan Item did not complete", 1),
    ("processed_item_not_visible", "My processed item is not visible", 2),
    ("background_removal_problem", "The background removal result is incorrect", 3),
    ("app_slow_or_frozen", "The app is slow or frozen", 4),
    ("outfit_or_wardrobe_problem", "Wardrobe or outfit features are not working", 5),
)
#: Names in the order of their places.
COLORS = ("Black", "White", "Gray", "Blue", "Navy", "Denim", "Beige", "Camel", "Cream", "Brown", "Green", "Olive", "Red", "Burgundy", "Pink", "Yellow", "Orange", "Purple", "Khaki", "Gold", "Silver")
CATEGORIES = ("Tops", "Pants", "Shorts", "Shoes", "Heels", "Jackets", "Dresses", "Bags", "Accessories", "Skirts")
STYLES = ("Minimal", "Classic", "Luxury", "Streetwear", "Sport")
OCCASIONS = ("Casual", "Work", "Date", "Party", "Sport", "Summer")
WEATHER = ("Hot", "Mild", "Rainy")
SEASONS = ("Spring", "Summer")
STATUSES = ("queued", "preparing", "processing", "finalizing", "completed", "failed", "cancelled", "paused", "interrupted", "retry-scheduled")


#: What people write: categories, subcategories, seasons and weather as they come.
RAW_CATEGORIES = ("T-Shirt", " tops ", "Jeans", "short_pants", "Dress", "SKIRT", "Sneakers", "high-heels", "Coat", "Handbag", "watch", "Sunglasses", "pants", "Shorts", "outer wear", "Jacket", "all")
RAW_SUBS = (
    "T-Shirt", "polo", "Hoodie", "jumper", "Tank Top", "chinos", "Cargo", "Formal pants", "denim_shorts", "Pencil Skirt", "summer dress", "Evening Dress", "Sneaker", "chelsea boots", "Loafers",
    "Sandals", "stilettos", "Puffer", "trench", "Blazer", "backpack", "purse", "hat", "Watch", " Scarf ", "  ", "wide-leg", "Overcoat", "Boots",
)
RAW_SEASONS = ("Summer", "estate", "FALL", "autunno", "Winter", "Inverno", "spring", "")
RAW_WEATHER = ("hot", " Rain", "RAINY", "cold", "Mild", "snow", "")
ITEM_STATES = ("ready", "queued", "processing", "failed", "cancelled")


def named(names: tuple[str, ...], place: str) -> str:
    """SQL of the name at a 0-based place; null for none. A list that is split keeps the generated code short."""
    return f"CASE WHEN {place} BETWEEN 0 AND {len(names) - 1} THEN split_part('{'|'.join(names)}', '|', CAST({place} AS int) + 1) END"


_EVENT_ISSUE = dict(zip(("click", "view", "error", "purchase", "signup"), (k for k, _, _ in ISSUES), strict=True))
_QUEUE_EVENT = {"click": "job-added", "view": "job-progress", "error": "job-failed", "purchase": "job-completed"}


def _case(column: str, of: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in of.items()) + f" ELSE {other} END"


DERIVED: dict[str, tuple[str, tuple[tuple[str, str], ...]]] = {
    "issue_clicks": ("events", (
        ("click_id", "event_id"), ("user_id", "user_id"), ("issue_key", _case("event_type", _EVENT_ISSUE)),
        ("platform", "CASE WHEN event_id % 4 = 0 THEN 'ios' WHEN event_id % 4 = 1 THEN 'android' ELSE 'unknown' END"),
        ("app_version", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('1.', CAST(event_id % 3 AS varchar(9))) END"), ("ms", "{ms:ts}"),
    )),
    "wardrobe": ("part", (
        ("id", "p_partkey"), ("owner_id", "CAST(floor(p_partkey / 20) AS bigint)"), ("category_ix", "p_partkey % 10"),
        ("category", named(CATEGORIES, "p_partkey % 10")), ("color_ix", "p_size % 21"), ("color", named(COLORS, "p_size % 21")),
        ("favorite", "p_partkey % 7 = 0"), ("name", "p_name"), ("created_seq", "(p_partkey * 7919) % 100003"),
    )),
    "clothes": ("part", (
        ("id", "p_partkey"), ("owner_id", "CAST(floor(p_partkey / 20) AS bigint)"), ("category", named(RAW_CATEGORIES, "p_partkey % 17")),
        ("sub_category", named(RAW_SUBS, "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(floor(p_partkey / 3) AS bigint) % 29 END")), ("name", "p_name"), ("color", named(COLORS, "p_size % 21")),
        ("season_1", named(RAW_SEASONS, "p_partkey % 9")), ("season_2", named(RAW_SEASONS, "p_size % 8")), ("state", named(ITEM_STATES, "p_size % 6")), ("favorite", "p_partkey % 7 = 0"),
        ("image", "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('https://x.example/storage/v1/object/public/wardrobe/u', CAST(p_size AS varchar(9)), '/my%20item', CAST(p_partkey AS varchar(9)), '.png?v=1') WHEN 2 THEN concat('file:///tmp/', CAST(p_partkey AS varchar(9)), '.HEIC') ELSE concat('https://x.example/storage/v1/object/public/wardrobe/', CAST(p_partkey AS varchar(9)), '.webp') END"),
    )),
    "saved_looks": ("orders", (
        ("id", "o_orderkey"), ("user_id", "o_custkey"), ("favorite", "o_orderkey % 5 = 0"), ("created_ms", "CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE {ms:o_orderdate} END"),
        ("score", "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 0 ELSE o_orderkey % 100 END"), ("ai_score", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey * 7) % 90 END"), ("color_score", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey * 3) % 101 END"),
        ("occasion", named((*OCCASIONS, " party "), "o_orderkey % 8")), ("weather", named(RAW_WEATHER, "CAST(floor(o_orderkey / 4) AS bigint) % 8")),
        ("top", "o_custkey % 2000"), ("bottom", "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_custkey * 3) % 2000 END"), ("shoes", "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_custkey * 7) % 2000 END"), ("jacket", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 2000 ELSE NULL END"),
        ("dress_look", "o_orderkey % 9 = 0 AND o_orderkey % 2 = 0"),
    )),
    "jobs": ("orders", (
        ("job_id", "o_orderkey"), ("item_id", "o_custkey"), ("batch_id", "CAST(floor(o_orderkey / 128) AS bigint)"), ("status", named(STATUSES, "o_orderkey % 10")),
        ("priority", "6 - CAST(substr(o_orderpriority, 1, 1) AS int)"), ("queue_position", "o_orderkey % 100"), ("created_ms", "{ms:o_orderdate}"),
        ("progress", "CAST(o_orderkey % 101 AS double) / 100"), ("total_processing_ms", "CAST(floor(o_totalprice) AS bigint)"), ("attempt", "1 + o_orderkey % 6"),
    )),
    "outfits": ("lineitem", (
        ("order_key", "l_orderkey"), ("line_no", "l_linenumber"), ("part_key", "l_partkey"), ("supp_key", "l_suppkey"),
        ("top", named(COLORS, "l_partkey % 21")), ("bottom", named(COLORS, "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_suppkey % 21 END")),
        ("shoes", named(COLORS, "l_orderkey % 21")), ("jacket", named(COLORS, "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE (l_linenumber * 5) % 21 END")),
        ("style", named(STYLES, "l_orderkey % 5")), ("occasion", named(OCCASIONS, "CASE WHEN l_partkey % 7 = 6 THEN NULL ELSE l_partkey % 7 END")),
        ("weather", named(WEATHER, "CASE WHEN l_suppkey % 4 = 3 THEN NULL ELSE l_suppkey % 4 END")),
        ("season", named(SEASONS, "CASE WHEN l_linenumber % 3 = 2 THEN NULL ELSE l_linenumber % 3 END")),
    )),
    "durations": ("lineitem", (
        ("supp_key", "l_suppkey"), ("ship_ms", "{ms:l_shipdate}"), ("order_key", "l_orderkey"), ("line_no", "l_linenumber"), ("part_key", "l_partkey"),
        ("duration_ms", "CAST(floor(l_extendedprice) AS bigint)"), ("weight", "least(100.0e0, greatest(0.01e0, l_quantity))"),
    )),
    "pixels": ("lineitem", (
        ("image_id", "l_suppkey"), ("r", "(l_partkey * 37 + l_linenumber * 11) % 256"), ("g", "(l_suppkey * 53 + l_partkey) % 256"), ("b", "(l_orderkey * 29) % 256"),
    )),
    "item_changes": ("events", (
        ("seq", "event_id"), ("id", "user_id"), ("ms", "{ms:ts}"), ("change", "CASE WHEN event_id % 10 < 3 THEN 'insert' WHEN event_id % 10 < 8 THEN 'update' ELSE 'delete' END"),
        ("name", "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '   ' ELSE concat(' item ', CAST(event_id AS varchar(9)), ' ') END"), ("favorite", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END"), ("token", "concat('t', CAST(event_id % 3 AS varchar(9)))"),
    )),
    "job_events": ("events", (
        ("seq", "event_id"), ("job_id", "user_id"), ("ms", "{ms:ts}"),
        ("kind", "CASE event_id % 12 WHEN 0 THEN 'added' WHEN 1 THEN 'added' WHEN 2 THEN 'added' WHEN 3 THEN 'progress' WHEN 4 THEN 'progress' WHEN 5 THEN 'failed' WHEN 6 THEN 'failed' WHEN 7 THEN 'completed' WHEN 8 THEN 'retry' WHEN 9 THEN 'cancelled' WHEN 10 THEN 'interrupted' ELSE CASE WHEN event_id % 5 = 0 THEN 'removed' ELSE 'progress' END END"),
        ("progress", "CAST(event_id % 100 AS double) / 100"), ("retryable", "event_id % 7 <> 0"), ("attempt", "1 + event_id % 3"), ("reset", "event_id % 2 = 0"),
    )),
    "scan_issues": ("lineitem", (
        ("scan_id", "l_orderkey"), ("seq", "CAST(l_linenumber AS bigint) * 1000000000000 + l_partkey * 1000000 + l_suppkey"), ("stage", "CASE WHEN l_partkey % 2 = 0 THEN 'pre' ELSE 'post' END"), ("code_ix", "(l_partkey * 7 + l_linenumber) % 34"),
        ("severity", "CASE (l_partkey + l_suppkey) % 9 WHEN 0 THEN 'critical' WHEN 1 THEN 'error' WHEN 2 THEN 'error' WHEN 3 THEN 'info' WHEN 4 THEN 'info' ELSE 'warning' END"), ("confidence", "CAST((l_partkey * 13 + l_suppkey) % 100 AS double) / 100"),
        ("pre_score", "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE CAST((l_orderkey * 7) % 101 AS double) / 100 END"), ("post_score", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST((l_orderkey * 3) % 101 AS double) / 100 END"), ("with_background", "l_orderkey % 3 <> 0"),
    )),
    "candidates": ("lineitem", (
        ("image_id", "l_orderkey"), ("ord", "CAST(l_linenumber AS bigint) * 1000000000000 + l_partkey * 1000000 + l_suppkey"), ("valid", "l_partkey % 8 <> 0"), ("reliable", "l_suppkey % 3 <> 0"),
        ("score", "CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE CAST(l_partkey % 5 AS double) / 5 + CAST(l_suppkey % 3 AS double) * 0.0000004e0 END"), ("leakage", "CAST(l_suppkey % 4 AS double) / 10"), ("edge", "CAST(l_partkey % 7 AS double) / 7"), ("samples", "l_quantity"),
    )),
    "queue_events": ("events", (
        ("seq", "event_id"), ("type", _case("event_type", _QUEUE_EVENT, "'queue-updated'")), ("job_id", "CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END"),
        ("batch_id", "event_id % 7"), ("ms", "{ms:ts}"),
    )),
}
_SPARK_MS, _SQL_MS = r"CAST(floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', \1) / 1000) AS bigint)", r"(epoch_us(\1) // 1000)"


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = DERIVED[name]
    return given(spark, sf_dir, table).selectExpr(*[f"{re.sub(r'{ms:(.*?)}', _SPARK_MS, e)} AS {c}" for c, e in columns])


def sql_of(name: str) -> str:
    """The derived table as a common table expression for the oracle."""
    table, columns = DERIVED[name]
    return f"{name} AS (SELECT " + ", ".join(f"{re.sub(r'{ms:(.*?)}', _SQL_MS, e)} AS {c}" for c, e in columns) + f" FROM {table})"


def issue_options(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, True) for row in ISSUES], "issue_key string, title_en string, display_order int, is_active boolean")


SQL_OPTIONS = "options(issue_key, title_en, display_order, is_active) AS (VALUES " + ", ".join(f"('{k}', '{t}', {o}, TRUE)" for k, t, o in ISSUES) + ")"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, i, x, y, lum, mask: eight by eight cells an embedding."""
    rows = given(spark, sf_dir, "embeddings").selectExpr("vec_id AS image_id", "posexplode(embedding) AS (i, v)")
    rows = rows.selectExpr("image_id", "i", "i % 8 AS x", "CAST(floor(i / 8) AS int) AS y", "least(1.0D, greatest(0.0D, 0.5D + 2 * CAST(v AS double))) AS lum")
    return rows.selectExpr("*", "lum >= 0.5D AS mask")


SQL_GRID = """grid0 AS (SELECT vec_id AS image_id, unnest(generate_series(0, len(embedding) - 1)) AS j, unnest(embedding) AS v FROM embeddings),
grid AS (SELECT image_id, CAST(j AS int) AS i, CAST(j % 8 AS int) AS x, CAST(j // 8 AS int) AS y, least(1.0e0, greatest(0.0e0, 0.5e0 + 2 * CAST(v AS double))) AS lum,
  least(1.0e0, greatest(0.0e0, 0.5e0 + 2 * CAST(v AS double))) >= 0.5e0 AS mask FROM grid0)"""


#: What a soft mask and its colours could look like, from the value v of an embedding's component: the same text for both engines.
SOFT = (
    ("alpha", "0.5e0 + 10 * v"), ("lum", "0.5e0 + 2 * v"), ("gradient", "5 * abs(v)"), ("fg_rgb", "0.5e0 + 2 * v"), ("fg_hsv", "0.6e0 + v"), ("fg_lab", "0.5e0 + 3 * v"),
    ("bg_rgb", "0.5e0 - 2 * v"), ("bg_hsv", "0.4e0 - v"), ("bg_lab", "0.5e0 - 3 * v"), ("local_fg", "0.5e0 + 4 * v"), ("all_fg", "0.55e0 + 2 * v"), ("all_bg", "0.6e0 - 4 * v"),
)
_SOFT = (
    *[f"least(1.0e0, greatest(0.0e0, {e})) AS {c}" for c, e in SOFT],
    "CASE WHEN image_id % 3 = 0 THEN NULL ELSE 20 * v END AS direction", "x = 0 OR y = 0 OR x = 7 OR y = 7 AS touches",
)


def soft_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, i, x, y, the columns of SOFT, direction, touches: eight by eight cells an embedding."""
    rows = given(spark, sf_dir, "embeddings").selectExpr("vec_id AS image_id", "posexplode(embedding) AS (i, e)")
    return rows.selectExpr("image_id", "i", "i % 8 AS x", "CAST(floor(i / 8) AS int) AS y", "CAST(e AS double) AS v").selectExpr("image_id", "i", "x", "y", *_SOFT)


SQL_SOFT = f"""soft0 AS (SELECT vec_id AS image_id, unnest(generate_series(0, len(embedding) - 1)) AS j, unnest(embedding) AS e FROM embeddings),
soft1 AS (SELECT image_id, CAST(j AS int) AS i, CAST(j % 8 AS int) AS x, CAST(j // 8 AS int) AS y, CAST(e AS double) AS v FROM soft0),
soft AS (SELECT image_id, i, x, y, {', '.join(_SOFT)} FROM soft1)"""


#: Cells with a low mask and colours of their own, from the value v of an embedding's component and the values w and u of two others.
TINTED = (("alpha", "0.15e0 + 2 * v"), ("gradient", "2 * abs(w)"), ("texture", "2 * abs(u)"), ("l", "0.5e0 + 1.5e0 * v"), ("a", "0.5e0 + 1.2e0 * w"), ("b", "0.5e0 + u"))
_TINTED = [f"least(1.0e0, greatest(0.0e0, {e})) AS {c}" for c, e in TINTED]


def tinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y and the columns of TINTED: eight by eight cells an embedding."""
    rows = given(spark, sf_dir, "embeddings").selectExpr("vec_id AS image_id", "embedding", "posexplode(embedding) AS (i, e)")
    of = "CAST(element_at(embedding, CAST((i + {}) % 64 + 1 AS int)) AS double) AS {}".format
    rows = rows.selectExpr("image_id", "i % 8 AS x", "CAST(floor(i / 8) AS int) AS y", "CAST(e AS double) AS v", of(7, "w"), of(19, "u"))
    return rows.selectExpr("image_id", "x", "y", *_TINTED)


SQL_TINTED = f"""tinted0 AS (SELECT vec_id AS image_id, unnest(generate_series(0, len(embedding) - 1)) AS j, unnest(embedding) AS e, embedding FROM embeddings),
tinted1 AS (SELECT image_id, CAST(j % 8 AS int) AS x, CAST(j // 8 AS int) AS y, CAST(e AS double) AS v, CAST(embedding[(j + 7) % 64 + 1] AS double) AS w, CAST(embedding[(j + 19) % 64 + 1] AS double) AS u FROM tinted0),
tinted AS (SELECT image_id, x, y, {', '.join(_TINTED)} FROM tinted1)"""
