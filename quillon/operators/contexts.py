"""Documents that are stored under a key: read with validation, and with a default that is put back where they don't hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wear

#: Temperature and weather of each season where nothing valid is stored.
DEFAULTS = {"Winter": (8.0, "Cold"), "Spring": (20.0, "Fresh"), "Summer": (32.0, "Sunny"), "Autumn": (16.0, "Cloudy")}


def weather_contexts(stored: DataFrame, day: Column) -> DataFrame:
    """stored (key, document, ...) with temperature, weather, season and put_back: what a reader of each key gets on a day.

    A document holds if its temperature is a number, its weather a text and its season one of the four, by the types of JSON: the text "12" isn't
    a number. Else the default of the day's season is read, and put_back says that it is also stored from then on.
    """
    document = F.try_parse_json("document")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(document, f"$.{name}", "variant"))
    text = lambda name: F.try_variant_get(document, f"$.{name}", "string")
    number = kind("temperature").isin("BIGINT", "DOUBLE", "FLOAT") | kind("temperature").startswith("DECIMAL")
    holds = number & (kind("weather") == "STRING") & (kind("season") == "STRING") & text("season").isin(*DEFAULTS)
    rows = stored.withColumn("holds", F.coalesce(holds, F.lit(False)))
    season = wear.calendar_season(day)
    of = lambda k: F.element_at(F.create_map(*[x for s, v in DEFAULTS.items() for x in (F.lit(s), F.lit(v[k]))]), season)
    pick = lambda own, default: F.when(F.col("holds"), own).otherwise(default)
    return rows.select(
        *stored.columns, pick(F.try_variant_get(document, "$.temperature", "double"), of(0)).alias("temperature"), pick(text("weather"), of(1)).alias("weather"),
        pick(text("season"), season).alias("season"), (~F.col("holds")).alias("put_back"),
    )
