"""Saved looks: cleaning, facets, the best and the latest, and picks that don't change until their seed does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: Looks among which one is drawn; facets that are no occasions.
TOP, FACETS = 10, ("All", "Favorites", "Hot", "Mild", "Rainy", "Summer")
LOOK = "top long, bottom long, shoes long, jacket long, occasion string, weather string, season string, score long, ai_score long, color_score long"


def plain_weather(x: Column) -> Column:
    """Hot, Rainy or Mild of what is written; anything else is Mild."""
    t = F.lower(trimmed(x))
    return F.when(t == "hot", "Hot").when(t.isin("rain", "rainy"), "Rainy").otherwise("Mild")


def newest_first(rows: DataFrame) -> DataFrame:
    """place: of each user's rows from 1, the newest first; rows of one time by id."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("created_ms"), "id")))


def as_documents(rows: DataFrame) -> DataFrame:
    """id, user_id, favorite, created_ms and look: the look as one JSON document."""
    names = [f.split()[0] for f in LOOK.split(", ")]
    return rows.select("id", "user_id", "favorite", "created_ms", F.to_json(F.struct(*[F.col(n) for n in names if n in rows.columns])).alias("look"))


def parsed(documents: DataFrame) -> DataFrame:
    """The documents with look as a struct; one that isn't a document is an empty look, which is what is stored then."""
    look = F.from_json("look", LOOK, {"mode": "PERMISSIVE"})
    empty = F.from_json(F.lit("{}"), LOOK)
    return documents.withColumn("look", F.when(trimmed(F.coalesce("look", F.lit(""))).rlike(r"^\{.*\}$"), F.coalesce(look, empty)).otherwise(empty))


def cleaned(rows: DataFrame) -> DataFrame:
    """What is shown of a saved look (a struct): no jacket, summer, and one of three kinds of weather."""
    look = F.col("look").withField("jacket", F.lit(None).cast("long")).withField("season", F.lit("Summer")).withField("weather", plain_weather(F.col("look.weather")))
    return rows.withColumn("look", look)


def shown_by(facet: str) -> Column:
    """Whether a row (favorite, look) is shown under a facet; Summer shows everything, as All does."""
    if facet in ("All", "Summer"):
        return F.lit(True)
    if facet == "Favorites":
        return F.coalesce("favorite", F.lit(False))
    if facet in FACETS:
        return plain_weather(F.col("look.weather")) == facet
    return F.coalesce(F.lower(trimmed(F.col("look.occasion"))) == facet.lower(), F.lit(False))


def best_scores(rows: DataFrame) -> DataFrame:
    """best_match and best_color of each user; a score of 0 counts as none, and none is 0."""
    match = F.coalesce(F.nullif(F.col("score"), F.lit(0)), F.nullif(F.col("ai_score"), F.lit(0)), F.lit(0))
    return rows.groupBy("user_id").agg(F.max(match).cast("long").alias("best_match"), F.max(F.coalesce("color_score", F.lit(0))).cast("long").alias("best_color"))


def latest(rows: DataFrame) -> DataFrame:
    """The newest row of each user that has a time; of one time the first id. Partial maxima come before the shuffle."""
    key = F.struct(F.col("created_ms"), (-F.col("id")).alias("first"))
    return rows.where(F.coalesce("created_ms", F.lit(0)) != 0).groupBy("user_id").agg(F.max_by("id", key).alias("id"), F.max("created_ms").alias("created_ms"))


def draw(rows: DataFrame, by: list[str], seed: Column) -> DataFrame:
    """One row of each group, the same one as long as the seed is: that with the smallest digest of seed and id."""
    key = F.md5(F.concat_ws("-", seed, F.col("id").cast("string")))
    return rows.groupBy(*by).agg(F.min_by("id", F.struct(key, "id")).alias("id"))


def draw_other(rows: DataFrame, by: str, current: Column, seed: Column) -> DataFrame:
    """One of the TOP best rows (by, id, rank) of each group whose identity isn't the current one; that one where there is no other."""
    key = F.md5(F.concat_ws("-", seed, F.col("id").cast("string")))
    among = rows.where(F.col("rank") <= TOP).withColumn("again", (F.col("id") == current).cast("int"))
    return among.groupBy(by).agg(F.min_by("id", F.struct("again", key, "id")).alias("id"))


def single(rows: DataFrame, key: str) -> DataFrame:
    """rows, of which none has a key twice; the query fails where one does."""
    twice = F.count("*").over(W.partitionBy(key)) > 1
    error = F.raise_error(F.lit("several rows of one key")).cast(rows.schema[key].dataType)
    return rows.withColumn(key, F.when(twice, error).otherwise(F.col(key)))  # in the key, so that no plan leaves it out


def found(keys: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Every key with its row, or with nulls where there is none; several rows of one key are an error."""
    return keys.join(single(rows, key), key, "left")
