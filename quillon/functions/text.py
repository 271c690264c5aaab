"""Texts as the services of the data trim, check and coerce them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def normalized(x: Column, most: int) -> Column:
    """Without blanks at both ends and cut to `most` characters; null for a blank text."""
    t = F.trim(x)
    return F.when(t == "", F.lit(None)).otherwise(F.substring(t, 1, max(1, most)))


def optional(x: Column, most: int) -> Column:
    t = trimmed(x)
    return F.when(t == "", F.lit(None)).otherwise(F.substring(t, 1, most))


def as_boolean(x: Column, fallback: bool = False) -> Column:
    t = F.lower(trimmed(x.cast("string")))
    return F.when(t.isin("true", "1"), F.lit(True)).when(t.isin("false", "0"), F.lit(False)).otherwise(F.lit(fallback))


def as_count(x: Column, fallback: int = 0) -> Column:
    """A whole number from 0 of a number or of its text."""
    n = x.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(fallback)).otherwise(F.greatest(F.lit(0), F.floor(n))).cast("long")


def platform(x: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(x, F.lit("unknown"))))
    return F.when(t.isin("ios", "android"), t).otherwise(F.lit("unknown"))


def shortened(x: Column, most: int) -> Column:
    """At most so many characters, the last one an ellipsis where something is cut."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def cleaned(x: Column) -> Column:
    """Lower case, with one blank for each run of blanks, hyphens and underscores."""
    return trimmed(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[\s_-]+", " "))


def major_version(x: Column) -> Column:
    return F.regexp_extract(F.coalesce(x.cast("string"), F.lit("")), r"(\d+)", 1).try_cast("int")


def image_format(uri: Column) -> Column:
    """png, webp, heic or jpg, by the data header or the ending before any query."""
    t = F.lower(F.regexp_replace(F.coalesce(uri, F.lit("")), r"[?#].*$", ""))
    out = F.lit("jpg")
    for name in ("heic", "webp", "png"):
        out = F.when(t.startswith(f"data:image/{name}") | t.endswith(f".{name}"), F.lit(name)).otherwise(out)
    return out
