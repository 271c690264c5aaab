"""Clothes: roles, seasons, weather and the older score of a look."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import MATCHING
from .num import half_up, score
from .text import cleaned, trimmed

#: Roles of categories, seasons of subcategories and categories.
ROLES = {"Tops": "UpperBody", "Pants": "LowerBody", "Shorts": "LowerBody", "Skirts": "LowerBody", "Dresses": "FullBody", "Shoes": "Footwear", "Heels": "Footwear", "Jackets": "Outerwear", "Bags": "Bag"}
SUB_ROLES = {"Backpack": "Bag", "Handbag": "Bag", "Cap": "Headwear", "Watch": "Watch"}
SUMMER_ONLY = ("TankTop", "CropTop", "DenimShorts", "CargoShorts", "SportShorts", "LinenShorts", "CasualShorts", "TailoredShorts", "CyclingShorts", "SummerDress", "Sandals", "Slides", "WedgeHeels")
WINTER_ONLY = ("Sweater", "Turtleneck", "SweaterDress", "Puffer", "Coat", "Overcoat", "Boots", "ChelseaBoots", "AnkleBoots", "HeeledBoots")
AUTUMN_WINTER = ("Hoodie", "Cardigan", "LeatherJacket", "Bomber", "TrenchCoat", "RainJacket", "DenimJacket")
RAIN_WORDS = ("rain", "storm", "drizzle", "shower", "thunder")
HOT_FROM = 28


def _texts(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def engine_role(category: Column) -> Column:
    """The role in the ranking of looks; what isn't known is an accessory."""
    c = cleaned(category)
    return (
        F.when(c.isin("top", "tops"), "Tops").when(c.isin("pants", "shorts", "skirts", "bottoms"), "Bottoms").when(c.isin("shoes", "heels", "heel"), "Shoes")
        .when(c.isin("jacket", "jackets"), "Jackets").when(c.isin("dress", "dresses"), "Dresses").otherwise("Accessories")
    )


def role(category: Column, sub_category: Column) -> Column:
    out = F.lit("Accessory")
    for name, r in reversed(SUB_ROLES.items()):
        out = F.when(sub_category == name, r).otherwise(out)
    for name, r in ROLES.items():
        out = F.when(category == name, r).otherwise(out)
    return out


def seasons(category: Column, sub_category: Column) -> Column:
    sub = F.coalesce(sub_category, F.lit(""))
    return (
        F.when(sub.isin(*SUMMER_ONLY), _texts("Summer")).when(sub.isin(*WINTER_ONLY), _texts("Winter")).when(sub.isin(*AUTUMN_WINTER), _texts("Autumn", "Winter"))
        .when(category == "Shorts", _texts("Summer")).when(category == "Jackets", _texts("Autumn", "Winter")).when(category == "Dresses", _texts("Summer", "Autumn")).otherwise(_texts("Summer", "Autumn", "Winter"))
    )


def suits(item_seasons: Column, season: Column) -> Column:
    """Whether an item can be worn in a season; an unknown one suits all."""
    return F.when(season.isNull(), F.lit(True)).otherwise(F.array_contains(item_seasons, season))


def calendar_season(day: Column) -> Column:
    m = F.month(day)
    return F.when(m.isin(12, 1, 2), "Winter").when(m <= 5, "Spring").when(m <= 8, "Summer").otherwise("Autumn")


def weather_class(words: Column, temperature: Column) -> Column:
    t = F.lower(trimmed(F.coalesce(words, F.lit(""))))
    wet = F.lit(False)
    for w in RAIN_WORDS:
        wet = wet | t.contains(w)
    return F.when(wet, "Rainy").when((t == "hot") | F.coalesce(temperature >= HOT_FROM, F.lit(False)), "Hot").otherwise("Mild")


def temperature(celsius: Column, unit: str) -> Column:
    return (half_up(celsius * 9 / 5 + 32) if unit == "F" else half_up(celsius)).cast("int")


def goes_with(a: Column, b: Column) -> Column:
    """The same colour, or one that is on the first one's list; the other way round doesn't count. Missing: no."""
    return F.coalesce((a == b) | F.concat_ws(">", a, b).isin(*MATCHING), F.lit(False)) & a.isNotNull() & b.isNotNull()


def older_score(top: Column, bottom: Column, shoes: Column, jacket: Column, accessory: Column, degrees: Column, weather: Column, season: Column, occasion: Column) -> list[Column]:
    """ai_color, ai_weather, ai_season, ai_style and ai_overall; sub-scores are whole before they are blended."""
    plus = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    worn, bare = jacket.isNotNull(), jacket.isNull()
    color = F.lit(60) + plus(goes_with(top, bottom), 15) + plus(goes_with(bottom, shoes), 10) + plus(goes_with(top, shoes), 8) + plus(goes_with(top, jacket), 5)
    air = F.lit(80) + plus((degrees >= 28) & bare, 15) + plus((degrees >= 28) & worn, -20) + plus((degrees <= 15) & worn, 15) + plus((degrees <= 15) & bare, -20) + plus((weather == "Rainy") & worn, 12) + plus((weather == "Rainy") & bare, -15)
    time = F.lit(80) + plus((season == "Summer") & bare, 15) + plus((season == "Summer") & worn, -20) + plus((season == "Winter") & worn, 15) + plus((season == "Winter") & bare, -15)
    style = F.lit(80) + plus(top.isNotNull() & bottom.isNotNull() & shoes.isNotNull(), 8) + plus(accessory.isNotNull(), 4) + plus((occasion == "Work") & worn, 6) + plus((occasion == "Date") & accessory.isNotNull(), 6) + plus(occasion == "Casual", 4)
    parts = [score(x) for x in (color, air, time, style)]
    overall = half_up(parts[0] * 0.3 + parts[1] * 0.25 + parts[2] * 0.25 + parts[3] * 0.2).cast("int")
    return [p.alias(f"ai_{n}") for p, n in zip(parts, ("color", "weather", "season", "style"), strict=True)] + [overall.alias("ai_overall")]
