"""The catalogue of clothes: what is written as a category, a subcategory or a season, and what is known of each."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import cleaned, trimmed
from .wear import AUTUMN_WINTER, SUMMER_ONLY, WINTER_ONLY

#: The words for each category, after cleaning.
CATEGORY_WORDS = {
    "All": ("all",),
    "Tops": ("top", "tops", "shirt", "shirts", "t shirt", "tshirt", "tshirts", "blouse", "blouses", "hoodie", "hoodies", "sweater", "sweaters", "polo", "polos", "tank top", "crop top"),
    "Pants": ("pant", "pants", "trouser", "trousers", "jean", "jeans", "cargo", "cargos", "jogger", "joggers", "legging", "leggings", "chino", "chinos"),
    "Shorts": ("short", "shorts", "short pant", "short pants"),
    "Dresses": ("dress", "dresses", "gown", "gowns"),
    "Skirts": ("skirt", "skirts"),
    "Shoes": ("shoe", "shoes", "sneaker", "sneakers", "boot", "boots", "loafer", "loafers", "sandal", "sandals", "slides"),
    "Heels": ("heel", "heels", "high heel", "high heels", "stiletto", "stilettos", "pumps"),
    "Jackets": ("jacket", "jackets", "coat", "coats", "blazer", "blazers", "bomber", "puffer", "trench", "outerwear"),
    "Bags": ("bag", "bags", "handbag", "handbags", "backpack", "backpacks", "purse", "purses"),
    "Accessories": ("accessory", "accessories", "watch", "watches", "cap", "caps", "hat", "hats"),
}
#: Subcategories, each known by its own words, and the other words for some.
SUB_CATEGORIES = (
    "TShirt", "Shirt", "Blouse", "Polo", "Hoodie", "Sweater", "TankTop", "CropTop", "LongSleeve", "Turtleneck", "Cardigan", "SportsTop",
    "Jeans", "Cargo", "Formal", "Joggers", "WideLeg", "StraightLeg", "SlimFit", "Chinos", "Leggings", "Flared", "Culottes",
    "DenimShorts", "CargoShorts", "SportShorts", "LinenShorts", "CasualShorts", "TailoredShorts", "CyclingShorts",
    "MiniSkirt", "MidiSkirt", "MaxiSkirt", "PleatedSkirt", "PencilSkirt", "DenimSkirt", "WrapSkirt",
    "MiniDress", "MidiDress", "MaxiDress", "CasualDress", "FormalDress", "EveningDress", "BodyconDress", "ShirtDress", "SummerDress", "CocktailDress", "SweaterDress",
    "Sneakers", "RunningShoes", "Boots", "ChelseaBoots", "AnkleBoots", "Loafers", "OxfordShoes", "FormalShoes", "Sandals", "Slides",
    "Pumps", "Stilettos", "BlockHeels", "KittenHeels", "PlatformHeels", "HeeledBoots", "WedgeHeels",
    "Jacket", "Coat", "Blazer", "DenimJacket", "LeatherJacket", "Bomber", "Puffer", "TrenchCoat", "RainJacket", "Overcoat", "Vest",
    "Backpack", "Handbag", "Cap", "Watch",
)
SUB_ALIASES = {
    "tshirt": "TShirt", "tee": "TShirt", "jumper": "Sweater", "jean": "Jeans", "cargos": "Cargo", "formal pants": "Formal", "jogger": "Joggers", "chino": "Chinos", "legging": "Leggings",
    "sports shorts": "SportShorts", "a line skirt": "AlineSkirt", "sneaker": "Sneakers", "boot": "Boots", "loafer": "Loafers", "oxford": "OxfordShoes", "sandal": "Sandals", "slide": "Slides",
    "pump": "Pumps", "stiletto": "Stilettos", "trench": "TrenchCoat", "bag": "Handbag", "purse": "Handbag", "hat": "Cap",
}
SEASON_WORDS = {"Summer": ("summer", "estate"), "Autumn": ("autumn", "fall", "autunno"), "Winter": ("winter", "inverno")}
#: What subcategories are worn as, and how warm they are.
SMART_CASUAL = ("Shirt", "Polo", "Blouse", "Chinos", "StraightLeg", "WideLeg", "Loafers", "ChelseaBoots", "Blazer", "MidiSkirt", "ShirtDress")
FORMAL = ("Formal", "Blazer", "PencilSkirt", "FormalDress", "EveningDress", "CocktailDress", "Pumps", "Stilettos", "BlockHeels", "KittenHeels", "OxfordShoes", "FormalShoes", "Overcoat")
SPORT = ("SportsTop", "Joggers", "Leggings", "SportShorts", "CyclingShorts", "Sneakers", "RunningShoes")
STREETWEAR = ("Hoodie", "Cargo", "CargoShorts", "WideLeg", "Bomber", "Puffer", "Sneakers", "Cap", "Backpack")
LUXURY = ("Blazer", "Formal", "PencilSkirt", "FormalDress", "EveningDress", "CocktailDress", "Pumps", "Stilettos", "BlockHeels", "Handbag", "Watch", "Overcoat", "TrenchCoat")
VERY_WARM = ("Puffer", "Coat", "Overcoat")
WARM = ("Sweater", "Turtleneck", "Hoodie", "Cardigan", "SweaterDress", "Boots", "ChelseaBoots", "AnkleBoots", "HeeledBoots")
LIGHT = ("TankTop", "CropTop", "LinenShorts", "SportShorts", "SummerDress", "Sandals", "Slides")
#: Id, label, gender and category of the templates, and the groups that show them, in order.
TEMPLATES = (
    ("male-tshirt-regular", "T-Shirt Regular", "male", "Tops"), ("male-tshirt-oversized", "T-Shirt Oversized", "male", "Tops"), ("male-polo", "Polo", "male", "Tops"),
    ("male-shirt-short-sleeve", "Short-Sleeve Shirt", "male", "Tops"), ("male-shirt-long-sleeve", "Long-Sleeve Shirt", "male", "Tops"),
    ("male-short-shorts", "Short Shorts", "male", "Shorts"), ("male-long-shorts", "Long Shorts", "male", "Shorts"), ("male-pants", "Pants", "male", "Pants"),
    ("male-sneakers-slim", "Slim Sneaker", "male", "Shoes"), ("male-sneakers-regular", "Regular Sneaker", "male", "Shoes"), ("male-sneakers-chunky", "Chunky Sneaker", "male", "Shoes"),
    ("male-shoes-classic-lace-up", "Classic Lace-Up", "male", "Shoes"), ("male-shoes-loafer", "Loafer", "male", "Shoes"),
)
DEFAULT_TEMPLATE = "male-tshirt-regular"
TEMPLATE_GROUPS = {
    "top": ("male-tshirt-regular", "male-tshirt-oversized", "male-polo"), "shirt": ("male-shirt-short-sleeve", "male-shirt-long-sleeve"), "shorts": ("male-short-shorts", "male-long-shorts"), "pants": ("male-pants",),
    "sneakers": ("male-sneakers-slim", "male-sneakers-regular", "male-sneakers-chunky"), "shoes": ("male-shoes-classic-lace-up", "male-shoes-loafer"),
}


def category_words() -> list[tuple[str, str]]:
    return [(w, name) for name, words in CATEGORY_WORDS.items() for w in words]


def sub_words() -> list[tuple[str, str]]:
    return [(re.sub(r"(?<!^)(?=[A-Z])", " ", name).lower(), name) for name in SUB_CATEGORIES] + list(SUB_ALIASES.items())


def with_names(items: DataFrame) -> DataFrame:
    """items with kind and sub_kind: what category and sub_category (as written) are called in the catalogue.

    A category that isn't known is Accessories; a subcategory that isn't known stays as it is, without blanks around it. The
    words are a list of fixed length, so they are sent to all tasks.
    """
    spark: SparkSession = items.sparkSession
    kinds = F.broadcast(spark.createDataFrame(category_words(), "c string, kind string"))
    subs = F.broadcast(spark.createDataFrame(sub_words(), "s string, sub string"))
    rows = items.withColumns({"c": cleaned(F.col("category")), "s": cleaned(F.col("sub_category"))}).join(kinds, "c", "left").join(subs, "s", "left")
    own = F.when(F.col("s") != "", F.coalesce("sub", trimmed(F.col("sub_category"))))
    return rows.withColumns({"kind": F.coalesce("kind", F.lit("Accessories")), "sub_kind": own}).drop("c", "s", "sub")


def season(x: Column) -> Column:
    """Summer, Autumn or Winter of an English or Italian word; null for another one."""
    t = cleaned(x)
    out = F.lit(None).cast("string")
    for name, words in SEASON_WORDS.items():
        out = F.when(t.isin(*words), name).otherwise(out)
    return out


def seasons(*words: Column) -> Column:
    """The different seasons of the words, in their order."""
    return F.array_distinct(F.array_compact(F.array(*[season(w) for w in words])))


def role(kind: Column, sub: Column) -> Column:
    return (
        F.when(kind == "Tops", "UpperBody").when(kind.isin("Pants", "Shorts", "Skirts"), "LowerBody").when(kind == "Dresses", "FullBody").when(kind.isin("Shoes", "Heels"), "Footwear").when(kind == "Jackets", "Outerwear")
        .when((kind == "Bags") | sub.isin("Backpack", "Handbag"), "Bag").when(sub == "Cap", "Headwear").when(sub == "Watch", "Watch").otherwise("Accessory")
    )


def _texts(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def default_seasons(kind: Column, sub: Column) -> Column:
    return (
        F.when(sub.isin(*SUMMER_ONLY), _texts("Summer")).when(sub.isin(*WINTER_ONLY), _texts("Winter")).when(sub.isin(*AUTUMN_WINTER), _texts("Autumn", "Winter"))
        .when(kind == "Shorts", _texts("Summer")).when(kind == "Jackets", _texts("Autumn", "Winter")).when(kind == "Dresses", _texts("Summer", "Autumn")).otherwise(_texts("Summer", "Autumn", "Winter"))
    )


def knowledge(kind: Column, sub: Column) -> list[Column]:
    """styles, occasions, warmth and formality. Later rules replace what earlier ones say; streetwear and luxury add to it."""
    styles = F.when(sub.isin(*SPORT), _texts("Sport", "Casual")).when(sub.isin(*FORMAL), _texts("Classic", "Elegant", "Luxury", "Business")).when(sub.isin(*SMART_CASUAL), _texts("SmartCasual", "Classic", "Minimal")).otherwise(_texts("Casual", "Minimal"))
    occasions = F.when(sub.isin(*SPORT), _texts("Sport", "Casual")).when(sub.isin(*FORMAL), _texts("Work", "Party", "Date")).when(sub.isin(*SMART_CASUAL), _texts("Casual", "Work", "Date")).otherwise(_texts("Casual"))
    formality = F.when(sub.isin(*SPORT), 1).when(sub.isin(*FORMAL), 5).when(sub.isin(*SMART_CASUAL), 3).otherwise(2)
    street, luxury = sub.isin(*STREETWEAR), sub.isin(*LUXURY)
    plus = lambda x, when, *more: F.when(when, F.array_union(x, _texts(*more))).otherwise(x)
    warmth = F.when(sub.isin(*VERY_WARM), 5).when(sub.isin(*WARM), 4).when(sub.isin(*LIGHT), 1).when(kind.isin("Jackets", "Pants"), 3).otherwise(2)
    return [
        plus(plus(styles, street, "Streetwear", "Casual"), luxury, "Luxury", "Elegant").alias("styles"), plus(plus(occasions, street, "Casual"), luxury, "Party", "Date").alias("occasions"),
        warmth.alias("warmth"), F.when(street, F.least(formality, F.lit(2))).otherwise(formality).alias("formality"),
    ]


def families(kind: Column, role_of: Column) -> list[Column]:
    return [
        kind.isin("Pants", "Shorts", "Skirts").alias("is_bottom"), (kind == "Dresses").alias("is_full_body"), (kind == "Tops").alias("is_top"), (kind == "Jackets").alias("is_jacket"), kind.isin("Accessories", "Bags").alias("is_accessory"),
        kind.isin("Shoes", "Heels").alias("is_shoes"), (role_of == "Bag").alias("is_bag"), (role_of == "Headwear").alias("is_cap"), (role_of == "Watch").alias("is_watch"),
    ]


def accessory_types(category: Column, sub_category: Column, name: Column) -> list[Column]:
    """strict: by category and subcategory alone; loose: also by words in all texts. They differ and both are in use."""
    c, s = cleaned(category), cleaned(sub_category)
    every = F.concat_ws(" ", *[F.when(x != "", x) for x in (c, s, cleaned(name))])
    bag = s.isin("handbag", "bag") | c.isin("bags", "bag")
    return [
        bag.alias("strict_handbag"), *[(s == w).alias(f"strict_{w}") for w in ("backpack", "cap", "watch")],
        (bag | every.contains("handbag")).alias("loose_handbag"), ((s == "backpack") | every.contains("backpack")).alias("loose_backpack"),
        ((s == "cap") | every.contains(" cap") | every.startswith("cap")).alias("loose_cap"), ((s == "watch") | every.contains("watch")).alias("loose_watch"),
    ]
