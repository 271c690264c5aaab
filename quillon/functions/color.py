"""Colours: names, groups, and how well they go together."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import COLORS
from .num import score
from .text import cleaned

#: Fixed values, in the order in which names are looked for: shades of each colour and the colours that go with it.
SHADES = {
    "Black": ("Black", "Jet Black", "Charcoal", "Washed Black"),
    "White": ("White", "Off White", "Ivory", "Cream"),
    "Gray": ("Gray", "Light Gray", "Dark Gray", "Charcoal Gray", "Ash Gray"),
    "Blue": ("Blue", "Royal Blue", "Sky Blue", "Light Blue", "Dark Blue"),
    "Navy": ("Navy", "Midnight Blue", "Dark Navy"),
    "Denim": ("Denim", "Light Denim", "Dark Denim"),
    "Beige": ("Beige", "Sand", "Stone"),
    "Camel": ("Camel", "Light Camel", "Dark Camel"),
    "Cream": ("Cream", "Off White", "Ivory"),
    "Brown": ("Brown", "Chocolate", "Coffee", "Dark Brown", "Light Brown"),
    "Green": ("Green", "Forest Green", "Dark Green", "Mint Green", "Sage Green"),
    "Olive": ("Olive", "Olive Green", "Military Green"),
    "Red": ("Red", "Dark Red", "Bright Red"),
    "Burgundy": ("Burgundy", "Wine", "Maroon"),
    "Pink": ("Pink", "Light Pink", "Dusty Pink", "Rose"),
    "Yellow": ("Yellow", "Mustard", "Golden Yellow"),
    "Orange": ("Orange", "Burnt Orange", "Rust"),
    "Purple": ("Purple", "Lavender", "Dark Purple"),
    "Khaki": ("Khaki", "Light Khaki"),
    "Gold": ("Gold",),
    "Silver": ("Silver",),
}
MATCHES = {
    "Black": ("White", "Gray", "Beige", "Cream", "Camel", "Blue", "Navy", "Olive", "Burgundy", "Red", "Pink", "Silver", "Denim"),
    "White": ("Black", "Gray", "Blue", "Navy", "Brown", "Green", "Olive", "Beige", "Camel", "Khaki", "Burgundy", "Pink", "Gold", "Denim"),
    "Gray": ("Black", "White", "Blue", "Navy", "Beige", "Camel", "Pink", "Burgundy", "Green", "Olive"),
    "Blue": ("White", "Gray", "Black", "Beige", "Camel", "Brown", "Olive", "Cream"),
    "Navy": ("White", "Gray", "Beige", "Cream", "Camel", "Brown", "Burgundy", "Pink", "Olive", "Gold"),
    "Denim": ("White", "Black", "Gray", "Beige", "Camel", "Brown", "Olive"),
    "Beige": ("Black", "White", "Brown", "Blue", "Navy", "Green", "Olive", "Burgundy", "Gray"),
    "Camel": ("White", "Black", "Navy", "Blue", "Cream", "Olive", "Brown", "Gray"),
    "Cream": ("Brown", "Camel", "Navy", "Blue", "Olive", "Black", "Gray", "Burgundy"),
    "Brown": ("White", "Cream", "Beige", "Camel", "Blue", "Navy", "Olive", "Green"),
    "Green": ("White", "Black", "Brown", "Beige", "Cream", "Gray", "Camel"),
    "Olive": ("Black", "White", "Cream", "Camel", "Brown", "Gray", "Beige", "Navy"),
    "Red": ("Black", "White", "Gray", "Cream", "Denim"),
    "Burgundy": ("Black", "White", "Gray", "Beige", "Cream", "Navy", "Camel", "Pink"),
    "Pink": ("White", "Gray", "Navy", "Black", "Beige", "Camel", "Burgundy"),
    "Yellow": ("Black", "Gray", "Blue", "Navy", "White"),
    "Orange": ("Black", "White", "Brown", "Beige", "Navy"),
    "Purple": ("Black", "White", "Gray", "Silver"),
    "Khaki": ("White", "Black", "Olive", "Brown", "Navy"),
    "Gold": ("Black", "White", "Navy", "Burgundy"),
    "Silver": ("Black", "White", "Gray", "Blue"),
}
#: Groups of colours, pairs that go very well, and pairs at risk.
NEUTRAL = ("Black", "White", "Gray", "Navy", "Denim", "Beige", "Camel", "Cream", "Brown", "Khaki", "Olive", "Gold", "Silver")
STRONG = ("Red", "Yellow", "Orange", "Purple", "Pink", "Green", "Blue", "Burgundy")
LIGHT = ("White", "Cream", "Beige", "Camel", "Pink", "Yellow", "Silver")
DARK = ("Black", "Navy", "Brown", "Olive", "Burgundy", "Purple", "Gray")
WARM = ("Red", "Orange", "Yellow", "Brown", "Camel", "Beige", "Cream", "Burgundy", "Pink", "Gold")
COOL = ("Blue", "Navy", "Denim", "Green", "Olive", "Purple", "Gray", "Silver")
SPRING = ("White", "Cream", "Beige", "Blue", "Green", "Pink", "Yellow", "Denim")
RAIN, SPORT = ("Black", "Navy", "Gray", "Brown", "Olive", "Denim"), ("Black", "White", "Gray", "Blue", "Navy")
BRIGHTNESS_GROUPS = {
    "dark": ("Black", "Navy", "Brown", "Olive", "Burgundy", "Purple"),
    "light": ("White", "Beige", "Cream", "Pink", "Yellow"),
    "medium": ("Gray", "Blue", "Denim", "Camel", "Green", "Red", "Orange", "Khaki"),
    "metallic": ("Gold", "Silver"),
}
BRIGHTNESS = {c: g for g, names in BRIGHTNESS_GROUPS.items() for c in names}
SATURATION_GROUPS = {
    "neutral": ("Black", "White", "Gray", "Beige", "Cream"),
    "strong": ("Blue", "Green", "Red", "Yellow", "Orange", "Purple"),
    "soft": ("Navy", "Denim", "Camel", "Brown", "Olive", "Burgundy", "Pink", "Khaki"),
    "metallic": ("Gold", "Silver"),
}
SATURATION = {c: g for g, names in SATURATION_GROUPS.items() for c in names}
EXCELLENT = (("Black", "White"), ("Black", "Gray"), ("Black", "Beige"), ("White", "Navy"), ("White", "Blue"), ("White", "Denim"), ("Beige", "Brown"), ("Beige", "Navy"), ("Camel", "Navy"), ("Cream", "Brown"), ("Gray", "Navy"), ("Blue", "Brown"), ("Olive", "Cream"), ("Burgundy", "Beige"))
RISKY = (("Red", "Green"), ("Purple", "Yellow"), ("Orange", "Pink"), ("Red", "Orange"), ("Green", "Purple"))
BRIGHTNESS_WORDS = (("light", ("light", "sky", "ivory", "off white", "mint")), ("dark", ("dark", "midnight", "charcoal", "coffee", "chocolate")))
SATURATION_WORDS = (("soft", ("dusty", "washed", "sage", "pastel")), ("strong", ("bright", "royal")))
UNKNOWN = "Unknown"


def canonical_pairs(pairs) -> list[str]:
    return ["|".join(sorted(p)) for p in pairs]


MATCHING = [f"{c}>{m}" for c in COLORS for m in MATCHES[c]]


def literal_map(of: dict[str, str | int]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in of.items()))


def _first(conditions, other: Column) -> Column:
    out = other
    for condition, value in reversed(list(conditions)):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def _has(t: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | t.contains(w)
    return out


def normalize(value: Column) -> Column:
    """The colour that a free text means: its name or shade as it is, else the first colour with a shade that is part of the
    text or that the text is part of. White comes before Cream and has it as a shade, so Cream means White."""
    t = cleaned(value)
    exact = {}
    for c in COLORS:
        for name in (c, *SHADES[c]):
            exact.setdefault(name.lower(), c)
    # one array to look through instead of a branch for each shade: the generated code stays small
    shades = F.array(*[F.struct(F.lit(s.lower()).alias("s"), F.lit(c).alias("c")) for c in COLORS for s in SHADES[c]])
    part = F.filter(shades, lambda x: t.contains(x["s"]) | x["s"].contains(t))
    return F.when(t == "", F.lit(UNKNOWN)).otherwise(F.coalesce(literal_map(exact)[t], F.get(part, F.lit(0))["c"], F.lit(UNKNOWN)))


def _group(value: Column, color: Column, words, of: dict[str, str]) -> Column:
    t = cleaned(value)
    return F.when(color == UNKNOWN, F.lit("unknown")).otherwise(_first([(_has(t, w), g) for g, w in words], literal_map(of)[color]))


def brightness(value: Column, color: Column) -> Column:
    return _group(value, color, BRIGHTNESS_WORDS, BRIGHTNESS)


def saturation(value: Column, color: Column) -> Column:
    return _group(value, color, SATURATION_WORDS, SATURATION)


def pair_score(a: Column, a_bright: Column, b: Column, b_bright: Column) -> Column:
    """How well two colours go together, by the first rule that holds: unknown, same, excellent, match of either, both or one
    neutral, light with dark, both warm or both cool, at risk, else."""
    key = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    goes = F.concat_ws(">", a, b).isin(*MATCHING) | F.concat_ws(">", b, a).isin(*MATCHING)
    contrast = ((a_bright == "light") & (b_bright == "dark")) | ((a_bright == "dark") & (b_bright == "light"))
    return (
        F.when((a == UNKNOWN) | (b == UNKNOWN), 62).when((a == b) & (a_bright != b_bright), 94).when(a == b, 86).when(key.isin(*canonical_pairs(EXCELLENT)), 98).when(goes, 91)
        .when(a.isin(*NEUTRAL) & b.isin(*NEUTRAL), 89).when(a.isin(*NEUTRAL) | b.isin(*NEUTRAL), 83).when(contrast, 79)
        .when((a.isin(*WARM) & b.isin(*WARM)) | (a.isin(*COOL) & b.isin(*COOL)), 74).when(key.isin(*canonical_pairs(RISKY)), 42).otherwise(64)
    )


def weighted(scores: list[tuple[Column, Column, int]]) -> Column:
    """The mean of (there, score, weight) over those that are there, whole; 55 without any."""
    total = sum((F.when(there, s * w).otherwise(0) for there, s, w in scores), F.lit(0))
    weights = sum((F.when(there, w).otherwise(0) for there, _, w in scores), F.lit(0))
    return F.when(weights <= 0, F.lit(55)).otherwise(score(total / weights))


#: What is compared in a look without a dress, with its weight; what a repeated colour adds.
HARMONY = (("top", "bottom", 35), ("bottom", "shoes", 25), ("top", "shoes", 15), ("jacket", "top", 20), ("bag", "shoes", 8), ("cap", "top", 5), ("watch", "top", 5), ("accessory", "top", 5))
REPEATS = (("shoes", "bag", 18), ("jacket", "shoes", 12), ("top", "shoes", 12), ("bottom", "jacket", 10), ("cap", "shoes", 8))


#: What is counted of the colours of a look, each in four bits of one number, so that one sum counts all of it.
COUNTED = {"known": COLORS, "light": LIGHT, "dark": DARK, "neutral": NEUTRAL, "strong": STRONG, "spring": SPRING, "rain": RAIN, "sport": SPORT}
BRIGHT = ("light", "dark", "medium")


#: All that brightness() says, and a number that is larger than that of any colour with any brightness.
BRIGHTNESSES, STRIDE, CODE_BITS = ("light", "dark", "medium", "metallic", "unknown"), 128, 48


def code(c: Column, b: Column) -> Column:
    """The colour c with brightness b as one number: the counts, and above CODE_BITS which of all pairs of both it is."""
    ix = F.coalesce(literal_map({n: i for i, n in enumerate(COLORS)})[c], F.lit(len(COLORS)))
    counts = literal_map({n: sum((n in names) << 4 * i for i, names in enumerate(COUNTED.values())) for n in COLORS})
    at = _first([(b == name, 1 << 4 * (len(COUNTED) + i)) for i, name in enumerate(BRIGHT)], F.lit(0)).cast("long")
    bright = F.array_position(F.array(*map(F.lit, BRIGHTNESSES)), b).cast("int") - 1
    return F.shiftleft((ix * len(BRIGHTNESSES) + bright).cast("long"), CODE_BITS) + F.coalesce(counts[c].cast("long"), F.lit(0).cast("long")) + at


def pair_scores(spark: SparkSession) -> DataFrame:
    """pair, pair_points: the score of any two codes a and b, at a * STRIDE + b. As many rows as there are pairs of codes."""
    n = (len(COLORS) + 1) * len(BRIGHTNESSES)
    rows = spark.range(n * n).select((F.col("id") / n).cast("int").alias("a"), (F.col("id") % n).cast("int").alias("b"))
    color = lambda k: F.element_at(F.array(*map(F.lit, (*COLORS, UNKNOWN))), (F.col(k) / len(BRIGHTNESSES)).cast("int") + 1)
    bright = lambda k: F.element_at(F.array(*map(F.lit, BRIGHTNESSES)), F.col(k) % len(BRIGHTNESSES) + 1)
    rows = rows.select("a", "b", color("a").alias("ca"), bright("a").alias("ba"), color("b").alias("cb"), bright("b").alias("bb"))
    return rows.select((F.col("a") * STRIDE + F.col("b")).cast("long").alias("pair"), pair_score(F.col("ca"), F.col("ba"), F.col("cb"), F.col("bb")).alias("pair_points"))


def counted(counts: Column, name: str) -> Column:
    """How many colours of a look count as one of COUNTED, or are as bright as one of BRIGHT."""
    place = [*COUNTED, *[f"{b} ones" for b in BRIGHT]].index(name)
    return F.shiftright(counts, 4 * place).bitwiseAND(15).cast("int")


def color_count_score(different: Column, style: Column) -> Column:
    four = F.when(style == "Streetwear", 88).when(style == "Sport", 82).otherwise(66)
    return F.when(different == 0, 45).when(different == 1, 86).when(different == 2, 100).when(different == 3, 96).when(different == 4, four).otherwise(F.when(style == "Streetwear", 64).otherwise(38))


def light_dark_score(light: Column, medium: Column, dark: Column, style: Column) -> Column:
    """Of how many colours are light, medium and dark; metallic ones and those that aren't known don't count."""
    n = light + medium + dark
    return (
        F.when(n == 0, 55).when((light > 0) & (dark > 0), 100).when((medium > 0) & ((light > 0) | (dark > 0)), 91)
        .when(dark == n, F.when(style.isin("Luxury", "Classic"), 88).otherwise(76)).when(light == n, F.when(style.isin("Minimal", "Sport"), 84).otherwise(72)).otherwise(78)
    )


def neutral_score(known: Column, neutral: Column, strong: Column) -> Column:
    return (
        F.when(known == 0, 50).when(strong == 0, F.when(neutral > 0, 92).otherwise(68)).when((strong == 1) & (neutral >= 1), 100)
        .when((strong == 2) & (neutral >= 2), 82).when(strong >= 3, 42).otherwise(70)
    )


def context_score(n, white: Column, style: Column, weather: Column, season: Column) -> Column:
    """n(name): how many colours count as that; white: whether one is white."""
    plus = lambda when, points: F.when(F.coalesce(when, F.lit(False)), points).otherwise(0)
    warm = (F.coalesce(weather == "Hot", F.lit(False))) | (F.coalesce(season == "Summer", F.lit(False)))
    total = F.lit(72) + plus(warm, n("light") * 6 - n("dark") * 2) + plus(weather == "Mild", n("neutral") * 2 + F.when((n("light") > 0) & (n("dark") > 0), 6).otherwise(0))
    total = total + plus(season == "Spring", n("spring") * 4) + plus((weather == "Rainy") & white, F.lit(-8)) + plus((weather == "Rainy") & (n("rain") > 0), F.lit(12))
    total = total + plus(style.isin("Minimal", "Classic", "Luxury"), n("neutral") * 4) + plus((style == "Streetwear") & n("strong").between(1, 2), F.lit(10)) + plus((style == "Sport") & (n("sport") > 0), F.lit(10))
    return F.when(n("known") == 0, 55).otherwise(score(total))


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and lightness of 8-bit red, green and blue."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = high - low, (high + low) / 2
    s = F.when(high == low, F.lit(0.0)).when(light > 0.5, d / (2 - high - low)).otherwise(d / (high + low))
    h = F.when(high == low, F.lit(0.0)).when(high == r, (g - b) / d + F.when(g < b, 6).otherwise(0)).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return h * 60, s, light


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value of 8-bit red, green and blue, each from 0 to 1."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    h = F.when(d == 0, 0.0).when(high == r, (g - b) / d).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return F.when(h < 0, h + 1).otherwise(h), F.when(high == 0, 0.0).otherwise(d / high), high


def hsv_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """The way round the circle of hues, which counts more the stronger the colours are, with saturation and value."""
    around = F.abs(a[0] - b[0])
    hue = F.least(around, 1 - around) * 2
    weight = F.lit(0.15) + (a[1] + b[1]) / 2 * 0.35
    return F.least(F.lit(1.0), hue * weight + F.abs(a[1] - b[1]) * 0.22 + F.abs(a[2] - b[2]) * (1 - weight - 0.22))


#: Bands of hue (up to, conditions in order, else); a condition is (least or most of l and s, colour).
HUES = (
    (12, (("l < 0.42", "Burgundy"), ("l > 0.68 AND s < 0.65", "Pink")), "Red"),
    (32, (("l < 0.36", "Brown"), ("s < 0.45 AND l > 0.55", "Camel")), "Orange"),
    (52, (("l > 0.72 AND s < 0.38", "Cream"), ("l > 0.56 AND s < 0.45", "Beige"), ("l < 0.42", "Brown")), "Camel"),
    (72, (("s < 0.35", "Khaki"), ("l < 0.45", "Gold")), "Yellow"),
    (165, (("s < 0.42 OR l < 0.36", "Olive"),), "Green"),
    (195, (("l > 0.72", "Blue"),), "Green"),
    (245, (("l < 0.32", "Navy"), ("s < 0.48 AND l < 0.62", "Denim")), "Blue"),
    (285, (("l < 0.35", "Navy"),), "Purple"),
    (345, (("l > 0.58", "Pink"),), "Purple"),
    (361, (("l < 0.42", "Burgundy"), ("l > 0.68 AND s < 0.65", "Pink")), "Red"),
)


def named_sql() -> str:
    """SQL of the colour name of columns h, s and l (doubles), in the words of both engines."""
    out = "CASE WHEN s < 0.08 THEN CASE WHEN l < 0.18 THEN 'Black' WHEN l > 0.86 THEN 'White' WHEN l > 0.68 THEN 'Silver' ELSE 'Gray' END"
    for upto, rules, other in HUES:
        out += f" WHEN h < {upto} THEN CASE " + " ".join(f"WHEN {rule} THEN '{c}'" for rule, c in rules) + f" ELSE '{other}' END"
    return out + " ELSE 'Black' END"


def shade_of(color: str, l_column: str = "l") -> str:
    """SQL of the shade of a colour by lightness: a dark one below 0.32, a light one above 0.7, else one with its name."""
    names = SHADES[color]
    low = lambda word: next((s for s in names if word in s.lower()), None)
    own = low(color.lower()) or names[0]
    dark = low("dark") or own
    light = low("light") or low("cream") or low("ivory") or names[0]
    return f"'{names[0]}'" if len(names) == 1 else f"CASE WHEN {l_column} < 0.32 THEN '{dark}' WHEN {l_column} > 0.7 THEN '{light}' ELSE '{own}' END"


def shade_sql() -> str:
    return "CASE color " + " ".join(f"WHEN '{c}' THEN {shade_of(c)}" for c in COLORS) + " END"


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*, a* and b* of 8-bit red, green and blue under daylight D65."""
    linear = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    rows = ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883))
    f = []
    for x, y, z, white in rows:
        v = (linear[0] * x + linear[1] * y + linear[2] * z) / white
        f.append(F.when(v > 0.008856, F.cbrt(v)).otherwise(v * 7.787 + 16 / 116))
    return f[1] * 116 - 16, (f[0] - f[1]) * 500, (f[1] - f[2]) * 200
