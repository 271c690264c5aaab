"""Rules for looks: what rejects one, and how it suits a style, an occasion, the weather and a season.

The rules are tables; each becomes one SQL expression over the columns of a look: top_t, bottom_t, shoes_t, jacket_t and
accessory_t (what is written about an item, in lower case, null without one), top, bottom, shoes, jacket and accessory (colours),
is_dress (the top is a dress, so no bottom is missing), style, occasion, weather and season. What all rules share is worked out
once a look, as few numbers (see prepared()): which kinds of items its texts name, and how often it has each colour.
"""

from __future__ import annotations

SLOTS = ("top", "bottom", "shoes", "jacket", "accessory")
#: Words that tell a kind of item; they are looked for anywhere in its text.
WORDS = {
    "shorts": ("shorts", "short pants"), "skirt": ("skirt",), "tshirt": ("tshirt", "t-shirt", "tee"), "polo": ("polo",), "hoodie": ("hoodie",), "sweater": ("sweater",), "formal": ("formal",), "jeans": ("jeans", "denim"),
    "cargo": ("cargo",), "joggers": ("jogger", "sweatpants"), "sneakers": ("sneaker",), "boots": ("boot",), "loafers": ("loafer",), "sandals": ("sandal",), "coat": ("coat",), "watch": ("watch",), "cap": ("cap", "hat"),
    "bag": ("bag", "backpack"), "sport": ("sport",), "anyshirt": ("shirt",),
}
NEUTRAL = ("Black", "White", "Gray", "Beige", "Brown", "Navy", "Cream")
LIGHT = ("White", "Beige", "Cream", "Light Blue", "Gray")
FAMILIES = {
    "Black": ("White", "Gray", "Beige", "Brown", "Navy", "Red", "Blue", "Green"),
    "White": ("Black", "Gray", "Beige", "Brown", "Navy", "Blue", "Green", "Red", "Pink", "Purple", "Yellow"),
    "Gray": ("Black", "White", "Beige", "Brown", "Navy", "Blue", "Green", "Pink"),
    "Beige": ("Black", "White", "Brown", "Navy", "Blue", "Green", "Gray"),
    "Brown": ("White", "Beige", "Cream", "Black", "Green", "Navy", "Blue"),
    "Navy": ("White", "Beige", "Brown", "Gray", "Blue", "Red"),
    "Blue": ("White", "Black", "Gray", "Beige", "Brown", "Navy"),
    "Green": ("White", "Black", "Beige", "Brown", "Gray"),
    "Red": ("Black", "White", "Gray", "Navy", "Beige"),
    "Pink": ("White", "Black", "Gray", "Beige", "Navy"),
    "Purple": ("White", "Black", "Gray", "Beige"),
    "Yellow": ("Black", "White", "Gray", "Navy", "Blue"),
    "Orange": ("Black", "White", "Brown", "Navy", "Blue"),
}
RISKY = (("Red", "Green"), ("Purple", "Yellow"), ("Orange", "Pink"), ("Red", "Orange"), ("Green", "Purple"))
#: Of each style the colours it prefers and avoids, most colours, least score, what a jacket, an accessory and few
#: colours add, and what a wrong colour and too many take.
STYLES = {
    "Minimal": (("Black", "White", "Gray", "Beige", "Brown", "Navy"), ("Yellow", "Orange", "Pink", "Purple"), 3, 78, 4, 8, 15, 15, 25),
    "Classic": (("Black", "White", "Gray", "Navy", "Brown", "Beige"), ("Pink", "Orange", "Yellow", "Purple"), 3, 82, 18, 12, 20, 20, 30),
    "Luxury": (("Black", "White", "Gray", "Navy", "Brown", "Beige"), ("Yellow", "Orange", "Pink", "Purple", "Green"), 3, 85, 25, 18, 25, 25, 35),
    "Streetwear": (("Black", "White", "Gray", "Green", "Blue", "Red"), (), 5, 72, 10, 15, 15, 8, 10),
    "Sport": (("Black", "White", "Blue", "Gray"), ("Brown", "Purple"), 4, 72, -10, 8, 15, 10, 15),
}
#: Points of a style for what is worn; of several in a row joined by > only the first that holds counts.
STYLE_POINTS = {
    "Minimal": (
        ("all neutral", 20), (("top:tshirt", "top:shirt", "top:polo"), 10), (("bottom:jeans", "bottom:formal"), 10), (("shoes:sneakers",), 8),
    ),
    "Classic": (
        (("top:shirt", "top:polo", "top:sweater"), 22), (("bottom:formal", "bottom:jeans"), 18), (("shoes:loafers", "shoes:boots"), 20), ("jacket",
        12), (("accessory:watch",), 10),
    ),
    "Luxury": (
        (("top:shirt", "top:polo"), 25), (("bottom:formal",), 25, ("bottom:jeans",), 10), (("shoes:loafers",), 25, ("shoes:boots",), 15,
        ("shoes:sneakers",), -8), ("jacket", 20), (("accessory:watch", "accessory:bag"), 15),
    ),
    "Streetwear": (
        (("top:hoodie", "top:tshirt"), 22), (("bottom:cargo", "bottom:jeans"), 22), (("shoes:sneakers",), 25), (("accessory:cap", "accessory:bag"),
        15),
    ),
    "Sport": ((("top:tshirt", "top:hoodie"), 20), (("bottom:shorts", "bottom:joggers"), 25), (("shoes:sneakers",), 30), (("accessory:cap",), 10)),
}
OCCASIONS = {
    "Casual": (
        ("Black", "White", "Gray", "Blue", "Green", "Brown", "Beige"), ((("top:tshirt", "top:polo", "top:hoodie"), 15), (("bottom:jeans",
        "bottom:cargo", "bottom:shorts"), 15), (("shoes:sneakers",), 15)),
    ),
    "Work": (
        ("Black", "White", "Gray", "Navy", "Brown", "Beige"), ((("top:shirt", "top:polo"), 25), (("bottom:formal",), 25), (("shoes:loafers",), 20),
        ("jacket", 10)),
    ),
    "Date": (
        ("Black", "White", "Gray", "Navy", "Brown", "Beige", "Red"), ((("top:shirt", "top:polo", "top:sweater"), 18), (("bottom:formal",
        "bottom:jeans"), 18), (("shoes:loafers", "shoes:boots"), 16), (("accessory:watch",), 12)),
    ),
    "Party": (
        ("Black", "White", "Gray", "Red", "Navy"), ((("top:shirt", "top:polo", "top:tshirt"), 15), (("bottom:jeans", "bottom:formal"), 15),
        (("shoes:sneakers", "shoes:loafers"), 15)),
    ),
    "Sport": (
        ("Black", "White", "Blue", "Gray"), ((("top:tshirt", "top:hoodie"), 20), (("bottom:shorts", "bottom:joggers"), 25), (("shoes:sneakers",),
        25)),
    ),
    "Summer": (
        ("White", "Beige", "Blue", "Gray", "Green"), ((("top:tshirt", "top:polo"), 15), (("bottom:shorts", "bottom:skirt"), 20), (("shoes:sneakers",
        "shoes:sandals"), 15), ("no jacket", 10)),
    ),
}
#: Preferred and forbidden colours, and points; `always` holds for every look.
WEATHERS = {
    "Hot": (
        ("White", "Beige", "Blue", "Gray", "Green"), (), (("no jacket", 20), (("bottom:shorts", "bottom:skirt"), 15), (("shoes:sandals",
        "shoes:sneakers"), 10)),
    ),
    "Mild": (("Black", "White", "Gray", "Brown", "Beige", "Blue"), (), (("always", 15), ("light jacket", 5))),
    "Rainy": (("Black", "Gray", "Brown", "Navy"), ("White",), (("jacket", 15, "always", 5), (("shoes:boots",), 20), (("shoes:sandals",), -40))),
}
SEASONS = {
    "Spring": (("White", "Blue", "Green", "Gray", "Beige"), (), ((("any", "White", "Blue", "Green", "Beige", "Gray"), 15), ("light jacket", 5))),
    "Summer": (
        ("White", "Beige", "Blue", "Gray", "Green"), (), (("no jacket", 20), (("bottom:shorts", "bottom:skirt"), 15), (("any", "White", "Beige",
        "Cream", "Gray"), 10)),
    ),
}
#: Option, its value, what rejects the look, and the reason that is given.
REJECTIONS = (
    (None, None, "no top", "Missing top or dress."),
    (None, None, "no bottom or dress", "Missing bottom."),
    (None, None, "no shoes", "Missing shoes."),
    ("style", "Luxury", ("bottom:shorts",), "Luxury outfits do not use shorts."),
    ("style", "Luxury", ("top:hoodie",), "Hoodies are not suitable for the selected Luxury style."),
    ("style", "Luxury", ("bottom:cargo", "bottom:joggers"), "Cargo and joggers are not suitable for Luxury outfits."),
    ("style", "Luxury", ("shoes:sandals",), "Sandals are not suitable for Luxury outfits."),
    ("style", "Classic", ("bottom:shorts",), "Classic outfits do not use shorts."),
    ("style", "Classic", ("bottom:cargo", "bottom:joggers"), "Cargo and joggers are not suitable for Classic outfits."),
    ("style", "Classic", ("top:hoodie",), "Hoodies are not suitable for Classic outfits."),
    ("style", "Classic", ("shoes:sandals",), "Sandals are not suitable for Classic outfits."),
    ("style", "Sport", "jacket without sport", "This jacket is not suitable for a Sport outfit."),
    ("style", "Sport", ("shoes:loafers", "shoes:boots"), "Loafers and boots are not suitable for this Sport outfit."),
    ("occasion", "Work", ("bottom:shorts",), "Shorts are not suitable for Work."),
    ("occasion", "Work", ("top:hoodie", "top:tshirt"), "This top is too casual for Work."),
    ("occasion", "Work", ("shoes:sandals",), "Sandals are not suitable for Work."),
    ("occasion", "Date", ("bottom:shorts",), "Shorts are not suitable for this Date outfit."),
    ("occasion", "Date", ("bottom:joggers",), "Joggers are too casual for this Date outfit."),
    ("occasion", "Party", ("bottom:joggers",), "Joggers are not suitable for this Party outfit."),
    ("occasion", "Sport", "shoes without sneakers or sport", "Sport outfits require sneakers."),
    ("occasion", "Summer", "jacket", "Summer outfits should not include a jacket."),
    ("occasion", "Summer", ("shoes:boots",), "Boots are not suitable for Summer."),
    ("weather", "Hot", "jacket", "Hot weather outfits should not include a jacket."),
    ("weather", "Hot", ("shoes:boots",), "Boots are not suitable for hot weather."),
    ("weather", "Rainy", ("shoes:sandals",), "Sandals are not suitable for rainy weather."),
    ("season", "Summer", ("jacket:coat",), "A coat is not suitable for Summer."),
)


def _names(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


#: All colours that a rule names. How often a look has each is four bits of one number, so a remainder by 15 is how often it has any of some.
NAMED = tuple(dict.fromkeys((*FAMILIES, *NEUTRAL, *LIGHT, *(c for x in RISKY for c in x), *(c for of in (*STYLES.values(), *OCCASIONS.values(), *WEATHERS.values(), *SEASONS.values()) for names in of[:2] for c in names if isinstance(c, str)))))
if len(NAMED) > 15:
    raise ValueError("four bits for each of more than 15 colours don't fit one number")
BITS = {kind: 1 << k for k, kind in enumerate(WORDS)}


def kind_bits(text: str, kinds=tuple(WORDS)) -> str:
    """SQL of a number that has a bit for each of the kinds that a text, in lower case, names."""
    has = lambda words: " OR ".join(f"contains({text}, '{w}')" for w in words)
    return "(" + " + ".join(f"CASE WHEN {has(WORDS[kind])} THEN {BITS[kind]} ELSE 0 END" for kind in kinds) + ")"


def _asked() -> dict[str, tuple[str, ...]]:
    """The kinds that the rules ask for in each slot."""
    asked = {f"accessory:{k}" for k in ("watch", "bag", "cap")} | {"jacket:coat", "jacket:sport", "shoes:sneakers", "shoes:sport"}
    rules = [*STYLE_POINTS.values(), *(of[-1] for of in (*OCCASIONS.values(), *WEATHERS.values(), *SEASONS.values()))]
    for what in [*(w for of in rules for rule in of for w in rule[::2]), *(what for _, _, what, _ in REJECTIONS)]:
        asked |= {w for w in what if ":" in w} if isinstance(what, tuple) else set()
    asked |= {"top:tshirt", "top:anyshirt"}  # what a shirt is
    return {slot: tuple(k for k in WORDS if f"{slot}:{k}" in asked) for slot in SLOTS}


def kinds() -> dict[str, str]:
    """A column for each slot, slot_kinds: a number with a bit for each kind of item that a rule asks for there (see BITS)."""
    return {f"{slot}_kinds": kind_bits(f"coalesce({slot}_t, '')", of) for slot, of in _asked().items()}


def prepared(slots=SLOTS) -> dict[str, str]:
    """The columns that the scores share: how often a look has each of NAMED, how many colours it has, how many different ones, and how
    its top goes with its bottom."""
    sums = lambda of: " + ".join(of)
    bits = "array(" + ", ".join(f"{n}L" for n in (0, *(1 << 4 * i for i in range(len(NAMED))))) + ")"
    return {
        "named_colors": sums(f"get({bits}, CAST(coalesce(array_position(array{_names(NAMED)}, {s}), 0) AS int))" for s in slots),
        "worn_colors": sums(f"CASE WHEN {s} IS NULL THEN 0 ELSE 1 END" for s in slots), "different_colors": different_colors(slots), "pair_score": pair_score("top", "bottom"),
    }


def _has(slot: str, *names: str) -> str:
    return f"(({slot}_kinds & {sum(BITS[k] for k in names)}) <> 0)"


def _kind(slot: str, kind: str) -> str:
    return f"({slot}_kinds & {BITS['anyshirt'] + BITS['tshirt']}) = {BITS['anyshirt']}" if kind == "shirt" else _has(slot, kind)


def _holds(what: str | tuple[str, ...]) -> str:
    """SQL of a condition of the tables."""
    if what == "always":
        return "TRUE"
    if what == "all neutral":
        return f"({_count(NEUTRAL)} = worn_colors)"
    if what[0] == "any":
        return f"({_count(what[1:])} > 0)"
    if isinstance(what, tuple):
        return "(" + " OR ".join(_kind(*w.split(":")) for w in what) + ")"
    special = {
        "jacket": "jacket_t IS NOT NULL", "no jacket": "jacket_t IS NULL", "no top": "top_t IS NULL", "no bottom or dress": "(bottom_t IS NULL AND NOT is_dress)", "no shoes": "shoes_t IS NULL",
        "light jacket": f"(jacket_t IS NOT NULL AND NOT {_kind('jacket', 'coat')})", "jacket without sport": f"(jacket_t IS NOT NULL AND NOT {_kind('jacket', 'sport')})",
        "shoes without sneakers or sport": f"NOT ({_kind('shoes', 'sneakers')} OR {_kind('shoes', 'sport')})",
    }
    return special[what]


def _points(rules) -> str:
    out = []
    for rule in rules:
        pairs = list(zip(rule[::2], rule[1::2], strict=True))
        out.append("CASE " + " ".join(f"WHEN {_holds(w)} THEN {n}" for w, n in pairs) + " ELSE 0 END")
    return "(" + " + ".join(out or ["0"]) + ")"


def _count(names: tuple[str, ...]) -> str:
    """How many of a look's colours are among the names: the sum of their four bits."""
    return f"CAST((named_colors & {sum(15 << 4 * NAMED.index(n) for n in names)}L) % 15 AS int)" if names else "0"


def different_colors(slots=SLOTS) -> str:
    out = []
    for i, s in enumerate(slots):
        again = " OR ".join(f"coalesce({s} = {b}, FALSE)" for b in slots[:i]) or "FALSE"
        out.append(f"CASE WHEN {s} IS NOT NULL AND NOT ({again}) THEN 1 ELSE 0 END")
    return "(" + " + ".join(out) + ")"


def pair_score(a: str, b: str) -> str:
    """SQL of the style engine's score of two colours; a missing one is Black."""
    a, b = f"coalesce({a}, 'Black')", f"coalesce({b}, 'Black')"
    goes = [f"{c}>{m}" for c, names in FAMILIES.items() for m in names]
    risky = [f"{x}>{y}" for p in RISKY for x, y in (p, p[::-1])]
    both = f"concat({a}, '>', {b})"
    return f"CASE WHEN {a} = {b} THEN 88 WHEN {a} IN {_names(NEUTRAL)} AND {b} IN {_names(NEUTRAL)} THEN 95 WHEN {both} IN {_names(goes)} OR concat({b}, '>', {a}) IN {_names(goes)} THEN 92 WHEN {both} IN {_names(risky)} THEN 45 ELSE 70 END"


def _whole(x: str) -> str:
    return f"CAST(least(100, greatest(0, floor({x} + 0.5e0))) AS int)"


def style_score() -> str:
    out = "CASE style"
    for name, (good, bad, most, _, jacket, accessory, few, wrong, many) in STYLES.items():
        total = f"60 + {_count(good)} * 5 - {_count(bad)} * {wrong} + CASE WHEN different_colors <= {most} THEN {few} ELSE -{many} END + CASE WHEN jacket_t IS NOT NULL THEN {jacket} ELSE 0 END + CASE WHEN accessory_t IS NOT NULL THEN {accessory} ELSE 0 END"
        out += f" WHEN '{name}' THEN {_whole(f'{total} + {_points(STYLE_POINTS[name])} + (pair_score - 70) * 0.25e0')}"
    return out + " END"


def occasion_score() -> str:
    return "CASE " + " ".join(f"WHEN occasion = '{n}' THEN {_whole(f'65 + {_count(good)} * 5 + {_points(rules)}')}" for n, (good, rules) in OCCASIONS.items()) + " ELSE 75 END"


def weather_score(column: str = "weather") -> str:
    of = WEATHERS if column == "weather" else SEASONS
    return "CASE " + " ".join(f"WHEN {column} = '{n}' THEN {_whole(f'65 + {_count(good)} * 5 - {_count(bad)} * 10 + {_points(rules)}')}" for n, (good, bad, rules) in of.items()) + " ELSE 75 END"


def accessory_score() -> str:
    lux = "style IN ('Luxury', 'Classic')"
    one = lambda k: _kind("accessory", k)
    return f"CASE WHEN accessory_t IS NULL THEN 65 ELSE least(100, 75 + CASE WHEN {lux} AND {one('watch')} THEN 20 ELSE 0 END + CASE WHEN {lux} AND {one('bag')} THEN 10 ELSE 0 END + CASE WHEN style = 'Streetwear' AND ({one('cap')} OR {one('bag')}) THEN 20 ELSE 0 END + CASE WHEN style = 'Sport' AND {one('cap')} THEN 20 ELSE 0 END) END"


def rejections() -> list[tuple[str, str]]:
    """SQL of each condition, in order, and its reason."""
    return [(f"({option} = '{value}' AND {_holds(what)})" if option else _holds(what), reason) for option, value, what, reason in REJECTIONS]


def least_score() -> str:
    return "CASE style " + " ".join(f"WHEN '{n}' THEN {s[3]}" for n, s in STYLES.items()) + " ELSE 72 END"
