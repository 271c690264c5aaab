"""Looks: their colours, how well these go together, and sums over a wardrobe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.num import compiled_apart, half_up, score

SLOTS = ("top", "bottom", "shoes", "jacket", "bag", "cap", "watch", "accessory")


#: Different texts of colours that every task may hold.
MOST_TEXTS = 100_000


def _named(outfits: DataFrame, slots: tuple[str, ...]) -> DataFrame:
    """text and the code of its colour and brightness (see color.code), worked out once for each different text. Up to
    MOST_TEXTS are sent to all tasks; more are joined by text."""
    texts = outfits.select(F.explode(F.array(*slots)).alias("text")).where("text IS NOT NULL").distinct()
    small = texts.limit(MOST_TEXTS + 1).count() <= MOST_TEXTS
    names = texts.withColumn("c", C.normalize(F.col("text"))).withColumn("b", C.brightness(F.col("text"), F.col("c"))).select("text", C.code(F.col("c"), F.col("b")).alias("code"))
    return F.broadcast(names) if small else names


def with_codes(outfits: DataFrame, slots: tuple[str, ...]) -> DataFrame:
    """outfits with the code of the colour of each slot, <slot>_code; null where nothing is worn."""
    names = _named(outfits, slots)
    for s in slots:
        outfits = outfits.join(names.select(F.col("text").alias(s), F.col("code").alias(f"{s}_code")), s, "left")
    return outfits


def color_scores(outfits: DataFrame, slots: tuple[str, ...]) -> DataFrame:
    """The six sub-scores of a look and their blend; each is whole before it is blended. All columns stay.

    Colours are numbers, what is counted of them is one sum, and how well two go together is looked up in the list of all
    pairs of codes, which has a fixed length: so the generated code is short enough to be compiled.
    """
    rows = outfits if f"{slots[0]}_code" in outfits.columns else with_codes(outfits, slots)
    points = F.broadcast(C.pair_scores(outfits.sparkSession))
    used = [(a, b, w) for a, b, w in C.HARMONY if a in slots and b in slots]
    pair_code = lambda s: F.shiftright(f"{s}_code", C.CODE_BITS)
    for a, b, _ in used:
        names = [f"{a} {b}", f"{a} {b} points"]
        rows = rows.withColumn(names[0], pair_code(a) * C.STRIDE + pair_code(b)).join(points.toDF(*names), names[0], "left").drop(names[0])
    color = lambda s: F.floor(pair_code(s) / len(C.BRIGHTNESSES)).cast("int")
    rows = rows.withColumns({f"{s} color": color(s) for s in slots} | {"all counts": sum((F.coalesce(f"{s}_code", F.lit(0)) for s in slots), F.lit(0).cast("long"))})
    n = lambda name: C.counted(F.col("`all counts`"), name)
    none = len(C.COLORS)
    bits = F.lit(0)
    for s in slots:
        bits = bits.bitwiseOR(F.when(F.col(f"`{s} color`") < none, F.call_function("shiftleft", F.lit(1), F.col(f"`{s} color`"))).otherwise(0))
    rows = rows.withColumn("all colors", bits).withColumns({name: n(name) for name in (*C.COUNTED, *[f"{b} ones" for b in C.BRIGHT])})
    style, bits, of = F.coalesce("style", F.lit("Minimal")), F.col("`all colors`"), lambda name: F.col(f"`{name}`")
    same = lambda a, b: F.coalesce((of(f"{a} color") == of(f"{b} color")) & (of(f"{a} color") < none), F.lit(False))
    different = F.bit_count(bits)
    spread = F.lit(68)
    for a, b, more in C.REPEATS:
        if a in slots and b in slots:
            spread = spread + F.when(same(a, b), more).otherwise(0)
    for s in ("watch", "accessory"):
        if s in slots:
            spread = spread + F.when(same(s, "top") | same(s, "shoes"), 6).otherwise(0)
    spread = score(spread + F.when(different.between(2, 3), 8).otherwise(0) - F.when(different >= 5, 28).otherwise(0))
    white = bits.bitwiseAND(1 << C.COLORS.index("White")) != 0
    pairs = [(of(f"{a} {b} points").isNotNull(), of(f"{a} {b} points"), w) for a, b, w in used]
    first, *others = outfits.columns
    rows = rows.select(
        compiled_apart(F.col(f"`{first}`")).alias(first), *[F.col(f"`{c}`") for c in others], C.weighted(pairs).cast("int").alias("pair_harmony"), C.color_count_score(different, style).alias("color_count"), C.light_dark_score(of("light ones"), of("medium ones"), of("dark ones"), style).alias("light_dark"),
        C.neutral_score(of("known"), of("neutral"), of("strong")).alias("neutral"), spread.alias("distribution"), C.context_score(of, white, F.col("style"), F.col("weather"), F.col("season")).cast("int").alias("context"),
    )
    final = F.col("pair_harmony") * 0.45 + F.col("color_count") * 0.15 + F.col("light_dark") * 0.15 + F.col("neutral") * 0.1 + F.col("distribution") * 0.1 + F.col("context") * 0.05
    return rows.withColumn("color_score", score(final))


def preferences(outfits: DataFrame, by: str, dimensions: dict[str, list[str]], limit: int = 5) -> DataFrame:
    """by, dimension, rank, value, n: the most frequent values, weight 3 in a favourite look and 1 else; ties by name."""
    parts = [F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, columns in dimensions.items() for c in columns]
    rows = outfits.select(by, F.when(F.col("favorite"), 3).otherwise(1).alias("w"), F.explode(F.array(*parts)).alias("p")).where("p.value IS NOT NULL AND p.value != ''")
    counts = rows.groupBy(by, "p.dimension", "p.value").agg(F.sum("w").alias("n"))
    first = F.row_number().over(W.partitionBy(by, "dimension").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", first).where(F.col("rank") <= limit)


def wardrobe_counts(items: DataFrame, by: str) -> DataFrame:
    is_in = lambda *names: F.count_if(F.col("category").isin(*names))
    return items.groupBy(by).agg(
        is_in("Top", "Tops").alias("tops"), is_in("Pants", "Shorts").alias("pants"), is_in("Shoes").alias("shoes"), is_in("Jacket", "Jackets").alias("jackets"),
        is_in("Accessory", "Accessories").alias("accessories"), F.count_if("favorite").alias("favorites"),
    )


def found(items: DataFrame, search: str, category: str = "All") -> DataFrame:
    """Items of the category (All: any) in one of whose texts the search is, without regard to case; a blank one finds all."""
    if category != "All":
        items = items.where(F.col("category") == category)
    word = search.strip().lower()
    if not word:
        return items
    texts = [c for c in ("category", "name", "color", "subCategory", "shade") if c in items.columns]
    hit = F.lit(False)
    for c in texts:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(word), F.lit(False))
    return items.where(hit)


def newest(items: DataFrame, owner: int) -> DataFrame:
    return items.where(F.col("owner_id") == owner).orderBy(F.desc("created_seq"), "id")


def without(items: DataFrame, excluded: DataFrame) -> DataFrame:
    """Items whose id isn't in the set; those without id are never excluded."""
    return items.join(excluded.select("id").distinct(), "id", "left_anti")


def latest_jobs(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items with the newest job for each (the smaller job_id of equals) and what is shown for it."""
    last = jobs.groupBy("item_id").agg(F.max_by(F.struct("job_id", "status", "progress"), F.struct("created_ms", -F.col("job_id"))).alias("j"))
    rows = items.join(last, items["id"] == last["item_id"], "left")
    status = F.col("j.status")
    shown = F.when(status.isNull() | (status == "completed"), F.lit("ready")).when(status.isin("failed", "cancelled"), F.lit("failed")).otherwise(F.lit("pending"))
    return rows.select("id", "owner_id", F.col("j.job_id").alias("job_id"), shown.alias("display_status"), F.when(shown == "pending", half_up(F.col("j.progress") * 100).cast("int")).alias("display_progress"))


def best_matches(items: DataFrame, drafts: DataFrame, matches: DataFrame, limit: int = 4) -> DataFrame:
    """draft_id, rank, id: for each draft the first items of its owner, newest first, in a colour that goes with its own
    (matches: color, other) and of another category."""
    wanted = drafts.join(matches, "color").select(F.col("id").alias("draft_id"), "owner_id", F.col("category").alias("draft_category"), F.col("other").alias("color"))
    rows = items.join(wanted, ["owner_id", "color"]).where((F.col("category") != F.col("draft_category")) & (F.col("id") != F.col("draft_id")))
    first = F.row_number().over(W.partitionBy("draft_id").orderBy(F.desc("created_seq"), "id"))
    return rows.withColumn("rank", first).where(F.col("rank") <= limit).select("draft_id", "rank", "id")


def background(r: Column, g: Column, b: Column) -> Column:
    """A pixel that is bright and almost grey, or almost black."""
    mean, spread = (r + g + b) / 3, F.greatest(r, g, b) - F.least(r, g, b)
    return ((mean > 232) & (spread < 28)) | (mean < 18)


def dominant_color(pixels: DataFrame) -> DataFrame:
    """image_id, r, g, b, pixels: the mean of the largest cell of a colour grid of step 24; the first cell of equals. Pixels of
    the background don't count. Cells are summed before they are compared, so a large image is spread over all tasks."""
    cell = [half_up(F.col(c) / 24).cast("long").alias(f"cell_{c}") for c in "rgb"]
    rows = pixels.where(~background(F.col("r"), F.col("g"), F.col("b"))).select("*", *cell)
    sums = rows.groupBy("image_id", "cell_r", "cell_g", "cell_b").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "rgb"])
    best = sums.groupBy("image_id").agg(F.max_by(F.struct("n", "r", "g", "b"), F.struct("n", -F.col("cell_r"), -F.col("cell_g"), -F.col("cell_b"))).alias("x"))
    mean = lambda c: half_up(F.col(f"x.{c}") / F.col("x.n")).cast("long").alias(c)
    return best.select("image_id", mean("r"), mean("g"), mean("b"), F.col("x.n").alias("pixels"))


def classified(pixels: DataFrame) -> DataFrame:
    """color and shade of r, g and b."""
    h, s, l = C.hsl(F.col("r"), F.col("g"), F.col("b"))
    rows = pixels.withColumns({"h": h, "s": s, "l": l})
    return rows.withColumn("color", F.expr(C.named_sql())).withColumn("shade", F.expr(C.shade_sql())).drop("h", "s", "l")
