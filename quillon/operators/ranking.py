"""Candidate looks of a wardrobe: the product of its roles, and the best of them."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import cleaned
from ..functions.wear import engine_role
from ..sources.shared import kept

#: Looks that are scored for an owner at most, as the loops come to them.
MOST_LOOKS = 50_000


SLOTS = ("bag", "cap", "watch", "other")
_ITEM = ("id", "color", "category", "favorite", "name")


def wardrobes(items: DataFrame, most: int = MOST_LOOKS, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row an owner: tops, dresses, bottoms, shoes, jackets and accessories as arrays in the order of their ids, what they are
    in number (n_tops, ...), and how many accessories of each slot there are (n_bag, ...).

    Items are structs of _ITEM, slot, at (the place among all of the role) and `extra`, columns that are worked out once an item. What the
    first `most` looks can't come to is left out: looks go through 5 most accessories at most (one of them is passed over only
    if it was worn in one of the looks before, which wear four each), and turn to the first `most` of each slot, so an owner's row is
    bounded however large a wardrobe is.
    """
    if "name" not in items.columns:
        items = items.withColumn("name", F.lit(None).cast("string"))
    width = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by owner once, for all that follows, and not fewer because items are small
    rows = items.repartition(width, "owner_id").withColumn("role", engine_role(F.col("category"))).withColumn("slot", F.when(F.col("role") == "Accessories", accessory_slot(F.struct(*_ITEM)))).withColumns(extra or {})
    at = lambda *by: (F.row_number().over(W.partitionBy(*by).orderBy("id")) - 1).cast("long")
    n = [F.count_if(F.col("role") == role).alias(f"n_{name}") for role, name in ROLES.items()] + [F.count_if(F.col("slot") == s).alias(f"n_{s}") for s in SLOTS]
    rows = rows.withColumns({"at": at("owner_id", "role"), "in_slot": at("owner_id", "role", "slot")})
    met = (F.col("at") < 5 * most + 5) | (F.col("in_slot") < most + 4)
    item = F.struct(*_ITEM, "slot", "at", *(extra or {}))
    of_role = lambda role, name: F.array_sort(F.collect_list(F.when((F.col("role") == role) & met, item))).alias(name)
    return rows.groupBy("owner_id").agg(*[of_role(role, name) for role, name in ROLES.items()], *n)


#: Roles and what an owner's items of them are called.
ROLES = {"Tops": "tops", "Dresses": "dresses", "Bottoms": "bottoms", "Shoes": "shoes", "Jackets": "jackets", "Accessories": "accessories"}
#: The arrays of an owner as they stand beside its looks.
ITS = [f"its_{name}" for name in ROLES.values()]


def _pieces() -> list[Column]:
    return [F.col(name).alias(its) for name, its in zip(ROLES.values(), ITS, strict=True)]


def candidates(items: DataFrame, most: int = MOST_LOOKS) -> DataFrame:
    """owner_id, ordinal and the items top, bottom, shoes, jacket and accessory of each look.

    Looks with a bottom come first, in the order of nested loops over tops, bottoms, shoes, no jacket and jackets, no accessory
    and accessories; then dresses without a bottom. Looks from `most` on are left out. A look is its ordinal: the places of its items are
    read off it, so an owner's numbers are written out once, and the items come from the owner's row that they are written out of.
    """
    owners = kept(wardrobes(items, most))
    jackets, more = F.col("n_jackets") + 1, F.col("n_accessories") + 1
    size, pairs = F.col("n_shoes") * jackets * more, F.col("n_tops") * F.col("n_bottoms")
    last = F.least(F.lit(most).cast("long"), (pairs + F.col("n_dresses")) * size) - 1
    each = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<long>"))
    rows = owners.select("owner_id", "n_bottoms", "n_dresses", pairs.alias("pairs"), size.alias("size"), (jackets * more).alias("per_shoe"), more.alias("more"), *_pieces(), F.explode(each).alias("ordinal"))
    div = lambda a, b: F.call_function("div", F.col(a), F.col(b)).cast("int")
    rows = rows.withColumns({"pair": div("ordinal", "size"), "inner": (F.col("ordinal") % F.col("size")).cast("int")})
    rows = rows.withColumns({"is_dress": F.col("pair") >= F.col("pairs"), "left": (F.col("inner") % F.col("per_shoe")).cast("int")})
    bottom = F.when(~F.col("is_dress"), (F.col("pair") % F.col("n_bottoms")).cast("int"))
    places = {"top": F.when(F.col("is_dress"), F.col("pair") - F.col("pairs")).otherwise(div("pair", "n_bottoms")).cast("int"), "bottom": bottom, "shoes": div("inner", "per_shoe"), "jacket": div("left", "more") - 1, "accessory": (F.col("left") % F.col("more") - 1).cast("int")}
    return dressed(rows.select("owner_id", "ordinal", "is_dress", *[c.alias(s) for s, c in places.items()], *ITS))


def dressed(looks: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """owner_id, ordinal, is_dress and the pieces themselves of looks that have their places (null or negative: none).

    Looks have the arrays of their owner (ITS) beside them: there are far more looks than a task or the driver holds, so they are neither
    joined nor moved. Those that don't are moved to their owners."""
    rows = looks
    if ITS[0] not in looks.columns:
        its = owners.select(F.col("owner_id").alias("of"), *_pieces()).hint("shuffle_hash")  # never the looks, which look small to the planner
        rows = looks.join(its, F.col("owner_id").eqNullSafe(F.col("of")))
    of = {"bottom": "its_bottoms", "shoes": "its_shoes", "jacket": "its_jackets"}
    top = F.get(F.when(F.col("is_dress"), F.col("its_dresses")).otherwise(F.col("its_tops")), F.col("top")).alias("top")
    slots = [s for s in WORN if s in looks.columns and s != "top"]
    return rows.select("owner_id", "ordinal", "is_dress", top, *[F.get(of.get(s, "its_accessories"), F.col(s)).alias(s) for s in slots])


def accessory_slot(item: Column) -> Column:
    """bag, cap, watch or other, by category and words in the texts of an item; other for none."""
    c, name = cleaned(item["category"]), cleaned(item["name"])
    every = F.concat_ws(" ", c, name)
    has = lambda *words: functools.reduce(lambda a, b: a | b, [every.contains(w) for w in words])
    return F.when(item["id"].isNull(), "other").when(c.isin("bag", "bags") | has("handbag", "backpack"), "bag").when(has("cap", "hat"), "cap").when(has("watch"), "watch").otherwise("other")


WORN = ("top", "bottom", "shoes", "jacket", "bag", "cap", "watch", "accessory")
_UNIQUE = "ordinal long, is_dress boolean, " + ", ".join(f"{s} int" for s in WORN)


class _Turns:
    """What the accessories of an owner give for each number of looks so far: of the options (none, then each accessory) those that
    make a new look, as places of bag, cap, watch and accessory (-1: none).

    A look wears its own accessory in the slot that it is for; in the others the owner's take turns, by the number of different
    looks so far and 0 to 3 more. Only looks of the same top, bottom, shoes and jacket can be repeats of one another, and for all
    of these the accessories are the same, so what follows depends on the number's remainders by the sizes of the slots alone.
    """

    def __init__(self, slots: list[str], places: list[int], sizes: list[int], most: int):
        self.options = [(-1, 3)] + [(i, SLOTS.index(s)) for i, (s, at) in enumerate(zip(slots, places, strict=True)) if at < 5 * most + 5]
        self.pools = [[i for i, s in enumerate(slots) if s == name] for name in SLOTS]
        self.sizes, self.most, self.known = sizes, most, {}

    def after(self, n: int) -> np.ndarray:
        key = tuple(n % size if size else 0 for size in self.sizes)
        if key not in self.known:
            seen: dict[tuple, None] = {}
            for item, slot in self.options:
                if len(seen) >= self.most:
                    break
                k = n + len(seen)
                worn = tuple(item if slot == s and item >= 0 else self.pools[s][(k + s) % size] if size else -1 for s, size in enumerate(self.sizes))
                seen.setdefault(worn)
            self.known[key] = np.array(list(seen), np.int64).reshape(-1, 4)
        return self.known[key]


def _one_after_another(most: int):
    def run(batches):
        for batch in batches:
            its = batch.select(["owner_id", *ITS])
            for row, r in enumerate(batch.drop_columns(ITS).to_pylist()):
                turns = _Turns(r["slots"], r["places"], [r[f"n_{s}"] for s in SLOTS], most)
                jackets = r["n_jackets"] + 1
                pairs, inner = r["n_tops"] * r["n_bottoms"], r["n_shoes"] * jackets
                n, combo, parts = 0, [], []
                for c in range((pairs + r["n_dresses"]) * inner):
                    if n >= most:
                        break
                    new = turns.after(n)[: most - n]
                    combo.append((c, len(new)))
                    parts.append(new)
                    n += len(new)
                if not n:
                    continue
                c, times = np.array(combo, np.int64).T
                c = np.repeat(c, times)
                pair, rest = c // inner, c % inner
                dress, worn = pair >= pairs, np.concatenate(parts)
                bottoms = max(1, r["n_bottoms"])
                columns = [np.where(dress, pair - pairs, pair // bottoms), np.where(dress, -1, pair % bottoms), rest // jackets, rest % jackets - 1, *worn.T]
                places = [pa.array(x, pa.int32(), mask=x < 0) for x in columns]
                looks = pa.StructArray.from_arrays([pa.array(np.arange(n)), pa.array(dress), *places], [x.split()[0] for x in _UNIQUE.split(", ")])
                yield pa.RecordBatch.from_arrays([*its.slice(row, 1).columns, pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), looks)], [*its.schema.names, "looks"])

    return run


def unique_looks(owners: DataFrame, most: int = MOST_LOOKS) -> DataFrame:
    """owner_id, ordinal, is_dress and the places of the pieces of each different look of owners (see wardrobes), with bag, cap, watch and
    accessory, as an owner's loops come to them; ordinal is the number of different looks before it, which also says whose turn it
    is among the accessories. At most `most` looks are taken; repeats don't count. Owners don't depend on one another.

    An owner is one row, with its looks as an array, until they are written out beside the owner's arrays (ITS)."""
    slots = [F.transform("accessories", lambda p: p["slot"]).alias("slots"), F.transform("accessories", lambda p: p["at"]).alias("places")]
    rows = owners.select("owner_id", *_pieces(), *[f"n_{name}" for name in ROLES.values()], *[f"n_{s}" for s in SLOTS], *slots)
    out = T.StructType([*rows.select("owner_id", *ITS).schema, T.StructField("looks", T.ArrayType(T.StructType.fromDDL(_UNIQUE)))])
    looks = rows.mapInArrow(_one_after_another(most), out).select("owner_id", *ITS, F.explode("looks").alias("look"))
    return looks.select("owner_id", "look.*", *ITS)


def identity(slots: tuple[str, ...] = ("top", "bottom", "shoes", "jacket", "accessory")) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f"{s}.id").cast("string"), F.lit("none")) for s in slots])


def distinct_looks(looks: DataFrame) -> DataFrame:
    """The first look of each identity of an owner."""
    return looks.withColumn("identity", identity()).groupBy("owner_id", "identity").agg(F.min("ordinal").alias("ordinal"))


def best(looks: DataFrame, by: str, score: str, limit: int) -> DataFrame:
    """The best looks of each owner with their rank; the earlier one of equals is first."""
    order = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), "ordinal"))
    return looks.withColumn("rank", order).where(F.col("rank") <= limit)
