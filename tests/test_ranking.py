"""The ranking of looks against a plain replay of the loops."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import ranking as R
from quillon.plans import evaluation
from quillon.sources.tables import derived

ITEMS = "id long, owner_id long, color string, category string, favorite boolean, name string"


def role(category):
    return {"Pants": "Bottoms", "Shorts": "Bottoms", "Skirts": "Bottoms", "Heels": "Shoes", "Bags": "Accessories"}.get(category, category)


def slot(item):
    text = f"{item['category']} {item['name'] or ''}".strip().lower()
    if item["category"].lower() in ("bag", "bags") or "handbag" in text or "backpack" in text:
        return "bag"
    return "cap" if "cap" in text or "hat" in text else "watch" if "watch" in text else "other"


def replay(items, most):
    """The different looks of one owner, in order, as dicts of items."""
    items = sorted(items, key=lambda i: i["id"])
    of = lambda name: [i for i in items if role(i["category"]) == name]
    pools = {s: [i for i in of("Accessories") if slot(i) == s] for s in R.SLOTS}
    turn = lambda s, n: pools[s][n % len(pools[s])] if pools[s] else None
    looks, seen = [], set()
    starts = [(t, b) for t in of("Tops") for b in of("Bottoms")] + [(d, None) for d in of("Dresses")]
    for top, bottom in starts:
        for shoes in of("Shoes"):
            for jacket in [None, *of("Jackets")]:
                for own in [None, *of("Accessories")]:
                    if len(looks) >= most:
                        return looks
                    worn = {s: own if own and slot(own) == s else turn(s, len(looks) + k) for k, s in enumerate(R.SLOTS)}
                    look = {"top": top, "bottom": bottom, "shoes": shoes, "jacket": jacket, "bag": worn["bag"], "cap": worn["cap"], "watch": worn["watch"], "accessory": worn["other"]}
                    key = tuple(i and i["id"] for i in look.values())
                    if key not in seen:
                        seen.add(key)
                        looks.append(look)
    return looks


def wardrobe(n, seed):
    import random

    rng = random.Random(seed)
    names = [None, "Steel watch", "Wool cap", "Backpack", "Ring", "Hat", "Loafers", "Formal pants"]
    return [{"id": i, "owner_id": i % 3, "color": rng.choice(["Black", "White", "Red", "Navy", None]), "category": rng.choice(["Tops", "Pants", "Skirts", "Shoes", "Heels", "Jackets", "Dresses", "Bags", "Accessories"]), "favorite": rng.random() < 0.3, "name": rng.choice(names)} for i in range(n)]


@pytest.mark.parametrize(("n", "seed", "most"), [(45, 1, 50_000), (60, 2, 50_000), (60, 3, 37), (9, 4, 50_000), (75, 5, 500)])
def test_unique_looks(spark, n, seed, most):
    items = wardrobe(n, seed)
    owners = R.wardrobes(spark.createDataFrame([tuple(i[c.split()[0]] for c in ITEMS.split(", ")) for i in items], ITEMS), most)
    got = R.dressed(R.unique_looks(owners, most), owners).select("owner_id", "ordinal", *[F.col(f"{s}.id").alias(s) for s in R.WORN])
    want = [(owner, k, *[look[s] and look[s]["id"] for s in R.WORN]) for owner in range(3) for k, look in enumerate(replay([i for i in items if i["owner_id"] == owner], most))]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == want


def test_the_ranking_is_that_of_the_replay(spark, sf_dir):
    """All looks of the replay, evaluated and sorted plainly, give the rows of the query."""
    rows = derived(spark, sf_dir, "wardrobe").withColumn("name", F.expr(evaluation.ITEM_NAME)).where("owner_id < 4")
    items = [r.asDict() for r in rows.collect()]
    of = {r.id: r for r in R.wardrobes(rows, extra=evaluation.of_item()).select(F.explode(F.concat("tops", "dresses", "bottoms", "shoes", "jackets", "accessories")).alias("i")).select("i.*").collect()}
    kind = R.wardrobes(rows, extra=evaluation.of_item()).schema["tops"].dataType.elementType.simpleString()
    looks = [(owner, k, look["top"]["category"] == "Dresses", *[look[s] and of[look[s]["id"]] for s in R.WORN]) for owner in range(4) for k, look in enumerate(replay([i for i in items if i["owner_id"] == owner], 50_000))]
    df = spark.createDataFrame(looks, "owner_id long, ordinal long, is_dress boolean, " + ", ".join(f"{s} {kind}" for s in R.WORN))
    want = sorted(map(tuple, evaluation.rank_looks(df).collect()))
    got = sorted(map(tuple, evaluation.outfit_rank_full(spark, sf_dir).where("owner_id < 4").collect()))
    assert got == want and got


def test_candidates_scan_once(spark, sf_dir):
    from quillon.plans import ranking

    plan = ranking.outfit_candidates(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and "CartesianProduct" not in plan


def test_looks_are_neither_joined_nor_sent_to_all(spark, sf_dir):
    """Looks are far more than items, but look small to the planner: none of them is broadcast or joined to its owner's pieces."""
    from quillon.plans import ranking

    for query in (ranking.outfit_candidates, ranking.outfit_identity_distinct, ranking.outfit_rank_topk, ranking.outfit_rank_summary, evaluation.accessory_fill):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Broadcast" not in plan, query.__name__
    items = derived(spark, sf_dir, "wardrobe")
    assert "Broadcast" not in R.wardrobes(items)._jdf.queryExecution().executedPlan().toString()


def test_looks_with_places_only_are_moved_to_their_owners(spark):
    items = wardrobe(45, 1)
    owners = R.wardrobes(spark.createDataFrame([tuple(i[c.split()[0]] for c in ITEMS.split(", ")) for i in items], ITEMS))
    looks = R.unique_looks(owners)
    plain = R.dressed(looks.drop(*R.ITS), owners)
    assert "Broadcast" not in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, plain.collect())) == sorted(map(str, R.dressed(looks).collect()))
