"""Rows worked out by hand, and properties that always hold."""

from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import color as C
from quillon.functions import num, text, wear
from quillon.operators import imaging, issues, outfits, queue
from quillon.sources.tables import COLORS, issue_options


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def pair(a, b):
    a, b = F.lit(a).cast("string"), F.lit(b).cast("string")
    x, y = C.normalize(a), C.normalize(b)
    return C.pair_score(x, C.brightness(a, x), y, C.brightness(b, y))


def test_pair_scores(spark):
    want = {("Red", "Green"): 42, ("Orange", "Pink"): 74, ("Green", "Purple"): 74, ("Purple", "Yellow"): 79, ("Cream", "Black"): 98, (None, "Black"): 62, ("Navy", "Navy"): 86, ("Light Blue", "Dark Blue"): 94, ("Khaki", "Gold"): 89, ("Red", "Khaki"): 83, ("Green", "Pink"): 64}
    assert one(spark, *[pair(a, b) for a, b in want]) == tuple(want.values())


def test_pair_scores_are_symmetric(spark):
    rows = spark.createDataFrame(list(product(COLORS, COLORS)), "a string, b string")
    x, y = C.normalize(F.col("a")), C.normalize(F.col("b"))
    s = lambda p, q: C.pair_score(F.col(p), C.brightness(F.col(p[0]), F.col(p)), F.col(q), C.brightness(F.col(q[0]), F.col(q)))
    rows = rows.withColumns({"a_c": x, "b_c": y}).withColumns({"s": s("a_c", "b_c"), "t": s("b_c", "a_c")})
    assert rows.where("s != t OR s NOT BETWEEN 0 AND 100").isEmpty()


def test_rounding(spark):
    assert one(spark, num.half_up(F.lit(72.5)), num.half_up(F.lit(-2.5)), num.score(F.lit(140.2)), num.duration(F.lit(-3.0)), num.duration(F.lit(3.9)), num.percent(F.lit(0.505))) == (73, -2, 100, 0, 3, 51)


def test_texts(spark):
    assert one(spark, text.normalized(F.lit("  ab "), 1), text.normalized(F.lit("   "), 9), text.platform(F.lit(" iOS")), text.platform(F.lit("web")), text.as_count(F.lit("7.9")), text.as_count(F.lit("x")), text.as_boolean(F.lit("1")), text.shortened(F.lit("abcdef"), 4), text.cleaned(F.lit(" Off_White-x ")), text.major_version(F.lit("Android 14.2")), text.image_format(F.lit("a/b.PNG?x=1"))) == ("a", None, "ios", "unknown", 7, 0, True, "abc…", "off white x", 14, "png")


def test_color_count(spark):
    style = lambda n, s: C.color_count_score(F.lit(n), F.lit(s))
    assert one(spark, *[style(n, s) for n, s in ((0, "Minimal"), (1, "Minimal"), (2, "Minimal"), (3, "Minimal"), (4, "Minimal"), (4, "Streetwear"), (4, "Sport"), (5, "Streetwear"), (5, "Minimal"))]) == (45, 86, 100, 96, 66, 88, 82, 64, 38)


def test_retry_delays(spark):
    assert one(spark, *[queue.retry_delay(F.lit(n)) for n in (1, 2, 3, 5, 6, 99)]) == (1500, 3000, 6000, 24000, 30000, 30000)


def test_queue_statistics(spark):
    jobs = spark.createDataFrame([("completed", 1.0, 60000), ("processing", 0.5, 0), ("queued", 0.0, 0)], "status string, progress double, total_processing_ms long")
    r = queue.statistics(jobs).first()
    assert (r["overall_progress"], r["overall_percentage"], r["average_completed_item_ms"], r["estimated_remaining_ms"]) == (0.5, 50, 60000, 90000)
    assert queue.statistics(jobs.limit(0)).first()["total"] == 0


def test_moving_average(spark):
    rows = spark.createDataFrame([(1, i, d) for i, d in enumerate((10_000, 20_000, 30_000))], "k int, t int, duration_ms long")
    kept = queue.last_durations(rows, "k", ["t"])
    assert queue.smoothed(kept, "k", "recalculated").first()["smoothed_ms"] == 43_991
    assert queue.smoothed(kept.where("t = 0"), "k").first()["smoothed_ms"] == 10_000


def test_percentiles(spark):
    cells = spark.createDataFrame([(1, float(v)) for v in (1, 2, 4, 10)], "image_id int, lum double")
    r = imaging.percentiles(cells).first()
    assert (r["p25"], r["p50"], r["deviation"]) == (1.75, 3.0, 3.49106)


def test_named_colors(spark):
    pixels = spark.createDataFrame([(128, 128, 128), (255, 0, 0), (0, 0, 128), (128, 0, 0)], "r int, g int, b int")
    assert [r["color"] for r in outfits.classified(pixels).collect()] == ["Gray", "Red", "Navy", "Burgundy"]
    assert outfits.classified(pixels).collect()[2]["shade"] == "Dark Navy"


def test_seasons(spark):
    assert one(spark, wear.seasons(F.lit("Shoes"), F.lit("Boots")), wear.seasons(F.lit("Shorts"), F.lit(None)), wear.seasons(F.lit("Tops"), F.lit("Hoodie"))) == (["Winter"], ["Summer"], ["Autumn", "Winter"])


def test_boxes_and_polygons(spark):
    box = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 2.0, 2.0)], "x1 double, y1 double, w1 double, h1 double, x2 double, y2 double, w2 double, h2 double")
    assert imaging.box_overlap(box).first()["iou"] == round(1 / 7, 6)
    square = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)))], "polygon int, i int, x double, y double")
    r = imaging.polygon_metrics(square).first()
    assert (r["area"], r["perimeter"], r["centre_x"], r["centre_y"], r["roundness"]) == (1.0, 4.0, 0.5, 0.5, 0.785398)


def test_changes(spark):
    rows = spark.createDataFrame([("INSERT", None, 1), ("UPDATE", 2, 3), ("UPDATE", 3, 3), ("DELETE", 1, 1)], "op string, old_count long, new_count long")
    assert issues.accepted_changes(rows).count() == 2


def test_five_active_options(spark):
    assert issue_options(spark).where("is_active").count() == 5


def test_items_without_id_stay(spark):
    items = spark.createDataFrame([(1, "a"), (None, "b")], "id long, name string")
    assert [r["name"] for r in outfits.without(items, items.where("id = 1")).collect()] == ["b"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from("ab"), st.sampled_from(["ios", "web", None]), st.sampled_from(["1", None, " "]), st.integers(0, 5)), max_size=12))
def test_fold_is_replay(spark, rows):
    """The aggregate gives what the upsert gives row after row."""
    clicks = [(i, u, k, p, v, ms) for i, (u, k, p, v, ms) in enumerate(rows)]
    want = {}
    for i, u, k, p, v, ms in sorted(clicks, key=lambda r: (r[5], r[0])):
        old = want.get((u, k), (0, ms, ms, None, None))
        want[u, k] = (old[0] + 1, old[1], ms, p if p == "ios" else "unknown", (v or "").strip() or old[4])
    df = spark.createDataFrame(clicks, "click_id long, user_id long, issue_key string, platform string, app_version string, ms long")
    got = {(r["user_id"], r["issue_key"]): (r["report_count"], r["first_reported_ms"], r["last_reported_ms"], r["platform"], r["app_version"]) for r in issues.fold_clicks(df).collect()}
    assert got == want


def test_transitions(spark):
    """A job that fails, is retried and fails for good; one that is cancelled; one that is removed; stream and batch agree."""
    from quillon.operators import transitions

    rows = [(1, 1, "added"), (1, 2, "progress"), (1, 3, "failed"), (1, 4, "retry"), (1, 5, "progress"), (1, 6, "interrupted"), (1, 7, "retry"), (1, 8, "failed"), (2, 1, "added"), (2, 2, "cancelled"), (2, 3, "completed"), (3, 1, "failed"), (4, 1, "added"), (4, 2, "removed"), (5, 1, "added"), (5, 2, "completed"), (5, 3, "failed")]
    data = [(j, n, n * 1000, kind, 0.5, True, 1 if n < 8 else 3, False) for j, n, kind in rows]
    events = spark.createDataFrame(data, "job_id long, seq long, ms long, kind string, progress double, retryable boolean, attempt long, reset boolean")
    got = {r["job_id"]: tuple(r)[1:] for r in transitions.folded(events).collect()}
    assert got[1] == ("failed", 3, 0.0, None, 8) and got[2] == ("completed", 0, 1.0, None, 3) and got[5] == ("completed", 0, 1.0, None, 2) and set(got) == {1, 2, 5}
    for job in (1, 2, 5):
        now = (None, 0, 0.0, None, 0)
        for e in sorted((r for r in events.collect() if r["job_id"] == job), key=lambda r: r["seq"]):
            now = transitions._after(now, e)
        assert now == got[job]


def test_simplified_contours():
    """Kept are the ends, and every point that is left out is near the line between the kept ones beside it."""
    import math
    import random

    from quillon.operators import shapes

    random.seed(3)
    for _ in range(20):
        n = random.randint(3, 60)
        ring = [(math.cos(k / n * 6.28) * 50 + random.random() * 9, math.sin(k / n * 6.28) * 50 + random.random() * 9) for k in range(n)]
        kept = shapes.simplify(ring, 4.0)
        assert set(kept) <= set(ring) and len(set(kept)) == len(kept)
        if n > shapes.LEAST_POINTS:
            at = [ring.index(p) for p in kept]
            turned = at[at.index(min(at)):] + at[:at.index(min(at))]
            assert turned == sorted(at)
            for a, b in zip(at, at[1:] + at[:1], strict=True):
                (x0, y0), (x1, y1) = ring[a], ring[b]
                for k in range(1, (b - a) % n):
                    x, y = ring[(a + k) % n]
                    assert abs((y1 - y0) * x - (x1 - x0) * y + x1 * y0 - y1 * x0) / math.hypot(x1 - x0, y1 - y0) <= 4.0 + 1e-9


def test_mask_parts(spark):
    """Parts joined by a corner are one with all eight directions and two with the sides only."""
    from quillon.operators import imaging

    picture = ["##..", "..#.", "#..#", "####"]
    cells = spark.createDataFrame([(1, x, y, c == "#") for y, row in enumerate(picture) for x, c in enumerate(row)], "image_id long, x int, y int, mask boolean")
    all_ways = sorted(tuple(r)[1:3] for r in imaging.components(cells).collect())
    sides = sorted(tuple(r)[1:3] for r in imaging.components(cells, diagonal=False).collect())
    assert all_ways == [(0, 9)] and sides == [(0, 2), (6, 1), (8, 6)]


def test_missing_bottom(spark):
    """A dress needs no bottom; any other top does."""
    from pyspark.sql import functions as F
    from quillon.functions import look_rules

    sql = next(s for s, reason in look_rules.rejections() if reason == "Missing bottom.")
    df = spark.createDataFrame([("dress", None, True), ("shirt", None, False), ("shirt", "jeans", False)], "top_t string, bottom_t string, is_dress boolean")
    assert [r[0] for r in df.select(F.expr(sql)).collect()] == [False, True, False]


def test_item_lookup_is_single(spark):
    import pytest
    from quillon.operators import saved

    keys, rows = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    with pytest.raises(Exception, match="several rows"):
        saved.found(keys, rows).collect()
    assert saved.found(keys, rows.limit(1)).where("id = 2").first()["v"] is None
