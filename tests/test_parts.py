"""Parts and distances of images that are spread over several tasks, against plain searches."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import boundary, parts


def plain_labels(mask, diagonal):
    out, h, w = {}, *mask.shape
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (diagonal or not dx or not dy)]
    for y in range(h):
        for x in range(w):
            if mask[y, x] and (x, y) not in out:
                out[x, y], todo = y * w + x, [(x, y)]
                while todo:
                    a, b = todo.pop()
                    for dx, dy in steps:
                        p = (a + dx, b + dy)
                        if 0 <= p[0] < w and 0 <= p[1] < h and mask[p[1], p[0]] and p not in out:
                            out[p] = y * w + x
                            todo.append(p)
    return out


def frame(spark, masks, column="mask"):
    rows = [(i, x, y, bool(m[y, x])) for i, m in enumerate(masks) for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, f"image_id long, x int, y int, {column} boolean").repartition(4)


def masks():
    rng = np.random.default_rng(3)
    snake = np.zeros((40, 17), bool)
    snake[::2] = True
    snake[1::4, -1], snake[3::4, 0] = True, True
    return [rng.random((33, 20)) < 0.55, rng.random((7, 9)) < 0.4, snake, np.zeros((9, 3), bool), np.ones((25, 1), bool)]


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("strip", [256, 4, 1])
def test_labels_across_strips(spark, diagonal, strip):
    got = {(r.image_id, r.x, r.y): r.label for r in parts.labelled(frame(spark, masks()), True, diagonal, strip).collect()}
    want = {(i, x, y): label for i, m in enumerate(masks()) for (x, y), label in plain_labels(m, diagonal).items()}
    assert got == want


def test_a_large_image_is_spread(spark):
    """A comb over 2,048 rows: one part if the strips are merged; no task has the whole image."""
    cells = spark.range(2048 * 512).selectExpr("0L AS image_id", "CAST(id % 512 AS int) AS x", "CAST(id div 512 AS int) AS y").withColumn("mask", (F.col("x") % 2 == 0) | (F.col("y") == 2047))
    got = parts.labelled(cells, strip=128).groupBy("label").count().collect()
    assert [(r.label, r["count"]) for r in got] == [(0, 2048 * 256 + 256)]


@pytest.mark.parametrize("most", [2, 3.5, 40])
def test_distances(spark, most):
    """The distance of every cell is that of a search over single steps."""
    for mask in masks():
        h, w = mask.shape
        seeds = mask & (np.random.default_rng(1).random(mask.shape) < 0.05)
        far, todo = {}, [(0.0, int(x), int(y)) for y, x in zip(*np.nonzero(seeds), strict=True)]
        while todo:
            d, x, y = heapq.heappop(todo)
            if (x, y) not in far:
                far[x, y] = d
                todo_more = [(d + math.hypot(dx, dy), x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and 0 <= x + dx < w and 0 <= y + dy < h]
                for t in todo_more:
                    heapq.heappush(todo, t)
        want = {(x, y): min(most, far.get((x, y), math.inf)) for y in range(h) for x in range(w)}
        got = {(r.x, r.y): r.distance for r in boundary.distances(frame(spark, [seeds], "seed"), "seed", most).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_robust_colors_take_as_many_parts_as_the_values_need(spark):
    from quillon.operators import masks

    pixels = spark.range(3000).selectExpr("id % 50 AS image_id", "id * 7 % 256 AS r", "id * 11 % 256 AS g", "id * 13 % 256 AS b")
    few, many = masks.robust_colors(pixels), masks.robust_colors(pixels, at_once=300)
    assert many.rdd.getNumPartitions() >= few.rdd.getNumPartitions() and "30)" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
