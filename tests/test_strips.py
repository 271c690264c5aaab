"""Strips of images: what is counted over them is the same however they are cut, and costs one shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import boundary as B
from quillon.operators.strips import over_strips


@pytest.fixture(scope="module")
def cells(spark):
    draw = random.Random(5)
    rows = [(i, x, y, draw.random(), draw.random() < 0.15) for i in range(40) for y in range(9) for x in range(7) if draw.random() < 0.9]
    return spark.createDataFrame(rows, "image_id long, x int, y int, alpha double, seed boolean")


@pytest.mark.parametrize("strip", [5, 256])
def test_distances_and_edges_over_strips(spark, cells, strip):
    look = lambda at: {"distance": at.distance(at.of("seed"), 4), "boundary": B._edge(at)}
    got = over_strips(cells, 5, look, "distance double, boundary boolean", strip)
    want = B.with_boundary(B.distances(cells, "seed", 4)).select(*got.columns)
    a, b = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert a == b


def test_an_image_that_is_longer_than_a_batch(spark, cells):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = over_strips(cells, 5, lambda at: {"distance": at.distance(at.of("seed"), 4)}, "distance double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == sorted(map(tuple, B.distances(cells, "seed", 4).select("image_id", "x", "y", "alpha", "seed", "distance").collect()))


def test_a_vote_is_one_shuffle_without_windows(spark, cells):
    rows = cells.select("image_id", "x", "y", "alpha", F.lit(1).alias("class"), F.lit(0.5).alias("confidence"), F.lit(True).alias("active"), "seed", F.lit(True).alias("main"), F.lit(0.5).alias("continuity"), F.lit(0.5).alias("support"), F.lit(0.5).alias("agreement"))
    plan = B._vote(rows, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
