"""Rules of looks: what is worked out of a look is short enough to be compiled, and colours that no rule names don't count."""

import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import look_rules as L
from quillon.plans import evaluation

#: The virtual machine never translates a function of more bytes.
MOST_BYTES = 8000


def largest_function(query, spark, sf_dir, capsys):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        capsys.readouterr()
        query(spark, sf_dir).explain("codegen")
        return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize("name", ["rule_scores", "hard_rejections", "outfit_rank_full"])
def test_rules_are_short_enough_to_be_compiled(spark, sf_dir, capsys, name):
    assert largest_function(evaluation.QUERIES[name], spark, sf_dir, capsys) < MOST_BYTES


def test_colors_of_a_look(spark):
    """Each named colour counts as often as it is worn, in up to eight slots; others count as worn and as different only."""
    slots = [f"s{i}" for i in range(6)] + ["top", "bottom"]
    rows = [["Red"] * 8, [None] * 8, ["Plaid", "plaid", "Light Blue", "Light Blue", None, "Navy", "Orange", "Pink"]]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{s} string" for s in slots))
    df = df.select(*[F.expr(sql).alias(name) for name, sql in L.prepared(slots).items()])
    got = df.select("worn_colors", "different_colors", "pair_score", *[F.expr(L._count(names)) for names in (("Red",), ("Light Blue", "Navy"), L.NAMED)]).collect()
    assert [tuple(r) for r in got] == [(8, 1, 88, 8, 0, 8), (0, 0, 88, 0, 0, 0), (7, 6, 45, 0, 3, 5)]


@pytest.mark.parametrize("name", ["outfit_evaluation", "outfit_evaluation_topk"])
def test_scores_of_colors_are_compiled(spark, sf_dir, name):
    """No score is a fold, which is gone through piece by piece for every look."""
    plan = evaluation.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "transform(" in plan
