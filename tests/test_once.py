"""What depends on a text alone is worked out once for each different text."""

from quillon.operators import outfits as O
from quillon.plans import evaluation, styling


def test_colors_are_named_once_a_text(spark, sf_dir):
    plan = styling.color_normalize(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan and plan.index("Aggregate [") > plan.index("normalized")  # names are made above the different texts


def test_match_scores_look_up_codes_once(spark, sf_dir, monkeypatch):
    calls, named = [], O._named
    monkeypatch.setattr(O, "_named", lambda *a: calls.append(a) or named(*a))
    evaluation.match_scores(spark, sf_dir)
    assert len(calls) == 1
