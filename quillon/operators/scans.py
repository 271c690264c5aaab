"""What is wrong with scans: the order, the strongest and the first of their issues, scores and decisions; candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import clamp

#: Severities from the weakest, codes from the most to the least important with their priorities.
SEVERITIES = ("info", "warning", "error", "critical")
CODES = (
    "invalid-input", "invalid-image-size", "invalid-pixel-buffer", "invalid-mask", "foreground-missing", "image-severely-blurry", "foreground-touching-multiple-edges", "multiple-objects-detected", "possible-hand-detected",
    "image-too-dark", "image-underexposed", "image-too-bright", "image-overexposed", "background-too-similar", "foreground-touching-top", "foreground-touching-bottom", "foreground-touching-left", "foreground-touching-right",
    "subject-too-close", "foreground-too-large", "subject-too-far", "foreground-too-small", "secondary-object-detected", "mask-too-fragmented", "mask-low-confidence", "mask-uncertain-edges", "mask-has-holes",
    "image-blurry", "image-low-contrast", "subject-off-center", "image-too-small", "image-too-large", "quality-score-too-low", "unknown-quality-failure",
)
FIRST_PRIORITY, LAST_PRIORITY = 1000, 100
INVALID, BLOCKING = CODES[:4], ("image-severely-blurry", "foreground-missing", "foreground-touching-multiple-edges", "multiple-objects-detected")
#: Weights of the parts of a scan's score, least scores, and from where on candidates differ.
PRE_WEIGHTS, POST_WEIGHTS, BACKGROUND_WEIGHT = (0.14, 0.12, 0.16), (0.20, 0.12, 0.12), 0.14
ACCEPT, WARN, RETRY, EPSILON = 0.78, 0.66, 0.48, 1e-6


def severity_weight(x: Column) -> Column:
    out = F.lit(0)
    for i, name in enumerate(SEVERITIES):
        out = F.when(x == name, i + 1).otherwise(out)
    return out


def priority(code_place: Column) -> Column:
    """Of the place of a code in CODES: from 1000 in steps of ten; the last one has 100."""
    return F.when(code_place == len(CODES) - 1, LAST_PRIORITY).otherwise(FIRST_PRIORITY - 10 * code_place)


def distinct_issues(issues: DataFrame) -> DataFrame:
    """Of the issues (scan_id, stage, code_ix, severity, confidence, seq) of one scan, stage and code the strongest: by severity,
    then confidence, the first of equals; with w, the weight of its severity, and first, when this kind came first."""
    w = severity_weight(F.col("severity"))
    key = F.struct(w, "confidence", -F.col("seq"))
    kept = issues.groupBy("scan_id", "stage", "code_ix").agg(F.max_by(F.struct("severity", "confidence"), key).alias("x"), F.min("seq").alias("first"))
    return kept.select("scan_id", "stage", "code_ix", "x.*", "first", severity_weight(F.col("x.severity")).alias("w"))


def primary(issues: DataFrame) -> DataFrame:
    """scan_id and its most important issue: by severity, priority and confidence, the first of equals."""
    key = F.struct("w", priority(F.col("code_ix")), "confidence", -F.col("first"), F.col("stage") == "pre")
    return issues.groupBy("scan_id").agg(F.max_by(F.struct("stage", "code_ix", "severity", "confidence"), key).alias("x"), F.count("*").alias("issues")).select("scan_id", "x.*", "issues")


def weighted(entries: list[tuple[Column, Column]]) -> Column:
    """The mean of scores (0 to 1) by weights; missing scores and weights that aren't above 0 don't count, and none is 0."""
    weights = [F.when(s.isNull() | w.isNull() | (w <= 0), 0.0).otherwise(w) for s, w in entries]
    total = sum(weights[1:], weights[0])
    parts = [F.coalesce(clamp(s, 0.0, 1.0), F.lit(0.0)) * w for (s, _), w in zip(entries, weights, strict=True)]
    return F.when(total > 0, clamp(sum(parts[1:], parts[0]) / total, 0.0, 1.0)).otherwise(0.0)


def final_score(pre: Column, post: Column, with_background: Column) -> Column:
    before = F.when(pre.isNotNull(), F.lit(sum(PRE_WEIGHTS)))
    after = F.when(post.isNotNull(), F.lit(sum(POST_WEIGHTS)) + F.when(with_background, BACKGROUND_WEIGHT).otherwise(0.0))
    return weighted([(pre, before), (post, after)])


def decided(scans: DataFrame) -> DataFrame:
    """decision of each scan (score, issues, invalid, blocking): what is invalid is rejected and what blocks is tried again
    whatever the score; a good scan with issues is accepted with a warning."""
    by_score = F.when(F.col("score") >= ACCEPT, F.when(F.col("issues") > 0, "accept-with-warning").otherwise("accept")).when(F.col("score") >= WARN, "accept-with-warning").when(F.col("score") >= RETRY, "retry").otherwise("reject")
    return scans.withColumn("decision", F.when(F.col("invalid"), "reject").when(F.col("blocking"), "retry").otherwise(by_score))


def highest(candidates: DataFrame) -> DataFrame:
    """image_id and the place of the highest finite score, the first of equals; 0 where there is none."""
    fine = F.col("score").isNotNull() & ~F.isnan("score")
    best = F.max_by(F.col("ord"), F.when(fine, F.struct("score", -F.col("ord"))))
    return candidates.groupBy("image_id").agg(F.coalesce(best, F.lit(0)).alias("selected"))


def best_candidates(candidates: DataFrame) -> DataFrame:
    """image_id and the place of the best candidate, found by going through them in order.

    Scores within EPSILON are equal, then a reliable one, less leakage, more edge and more samples win. Being equal isn't
    transitive, so this is a fold in order, over the few candidates of an image. Invalid ones only count where all are: then it
    is the highest score.
    """
    row = F.struct("ord", "valid", "reliable", F.coalesce("score", F.lit(0.0)).alias("score"), "leakage", "edge", "samples")
    rows = candidates.groupBy("image_id").agg(F.array_sort(F.collect_list(row)).alias("all"))

    def better(best: Column, x: Column) -> Column:
        def ladder(name: str, sign: int, rest: Column) -> Column:
            d = (x[name] - best[name]) * sign
            return F.when(d > EPSILON, True).when(F.abs(d) > EPSILON, False).otherwise(rest)

        tie = F.when(x["reliable"] != best["reliable"], x["reliable"]).otherwise(ladder("leakage", -1, ladder("edge", 1, x["samples"] > best["samples"])))
        return F.when(F.when(best["ord"].isNull(), True).otherwise(ladder("score", 1, tie)), x).otherwise(best)

    usable = F.filter("all", lambda x: x["valid"])
    start = F.element_at("all", 1).withField("ord", F.lit(None).cast("long"))
    of_all = F.aggregate("all", F.element_at("all", 1), lambda best, x: F.when(x["score"] > best["score"], x).otherwise(best))
    chosen = F.when(F.size(usable) > 0, F.aggregate(usable, start, better)["ord"]).otherwise(of_all["ord"])
    return rows.select("image_id", chosen.alias("selected"))
