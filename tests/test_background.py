"""Clusters of the background's colours against a plain replay, with many merges."""

import math
import random

import pytest

from quillon.operators import background as B

SEEDS = "image_id long, place int, source string, x int, y int, l double, a double, b double, texture double, confidence double"


def seeds(seed, images=4, n=80):
    rng = random.Random(seed)
    spots = [[rng.random() for _ in range(3)] for _ in range(9)]
    out = []
    for image in range(images):
        for place in range(1, n + 1 if image else 3):
            spot = rng.choice(spots)
            out.append((image, place, "border", place % 9, place // 9, *[s + rng.gauss(0, 0.03) for s in spot], rng.random() / 5, round(rng.random(), 1)))
    return out


def far(p, q):
    return round(math.sqrt(sum((p[c] / p["n"] - q[c] / q["n"]) ** 2 for c in "lab")) / math.sqrt(3), 9)


def plain(rows, most=5):
    """The clusters of one image's seeds, in order: number, mean colour."""
    clusters = []
    for _, _, _, _, _, l, a, b, _, _ in sorted(rows, key=lambda r: (-r[9], r[1])):
        s = {"n": 1, "l": l, "a": a, "b": b}
        near = min(clusters, key=lambda c: far(c, s), default=None)
        if near is not None and far(near, s) <= 0.115:
            for k in s:
                near[k] += s[k]
        else:
            clusters.append(s)
        if len(clusters) > most:
            _, i, j = min((far(p, q), i, j) for i, p in enumerate(clusters) for j, q in enumerate(clusters) if i < j)
            for k in s:
                clusters[i][k] += clusters[j][k]
            del clusters[j]
    large = [c for c in clusters if c["n"] >= max(2, math.floor(len(rows) * 0.08))] or clusters
    return [(c["n"], *[c[k] / c["n"] for k in "lab"]) for c in sorted(large, key=lambda c: -c["n"])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters(spark, seed):
    rows = seeds(seed)
    got = {}
    for r in sorted(B.color_clusters(spark.createDataFrame(rows, SEEDS).repartition(3)).collect(), key=lambda r: (r.image_id, r.cluster)):
        got.setdefault(r.image_id, []).append((r.n, r.l, r.a, r.b))
    assert got.keys() == set(range(4))
    for i in got:
        want = plain([r for r in rows if r[0] == i])
        assert [c[0] for c in got[i]] == [c[0] for c in want]
        assert got[i] == [pytest.approx(c, abs=1e-8) for c in want]
