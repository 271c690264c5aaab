"""Collocations against a plain count of all phrases, with small tiles and chunks too."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import collocations

DOCS = "doc_id long, text string, lang string, chunk int, word string, f int, id long"


def doc_rows():
    rng = np.random.default_rng(5)
    common = [f"w{i}" for i in range(40)]
    out = [None, "", " \t ", "a  b\tc.A B,C a b c", "é ß é ß\x0bé ß", "<x> \0 y " * 50, "a b " * 3000, "." * 100, "Ä ä A a" * 20, "long" * 300_000]
    out += [" ".join(rng.choice(common, 30)) + rng.choice(list(".,;:!?\n\r \t")) + " new york city hall is big" for _ in range(200)]
    out += ["san diego"] * 50 + ["one two three four five"] * 31
    langs = ["en", None, "de", "", "und"]
    return [(i if i % 9 else None, t, langs[i % 3] if i > 20 else langs[i % 5], 1, "s", 2, 3) for i, t in enumerate(out)]


def plain(rows, least, longest=4, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = collections.Counter()
    for (lang, ws), a in some.items():
        for size in range(2, len(ws)):
            for i in range(len(ws) - size + 1):
                inside[lang, ws[i : i + size]] = max(inside[lang, ws[i : i + size]], a)
    out = collections.defaultdict(list)
    for (lang, ws), a in some.items():
        if 100 * inside[lang, ws] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        out[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).repartition(5).cache()


@pytest.mark.parametrize(("least", "longest", "top", "chunk_mb", "side"), [(30, 4, 2000, 16, 1024), (2, 4, 50, 0.01, 8), (3, 3, 2000, 0.005, 1), (30, 2, 3, 16, 1024)])
def test_collocations(docs, least, longest, top, chunk_mb, side):
    got = sorted(map(tuple, collocations.collocations(docs, least, longest, top, chunk_mb, side).collect()))
    assert got == plain(doc_rows(), least, longest, top)
    assert got


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame(doc_rows()[:3], DOCS)).collect() == []


def test_scores_beyond_64_bits(spark):
    a, both = 2**62 - 1, 2**63 - 3
    df = spark.createDataFrame([(a, both)], "a long, b long").select(collocations._exact_score(F.col("a"), F.col("b").cast("decimal(19,0)") + F.col("b")).alias("s"))
    assert df.first().s == 2_000_000 * a // (2 * both)


def test_square_counts_every_pair():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, 5000) % 300 - 1
    want = collections.Counter((a, b) for a, b in zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True) if a >= 0 and b >= 0)
    got = collections.Counter()
    for d, strip, keys, counts in collocations.square(ids, 7, 16):
        for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
            got[k >> 32, k & 0xFFFFFFFF] += c
        if strip is not None:
            for x, y in np.argwhere(strip):
                got[int(x) * 7 + d, int(y)] += int(strip[x, y])
    assert got == want
