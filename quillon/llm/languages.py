"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

#: Hash cells of n-grams of 1 to ORDERS characters; the labelled documents that a model is fitted on at most, dealt evenly to
#: the languages (one of each language, if there are more languages than that).
CELLS, ORDERS, SAMPLE = 1 << 16, 3, 4000
#: Of follow-the-regularised-leader: step, its offset, L1 and L2 penalties, passes over the sample; the share for calibration.
ALPHA, BETA, L1, L2, PASSES, CALIBRATION = 0.3, 1.0, 0.002, 0.01, 3, 0.2
UNKNOWN = "und"
_SALTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the lower-cased text's n-grams, and how many n-grams fell in each."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    counts = np.zeros(CELLS, np.int64)
    h = np.zeros(len(c), np.uint64)
    for n in range(min(ORDERS, len(c))):
        h = (h[: len(c) - n] + c[n:] + np.uint64(1)) * _SALTS[n]
        counts += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=CELLS)
    cells = np.flatnonzero(counts)
    return cells, counts[cells]


@dataclass
class Model:
    """Languages, weights (cell, language), offsets, the cells' inverse document frequencies, and the temperature."""

    languages: list[str]
    weights: np.ndarray
    offsets: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.scaled(*ngram_counts(text))

    def scaled(self, cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.log1p(counts) * self.idf[cells]
        return cells, x / (math.sqrt(x @ x) or 1.0)

    def logits(self, cells: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[cells] + self.offsets

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*self.features(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, max(0.0, p[best])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets by follow-the-regularised-leader with elastic-net penalties, one row after the other.

    z gathers the slopes and n their squares; a weight is 0 until |z| is over L1. The offsets aren't penalised.
    """
    z, n = np.zeros((CELLS + 1, languages)), np.zeros((CELLS + 1, languages))
    free = np.zeros(CELLS + 1)
    free[CELLS] = 1

    def weights(cells):
        l1 = L1 * (1 - free[cells])[:, None]
        over = np.abs(z[cells]) > l1
        return np.where(over, (np.sign(z[cells]) * l1 - z[cells]) / ((BETA + np.sqrt(n[cells])) / ALPHA + L2), 0.0)

    for _ in range(PASSES):
        for cells, x, y in rows:
            cells, x = np.append(cells, CELLS), np.append(x, 1.0)
            w = weights(cells)
            p = softmax(x @ w)
            p[y] -= 1
            slope = x[:, None] * p
            after = n[cells] + slope**2
            z[cells] += slope - (np.sqrt(after) - np.sqrt(n[cells])) / ALPHA * w
            n[cells] = after
    w = weights(np.arange(CELLS + 1))
    return w[:CELLS], w[CELLS]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search between 1/20 and 20."""
    if not len(y):
        return 1.0

    def loss(t):
        return -np.log(np.maximum(softmax(logits / math.exp(t))[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, g = -math.log(20), math.log(20), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def _has_letter(c: str = "text"):
    return F.coalesce(F.col(c).rlike(r"\p{L}"), F.lit(False))


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text mod 3; null where it is missing."""
    return F.crc32(doc_id.cast("string")) % 3


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all the documents each cell is, and how many there are. The answer has CELLS rows at most."""

    def run(batches):
        total, seen = 0, np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                seen[ngram_counts(text)[0]] += 1
                total += 1
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, CELLS)), pa.array(np.append(seen[cells], total))], ["cell", "n"])

    out = np.zeros(CELLS + 1, np.int64)
    for cell, n in docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out[:CELLS], int(out[CELLS])


def features_of(docs: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Language (its place y), cells and counts of each row of docs, in one order; CELLS entries a row at most, whatever its text."""

    def run(batches):
        for batch in batches:
            for text, y, h in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), batch["h"].to_pylist(), strict=True):
                cells, counts = ngram_counts(text)
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([y], pa.int32()), pa.array([cells.astype("<i4").tobytes()]), pa.array([counts.astype("<i4").tobytes()])], ["h", "y", "cells", "counts"])

    got = docs.select("text", "y", "h").mapInArrow(run, "h long, y int, cells binary, counts binary").toArrow()
    rows = sorted(zip(*(got[c].to_pylist() for c in ("h", "y", "cells", "counts")), strict=True))
    return [(y, np.frombuffer(cells, "<i4").astype(np.int64), np.frombuffer(counts, "<i4")) for _, y, cells, counts in rows]


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the rows of docs (doc_id, text, lang) that have text with a letter and lang.

    The document frequencies are of all rows. The weights and the temperature are fitted on at most `sample` rows: of each
    language as many as of any other, those with the smallest hashes (of doc_id, then text), so that a rare language has rows
    too; a fifth of them is for the temperature only. What reaches the driver is at most CELLS counts a row of the sample.
    Languages are all lang values; the weights take CELLS numbers for each on the driver and in every worker.
    """
    rows = docs.where(F.col("lang").isNotNull() & _has_letter()).select("text", "lang", F.xxhash64("doc_id", "text", F.lit(5)).alias("h"))
    order = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    first = written(rows.select("lang", "h").withColumn("place", order).where(F.col("place") <= sample))
    languages = sorted(r["lang"] for r in first.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((CELLS, 0)), np.zeros(0), np.ones(CELLS))
    each = max(1, sample // len(languages))
    last = dict(first.where(F.col("place") <= each).groupBy("lang").agg(F.max("h")).collect())
    bounds = docs.sparkSession.createDataFrame([(lang, y, last[lang]) for y, lang in enumerate(languages)], "lang string, y int, last long")
    wanted = rows.join(F.broadcast(bounds), "lang").where(F.col("h") <= F.col("last"))  # a row for each language
    data, per = [], dict.fromkeys(range(len(languages)), 0)
    for y, cells, counts in features_of(wanted.dropDuplicates(["h", "lang"])):
        per[y] += 1
        if per[y] <= each:
            data.append((cells, counts, y))
    seen, total = document_frequencies(rows)
    model = Model(languages, np.zeros((CELLS, len(languages))), np.zeros(len(languages)), np.log((1 + total) / (1 + seen)) + 1)
    data = [(*model.scaled(cells, counts), y) for cells, counts, y in data]
    held = int(len(data) * CALIBRATION)
    model.weights, model.offsets = fit_ftrl(data[held:], len(languages))
    if held:
        model.temperature = fit_temperature(np.array([model.logits(c, x) for c, x, _ in data[:held]]), np.array([y for _, _, y in data[:held]]))
    return model


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep of docs and lang_pred, score for each row's whole text.

    lang_pred is UNKNOWN and score 0 where the text is missing or has no letter, or where the model has no language; score
    is the calibrated probability otherwise. Equal texts have equal values. No row moves.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")]).alias("row"), F.when(_has_letter(), F.col("text")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) if t is not None else (UNKNOWN, 0.0) for t in batch["text"].to_pylist()]
            lang, score = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "lang_pred", "score")


def learnt_from(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn from: those whose fold isn't 1."""
    return docs.where(fold(F.col("doc_id")) != 1)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a model of those that aren't held out.

    held_out: the fold is 1 (false without doc_id; such a row isn't learnt from either). Repeated rows give repeated rows, an
    empty table none, and other columns are ignored.
    """
    model = train(learnt_from(docs.select("doc_id", "text", "lang")))
    rows = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"))
    return predict(rows, model, ["doc_id", "held_out"]).select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows whose language isn't known: no letter, or a score under least."""
    model = train(learnt_from(docs.select("doc_id", "text", "lang")))
    named = predict(docs.select(F.struct("*").alias("doc"), "text"), model, ["doc"])
    return named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("doc.*")


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
