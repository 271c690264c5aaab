"""Media columns: texts as lossless WebP images, read back with their features."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import webp
from .common import table

#: Samples of an image row; a payload is whole rows, filled up with this byte.
ROW, FILL = 576, 255
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(text: bytes) -> list[bytes]:
    """The text, filled up to whole rows, as WebP files of 8-bit samples: one file for each webp.MAX_SIDE rows."""
    rows = max(1, -(-len(text) // ROW))
    samples = np.full(rows * ROW, FILL, np.uint8)
    samples[: len(text)] = np.frombuffer(text, np.uint8)
    samples = samples.reshape(rows, ROW)
    return [webp.encode_gray(samples[r : r + webp.MAX_SIDE]) for r in range(0, rows, webp.MAX_SIDE)]


def read_back(media: list[bytes]) -> np.ndarray:
    """The samples of the files, one below the other."""
    return np.concatenate([webp.decode(m)[..., webp.GREEN] for m in media])


def feature(samples: np.ndarray) -> str:
    """Mean and deviation of the samples and a hash of 64 bits: which of 64 equal stretches are brighter than the mean."""
    flat = samples.ravel()
    sums = np.add.reduceat(flat, np.arange(0, len(flat), len(flat) // 64), dtype=np.int64)
    mean = flat.mean()
    bits = int("".join("1" if s > mean * (len(flat) // 64) else "0" for s in sums[:64].tolist()), 2)
    return f"{mean:.4f},{flat.std():.4f},{bits:016x}"


def _stored(batches):
    for batch in batches:
        for i, text in enumerate(batch["text"].to_pylist()):
            media = pa.array([store((text or "").encode())], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, 1), media], ["doc_id", "media"])


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, media: the WebP files of every row's whole text, as media_digests describes them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stored, "doc_id long, media array<binary>")


def _pixels(batches):
    for batch in batches:
        for i, media in enumerate(batch["media"].to_pylist()):
            samples = [read_back(media).tobytes() if media else None]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, 1), pa.array(samples, pa.binary())], ["doc_id", "samples"])


def pixels(media: DataFrame) -> DataFrame:
    """doc_id, samples: the pixel array (ROW samples a row) of the files in the column media; null where there is none."""
    return media.select("doc_id", "media").mapInArrow(_pixels, "doc_id long, samples binary")


def _rows(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            text = (text or "").encode()
            media = store(text)
            samples = read_back(media)
            payload = samples.tobytes()
            joined = b"".join(media)
            rows.append((doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(joined), hashlib.sha256(joined).hexdigest(), feature(samples)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])


def media_digests(docs: DataFrame) -> DataFrame:
    """One row a document: its bytes, the payload read back from the stored form, the stored form, and the feature.

    A missing or empty text is one row of fill bytes. Repeated rows give repeated rows, equal texts equal values, an empty
    table no row; other columns are ignored. A long text is more rows of the image, and more files beyond webp.MAX_SIDE rows.
    No row moves, and a task holds one text at a time besides its batch. stored() and pixels() give the files and the samples
    themselves.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows, SCHEMA)


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
