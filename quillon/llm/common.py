"""What several operators share: reading tables, tables in the shared folder, blocks of documents."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A session on this machine alone that names none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and there for whoever reads it after a loss."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_blocks(docs: DataFrame, block_mb: float, text: str = "text") -> int:
    """How many blocks of about block_mb MB of text the rows make, 1 at least."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / (block_mb * 1e6)))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Destinations of messages at most: a block sends a row to each.
MOST_DESTINATIONS = 4096


def destinations(spark: SparkSession, blocks: int, blocks_each: float) -> int:
    """How many destinations the messages of so many blocks need if each can take those of blocks_each; at least
    spark.sql.shuffle.partitions, so that all cores have some."""
    return min(max(shuffle_width(spark), math.ceil(blocks / blocks_each)), max(MOST_DESTINATIONS, shuffle_width(spark)))


def in_blocks(docs: DataFrame, blocks: int, *more) -> DataFrame:
    """doc_id, text, more and their block. A row's block depends on doc_id and text, so that rows without doc_id, or with the
    same one, are spread; equal rows are in one block."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(blocks)).cast("long"))


def in_order(block: pa.Table) -> pa.Table:
    """The block's rows by doc_id (missing: before all) and text, so that a row's place in its block never changes."""
    block = block.set_column(block.column_names.index("doc_id"), "doc_id", pc.fill_null(block["doc_id"], MISSING_ID))
    block = block.set_column(block.column_names.index("text"), "text", pc.fill_null(block["text"], ""))
    return block.take(pc.sort_indices(block, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()


def ids_or_null(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == MISSING_ID)


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column without nulls, end to end, and where each value starts (one more: the end)."""
    arrays = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    bufs, offs, at = [], [np.zeros(1, np.int64)], 0
    for a in arrays:
        if not len(a):
            continue
        wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
        off = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
        data = a.buffers()[2]
        bufs.append(np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8))
        offs.append(off[1:] - off[0] + at)
        at += int(off[-1] - off[0])
    return (np.concatenate(bufs) if len(bufs) != 1 else bufs[0]) if bufs else np.zeros(0, np.uint8), np.concatenate(offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class RollingHash:
    """Hashes of byte ranges from one pass of running sums: equal bytes, equal hash, wherever they stand."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.of_byte = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**40, 2**62)) * 8 + 5
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << max(12, n.bit_length())
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                steps = np.full(size, base % 2**64, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def sums(self, buf: np.ndarray) -> np.ndarray:
        self._powers(len(buf) + 1)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.of_byte[buf] * self.up[: len(buf)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The hashes of buf[lo:hi], not yet mixed."""
        return (sums[hi] - sums[lo]) * self.down[lo]


def run_edges(same_as_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs in an array whose element i + 1 goes on as same_as_before[i] says."""
    breaks = np.flatnonzero(~same_as_before)
    return np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(same_as_before)]])


def squeezed(a: np.ndarray, size: int | None = None) -> bytes:
    """The values, of each the lowest `size` bytes, first bytes first: small and slowly growing ones take little room."""
    wide = a.dtype.itemsize
    by_byte = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), wide)[:, : size or wide]
    return zstandard.compress(np.ascontiguousarray(by_byte.T).tobytes(), 3)


def loose(b: bytes, kind: type, size: int | None = None) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    by_byte = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size or wide, -1).T
    out = np.zeros((len(by_byte), wide), np.uint8)
    out[:, : by_byte.shape[1]] = by_byte
    return out.view(kind).ravel()


def unlisted(column) -> np.ndarray:
    """All elements of a column of lists, end to end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([unlisted(c) for c in column.chunks]) if column.num_chunks else np.zeros(0, column.type.value_type.to_pandas_dtype())
    return column.flatten().to_numpy(zero_copy_only=False)


def list_lengths(column) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)


#: Rows of a range of placed() that one task numbers.
RANGE_ROWS = 500_000


def _numbered(groups: list[str]):
    """The rows, each with its number (at) in its group within this range; rows come sorted by group."""

    def run(batches):
        last, n = None, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            new = np.zeros(rows.num_rows, bool)
            for g in groups:
                c = rows[g].combine_chunks()
                new[1:] |= ~pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new | (np.arange(rows.num_rows) == 0))
            at = np.arange(rows.num_rows) - np.repeat(first, np.diff(np.append(first, rows.num_rows)))
            if rows.num_rows:
                if [rows[g][0].as_py() for g in groups] == last:
                    at[: first[1] if len(first) > 1 else None] += n
                last, n = [rows[g][-1].as_py() for g in groups], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])

    return run


def placed(rows: DataFrame, groups: list[str], order: list) -> DataFrame:
    """rows with pos, the place in the group by order (from 0), and n, the size of the group. Groups have no nulls.

    Rows are dealt by ranges of group and order, numbered there, and moved on by what the ranges before have of the group, so
    that a group of any size is spread. rows should be a table: it is read twice (the first time for the bounds of the ranges).
    """
    width = max(shuffle_width(rows.sparkSession), math.ceil(rows.count() / RANGE_ROWS))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = rows.repartitionByRange(width, *groups, *order).sortWithinPartitions(*groups, *order).withColumn("range", F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, T.StructField("at", T.LongType())])
    numbered = written(dealt.mapInArrow(_numbered(groups), schema))
    sizes = numbered.groupBy(*groups, "range").agg(F.count("*").alias("k"))
    before = W.partitionBy(*groups).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("k").over(before), F.lit(0)), "n": F.sum("k").over(W.partitionBy(*groups))})
    return numbered.join(sizes.drop("k"), [*groups, "range"]).withColumn("pos", F.col("before") + F.col("at")).select(*[F.col(f"`{c}`") for c in rows.columns], "pos", "n")
