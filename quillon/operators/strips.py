"""Strips of images: rows of cells with some above and below, many strips a batch, and the cells around each of them.

Images may be many and small or few and large: a task takes whole strips one batch after another, so what is done costs by cells and
not by images, and an image of any height is spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an image that are one strip.
STRIP = 256


def _starts(table: pa.Table) -> np.ndarray:
    """Where another strip begins in rows that are sorted by image and strip."""
    image = table["image_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    strip = table["strip"].to_numpy()
    return np.flatnonzero(np.r_[True, (image[1:] != image[:-1]) | (strip[1:] != strip[:-1])])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole strips: the last strip of a batch waits for the next batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(_starts(pa.Table.from_batches([batch]))[-1])
        ends = bool(waiting) and len(_starts(pa.Table.from_batches([waiting[-1].slice(waiting[-1].num_rows - 1), batch.slice(0, 1)]))) > 1
        if last or ends:
            done = [*waiting, batch.slice(0, last)] if last else waiting
            yield pa.Table.from_batches(done)
            waiting = [batch.slice(last)]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)


class Cells:
    """The cells of whole strips, sorted by strip, y and x: the place of each, and where those around it are."""

    def __init__(self, table: pa.Table, strip: int, reach: int):
        self.table = table
        starts = _starts(table)
        self.x, self.y = (table[c].to_numpy().astype(np.int64) for c in "xy")
        self.group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, table.num_rows]))
        # one number a place, in order, with room for `reach` more on all sides
        reach = max(1, reach)
        self.width = int(self.x.max() - self.x.min()) + 2 * reach + 1
        row = self.y - table["strip"].to_numpy() * strip
        low, high = int(row.min()), int(row.max())
        self.rows = high - low
        self.row = self.group * (self.rows + 2 * reach + 1) + row - low + reach
        self.key = self.row * self.width + self.x - self.x.min() + reach
        again = np.diff(np.flatnonzero(np.r_[True, np.diff(self.key) != 0, True]))
        self.most = int(again.max())

    def of(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()

    def at(self, dx: int, dy: int, cells: np.ndarray | slice = slice(None)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each of cells the index of the one that lies dx and dy from it, and whether there is one; once more for each time that a
        place comes again."""
        wanted = self.key[cells] + dy * self.width + dx
        first = np.searchsorted(self.key, wanted)
        for k in range(self.most):
            i = np.minimum(first + k, len(self.key) - 1)
            yield i, (self.key[i] == wanted) & (first + k < len(self.key))

    def distance(self, seed: np.ndarray, most: float) -> np.ndarray:
        """As distances() of boundary: each row is searched once, to both sides, then each column up and down."""
        n, reach = len(self.key), int(np.ceil(most))
        index = np.arange(n)
        before = np.maximum.accumulate(np.where(seed, index, -1))
        after = n - 1 - np.maximum.accumulate(np.where(seed[::-1], index, -1))[::-1]
        side = np.full(n, np.inf)
        for i, there in ((before, before >= 0), (after, after < n)):
            i = np.clip(i, 0, n - 1)
            side = np.minimum(side, np.where(there & (self.row[i] == self.row), np.abs(self.x - self.x[i]), np.inf))
        side[side > reach] = np.inf
        out = np.full(n, float(most))
        for rise in range(-min(reach, self.rows), min(reach, self.rows) + 1):
            for i, there in self.at(0, rise):
                s = np.where(there, side[i], np.inf)
                near = np.isfinite(s)
                short = np.minimum(s[near], abs(rise))
                out[near] = np.minimum(out[near], np.maximum(s[near], abs(rise)) - short + short * np.sqrt(2))
        return out


def over_strips(cells: DataFrame, reach: int, look: Callable[[Cells], dict[str, np.ndarray]], added: str, strip: int = STRIP) -> DataFrame:
    """cells (image_id, x, y, ...) with the columns `added` that look gives: it has whole strips with `reach` rows above and below,
    so what lies farther up or down must not count. y begins at 0. One shuffle; a row is sent once, near a border of strips to both."""
    of = lambda rise: F.floor((F.col("y") + rise) / strip).cast("int")
    rows = cells.withColumn("strip", F.explode(F.sequence(F.greatest(F.lit(0), of(-reach)), of(reach))) if reach else of(0))
    rows = rows.repartition("image_id", "strip").sortWithinPartitions("image_id", "strip", "y", "x")
    extra = T.StructType.fromDDL(added)
    schema = T.StructType([*cells.schema.fields, *extra.fields])
    names, arrow = cells.columns, [{"boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64()}[f.dataType.simpleString()] for f in extra.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            at = Cells(table, strip, reach)
            found = look(at)
            out = table.select(names)
            for f, kind in zip(extra.fields, arrow, strict=True):
                out = out.append_column(f.name, pa.array(found[f.name], kind))
            own = at.y // strip == table["strip"].to_numpy()
            yield from (out if own.all() else out.filter(pa.array(own))).to_batches()

    return rows.mapInArrow(run, schema)
