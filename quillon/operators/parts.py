"""Connected parts of masks: runs joined in strips of rows, and strips joined by the labels that meet at their borders."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .strips import STRIP, Cells, over_strips

#: A label is the row and the column of a cell: row * 2 ** COLUMN_BITS + column.
COLUMN_BITS = 32


def _joined(row: np.ndarray, first: np.ndarray, last: np.ndarray, height: int, diagonal: bool) -> list[int]:
    """Of each run the first run that it is connected with: runs of neighbouring rows that overlap are one."""
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    starts, more = np.searchsorted(row, np.arange(height + 1)), int(diagonal)
    for y in range(height - 1):
        above, below = starts[y], starts[y + 1]
        while above < starts[y + 1] and below < starts[y + 2]:
            if first[below] <= last[above] + more and first[above] <= last[below] + more:
                a, b = find(above), find(below)
                root[max(a, b)] = min(a, b)
            above, below = (above + 1, below) if last[above] < last[below] else (above, below + 1)
    return [find(i) for i in range(len(root))]


def _in_strips(value: bool, diagonal: bool):
    def look(at: Cells) -> dict[str, np.ndarray]:
        labels = np.full(len(at.key), -1, np.int64)
        of = np.flatnonzero(pc.fill_null(pc.equal(at.table["mask"], value), False).to_numpy())
        if len(of):
            places, i = np.unique(at.key[of], return_index=True)
            row, x, y = at.row[of][i], at.x[of][i], at.y[of][i]
            begins = np.r_[True, (row[1:] != row[:-1]) | (x[1:] != x[:-1] + 1)]
            ends = np.r_[begins[1:], True]
            first = np.array(_joined(row[begins] - row[0], x[begins], x[ends], int(row[-1] - row[0]) + 1, diagonal), np.int64)
            own = (y[begins] << COLUMN_BITS | x[begins])[first][np.cumsum(begins) - 1]
            labels[of] = own[np.searchsorted(places, at.key[of])]
        return {"label": np.ma.masked_less(labels, 0)}

    return look


def connected(edges: DataFrame) -> DataFrame:
    """node, label of the nodes of edges (a, b): the smallest node that a chain of edges leads to.

    Each round takes the least label of the neighbours and then the label of that label, so rounds grow with the logarithm of a
    chain's length; what a round gives is a table in the shared folder.
    """
    both = kept(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = kept(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jumped = lower.join(labels.select(F.col("node").alias("to"), F.col("label").alias("further")), "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("label"), "was")
        after = kept(jumped)
        if after.where(F.col("label") != F.col("was")).isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def with_labels(cells: DataFrame, value: bool = True, diagonal: bool = True, strip: int = STRIP) -> DataFrame:
    """cells (image_id, x, y, mask, ...) with label: of cells with mask = value the first one, in reading order, of those that are
    connected (see COLUMN_BITS), null of the others.

    A strip of an image is one task's, so an image of any height is spread; labels that meet where strips do are merged as a
    graph that has a node a label, not a cell. Rows of one place that come twice are one cell. An image without cells has no row.
    """
    rows = kept(over_strips(cells, 0, _in_strips(value, diagonal), "label long", strip))
    labels = rows.where("label IS NOT NULL").select("image_id", "x", "y", "label")
    reach = F.explode(F.array(*[F.col("x") + d for d in ((-1, 0, 1) if diagonal else (0,))]))
    above = labels.where(F.col("y") % strip == strip - 1).select("image_id", reach.alias("x"), (F.col("y") + 1).alias("y"), F.col("label").alias("above"))
    below = labels.where(F.col("y") % strip == 0).withColumnRenamed("label", "below")
    node = lambda c: F.struct("image_id", F.col(c).alias("label"))
    edges = kept(below.join(above, ["image_id", "x", "y"]).select(node("above").alias("a"), node("below").alias("b")).distinct())
    if edges.isEmpty():
        return rows
    to = connected(edges).select(F.col("node.image_id").alias("image_id"), F.col("node.label").alias("label"), F.col("label.label").alias("to"))
    merged = rows.join(to, ["image_id", "label"], "left").withColumn("label", F.coalesce("to", "label"))
    return merged.select(*[F.col(f"`{c}`") for c in cells.columns], "label")


def labelled(cells: DataFrame, value: bool = True, diagonal: bool = True, strip: int = STRIP) -> DataFrame:
    """image_id, x, y, label of the cells with mask = value; label is the number, in reading order, of their part's first cell."""
    width = cells.groupBy("image_id").agg((F.max("x") + 1).alias("width"))
    rows = with_labels(cells.select("image_id", "x", "y", "mask"), value, diagonal, strip).where("label IS NOT NULL").join(width, "image_id")
    at = F.shiftright("label", COLUMN_BITS) * F.col("width") + F.col("label") % (1 << COLUMN_BITS)
    return rows.select("image_id", "x", "y", at.cast("long").alias("label"))
