"""Nearest neighbours by a forest of random-projection trees searched through one priority queue."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import flat, table, unlisted, written

#: Trees, vectors that the trees are laid out by at most, of these in a leaf; neighbours of so many queries that are looked for in
#: this sample to learn how far a search goes, and the share of them that it has to find. MB of codes that are searched together.
TREES, SAMPLE, LEAF, TRIALS, RECALL, PART_MB = 12, 16384, 24, 96, 0.94, 8
SEED = 7


@dataclass
class Forest:
    """Nodes of all trees: normal and offset of the split, its children (a negative child -1 - leaf), sample size of leaves."""

    roots: list[int]
    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaf_sizes: np.ndarray

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, shape (vectors, trees)."""
        out = np.empty((len(v), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(v), root)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                right = np.einsum("ij,ij->i", v[inner], self.normals[at]) > self.offsets[at]
                node[inner] = self.children[at, right.astype(int)]
            out[:, t] = -1 - node
        return out

    def in_order(self, q: np.ndarray):
        """Leaves of all trees in the order of one queue, the least distance to the splits on the wrong side first."""
        margins, children = (self.normals @ q - self.offsets).tolist(), self.children
        queue = [(0.0, root) for root in self.roots]
        while queue:
            far, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node]
                right = int(m > 0)
                heapq.heappush(queue, (max(far, abs(m)), int(children[node, 1 - right])))
                node = int(children[node, right])
            yield -1 - node

    def trees(self) -> np.ndarray:
        """The tree of each leaf; leaves are numbered tree by tree."""
        out, stack = np.empty(len(self.leaf_sizes), np.int64), list(enumerate(self.roots))
        while stack:
            tree, node = stack.pop()
            if node < 0:
                out[-1 - node] = tree
            else:
                stack += [(tree, int(child)) for child in self.children[node]]
        return out

    def search(self, q: np.ndarray, enough: int, entries: np.ndarray, tree: np.ndarray, least: int) -> list[int]:
        """The first leaves in this order that hold `enough` of the sample and, in one of the trees, `least` entries (all, if
        there are fewer); entries and tree are those of each leaf."""
        out, got, seen = [], 0, [0] * len(self.roots)
        for leaf in self.in_order(q):
            if got >= enough and max(seen) >= least:
                break
            out.append(leaf)
            got += int(self.leaf_sizes[leaf])
            seen[tree[leaf]] += int(entries[leaf])
        return out


def grow(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF) -> Forest:
    """Splits half-way between two far members of a node along the line between them; halves by the median where that fails."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    normals, offsets, children, sizes, roots = [], [], [], [], []

    def plant(members: np.ndarray) -> int:
        if len(members) <= leaf:
            sizes.append(max(1, len(members)))
            return -len(sizes)
        normal = rng.standard_normal(sample.shape[1])
        if len(members) > 1:
            a, b = sample[rng.choice(members, 2, replace=False)]
            normal = a - b if (a != b).any() else normal
        normal = normal / np.linalg.norm(normal)
        along = sample[members] @ normal
        cut = float(np.median(along))
        right = along > cut
        if not 0.1 < right.mean() < 0.9:  # many on the cut
            sizes.append(len(members))
            return -len(sizes)
        at = len(normals)
        normals.append(normal)
        offsets.append(cut)
        children.append([0, 0])
        children[at] = [plant(members[~right]), plant(members[right])]
        return at

    for _ in range(trees):
        roots.append(plant(np.arange(len(sample))))
    width = sample.shape[1]
    return Forest(roots, np.array(normals).reshape(-1, width), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(sizes, np.int64))


def effort(forest: Forest, sample: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """How much of the sample (summed over the trees) a search has to visit to find `recall` of the k nearest, by trial.

    The neighbours of `trials` members of the sample are looked for among all its members. Vectors in groups need little,
    vectors without any structure much; where a leaf holds more rows than members the neighbours are nearer and found earlier.
    """
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    asked = rng.choice(len(sample), min(trials, len(sample)), replace=False)
    leaves_of, norms, seen = forest.leaves(sample), (sample**2).sum(1), []
    for i in asked:
        d = norms - 2 * (sample @ sample[i])
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(d)) - 1)[:k]
        near = near[near != i]
        wanted: dict[int, list[int]] = {}
        for j in near.tolist():
            for leaf in set(leaves_of[j].tolist()):
                wanted.setdefault(leaf, []).append(j)
        missing, got = set(near.tolist()), 0
        for leaf in forest.in_order(sample[i]):
            got += int(forest.leaf_sizes[leaf])
            if found := missing.intersection(wanted.get(leaf, ())):
                seen += [got] * len(found)
                missing -= found
            if not missing:
                break
    return int(np.quantile(seen, recall, method="higher")) if seen else 1


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id and v of the rows that have an id and a vector without null or non-finite components that isn't zero, of the
    dimension that most of them have (the smaller one of equals)."""
    v = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & good)
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def _matrix(column, n: int) -> np.ndarray:
    return unlisted(column).astype(np.float64).reshape(n, -1)


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector in 8 bits a component, and the step of its code: a component is off by half a step at most."""
    step = np.maximum(np.abs(v).max(1), np.finfo(float).tiny) / 127
    return np.rint(v / step[:, None]).astype(np.int8), step


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0], ..., hi[0] - 1, lo[1], ..., hi[1] - 1, ..."""
    n = hi - lo
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _rank(k: int):
    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        got = [[], [], [], []]
        if entries.num_rows and queries.num_rows:
            leaf_of = entries["leaf"].to_numpy()
            order = np.argsort(leaf_of, kind="stable")
            leaf_of, entry, step = leaf_of[order], entries["entry"].to_numpy()[order], entries["step"].to_numpy()[order]
            codes, _ = flat(entries["code"])
            v = codes.view(np.int8).reshape(len(order), -1)[order].astype(np.float32) * step[:, None].astype(np.float32)
            norms = np.einsum("ij,ij->i", v, v)
            off = step / 2 * v.shape[1] ** 0.5
            asked = _matrix(queries["v"], queries.num_rows)
            for query, q, leaves in zip(queries["query"].to_pylist(), asked, queries["leaves"].to_pylist(), strict=True):
                at = ranges(np.searchsorted(leaf_of, leaves, "left"), np.searchsorted(leaf_of, leaves, "right"))
                if not len(at):
                    continue
                at = at[np.unique(entry[at], return_index=True)[1]]  # one vector is in several leaves
                scale = float(q @ q)
                square = norms[at] - 2 * (v[at] @ q.astype(np.float32)) + scale
                slack = 1e-5 * (norms[at] + scale)  # of 32-bit sums
                high = np.sqrt(np.maximum(square + slack, 0)) + off[at]
                low = np.maximum(np.sqrt(np.maximum(square - slack, 0)) - off[at], 0)
                near = low <= np.partition(high, k)[k] if len(at) > k + 1 else np.ones(len(at), bool)
                for x, y in zip(got, (np.full(near.sum(), query), entry[at][near], low[near], high[near]), strict=True):
                    x.append(y)
        kinds = (np.int64, np.int64, np.float64, np.float64)
        return pa.table({n: pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t)) for n, t, x in zip(("query", "entry", "low", "high"), kinds, got, strict=True)})

    return run


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_column: str = "vec_id", column: str = "embedding", trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`, among all other rows.

    score is the Euclidean distance in double precision; ties go to the smaller id. Rows that aren't usable() take no part.
    Repeated ids are repeated candidates of one id and count once. Fewer than k other rows: all that are found. The trees
    are laid out on at most `sample` vectors, those with the smallest hashes of their ids, and every row is put in a leaf of
    each tree; how far a search goes is learnt from this sample (see effort), but never ends before k + 1 entries. Rows with equal vectors are one entry with the
    k + 1 smallest of their ids, and equal queries are one search, so a vector that a third of all rows have makes neither a
    large leaf nor a repeated search. Only ids and codes of 8 bits a component are sent to the leaves; all candidates that
    can be among the nearest by the bounds of their codes are then ranked by the vectors themselves. Leaves are dealt to as many
    parts as the rows need, whatever spark.sql.shuffle.partitions is.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, column)
    first = F.dense_rank().over(W.partitionBy("v").orderBy("id"))
    entries = rows.withColumn("at", first).where(F.col("at") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    entries = written(entries.select(F.xxhash64("v").alias("entry"), "ids", "v"))
    of_sample = entries.select("v", F.xxhash64(F.col("ids")[0]).alias("h")).orderBy("h").limit(sample).select("v").toArrow()
    if not of_sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = _matrix(of_sample["v"], of_sample.num_rows)
    grown = grow(points, trees, leaf)
    enough = effort(grown, points, k, recall)
    forest = spark.sparkContext.broadcast(grown)
    width = math.ceil(entries.count() * trees * (points.shape[1] + 32) / (PART_MB * 1e6))
    element = vectors.schema[column].dataType.simpleString()

    def index(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch["v"], batch.num_rows)
            leaves = forest.value.leaves(v)
            at = np.repeat(np.arange(batch.num_rows), leaves.shape[1])
            leaves, (codes, step) = leaves.ravel(), coded(v)
            code = pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(leaves % width), pa.array(leaves), batch["entry"].take(pa.array(at)), code, pa.array(step[at])], ["part", "leaf", "entry", "code", "step"])

    def ask(batches):
        for batch in batches:
            parts, leaves, at = [], [], []
            for i, q in enumerate(_matrix(batch["v"], batch.num_rows) if batch.num_rows else []):
                found = np.sort(np.array(forest.value.search(q, enough, *sizes.value, k + 1), np.int64))
                to = found % width
                for b in np.unique(to):
                    parts.append(b)
                    leaves.append(found[to == b])
                    at.append(i)
            out = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), out["query"], out["v"]], ["part", "leaves", "query", "v"])

    queries = rows.where(F.col("id") % every == 0).distinct()
    searches = written(queries.groupBy("v").agg(F.min("id").alias("query")))
    indexed = written(entries.select("entry", "v").mapInArrow(index, "part long, leaf long, entry long, code binary, step double"))
    of_leaf = np.zeros(len(grown.leaf_sizes), np.int64)
    filled = indexed.groupBy("leaf").agg(F.count("*").alias("n")).toArrow()  # as many as the trees have leaves
    of_leaf[filled["leaf"].to_numpy()] = filled["n"].to_numpy()
    sizes = spark.sparkContext.broadcast((of_leaf, grown.trees()))
    indexed = indexed.repartition(width, "part")
    asked = searches.select("query", "v").mapInArrow(ask, f"part long, leaves array<long>, query long, v {element}").repartition(width, "part")
    found = indexed.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_rank(k), "query long, entry long, low double, high double")
    found = found.groupBy("query", "entry").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    at = F.row_number().over(W.partitionBy("query").orderBy("high"))
    bound = F.max(F.when(F.col("at") <= k + 1, F.col("high"))).over(W.partitionBy("query"))
    near = found.withColumn("at", at).withColumn("bound", bound).where(F.col("low") <= F.col("bound")).select("query", "entry")
    apart = F.zip_with(F.col("v").cast("array<double>"), F.col("w").cast("array<double>"), lambda a, b: (a - b) * (a - b))
    scored = near.join(entries, "entry").join(searches.select("query", F.col("v").alias("w")), "query")
    scored = scored.select("query", F.explode("ids").alias("near"), F.sqrt(F.aggregate(apart, F.lit(0.0), lambda a, x: a + x)).alias("score"))
    scored = scored.groupBy("query", "near").agg(F.min("score").alias("score"))
    best = W.partitionBy("query").orderBy("score", "near")
    nearby = scored.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    lists_of = nearby.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "near"))).alias("found"))
    each = queries.join(searches, "v").select(F.col("id").alias("query_id"), "query").join(lists_of, "query")
    others = F.slice(F.filter("found", lambda x: x["near"] != F.col("query_id")), 1, k)
    shown = each.select("query_id", F.posexplode(others).alias("pos", "hit"))
    return shown.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.near").alias("vec_id"), F.col("hit.score").alias("score"))


def op2_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
