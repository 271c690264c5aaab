"""Near-duplicates by BagMinHash signatures of word shingles, bands, and the overlap of the multisets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix, table, written
from .words import U, in_pieces, shingles

#: Words of a shingle, least similarity, bands and values of a band. A pair at the least similarity meets in no band with
#: probability (1 - 0.8 ** 6) ** 36 = 0.00002.
SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 36, 6
#: Different texts of a bucket up to which all pairs of different classes are compared; in larger ones only those that share
#: a rare shingle can be alike. Draws in large buckets before that (each only if the one before has linked something), steps in
#: which numbers of shingles are told apart, cells of the histogram that says which shingles are rare, and texts of a shingle that
#: are joined at once.
ALL_PAIRS, DRAWS, STEP, CELLS, AT_ONCE = 32, 1, 0.02, 1 << 18, 1000
_STEP, _SLOT, _LEVEL = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03), U(0x8CB92BA72F3D8DD7)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def processes(of: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, seed, rate and share of each Poisson process. The levels of a weight are the unit steps up to it, in octaves
    [0, 1), [1, 2), [2, 4), [4, 8), ...: a process for each, of which the top one counts only in its share below the weight."""
    out, j = [(of, mix(h), np.ones(len(h)), np.ones(len(h)))], 1
    while len(of := of[weight > (low := 1 << (j - 1))]):
        h, weight = h[weight > low], weight[weight > low]
        out.append((of, mix(h ^ mix(np.full(len(h), j, U))), np.full(len(h), float(low)), np.minimum(1.0, (weight - low) / low)))
        j += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(of: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """BagMinHash: the first point of all processes of a text in each of `size` places; infinite without shingles.

    A process gives its points in ascending order, each in a random place and at a random level, and ends when its next
    point is past the largest value of its text's signature. A text's values are the same to the last bit whatever other
    texts are signed with it.
    """
    out = np.full((texts, size), np.inf)
    flat_out = out.ravel()
    of, seed, rate, share = processes(of, h, weight)
    x, step, largest = np.zeros(len(of)), 0, np.full(texts, np.inf)
    while len(of):
        many = int(np.clip(40_000 // len(of), 1, 64))
        key = seed[:, None] + (np.arange(step, step + many, dtype=np.uint64) * _STEP)[None, :]
        points = -np.log(_uniform(key)) / rate[:, None]
        points[:, 0] += x  # the sum goes strictly from point to point, so its last bits don't depend on how many come at once
        points = np.cumsum(points, axis=1)
        place = (mix(key ^ _SLOT) % U(size)).astype(np.int64)
        counts = points < largest[of][:, None]
        if (share < 1).any():
            counts &= (share >= 1)[:, None] | (_uniform(key ^ _LEVEL) < share[:, None])
        np.minimum.at(flat_out, (of[:, None] * size + place)[counts], points[counts])
        x, step = points[:, -1], step + many
        some = np.unique(of)
        largest[some] = out[some].max(1)
        on = x < largest[of]
        of, seed, rate, share, x = of[on], seed[on], rate[on], share[on], x[on]
    return out


def _signed(batches):
    for batch in batches:
        for piece in in_pieces(batch):
            of, h, weight = shingles(pc.fill_null(piece["text"], ""), SHINGLE)
            s = signatures(of, h, weight, piece.num_rows, BANDS * ROWS).view(np.uint64).reshape(-1, BANDS, ROWS)
            bands = np.zeros(s.shape[:2], U)
            for r in range(ROWS):
                bands = mix(bands * _STEP + s[:, :, r])
            n = np.bincount(of, weight, piece.num_rows).astype(np.int64)
            values = pa.array(bands.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["digest"], pa.array(n), pa.ListArray.from_arrays(pa.array(np.arange(piece.num_rows + 1) * BANDS, pa.int32()), values)], ["doc_id", "digest", "n", "bands"])


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n (shingles with repeats), bands of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.md5("text").alias("digest"), "text").mapInArrow(_signed, "doc_id long, digest string, n long, bands array<long>")


def _overlaps(batches):
    """a, b, similarity: the weighted Jaccard similarity of the shingles of text_a and text_b."""
    for batch in batches:
        for piece in in_pieces(batch, "text_b"):
            one, at = np.unique(np.array(piece["a"].to_pylist(), object), return_index=True) if piece.num_rows else ([], [])
            place = {k: i for i, k in enumerate(one)}
            left = np.array([place[k] for k in piece["a"].to_pylist()], np.int64)
            of_a, h_a, n_a = shingles(piece["text_a"].take(pa.array(at, pa.int64())), SHINGLE)
            of_b, h_b, n_b = shingles(piece["text_b"], SHINGLE)
            starts, ends = np.searchsorted(of_a, np.arange(len(one)), "left"), np.searchsorted(of_a, np.arange(len(one)), "right")
            lo, hi = np.searchsorted(of_b, np.arange(piece.num_rows), "left"), np.searchsorted(of_b, np.arange(piece.num_rows), "right")
            out = []
            for i, k in enumerate(left.tolist()):
                a, b = slice(starts[k], ends[k]), slice(lo[i], hi[i])
                x, y = h_a[a], h_b[b]
                total = int(n_a[a].sum() + n_b[b].sum())
                if not len(x) or not len(y):
                    out.append(0.0)
                    continue
                to = np.minimum(np.searchsorted(x, y), len(x) - 1)
                same = x[to] == y
                both = int(np.minimum(n_a[a][to[same]], n_b[b][same]).sum())
                out.append(both / (total - both))
            yield pa.RecordBatch.from_arrays([piece["a"], piece["b"], pa.array(out, pa.float64())], ["a", "b", "similarity"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b: digests) whose similarity is LEAST or more, by the texts (digest, text)."""
    a = texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_overlaps, "a string, b string, similarity double").where(F.col("similarity") >= LEAST)


def components(edges: DataFrame) -> DataFrame:
    """node, label of the nodes of edges (a, b): the smallest node that a chain of edges leads to.

    Each round takes the least label of the neighbours and then the label of that label, and is a table in the shared
    folder; rounds grow with the logarithm of a chain's length.
    """
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = both.groupBy("node").agg(F.least("node", F.min("other")).alias("label"))
    while True:
        labels = written(labels)
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jumped = lower.join(labels.select(F.col("node").alias("to"), F.col("label").alias("further")), "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("label"), "was")
        after = written(jumped)
        if after.where(F.col("label") != F.col("was")).isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after more links (a, b): their components are those of the classes that the links connect."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    named = written(links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("label_a", "a").alias("la"), F.coalesce("label_b", "b").alias("lb")))
    classes = components(named.select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a != b").distinct())
    new = named.select(F.col("a").alias("node")).unionByName(named.select(F.col("b").alias("node"))).distinct().join(labels, "node", "left_anti")
    every = labels.unionByName(new.withColumn("label", F.col("node")))
    to = classes.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return written(every.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def _alike(n: str, m: str):
    return F.least(n, m) >= F.lit(LEAST) * F.greatest(n, m)


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, n_shingles: one row a document (a row of docs).

    Two texts are linked if the weighted Jaccard similarity of their shingles, as multisets, is LEAST or more; classes are
    what links connect, and class_id is the smallest doc_id in one (null ids are never the smallest). Equal texts, empty ones
    too, are one class; a text without words links to no other text, a text of less than SHINGLE words is one shingle. A missing
    text is empty. An empty table gives no row; other columns are ignored.
    Equal texts count as one from the start. In each bucket of a band every text is compared with one of them; where a bucket
    still has several classes, all pairs of different classes in it are compared up to ALL_PAIRS texts, and beyond that every
    text with one that each bucket draws anew, up to DRAWS times. Where larger buckets have several classes after that, all their
    pairs of different classes are compared that can reach LEAST by their rarest shingles (see _by_rare_shingles), so that no
    pair that meets in a bucket is missed. Joins on labels and buckets are of tables in the shared folder, so that an adaptive
    plan can split a class or a bucket that a third of all texts are in; a side is only sent to all tasks where its size, known
    when it is read, is below spark.sql.autoBroadcastJoinThreshold.
    """
    named = _named(docs)
    named = written(named)
    classes = written(named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    return named.join(classes, "label").select("doc_id", "class_id", "class_size", F.col("n").alias("n_shingles"))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n, label (of the class, the same for all rows in it) of every row: what near_classes counts."""
    rows = written(signed(docs))
    texts = rows.groupBy("digest").agg(F.min_by(F.struct("doc_id", "n", "bands"), F.coalesce("doc_id", F.lit(2**63 - 1))).alias("t")).select("digest", "t.*")
    banded = texts.where("n > 0").select("digest", "n", F.posexplode("bands").alias("band", "h"))
    shared = written(banded.groupBy("band", "h").agg(F.count("*").alias("texts"), F.min(F.struct("digest", "n")).alias("head")).where("texts > 1"))
    met = written(banded.join(shared, ["band", "h"]))
    star = met.where(F.col("digest") != F.col("head.digest")).where(_alike("n", "head.n")).select(F.col("head.digest").alias("a"), F.col("digest").alias("b")).distinct()
    involved = met.select("digest").distinct().join(texts.select("digest", "doc_id"), "digest")
    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    same = rows_of["doc_id"].eqNullSafe(involved["doc_id"]) & (rows_of["digest"] == involved["digest"])
    their = written(rows_of.join(involved, same, "left_semi").select("digest", "text").dropDuplicates(["digest"]))
    compared = written(star)
    labels = components(written(verified(compared, their)))
    for draw in range(DRAWS):
        pairs = written(_across(met, labels, draw).join(compared, ["a", "b"], "left_anti"))
        more = written(verified(pairs, their))
        if more.isEmpty():
            break
        labels, compared = merged(labels, more), compared.unionByName(pairs)
    members = written(_in_large(met, labels))
    if not members.isEmpty():
        more = written(verified(_by_rare_shingles(members, their).join(compared, ["a", "b"], "left_anti"), their))
        if not more.isEmpty():
            labels = merged(labels, more)
    return rows.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("doc_id", "digest", "n", F.coalesce("label", "digest").alias("label"))


def _labelled(met: DataFrame, labels: DataFrame) -> DataFrame:
    return met.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))


def _across(met: DataFrame, labels: DataFrame, draw: int) -> DataFrame:
    """a, b (a before b): pairs of texts of different classes in one bucket, of like numbers of shingles; in buckets of more
    than ALL_PAIRS texts only those with the drawn one. The first draw takes all buckets, later ones only the large."""
    now = _labelled(met if draw == 0 else met.where(F.col("texts") > ALL_PAIRS), labels)
    drawn = F.min_by(F.struct("digest", "n", "label"), F.xxhash64("digest", "band", F.lit(draw))).alias("drawn")
    mixed = written(now.groupBy("band", "h").agg(F.min("label").alias("low"), F.max("label").alias("high"), drawn).where("low != high").select("band", "h", "drawn"))
    rows = written(now.join(mixed, ["band", "h"]))
    small = rows.where(F.col("texts") <= ALL_PAIRS)
    x = small.select("band", "h", F.col("digest").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"))
    y = small.select("band", "h", F.col("digest").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"))
    pairs = x.join(y, ["band", "h"]).where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & _alike("n_a", "n_b")).select("a", "b")
    large = rows.where((F.col("texts") > ALL_PAIRS) & (F.col("label") != F.col("drawn.label")) & _alike("n", "drawn.n"))
    return pairs.unionByName(large.select(F.least("digest", "drawn.digest").alias("a"), F.greatest("digest", "drawn.digest").alias("b"))).distinct()


def _in_large(met: DataFrame, labels: DataFrame) -> DataFrame:
    """digest, label, low: the texts of buckets of more than ALL_PAIRS texts and of several classes; low is a bound on the
    number of shingles of those in the same buckets that have fewer and can be alike. A bucket is summed up by the steps of
    STEP (of the logarithm of n) that its texts are in."""
    now = _labelled(met.where(F.col("texts") > ALL_PAIRS), labels).withColumn("step", F.floor(F.log("n") / STEP))
    mixed = written(now.groupBy("band", "h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.collect_set("step").alias("steps")).where("low != high").select("band", "h", "steps"))
    least = F.array_min(F.filter("steps", lambda x: x >= F.floor(F.log(LEAST * F.col("n")) / STEP - 1e-9)))
    rows = now.join(mixed, ["band", "h"]).select("digest", "label", "n", least.alias("least"))
    low = F.greatest(F.ceil(LEAST * F.col("n") - 1e-6), F.floor(F.exp(F.min("least") * STEP) + 1e-9))
    return rows.groupBy("digest", "label", "n").agg(low.cast("long").alias("low")).select("digest", "label", "low")


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of every occurrence of a shingle: the k-th of equal ones has a key of its own, so that the overlap of
    two texts' multisets is that of two sets of keys."""
    of, h, weight = shingles(texts, SHINGLE)
    k = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.repeat(of, weight), mix(np.repeat(h, weight) + k.astype(U) * _SLOT)


def _cells(batches):
    cells = np.zeros(CELLS, np.int64)
    for batch in batches:
        for piece in in_pieces(batch):
            cells += np.bincount((occurrences(piece["text"])[1] % U(CELLS)).astype(np.int64), minlength=CELLS)
    some = np.flatnonzero(cells)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], ["cell", "k"])


def _rarest(cells: np.ndarray):
    def run(batches):
        for batch in batches:
            for piece in in_pieces(batch):
                of, key = occurrences(piece["text"])
                order = np.lexsort([key, cells[(key % U(CELLS)).astype(np.int64)], of])
                of, key = of[order], key[order]
                n = np.bincount(of, minlength=piece.num_rows)
                rest = np.repeat(np.cumsum(n), n) - np.arange(len(of))  # keys from this one on
                low = np.maximum(LEAST * n, pc.fill_null(piece["low"], 0).to_numpy(zero_copy_only=False))
                first = (1 + LEAST) * rest >= LEAST * (n + low)[of] - 1e-6
                ends = np.concatenate([[0], np.cumsum(np.bincount(of[first], minlength=piece.num_rows))])
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[first].view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece["digest"], piece["label"], pa.array(n, pa.int64()), keys], ["digest", "label", "n", "keys"])

    return run


def _by_rare_shingles(members: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b (a before b): all pairs of members (digest, label, low) of different labels whose similarity can be LEAST or more.

    The keys of every text are put in one order, rare ones first (by a histogram of CELLS cells of all texts; the pairs found
    don't depend on it). The first key that two texts share leaves at most the rest of each to share, so pairs are taken only
    at keys where that rest is enough: for a text with n keys and others with `low` at least, if there is a bound. A key that many texts have is joined in parts of about AT_ONCE texts against all.
    """
    cells = np.zeros(CELLS, np.int64)
    counted = texts.select("text").mapInArrow(_cells, "cell long, k long").groupBy("cell").agg(F.sum("k").alias("k")).toArrow()
    cells[counted["cell"].to_numpy()] = counted["k"].to_numpy()  # CELLS of them at most
    if "low" not in members.columns:
        members = members.withColumn("low", F.lit(None).cast("long"))
    rarest = texts.join(members, "digest").mapInArrow(_rarest(cells), "digest string, label string, n long, keys array<long>")
    keys = written(rarest).select("digest", "label", "n", F.posexplode("keys").alias("at", "key"))
    keys = keys.select("digest", "label", "n", (F.col("n") - F.col("at")).alias("rest"), "key")
    shared = keys.groupBy("key").agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("parts"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key", "parts")
    both = written(keys.join(written(shared), "key"))
    name = lambda df, x: df.select("key", "part", *[F.col(c).alias(f"{c}_{x}") for c in ("digest", "label", "n", "rest")])
    x = name(both.where((1 + LEAST) * F.col("rest") >= 2 * LEAST * F.col("n") - 1e-6).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")), "x")
    y = name(both.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "y")
    larger = F.struct("n_x", "digest_x") < F.struct("n_y", "digest_y")
    enough = (1 + LEAST) * F.least("rest_x", "rest_y") >= LEAST * (F.col("n_x") + F.col("n_y")) - 1e-6
    met = x.join(y, ["key", "part"]).where(larger & (F.col("label_x") != F.col("label_y")) & enough)
    return met.select(F.least("digest_x", "digest_y").alias("a"), F.greatest("digest_x", "digest_y").alias("b")).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near_classes: that of its smallest doc_id, and of rows with the same doc_id that of
    the smallest text. A class that has no doc_id at all keeps its smallest text. Rows of one doc_id in different classes stay."""
    named = _named(docs.select("doc_id", "text"))
    named = written(named)
    least = written(named.groupBy("label").agg(F.min("doc_id").alias("least")))
    first = named.join(least, "label").where(F.col("doc_id").eqNullSafe(F.col("least")))
    first = first.select(F.col("doc_id").alias("kept id"), F.col("digest").alias("kept digest"), F.col("label").alias("kept class")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("`kept id`")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("`kept digest`"))
    place = F.row_number().over(W.partitionBy("`kept class`").orderBy("text"))
    return docs.join(first, same).withColumns({"place in its class": place}).where("`place in its class` = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
