"""Phrase collocations: exact counts of word pairs, triples and quadruples by direct-address tiles over frequency ranks.

Words that are frequent enough get ids by rank. A chunk of texts becomes a row of ids, and a pair of neighbours is the cell
(x, y) of a square of ranks. The tile of the lowest ranks, which holds much of all pairs, is counted in a dense array by bincount;
cells of other tiles are sorted coordinates with counts (COO). Frequent pairs are ranked anew and are the symbols of the next level, where a
pair of neighbouring pairs is a triple, and a pair of neighbouring triples a quadruple; what contains an infrequent part can't be
frequent itself, so each level keeps only what the one before has left.

A chunk sends the dense tile in strips of rows and the rows of other tiles by their hash, summed up in the chunk; who adds up a strip or
a share of the coordinates reads one chunk after the other. Where phrases are frequent goes back to each chunk the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import destinations, flat, loose, mix, placed, run_edges, squeezed, table, written

#: Least count of a phrase, words of the longest, rows of the report for each language, share (in hundredths) of a phrase's count from which
#: a longer one stands for it, and the score's factor.
LEAST, LONGEST, TOP, SHARE, SCALE = 30, 4, 2000, 80, 2_000_000
#: Ranks a side of the dense tile; MB of text of a chunk; chunks whose messages one destination takes; parts of a language in which
#: the best phrases are looked for first.
SIDE, CHUNK_MB, CHUNKS_EACH, PARTS = 1024, 16, 4, 32
U = np.uint64

#: Bytes that end a piece, and that part words.
STOPS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(STOPS)] = 2
_KIND[list(BLANKS)] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

CHUNKS = "chunk long, ids binary, words array<struct<lang:string,word:string,n:long>>"
SQUARE = "dest int, chunk long, ids binary, dense binary, keys binary, counts binary"
FOUND = "dest int, x long, y long, f long"
REPLIES = "chunk long, dest int, known binary, ids binary"


def words_of(texts) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts end to end, lower-cased (A to Z), and which of them start a piece."""
    buf, off = flat(texts)
    buf = _LOWER[buf]
    kind = _KIND[buf]
    inside = kind == 0
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(start)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(end) + 1 - first)])
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf[inside].tobytes())])
    at = np.searchsorted(np.flatnonzero((kind == 2) | edge[:-1]), first, "right")  # the piece of each word
    return words, np.concatenate([[True], at[1:] != at[:-1]]) if len(first) else np.zeros(0, bool)


def with_breaks(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """ids with -1 in front of those that start a piece."""
    at = np.flatnonzero(starts)
    return np.insert(ids, at, -1)


def _chunk(number: int, parts: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    """parts: language and texts. Words of different languages are different words."""
    ids, words = [], []
    for lang in dict.fromkeys(x for x, _ in parts):
        found, starts = words_of(pa.chunked_array([t for x, t in parts if x == lang]))
        if not len(found):
            continue
        coded = found.dictionary_encode()
        of = coded.indices.to_numpy().astype(np.int64)
        counts = np.bincount(of, minlength=len(coded.dictionary))
        ids.append(with_breaks(of + sum(len(w) for w in words), starts))
        words.append(pa.StructArray.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(counts)), coded.dictionary.cast(pa.large_string()).cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "word", "n"]))
    every = pa.concat_arrays(words) if words else pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], ["lang", "word", "n"])
    row = squeezed((np.concatenate(ids) if ids else np.zeros(0, np.int64)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([row], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)], ["chunk", "ids", "words"])


def _chunks(chunk_bytes: int):
    def run(batches):
        parts, size, n, part = [], 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch["part"][0].as_py() << 32
            sizes = np.cumsum(pc.binary_length(batch["text"]).to_numpy())
            cuts, at = [], 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chunk_bytes, "right")))
                cuts, at = [*cuts, (at, to)], to
            for a, b in cuts:
                its = batch.slice(a, b - a)
                langs = its["lang"].dictionary_encode()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    parts.append((lang, its["text"].filter(pc.equal(langs.indices, k))))
                size += int(sizes[b - 1] - (sizes[a - 1] if a else 0))
                if size >= chunk_bytes:
                    yield _chunk(part + n, parts)
                    parts, size, n = [], 0, n + 1
        if parts:
            yield _chunk(part + n, parts)

    return run


def square(ids: np.ndarray, width: int, side: int = SIDE) -> list[tuple]:
    """(destination, dense strip or None, keys, counts): the pairs of neighbours (neither -1) of a chunk, counted.

    The dense tile's rows are dealt in turn to the first destinations, the rows of other tiles by their hash: the cells of
    such a row stay together, so their differences are small.
    """
    x, y = ids[:-1], ids[1:]
    both = (x >= 0) & (y >= 0)
    x, y = x[both], y[both]
    low = (x < side) & (y < side)
    dense = np.bincount(x[low] * side + y[low], minlength=side * side).reshape(side, side) if low.any() else None
    keys = np.sort(x[~low] << 32 | y[~low])
    first, last = run_edges(keys[1:] == keys[:-1]) if len(keys) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys, counts = keys[first], last - first + 1
    to = (mix((keys >> 32).astype(U) * U(1 << 32) + (keys & 0xFFFFFFFF).astype(U) // U(side)) % U(width)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(width + 1))
    out = []
    for d in range(width):
        some = order[ends[d] : ends[d + 1]]
        strip = dense[d::width] if dense is not None and d < side else None
        if len(some) or strip is not None and strip.any():
            out.append((d, strip, keys[some], counts[some]))
    return out


def _sent(chunk: int, ids: np.ndarray, width: int, side: int) -> pa.Table:
    """The chunk's row of ids, and its messages."""
    out = [(None, chunk, squeezed(ids), None, None, None)]
    for d, strip, keys, counts in square(ids, width, side):
        out.append((d, chunk, None, None if strip is None else squeezed(strip.ravel().astype(np.int64), 5), squeezed(np.diff(keys, prepend=0)), squeezed(counts.astype(np.int64), 5)))
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({c.split()[0]: pa.array(v, k) for c, v, k in zip(SQUARE.split(", "), zip(*out, strict=True), kinds, strict=True)})


def _keys(b: bytes) -> np.ndarray:
    return np.cumsum(loose(b, np.int64))


def _add(keys: np.ndarray, counts: np.ndarray, more_keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted coordinates and counts of two lists as one."""
    k, c = np.concatenate([keys, more_keys]), np.concatenate([counts, more])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first, _ = run_edges(k[1:] == k[:-1]) if len(k) else (np.zeros(0, np.int64), None)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def _strip_cells(d: int, width: int, rows: int, side: int) -> np.ndarray:
    """The keys of a strip's cells."""
    x = np.arange(rows, dtype=np.int64) * width + d
    return (x[:, None] << 32 | np.arange(side, dtype=np.int64)[None, :]).ravel()


def _frequent(least: int, width: int, side: int):
    """The pairs of a destination that are frequent. Lists are added up pairwise, like with like, so that each count is moved a
    number of times that is the logarithm of the number of chunks."""

    def run(got: pa.Table) -> pa.Table:
        d, dense, stack = got["dest"][0].as_py(), None, []
        for strip, keys, counts in zip(got["dense"], got["keys"], got["counts"], strict=True):
            if strip.is_valid:
                its = loose(strip.as_py(), np.int64, 5)
                dense = its if dense is None else dense + its
            stack.append((_keys(keys.as_py()), loose(counts.as_py(), np.int64, 5)))
            while len(stack) > 1 and len(stack[-2][0]) <= 2 * len(stack[-1][0]):
                stack[-2:] = [_add(*stack[-2], *stack[-1])]
        while len(stack) > 1:
            stack[-2:] = [_add(*stack[-2], *stack[-1])]
        keys, f = stack[0]
        keys, f = keys[f >= least], f[f >= least]
        if dense is not None:
            some = np.flatnonzero(dense >= least)
            keys, f = np.concatenate([keys, _strip_cells(d, width, len(dense) // side, side)[some]]), np.concatenate([f, dense[some]])
        return pa.table({"dest": pa.array([d] * len(keys), pa.int32()), "x": keys >> 32, "y": keys & 0xFFFFFFFF, "f": f.astype(np.int64)})

    return run


def _asked(d: int, width: int, side: int, strip: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """The cells that a chunk has sent something of to a destination, in an order that both know."""
    if strip is None:
        return keys
    return np.concatenate([keys, _strip_cells(d, width, strip.size // side, side)[strip.ravel() > 0]])


def _reply(width: int, side: int):
    """To each chunk that sent something here, which of its pairs are frequent (bits, in the order of _asked), and their ids."""

    def run(got: pa.Table, frequent: pa.Table) -> pa.Table:
        out = []
        if got.num_rows and frequent.num_rows:
            keys = frequent["x"].to_numpy() << 32 | frequent["y"].to_numpy()
            order = np.argsort(keys)
            keys, ids = keys[order], frequent["id"].to_numpy()[order]
            d = got["dest"][0].as_py()
            for chunk, strip, its in zip(got["chunk"], got["dense"], got["keys"], strict=True):
                its = _asked(d, width, side, loose(strip.as_py(), np.int64, 5) if strip.is_valid else None, _keys(its.as_py()))
                at = np.minimum(np.searchsorted(keys, its), len(keys) - 1)
                known = keys[at] == its
                if known.any():
                    out.append((chunk.as_py(), d, squeezed(np.packbits(known)), squeezed(ids[at[known]])))
        return pa.table({c.split()[0]: pa.array([x[i] for x in out], k) for i, (c, k) in enumerate(zip(REPLIES.split(", "), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True))})

    return run


def _first_square(width: int, side: int):
    """A chunk's words become ids by rank; those that aren't frequent are breaks."""

    def run(chunk: pa.Table, known: pa.Table) -> pa.Table:
        ids = loose(chunk["ids"][0].as_py(), np.int32).astype(np.int64)
        to = np.full(int(ids.max(initial=-1)) + 2, -1, np.int64)  # the last one is that of -1
        if known.num_rows:
            to[known["place"].to_numpy()] = known["id"].to_numpy()
        return _sent(chunk["chunk"][0].as_py(), shortened(to[ids]), width, side)

    return run


def shortened(ids: np.ndarray) -> np.ndarray:
    """Without the second and further of breaks in a row."""
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] >= 0) | (ids[:-1] >= 0)
    return ids[keep]


def _next_square(width: int, side: int):
    """Pairs of neighbours become the symbols of the next level."""

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        ids = loose(chunk["ids"][0].as_py(), np.int64)
        out = np.zeros(0, np.int64)
        if replies.num_rows and len(ids) > 1:
            asked = {d: _asked(d, width, side, strip, keys) for d, strip, keys, _ in square(ids, width, side)}  # again what was sent
            keys = np.concatenate([asked[d][np.unpackbits(loose(b, np.uint8), count=len(asked[d])) > 0] for d, b in zip(replies["dest"].to_pylist(), replies["known"].to_pylist(), strict=True)])
            of = np.concatenate([loose(b, np.int64) for b in replies["ids"].to_pylist()])
            order = np.argsort(keys)
            keys, of = keys[order], of[order]
            pairs = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] << 32 | ids[1:], -1)
            at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            out = shortened(np.where(keys[at] == pairs, of[at], -1))
        return _sent(chunk["chunk"][0].as_py(), out, width, side)

    return run


def _ranked(found: DataFrame, *order: str) -> DataFrame:
    """found with id: the rank by f, largest first."""
    every = written(found.withColumn("all", F.lit(0)))
    return written(placed(every, ["all"], [F.desc("f"), *order]).withColumnRenamed("pos", "id").drop("all", "n"))


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk_mb: float = CHUNK_MB, side: int = SIDE) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """All words (lang, word, f) with their counts; the frequent ones with id; and for two words and more the frequent phrases as
    id, x, y, f, where x and y are the ids of the phrase without its last and its first word."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = written(rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_chunks(int(chunk_mb * 1e6)), CHUNKS))
    width = destinations(spark, chunks.count(), CHUNKS_EACH)
    named = chunks.select("chunk", F.posexplode("words").alias("place", "w")).select("chunk", "place", "w.*")
    words = written(named.groupBy("lang", "word").agg(F.sum("n").alias("f")))
    frequent = _ranked(words.where(F.col("f") >= least), "lang", "word")
    known = named.join(frequent.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("of_chunk"), "place", "id")
    sent = written(chunks.select("chunk", "ids").groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(_first_square(width, side), SQUARE))
    phrases = []
    for size in range(2, longest + 1):
        messages = sent.where("dest is not null").select("dest", "chunk", "dense", "keys", "counts")
        found = _ranked(messages.groupBy("dest").applyInArrow(_frequent(least, width, side), FOUND), "x", "y")
        phrases.append(found.select("id", "x", "y", "f"))
        if size < longest:
            replies = messages.select("dest", "chunk", "dense", "keys").groupBy("dest").cogroup(found.groupBy("dest")).applyInArrow(_reply(width, side), REPLIES)
            sent = written(sent.where("dest is null").select("chunk", "ids").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_next_square(width, side), SQUARE))
    return words, frequent, phrases


def _exact_score(a, both):
    """floor(SCALE * a / both) in decimals of 38 digits."""
    return F.call_function("div", a.cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(8,0)"), both.cast("decimal(20,0)")).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, chunk_mb: float = CHUNK_MB, side: int = SIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    Words are parted by blanks and tabs, pieces end at STOPS, and no phrase goes beyond a piece or a row. A phrase of 2 to `longest`
    words with a occurrences, `least` or more, is scored at the cut that gives it the lowest score, the first of equals: SCALE times a
    over the occurrences of its two parts, rounded down, in exact arithmetic. A phrase that is inside a longer one of at least SHARE
    hundredths of its own count is left out. Order is by score, a (both largest first) and the phrase's bytes. n are the words
    of the language. A missing language is `und`, a missing text has no words, a repeated row counts again, an empty table gives no
    row; other columns are ignored. A chunk has about chunk_mb of texts, more only if a single text is longer.
    """
    words, frequent, phrases = counted(docs, least, longest, chunk_mb, side)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    level = frequent.select("id", "lang", F.col("word").alias("phrase"), F.array(F.col("f")).alias("heads"), F.array(F.col("f")).alias("tails"), F.col("word").alias("last"))
    every: list[DataFrame] = []
    for found in phrases:
        # heads[k - 1] and tails[k - 1]: the counts of the first k words and of the last k words
        x = level.select(F.col("id").alias("x"), "lang", F.col("phrase").alias("start"), "heads")
        y = level.select(F.col("id").alias("y"), "last", "tails")
        joined = found.join(x, "x").join(y, "y")
        level = written(joined.select("id", "x", "y", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), F.array_append("heads", F.col("f")).alias("heads"), F.array_append("tails", F.col("f")).alias("tails"), "last", F.col("f").alias("a")))
        if every:  # only the next level is asked: what is in a still longer phrase is in one of that, which is as frequent at least
            inside = written(level.select("a", F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.max("a").alias("longer")))
            stands_for = F.lit(100).cast("decimal(3,0)") * F.col("longer").cast("decimal(19,0)") >= F.lit(SHARE).cast("decimal(3,0)") * F.col("a").cast("decimal(19,0)")
            every[-1] = every[-1].join(inside, "id", "left").where(~F.coalesce(stands_for, F.lit(False))).drop("longer")
        every.append(level)
    kept = every[0]
    for more in every[1:]:
        kept = kept.unionByName(more)
    cuts = F.transform(F.sequence(F.lit(1), F.size("heads") - 1), lambda k: F.struct(_exact_score(F.col("a"), F.element_at("heads", k).cast("decimal(19,0)") + F.element_at("tails", F.size("heads") - k)).alias("score"), k.alias("k"), F.element_at("heads", k).alias("l"), F.element_at("tails", F.size("heads") - k).alias("r")))
    scored = kept.select("lang", "phrase", "a", F.array_min(cuts).alias("cut")).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = scored.withColumn("in_part", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).where(F.col("in_part") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    joined = lambda i, size: " || ' ' || ".join(f"w[{k}]" for k in range(i, i + size))
    grams = "\nUNION ALL ".join(f"SELECT lang, {size} AS size, {joined(1, size)} AS phrase, {'[' + ', '.join(f'w[{k}]' for k in range(1, size + 1)) + ']'} AS ws FROM (SELECT lang, ws[i:i + {size - 1}] AS w FROM p, range(1, len(ws) - {size - 2}) t(i))" for size in range(1, LONGEST + 1))
    return f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM t),
g AS ({grams}),
n AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, size, phrase, ws, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT f.*, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (SELECT c.lang, c.phrase, c.size, c.f AS a, x.f AS l, y.f AS r, {SCALE} * c.f // (x.f + y.f) AS score, c.k FROM c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:], ' ')),
cut AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s),
inside AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM f, range(2, {LONGEST}) a(m), range(1, {LONGEST + 1}) b(i) WHERE m < size AND i + m - 1 <= size GROUP BY ALL),
kept AS (SELECT cut.* FROM cut LEFT JOIN inside i USING (lang, phrase) WHERE o = 1 AND coalesce(100 * i.longer < {SHARE} * a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""


ORACLE = _oracle()
