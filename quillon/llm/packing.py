"""Best-fit packing: patterns of lengths, fitted to the histogram by non-negative least squares."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long"
#: Steps of the fit. The histogram has CAPACITY cells at most, so the fit's cost doesn't depend on the input.
FIT_STEPS = 400

_encoders: dict[tuple, object] = {}


def special_tokens(vocabulary_file: str) -> dict[str, int]:
    """The added tokens of a vocabulary of `tokenizers` and their ids: such strings are one token wherever they stand in a text."""
    with open(vocabulary_file, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def byte_level_encoder(ranks_file: str, pattern: str, special: dict[str, int] | None = None):
    """The ids of a text by the byte-level vocabulary in ranks_file and the special tokens, as an array of 32-bit integers."""
    special = special or {}
    key = ranks_file, pattern, tuple(sorted(special.items()))
    if key not in _encoders:
        import base64

        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    encoding = _encoders[key]
    return lambda text: np.frombuffer(encoding.encode_to_numpy(text, allowed_special=set(special), disallowed_special=()), np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: all of capacity but the first, which takes what is over."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, ranks_file: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, special: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part: the pieces of every row's whole text with end_id behind it."""

    def run(batches):
        from pyspark import TaskContext

        encode = byte_level_encoder(ranks_file, pattern, special)
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                rows += [(doc_id, i, s, n, zlib.crc32(ids[s : s + n]), part) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three of the lengths (0: none), longest first, that fill a sequence as far as the last one can."""
    lengths = np.sort(lengths)
    rows = [np.stack([lengths, 0 * lengths, 0 * lengths], 1)]
    a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
    two = (a >= b) & (a + b <= capacity)
    a, b = a[two], b[two]
    rows.append(np.stack([a, b, 0 * a], 1)[a + b == capacity])
    c = lengths[np.maximum(0, np.searchsorted(lengths, np.minimum(b, capacity - a - b), "right") - 1)]
    fits = (c <= b) & (a + b + c <= capacity)
    rows += [np.stack([a, b, c], 1)[fits], np.stack([a, b, 0 * a], 1)[~fits]]
    return np.unique(np.concatenate(rows), axis=0)


def fit_repeats(shapes: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """How often each pattern is used: min |A x - counts| over x >= 0 by projected gradients with momentum.

    A pattern's free place is a cost as well, so full sequences come first.
    """
    used = (shapes > 0).astype(float)
    free = (capacity - shapes.sum(1)) / capacity
    scale = counts.max()
    goal = counts / scale
    x = y = np.zeros(len(shapes))
    momentum = 1.0
    made = lambda x: np.bincount(shapes.ravel(), (x[:, None] * used).ravel(), len(counts))
    v = np.ones(len(shapes))  # the largest eigenvalue of A'A bounds the step
    for _ in range(12):
        v = (made(v)[shapes] * used).sum(1)
        size = np.linalg.norm(v)
        v /= size
    for _ in range(FIT_STEPS):
        slope = ((made(y) - goal)[shapes] * used).sum(1) + 0.05 * free
        after = np.maximum(0, y - slope / (1.05 * size))
        momentum, before = (1 + (1 + 4 * momentum**2) ** 0.5) / 2, momentum
        x, y = after, after + (before - 1) / momentum * (after - x)
    return x * scale


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; counts[n] pieces of length n are all placed.

    Fit, round down, and best fit for what is left, longest first, all on the histogram: the work has a bound that
    depends on capacity, not on the number of documents.
    """
    left = counts.astype(np.int64).copy()
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    lengths = np.flatnonzero(left)
    if len(lengths):
        shapes = patterns(lengths, capacity)
        repeats = np.floor(fit_repeats(shapes, left.astype(float), capacity) + 1e-9).astype(np.int64)
        full = shapes.sum(1)
        for i in sorted(np.flatnonzero(repeats), key=lambda i: (full[i], repeats[i]), reverse=True):
            shape = [int(n) for n in shapes[i] if n]
            if full[i] < capacity:  # the best fit does at least as well with these
                continue
            most = min(left[n] // shape.count(n) for n in shape)
            if k := int(min(repeats[i], most)):
                for n in shape:
                    left[n] -= k
                out.append((tuple(shape), k))
    return out + best_fit(left, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over lengths with counts: equal sequences are one entry with a number."""
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms: list[int] = []

    def put(room: int, shape: tuple[int, ...], k: int) -> None:
        if not by_room[room]:
            insort(rooms, room)
        by_room[room][shape] = by_room[room].get(shape, 0) + k

    for n in map(int, np.flatnonzero(counts)[::-1]):
        todo = int(counts[n])
        while todo:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                per = capacity // n
                if todo >= per:
                    put(capacity - per * n, (n,) * per, todo // per)
                if todo % per:
                    put(capacity - todo % per * n, (n,) * (todo % per), 1)
                break
            room = rooms[at]
            shape, k = next(iter(by_room[room].items()))
            fit = min(room // n, todo)
            took = min(k, todo // fit)
            del by_room[room][shape]
            if not by_room[room]:
                rooms.pop(at)
            if k > took:
                put(room, shape, k - took)
            put(room - fit * n, shape + (n,) * fit, took)
            todo -= took * fit
    return [(shape, k) for room in sorted(by_room) for shape, k in by_room[room].items()]


def slots(packed: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the rank-th piece of a length goes: sorted keys (length, first rank), first sequence, step and offset."""
    rows, taken, sequence = [], defaultdict(int), 0
    for shape, k in packed:
        offset = 0
        for n in shape:
            rows.append((n, taken[n], sequence, offset))
            taken[n] += k
            offset += n
        sequence += k
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows of pieces (length, part and more columns) with sequence_id and offset in place of part.

    A piece's rank within its length is the count in earlier parts plus its place in its own part, so that a length which
    a third of all pieces have is spread over all tasks. rows is read twice and has to stay the same.
    """
    order = ["doc_id", "piece", "start", "ids_crc32"]
    by_part = rows.groupBy("part", "length").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in rows.groupBy("length").count().collect():  # a row for each length: capacity of them at most
        counts[n] = k
    at = slots(plan(counts, capacity))
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy("part", "length").orderBy(*order)) - 1)
    ranked = ranked.join(by_part.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))
    keep = [c for c in rows.columns if c != "part"]

    def run(batches):
        keys = at["length"] << 50 | at["rank"]
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rank, length = t["rank"].to_numpy(), t["length"].to_numpy()
            i = np.searchsorted(keys, length << 50 | rank, "right") - 1
            t = t.select(keep).append_column("sequence_id", pa.array(at["sequence"][i] + rank - at["rank"][i])).append_column("offset", pa.array(at["offset"][i]))
            yield from t.to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return ranked.select(*keep, "rank").mapInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, ranks_file: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, special: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece of every document.

    A missing or empty text is one piece, its end id. Repeated rows are documents of their own; an empty table gives no
    row; other columns are ignored. Strings in special are one token; without it they are ordinary text. The texts are read once: their pieces are a table in the shared folder, from which the
    histogram, the ranks and the result come.
    """
    return pack(written(pieces(docs, ranks_file, pattern, capacity, end_id, special)), capacity)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return pack_documents(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN, special=special_tokens(p.path("byte_bpe_50k.json")))
