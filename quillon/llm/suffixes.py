"""Repeated passages by depth-limited radix passes over suffixes.

Suffixes are told apart through `depth` bytes only, most significant digit first, and a group that is equal through the
last digit is exactly one repeated window. Ordering a suffix for every byte would move many times the input, so the first
digit is laid at places that the bytes themselves choose: of the hashes of the GRAM-byte strings in a window the smallest,
leftmost of equals. Equal windows choose the same place, so nothing that is repeated is missed.

1. First digit: the string at the chosen place. A group of one is closed.
2. Second digit: all bytes of the windows that chose the place. In a group of one such context the first anchor stays
   and the windows of the others are repeats. (Copies end here.)
3. Only where a first digit has several contexts (at the edges of repeated passages): the whole window is the digit.

A first digit that has several contexts within one block needs no comparison to know that: the block sends two of its anchors
as witnesses for the other blocks, deals all of them by both digits, and those that are the first of theirs go to step 3, where
windows are dealt by their bytes. So a line or a passage that a third of all documents share is two entries a block in one place, and
its contexts are spread over all destinations.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RollingHash, destinations, flat, ids_or_null, in_blocks, in_order, loose, mix, n_blocks, run_edges, squeezed, table

#: Bytes of a repeated string, of the first digit, of a block of documents (MB), and of what is hashed at once; blocks whose
#: messages one destination takes.
DEPTH, GRAM, BLOCK_MB, AT_ONCE, BLOCKS_EACH = 100, 32, 4, 400_000, 4
#: Windows in a row that are sent together in step 3.
TOGETHER = 8
FIRST, SECOND = RollingHash(3), RollingHash(4)
U = np.uint64

#: Columns of a message or an answer: type, and the bytes of it that are sent. Beside the 8 bytes of h1 stand h2, the context of an
#: anchor, or w, the hashes of n windows.
COLUMNS = {"h1": (np.uint64, 8), "h2": (np.uint64, 6), "w": (np.uint64, 6), "doc_id": (np.int64, 8), "i": (np.int32, 4), "lo": (np.int32, 4), "n": (np.int32, 4), "rel": (np.int32, 4)}
MESSAGES = "dest long, block long, own boolean, deep boolean, " + ", ".join(f"{c} binary" for c in COLUMNS)
BACK = ("i", "lo", "n", "rel")
ANSWERS = "block long, ask boolean, i binary, lo binary, n binary, rel binary"


def segments(off: np.ndarray, depth: int):
    """Groups of (document, first byte, last byte) of about AT_ONCE bytes; a longer document comes in overlapping parts."""
    group, size = [], 0
    for i, n in enumerate(np.diff(off).tolist()):
        if n < depth:
            continue
        for s in range(0, n - depth + 1, AT_ONCE):
            e = min(n, s + AT_ONCE + depth - 1)
            if group and size + e - s > AT_ONCE:
                yield group
                group, size = [], 0
            group.append((i, s, e))
            size += e - s
    if group:
        yield group


def gathered(buf: np.ndarray, off: np.ndarray, group: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a group end to end; of each part its document, its place there, and its start here (one more: the end)."""
    part = np.concatenate([buf[off[i] + s : off[i] + e] for i, s, e in group])
    i, s, e = np.array(group, np.int64).reshape(-1, 3).T
    return part, i, s, np.concatenate([[0], np.cumsum(e - s)])


def leftmost_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each stretch of w values the place of the smallest, leftmost of equals."""
    n, low, seven = len(h) - w + 1, U(127), U(7)
    blocks = -(-len(h) // w)
    keys = np.full(blocks * w, ~U(0))
    keys[: len(h)] = h & ~low
    keys = (keys & ~low).reshape(blocks, w) | np.arange(w, dtype=np.uint64)  # a tie in the hash goes to the left
    from_left = np.minimum.accumulate(keys, axis=1).ravel()
    to_right = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(n)
    left, right = to_right[:n], from_left[w - 1 : w - 1 + n]
    first = (left >> seven) <= (right >> seven)
    return np.where(first, p // w * w + (left & low).astype(np.int64), (p + w - 1) // w * w + (right & low).astype(np.int64))


def anchors(part: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """h1, h2, part, first window, number of windows, place of the anchor in the first window: one of each run of windows
    that chose the same place."""
    gram = min(GRAM, depth)
    sums = FIRST.sums(part)
    at = np.arange(len(part) - gram + 1)
    h = mix(FIRST.spans(sums, at, at + gram))
    chosen = leftmost_minima(h, depth - gram + 1)
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    p = np.flatnonzero(np.arange(len(chosen)) + depth <= starts[1:][of[: len(chosen)]])
    a = chosen[p]
    first, last = run_edges((a[1:] == a[:-1]) & (p[1:] == p[:-1] + 1) & (of[p[1:]] == of[p[:-1]]))
    lo, n, a = p[first], last - first + 1, a[first]
    context = SECOND.spans(SECOND.sums(part), lo, lo + n + depth - 1)
    h2 = mix(context + mix((a - lo).astype(U) << U(32) | n.astype(U)))
    return h[a], h2, of[lo], lo - starts[:-1][of[lo]], n, a - lo


def first_of_equals(*keys: np.ndarray) -> np.ndarray:
    """Which rows are the first with their values, in the order given (the rows of one value have to be in order)."""
    order = np.lexsort([np.arange(len(keys[0])), *keys[::-1]])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out


def _packed(name: str, parts: list[np.ndarray]) -> pa.Array:
    kind, size = COLUMNS[name]
    return pa.array([squeezed(x.astype(kind), size) for x in parts], pa.binary())


def _unpacked(table: pa.Table, name: str) -> list[np.ndarray]:
    return [loose(b, *COLUMNS[name]) if b is not None else np.zeros(0, COLUMNS[name][0]) for b in table[name].to_pylist()]


def _messages(block: int, width: int, sent: list[tuple[bool, np.ndarray, dict[str, np.ndarray]]], own: dict[str, np.ndarray]) -> pa.Table:
    """What a block sends: of each (deep, key, found) a row for each destination with its part of found, dealt by key; and its
    own repeats, which come back to it as they are."""
    dest, deep, parts = [], [], {c: [] for c in COLUMNS}
    for is_deep, key, found in sent:
        of = (mix(key) % U(width)).astype(np.int64)
        order = np.lexsort([found["lo"], found["i"], of])
        to, first = np.unique(of[order], return_index=True)
        some = np.split(order, first[1:]) if len(to) else []
        dest += to.tolist()
        deep += [is_deep] * len(to)
        for c in COLUMNS:
            if c == "w" and c in found:  # n values for each
                ends, n = np.cumsum(found["n"]), found["n"]
                some_w = [found["w"][np.repeat(ends[p] - n[p], n[p]) + _counted(n[p])] for p in some]
                parts[c].append(_packed(c, some_w))
            else:
                parts[c].append(_packed(c, [found[c][p] for p in some]) if c in found else pa.nulls(len(to), pa.binary()))
    back = int(bool(len(own["i"])))
    for c in COLUMNS:
        parts[c].append(_packed(c, [own[c]]) if back and c in own else pa.nulls(back, pa.binary()))
    n = len(dest)
    return pa.table({
        "dest": pa.array(dest + [block % width] * back, pa.int64()), "block": pa.array([block] * (n + back), pa.int64()),
        "own": pa.array([False] * n + [True] * back, pa.bool_()), "deep": pa.array(deep + [False] * back, pa.bool_()),
    } | {c: pa.concat_arrays(x) for c, x in parts.items()})


def _counted(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _ids(block: pa.Table) -> np.ndarray:
    return block["doc_id"].to_numpy()


def _anchor_pass(depth: int, width: int):
    names = ("h1", "h2", "doc_id", "i", "lo", "n", "rel")

    def run(block: pa.Table) -> pa.Table:
        block = in_order(block)
        buf, off = flat(block["text"])
        ids, found = _ids(block), [(np.zeros(0, U), np.zeros(0, U), *[np.zeros(0, np.int64)] * 5)]
        for group in segments(off, depth):
            part, i, s, starts = gathered(buf, off, group)
            h1, h2, of, lo, n, rel = anchors(part, starts, depth)
            found.append((h1, h2, ids[i[of]], i[of], lo + s[of], n, rel))
        every = dict(zip(names, (np.concatenate(x) for x in zip(*found, strict=True)), strict=True))
        first = first_of_equals(every["h1"], every["h2"])  # copies within the block are one
        own = {c: every[c][~first] for c in BACK}
        every = {c: x[first] for c, x in every.items()}
        several, witness = _several_contexts(every["h1"], every["h2"])
        plain, deep = ({c: x[which] for c, x in every.items()} for which in (~several | witness, several))
        return _messages(block["block"][0].as_py(), width, [(False, plain["h1"], plain), (True, deep["h1"] ^ mix(deep["h2"]), deep)], own)

    return run


def _several_contexts(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors (of different contexts) share their first digit with another one, and of each such digit the first and
    the last context."""
    order = np.lexsort([h2, h1])
    first, last = run_edges(h1[order][1:] == h1[order][:-1]) if len(h1) else (np.zeros(0, int), np.zeros(0, int))
    several, witness = np.zeros(len(h1), bool), np.zeros(len(h1), bool)
    several[order] = np.repeat(last > first, last - first + 1)
    witness[order[np.concatenate([first, last])]] = True
    return several, witness & several


def _window_pass(depth: int, width: int):
    """Windows in groups of TOGETHER by their distance from the anchor. A group is dealt by what all its windows have in common,
    so equal windows meet, and those of different contexts don't."""
    step = min(TOGETHER, depth)
    names = ("h1", "doc_id", "i", "lo", "n", "rel", "w")

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.filter(answers["ask"])
        none = {c: np.zeros(0, np.int64) for c in BACK}
        if not block.num_rows or not answers.num_rows:
            return _messages(0, width, [], none)
        block = in_order(block)
        buf, off = flat(block["text"])
        i, lo, n, rel = (np.concatenate(_unpacked(answers, c)).astype(np.int64) for c in BACK)
        order = np.lexsort([lo, i])
        i, lo, n, rel = i[order], lo[order], n[order], rel[order]
        once = np.concatenate([[True], (i[1:] != i[:-1]) | (lo[1:] != lo[:-1])])  # a witness can be asked for twice
        i, lo, n, rel = i[once], lo[once], n[once], rel[once]
        ids, sizes, found = _ids(block), np.cumsum(n + depth), []
        for r in np.split(np.arange(len(i)), np.searchsorted(sizes, np.arange(AT_ONCE, sizes[-1], AT_ONCE))):
            if len(r):
                parts = list(zip(i[r].tolist(), lo[r].tolist(), (lo[r] + n[r] + depth - 1).tolist(), strict=True))
                part, _, _, starts = gathered(buf, off, parts)
                k, start, far = _counted(n[r]), np.repeat(starts[:-1], n[r]), np.repeat(rel[r], n[r])
                group = (far - k) // step
                first = np.flatnonzero((k == 0) | (group != np.concatenate([[-1], group[:-1]])))
                common = (start + far - group * step)[first]
                c = mix(FIRST.spans(FIRST.sums(part), common, common + depth - step + 1) + mix(group[first].astype(U)))
                w = mix(SECOND.spans(SECOND.sums(part), start + k, start + k + depth))
                of = np.repeat(i[r], n[r])[first]
                found.append((c, ids[of], of, (np.repeat(lo[r], n[r]) + k)[first], np.diff(np.append(first, len(k))), (far - k)[first], w))
        every = dict(zip(names, (np.concatenate(x) for x in zip(*found, strict=True)), strict=True))
        return _messages(block["block"][0].as_py(), width, [(False, every["h1"], every)], none)

    return run


def _compare(windows: bool):
    """Of the messages to one destination: what an earlier one repeats; in the first pass also which anchors to look at again,
    because their first digit has several contexts."""

    def run(got: pa.Table) -> pa.Table:
        own = got.filter(got["own"])
        out = [pa.table({"block": own["block"], "ask": pa.array([False] * own.num_rows, pa.bool_())} | {c: own[c] for c in BACK})]
        for deep in (False, True):
            some = got.filter(pc.and_(pc.invert(got["own"]), pc.equal(got["deep"], deep)))
            if some.num_rows:
                out += compared(some, deep)
        return pa.concat_tables(x.cast(out[0].schema) for x in out)

    def compared(got: pa.Table, deep: bool) -> list[pa.Table]:
        h1 = _unpacked(got, "h1")
        block = np.repeat(got["block"].to_numpy(), [len(x) for x in h1])
        h1 = np.concatenate(h1)
        doc_id, i, lo, n, rel = (np.concatenate(_unpacked(got, c)) for c in ("doc_id", "i", "lo", "n", "rel"))
        if windows:  # a row for each window; its distance from the anchor is part of the digit
            k = _counted(n)
            second = np.concatenate(_unpacked(got, "w")) | (np.repeat(rel, n) - k).astype(U) << U(48)
            block, h1, doc_id, i, lo = (np.repeat(x, n) for x in (block, h1, doc_id, i, lo))
            lo, n, rel = lo + k.astype(np.int32), np.ones(len(k), np.int32), np.zeros(len(k), np.int32)
        else:
            second = np.concatenate(_unpacked(got, "h2"))
        order = np.lexsort([lo, i, block, doc_id, second, h1])
        block, h1, second, i, lo, n, rel = (x[order] for x in (block, h1, second, i, lo, n, rel))
        later = np.zeros(len(h1), bool)
        later[1:] = (h1[1:] == h1[:-1]) & (second[1:] == second[:-1])
        out = [_answers(block[later], i[later], lo[later], n[later], rel[later], False)]
        if not windows:
            again = ~later  # of what is known to have several contexts all firsts
            if not deep:
                first, last = run_edges(h1[1:] == h1[:-1])
                again &= np.repeat(second[first] != second[last], last - first + 1)
            out.append(_answers(block[again], i[again], lo[again], n[again], rel[again], True))
        return out

    return run


def _answers(block: np.ndarray, i: np.ndarray, lo: np.ndarray, n: np.ndarray, rel: np.ndarray, ask: bool) -> pa.Table:
    """A row for each block; windows in a row of one document become one entry."""
    order = np.lexsort([lo, i, block])
    block, i, lo, n, rel = (x[order] for x in (block, i, lo, n, rel))
    if not ask and len(block):
        first, last = run_edges((block[1:] == block[:-1]) & (i[1:] == i[:-1]) & (lo[1:] == lo[:-1] + n[:-1]))
        block, i, n, lo = block[first], i[first], lo[last] + n[last] - lo[first], lo[first]
        rel = np.zeros(len(i), np.int32)
    to, first = np.unique(block, return_index=True)
    parts = np.split(np.arange(len(block)), first[1:]) if len(to) else []
    return pa.table({"block": pa.array(to, pa.int64()), "ask": pa.array([ask] * len(to), pa.bool_())} | {c: _packed(c, [v[p] for p in parts]) for c, v in (("i", i), ("lo", lo), ("n", n), ("rel", rel))})


def removed_bytes(off: np.ndarray, answers: pa.Table, depth: int) -> np.ndarray:
    """Of each byte of a block whether a repeated window covers it."""
    marks = np.zeros(int(off[-1]) + 1, np.int32)
    answers = answers.filter(pc.invert(answers["ask"]))
    if answers.num_rows:
        i, lo, n = (np.concatenate(_unpacked(answers, c)).astype(np.int64) for c in ("i", "lo", "n"))
        np.add.at(marks, off[i] + lo, 1)
        np.add.at(marks, off[i] + lo + n - 1 + depth, -1)
    return np.cumsum(marks[:-1]) > 0


def _cut(depth: int, columns: list[str], whole_characters: bool):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        kept_columns = [c for c in columns if c in block.column_names]
        if not block.num_rows:
            return pa.table({c: block[c] for c in kept_columns} | {"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), ("text" if whole_characters else "kept_sha256"): pa.array([], pa.string())})
        block = in_order(block)
        buf, off = flat(block["text"])
        gone = removed_bytes(off, answers, depth)
        if whole_characters:  # a character goes if all its bytes go
            head = (buf & 0xC0) != 0x80
            starts = np.flatnonzero(head)
            if len(starts):
                gone = np.repeat(np.minimum.reduceat(gone, starts), np.diff(np.append(starts, len(buf))))
        rows = []
        for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            g = gone[s:e]
            kept = buf[s:e][~g].tobytes() if g.any() else buf[s:e].tobytes()
            spans = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
            rows.append((e - s, int(g.sum()), spans, kept.decode() if whole_characters else hashlib.sha256(kept).hexdigest()))
        n, removed, spans, kept = zip(*rows, strict=True)
        out = {c: block[c] for c in kept_columns} | {"doc_id": ids_or_null(_ids(block)), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
        return pa.table(out | {("text" if whole_characters else "kept_sha256"): pa.array(kept, pa.string())})

    return run


def _repeats(docs: DataFrame, blocks: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """The documents in blocks, and the answers to the blocks: what is repeated in each."""
    width = destinations(docs.sparkSession, blocks, BLOCKS_EACH)
    found = docs.groupBy("block").applyInArrow(_anchor_pass(depth, width), MESSAGES)
    first = found.groupBy("dest").applyInArrow(_compare(False), ANSWERS)
    edges = docs.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_window_pass(depth, width), MESSAGES)
    second = edges.groupBy("dest").applyInArrow(_compare(True), ANSWERS)
    return first, second


def cut_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row a document.

    Each byte goes that a string of depth bytes covers which also starts earlier: in a smaller doc_id, or before in the same
    document. Rows without doc_id come first; rows of the same doc_id are documents in the order of their blocks, and within
    a block of their texts (all rows of up to BLOCK_MB are one block). A missing text is empty, a text of under depth bytes
    loses nothing, an empty table gives no row, other columns are ignored. Blocks of about BLOCK_MB, and the destinations of
    their messages, are as many as the input needs; a text that is longer than that is a block of its own size.
    """
    many = n_blocks(docs, BLOCK_MB)
    blocks = in_blocks(docs, many)
    first, second = _repeats(blocks, many, depth)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return blocks.groupBy("block").cogroup(first.unionByName(second).groupBy("block")).applyInArrow(_cut(depth, [], False), schema)


def without_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs with the columns it has; text is what cut_repeats leaves, but a character stays unless all its bytes go.

    A missing text becomes empty, a missing doc_id stays missing, and n_chars (if there is one) counts the characters left.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "doc_id")] or [F.lit(0).alias("none")]).alias("others")
    many = n_blocks(docs, BLOCK_MB)
    blocks = in_blocks(docs, many, kept)
    first, second = _repeats(blocks.select("doc_id", "text", "block"), many, depth)
    schema = T.StructType([blocks.schema["others"]])
    for name in ("doc_id", "n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("text", T.StringType())
    out = blocks.groupBy("block").cogroup(first.unionByName(second).groupBy("block")).applyInArrow(_cut(depth, ["others"], True), schema)
    of = {"text": F.col("text"), "doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "n_chars": F.length("text").cast("long")}
    return out.select(*[of[c].alias(c) if c in of else F.col(f"others.`{c}`").alias(c) for c in docs.columns])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))
