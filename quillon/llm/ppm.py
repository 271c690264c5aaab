"""LM scoring by prediction by partial matching: a byte-context model with escapes and symbol exclusion.

The model's counts are those of windows of ORDER + 1 symbols in the whole training part; contexts of lower orders are sums
of these. A block of documents sends its distinct windows with their counts, and its distinct words, to where all windows of
one context meet; what comes back are the windows' log probabilities and the words' counts, in the order in which they were sent.
Neither the model nor the vocabulary is in one place. Windows are dealt by the last two symbols of their context. Where such a
pair is frequent, its windows are dealt to several groups by the last four, and the counts of its contexts of two and three
symbols, which need all of them, come from a table that is summed before.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import destinations, flat, ids_or_null, in_blocks, in_order, loose, mix, n_blocks, squeezed, table, written
from .words import in_pieces, tokens, word_hashes

#: Symbols of the longest context; bits of a symbol; symbols: 0 before a text, byte + 1, END behind it. MB of a block; blocks whose
#: windows one group takes.
ORDER, BITS, END, BLOCK_MB, BLOCKS_EACH = 6, 9, 257, 5, 2
SYMBOLS = 257
END_WORD = np.uint64(0x0123456789ABCDEF)
U = np.uint64
MESSAGES = "dest long, block long, keys binary, counts binary"
ANSWERS = "block long, dest long, answer binary"
#: Cells of the pairs of symbols; bits behind the point of what is sent, and what stands for a number that is too large; the
#: block that the totals of the words go to.
PAIRS, POINT, FAR, TOTALS = 1 << 2 * BITS, 27, (1 << 32) - 1, -1
SUMS = "total boolean, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def lower_bytes(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def symbols(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ORDER zeros, the bytes + 1 and END of each text, end to end; where the first symbol of each stands."""
    n = np.diff(off)
    starts = np.concatenate([[0], np.cumsum(n + ORDER + 1)])
    out = np.zeros(int(starts[-1]), np.uint16)
    out[np.arange(len(buf)) + np.repeat(starts[:-1] + ORDER - off[:-1], n)] = buf.astype(np.uint16) + 1
    out[starts[1:] - 1] = END
    return out, starts[:-1] + ORDER


def windows(s: np.ndarray) -> np.ndarray:
    """The windows that end in a symbol of a text, oldest symbol highest."""
    n = len(s) - ORDER
    if n <= 0:
        return np.zeros(0, U)
    key = np.zeros(n, U)
    for k in range(ORDER + 1):
        key <<= U(BITS)
        key |= s[k : k + n]
    return key[s[ORDER:] > 0]


class Layout:
    """Which group a window goes to: of each pair of symbols at the end of a context the first group and how many it has.

    A pair with more than its share of the training symbols has groups of its own; the others share the rest by their hashes.
    """

    def __init__(self, pairs: np.ndarray, groups: int):
        share = max(1.0, pairs.sum() / groups)
        self.parts = np.maximum(1, np.ceil(pairs / share)).astype(np.int64)
        self.hot = pairs > share
        self.first = np.zeros(len(pairs), np.int64)
        own = self.parts[self.hot]
        self.first[self.hot] = np.cumsum(own) - own
        rest = max(1, math.ceil(pairs[~self.hot].sum() / share))
        self.first[~self.hot] = own.sum() + (mix(np.flatnonzero(~self.hot).astype(U)) % U(rest)).astype(np.int64)
        self.groups = int(own.sum()) + rest

    def of(self, keys: np.ndarray) -> np.ndarray:
        pair = (keys >> U(BITS) & U(PAIRS - 1)).astype(np.int64)
        return self.first[pair] + (mix(keys >> U(BITS) & U(PAIRS**2 - 1)) % self.parts[pair].astype(U)).astype(np.int64)


def _runs(keys: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (of 63 bits) in order and how many of each have the flag."""
    keys = keys << U(1) | flag
    keys.sort()
    flag, keys = (keys & U(1)).astype(np.uint8), keys >> U(1)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], (np.add.reduceat(flag, at, dtype=np.uint32) if len(at) else np.zeros(0, np.uint32))


class Places:
    """Where keys are among the distinct ones (all are): by a table of hashes, and by bisection where two share a slot."""

    def __init__(self, distinct: np.ndarray):
        self.distinct, self.shift = distinct, U(64 - max(4, len(distinct).bit_length() + 2))
        self.slots = np.zeros(1 << int(64 - self.shift), np.int32)
        self.slots[self._slot(distinct)] = np.arange(len(distinct))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15)) >> self.shift

    def values(self, keys: np.ndarray, of: np.ndarray, at_once: int = 1 << 19) -> np.ndarray:
        """of[place] of each key."""
        out = np.empty(len(keys), of.dtype)
        for s in range(0, len(keys), at_once):
            k = keys[s : s + at_once]
            at = self.slots[self._slot(k)]
            other = np.flatnonzero(self.distinct[at] != k)
            at[other] = np.searchsorted(self.distinct, k[other])
            out[s : s + at_once] = of[at]
        return out


class Block:
    """The windows and words of a block's texts."""

    def __init__(self, block: pa.Table):
        self.rows = in_order(block)
        buf, off = flat(self.rows["text"])
        buf = lower_bytes(buf)
        self.train = self.rows["train"].to_numpy(zero_copy_only=False).astype(bool)
        s, _ = symbols(buf, off)
        self.sizes = np.diff(off) + 1
        self.windows = windows(s)
        first, last, of = tokens(buf, off)
        self.words = np.concatenate([word_hashes(buf, first, last) >> U(1), np.full(len(self.sizes), END_WORD)])
        self.word_of = np.concatenate([of, np.arange(len(self.sizes))])

    def sent(self, layout: Layout, width: int):
        """Of the windows and the words: the distinct ones, how often they are trained on, and where each goes."""
        keys, counts = _runs(self.windows, np.repeat(self.train, self.sizes))
        yield keys, counts, layout.of(keys)
        keys, counts = _runs(self.words, self.train[self.word_of])
        yield keys, counts, layout.groups + (keys % U(width)).astype(np.int64)


def _send(shared, width: int):
    def run(block: pa.Table) -> pa.Table:
        b, out = Block(block), []
        at = b.rows["block"][0].as_py()
        for keys, counts, dest in b.sent(shared.value[1], width):
            order = np.argsort(dest, kind="stable")
            to, first = np.unique(dest[order], return_index=True)
            for d, part in zip(to.tolist(), np.split(order, first[1:]), strict=True):
                out.append((d, at, squeezed(np.diff(keys[part], prepend=U(0))), squeezed(counts[part])))
        dest, at, keys, counts = zip(*out, strict=True)
        return pa.table({"dest": pa.array(dest, pa.int64()), "block": pa.array(at, pa.int64()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


class Model:
    """Counts of the contexts of all orders, as far as windows of the given ones need them.

    Order j: seen (context and symbol) with counts, contexts with total n and distinct symbols q, and left: the total of
    the shorter context that is left when the symbols of this one are excluded. pairs: counts of (symbol before, symbol)
    in the whole training part, which orders 1 and 0 come from. short: keys of four symbols and their counts, which orders
    2 and 3 come from where the windows given aren't all of a pair.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, short: tuple[np.ndarray, np.ndarray] | None = None):
        every = np.flatnonzero(pairs).astype(U)
        single = np.bincount((every & U((1 << BITS) - 1)).astype(np.int64), pairs[every.astype(np.int64)], 1 << BITS).astype(np.int64)
        levels = [(np.flatnonzero(single).astype(U), single[single > 0]), (every, pairs[every.astype(np.int64)].astype(np.int64))]
        for j in range(2, ORDER + 1):
            of, n = short if short is not None and j < 4 else (keys, counts)
            cut = of & U((1 << BITS * (j + 1)) - 1)
            order = np.argsort(cut, kind="stable")
            cut = cut[order]
            at = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]])) if len(cut) else np.zeros(0, np.int64)
            levels.append((cut[at], np.add.reduceat(n[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)))
        self.seen, self.counts = [x for x, _ in levels], [c for _, c in levels]
        self.contexts, self.n, self.q, self.left = [], [], [], []
        for j, (seen, count) in enumerate(levels):
            context = seen >> U(BITS)
            at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(seen) else np.zeros(0, np.int64)
            add = (lambda x: np.add.reduceat(x, at)) if len(at) else (lambda x: np.zeros(0, np.int64))
            self.contexts.append(context[at])
            self.n.append(add(count))
            self.q.append(np.diff(np.append(at, len(seen))))
            if j == 0:
                self.left.append(np.zeros(len(at), np.int64))
            else:
                shorter = self.counts[j - 1][np.searchsorted(self.seen[j - 1], seen & U((1 << BITS * j) - 1))]
                total = self.n[j - 1][np.searchsorted(self.contexts[j - 1], context[at] & U((1 << BITS * (j - 1)) - 1))]
                self.left.append(total - add(shorter))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """The log probability of each window's last symbol after the others.

        From the longest context that was trained on: (2 count - 1) / 2n, or the escape q / 2n and on to the next shorter one
        without the symbols that the longer ones had; at the end all symbols that never came are alike.
        """
        out = np.zeros(len(keys))
        on = np.arange(len(keys))
        q_before, left = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for j in range(ORDER, -1, -1):
            seen = keys[on] & U((1 << BITS * (j + 1)) - 1)
            context = seen >> U(BITS)
            node = np.minimum(np.searchsorted(self.contexts[j], context), max(0, len(self.contexts[j]) - 1))
            here = self.contexts[j][node] == context if len(self.contexts[j]) else np.zeros(len(on), bool)
            if not here.any():
                continue
            at, node, seen = on[here], node[here], seen[here]
            fresh = left[at] < 0
            n = np.where(fresh, self.n[j][node], left[at])
            q = self.q[j][node] - q_before[at]
            place = np.minimum(np.searchsorted(self.seen[j], seen), len(self.seen[j]) - 1)
            hit = self.seen[j][place] == seen
            part = np.where(hit, 2 * self.counts[j][place] - 1, q).astype(float)
            some = hit | (q > 0)  # where all symbols are excluded, the escape is sure
            out[at[some]] += np.log10(part[some] / (2 * n)[some])
            q_before[at], left[at] = self.q[j][node], self.left[j][node]
            done = np.zeros(len(on), bool)
            done[here] = hit
            on = on[~done]
        out[on] -= np.log10(np.maximum(1, SYMBOLS - q_before[on]))
        return out


def _values(values: np.ndarray) -> bytes:
    """Log probabilities in 32 bits with POINT bits behind the point, in steps of 4e-9 (a 32-bit float of -2 has steps of
    2e-7); what is out of range follows as it is. Counts as they are."""
    if values.dtype != np.float64:
        return squeezed(values)
    scaled = np.rint(-values * (1 << POINT))
    far = scaled >= FAR
    table = squeezed(np.where(far, FAR, scaled).astype(np.uint32))
    return len(table).to_bytes(4, "little") + table + values[far].tobytes()


def _valued(b: bytes, kind: type) -> np.ndarray:
    if kind is not np.float64:
        return loose(b, kind)
    end = 4 + int.from_bytes(b[:4], "little")
    scaled = loose(b[4:end], np.uint32)
    out = scaled / -float(1 << POINT)
    out[scaled == FAR] = np.frombuffer(b[end:], np.float64)
    return out


def _answer(shared):
    def run(got: pa.Table, short: pa.Table) -> pa.Table:
        if not got.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "dest": pa.array([], pa.int64()), "answer": pa.array([], pa.binary())})
        pairs, layout = shared.value
        dest = got["dest"][0].as_py()
        keys = [np.cumsum(loose(b, U)) for b in got["keys"].to_pylist()]
        counts = np.concatenate([loose(b, np.uint32) for b in got["counts"].to_pylist()])
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        values = np.bincount(at, counts, len(every)).astype(np.int64)
        if dest < layout.groups:
            trained = values > 0
            four = (short["key"].to_numpy().astype(U), short["n"].to_numpy()) if short.num_rows else None
            values = Model(every[trained], values[trained], pairs, four).log10(every)
        parts = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
        to, answers = got["block"].to_pylist(), [_values(values[p]) for p in parts]
        if dest >= layout.groups:  # tokens and different ones, once
            to.append(TOTALS)
            answers.append(np.array([values.sum(), (values > 0).sum()], np.int64).tobytes())
        return pa.table({"block": pa.array(to, pa.int64()), "dest": pa.array([dest] * len(to), pa.int64()), "answer": pa.array(answers, pa.binary())})

    return run


def _score(shared, width: int):
    names = [f.split()[0] for f in SUMS.split(", ")]
    kinds = [pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def table_of(columns) -> pa.Table:
        return pa.table({k: x if isinstance(x, pa.Array) else pa.array(x, t) for k, x, t in zip(names, columns, kinds, strict=True)})

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            both = np.sum([np.frombuffer(a, np.int64) for a in answers["answer"].to_pylist()] or [[0, 0]], axis=0)
            return table_of([[True], [None], [None], both[:1], both[1:], [None], [None]])
        b = Block(block)
        by_dest = dict(zip(answers["dest"].to_pylist(), answers["answer"].to_pylist(), strict=True))
        values = []
        for (keys, _, dest), kind in zip(b.sent(shared.value[1], width), (np.float64, np.int64), strict=True):
            v = np.zeros(len(keys), kind)
            order = np.argsort(dest, kind="stable")
            to, first = np.unique(dest[order], return_index=True)
            for d, part in zip(to.tolist(), np.split(order, first[1:]), strict=True):
                v[part] = _valued(by_dest[d], kind)
            values.append((keys, v))
        texts = len(b.sizes)
        keys, v = values[0]
        score = np.add.reduceat(Places(keys).values(b.windows, v), np.cumsum(b.sizes) - b.sizes)
        keys, v = values[1]
        c = Places(keys).values(b.words, v)
        n = np.bincount(b.word_of, minlength=texts)
        known = np.bincount(b.word_of, c > 0, texts).astype(np.int64)
        return table_of([np.zeros(texts, bool), ids_or_null(b.rows["doc_id"].to_numpy()), b.rows["held_out"].combine_chunks(), n, known, np.bincount(b.word_of, np.log10(c + 1.0), texts), score])

    return run


def pair_counts(docs: DataFrame) -> np.ndarray:
    """Counts of (symbol before, symbol) in the texts of docs, and of texts at 0: PAIRS cells at most, whatever the input."""

    def run(batches):
        cells = np.zeros(PAIRS, np.int64)
        for batch in batches:
            for piece in in_pieces(batch):
                buf, off = flat(pc.fill_null(piece["text"], ""))
                s, _ = symbols(lower_bytes(buf), off)
                at = np.flatnonzero(s)
                if len(at):
                    cells += np.bincount(s[at - 1].astype(np.int64) << BITS | s[at], minlength=PAIRS)
                cells[0] += len(off) - 1  # what follows (0, 0) is the first symbol of a text
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], ["cell", "n"])

    out = np.zeros(PAIRS, np.int64)
    for cell, n in docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out


def short_counts(docs: DataFrame, shared) -> DataFrame:
    """dest, key, n: counts of four symbols in the texts of docs, for each group of a pair that has several groups."""

    def run(batches):
        layout = shared.value[1]
        for batch in batches:
            for piece in in_pieces(batch):
                buf, off = flat(pc.fill_null(piece["text"], ""))
                keys = windows(symbols(lower_bytes(buf), off)[0]) & U(PAIRS**2 - 1)
                pair = (keys >> U(BITS) & U(PAIRS - 1)).astype(np.int64)
                keys, n = np.unique(keys[layout.parts[pair] > 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["key", "n"])

    def dealt(batches):
        layout = shared.value[1]
        for batch in batches:
            pair = batch["key"].to_numpy() >> BITS & PAIRS - 1
            parts = layout.parts[pair]
            at = np.repeat(np.arange(batch.num_rows), parts)
            dest = np.repeat(layout.first[pair], parts) + np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            yield pa.RecordBatch.from_arrays([pa.array(dest), *[batch[c].take(pa.array(at)) for c in ("key", "n")]], ["dest", "key", "n"])

    summed = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return summed.mapInArrow(dealt, "dest long, key long, n long")


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text mod 7 is 2; null where it is missing."""
    return F.crc32(doc_id.cast("string")) % 7 == 2


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row a document.

    score is the log10 probability of the text, A-Z in lower case, and of its end, by the model of all texts that aren't
    held out (a row without doc_id is neither held out nor learnt from). Tokens are words and one end a text; base_score is
    the unigram model's with one added to each count. A missing text is empty: one token, its end. Repeated rows are documents
    of their own, equal texts have equal values, an empty table gives no row, other columns are ignored. Without anything
    to learn from all symbols are alike.
    """
    spark, blocks = docs.sparkSession, n_blocks(docs, BLOCK_MB)
    width = destinations(spark, blocks, BLOCKS_EACH)
    held = held_out(F.col("doc_id"))
    rows = in_blocks(docs, blocks, F.coalesce(held, F.lit(False)).alias("held_out"), F.coalesce(~held, F.lit(False)).alias("train"))
    trained_on = docs.where(~held)
    pairs = pair_counts(trained_on)
    layout = Layout(pairs, width)
    pairs = np.where(np.arange(PAIRS) == 0, 0, pairs)
    shared = spark.sparkContext.broadcast((pairs, layout))  # PAIRS entries
    sent = rows.groupBy("block").applyInArrow(_send(shared, width), MESSAGES)
    short = short_counts(trained_on, shared) if (layout.parts > 1).any() else spark.createDataFrame([], "dest long, key long, n long")
    answers = sent.groupBy("dest").cogroup(short.groupBy("dest")).applyInArrow(_answer(shared), ANSWERS)
    sums = written(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(shared, width), SUMS))
    trained, distinct = sums.where("total").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_known"), F.lit(0))).first()
    base = F.col("base") - F.col("n_tokens") * F.lit(math.log10(trained + distinct + 1))
    return sums.where("NOT total").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
