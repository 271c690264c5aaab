"""Merkle manifest of a dataset: trees over the rows of each source, a proof for each row, and its verification.

Time-forward processing: nodes are labelled so that children come before parents, and a node's digest is a message to its
parent. Within a block of FAN ** STEPS neighbours a priority queue by label delivers the messages; between blocks a shuffle that
is ordered by the place of the block does, which is the same queue kept outside of memory. A sweep in the reverse order then delivers
proofs: a node passes what it got from above, with the siblings of each child in front, on to its children.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import placed, table, written

#: Children of a node, and levels of a block.
FAN, STEPS = 3, 6

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(parts) -> bytes:
    """SHA-256 of digests as hexadecimal text, end to end."""
    return hashlib.sha256("".join(x.hex() for x in parts).encode()).digest()


def levels(n: int, fan: int = FAN) -> int:
    """Levels above n nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // fan), out + 1
    return out


def _labels(n: int, steps: int, fan: int) -> list[int]:
    """First label of each level of a block over n nodes, the lowest first, and one more: the number of all labels."""
    out = [0]
    for _ in range(steps):
        out, n = [*out, out[-1] + n], -(-n // fan)
    return [*out, out[-1] + n]


def sweep_up(leaves: list[bytes], steps: int, fan: int = FAN) -> list[list[bytes]]:
    """The digests of all levels of a block. The queue holds (label of the parent, place below it, digest); a node takes what is
    addressed to it, which is all there once the labels before it have been dealt with."""
    first = _labels(len(leaves), steps, fan)
    queue: list[tuple[int, int, bytes]] = []
    out: list[list[bytes]] = [[] for _ in range(steps + 1)]
    for level in range(steps + 1):
        for i in range(first[level + 1] - first[level]):
            if level:
                got = []
                while queue and queue[0][0] == first[level] + i:
                    got.append(heapq.heappop(queue)[2])
                digest = hashed(got)
            else:
                digest = leaves[i]
            out[level].append(digest)
            if level < steps:
                heapq.heappush(queue, (first[level + 1] + i // fan, i % fan, digest))
    return out


def sweep_down(tree: list[list[bytes]], above: bytes, fan: int = FAN) -> list[bytes]:
    """The proof of each leaf of a block whose top has the proof `above`: of each level, from the lowest, the place in the run, the
    length of the run and the siblings' digests."""
    steps = len(tree) - 1
    first = _labels(len(tree[0]), steps, fan)
    queue: list[tuple[int, bytes]] = [(-first[steps], above)]
    out: list[bytes] = [b""] * len(tree[0])
    while queue:
        label, proof = heapq.heappop(queue)
        level = next(k for k in range(steps, -1, -1) if -label >= first[k])
        i = -label - first[level]
        if not level:
            out[i] = proof
            continue
        run = tree[level - 1][i * fan : (i + 1) * fan]
        for k in range(len(run)):
            heapq.heappush(queue, (-(first[level - 1] + i * fan + k), bytes((k, len(run))) + b"".join(run[:k] + run[k + 1 :]) + proof))
    return out


def read_proof(proof: bytes) -> list[tuple[int, list[bytes]]]:
    """Place and siblings of each level."""
    out, at = [], 0
    while at < len(proof):
        place, n = proof[at], proof[at + 1] - 1
        out.append((place, [proof[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(n)]))
        at += 2 + 32 * n
    return out


def fold(leaf: bytes, proof: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its proof give."""
    for place, siblings in proof:
        leaf = hashed([*siblings[:place], leaf, *siblings[place:]])
    return leaf


def _climb(steps: int, fan: int):
    """A row for each block: its top is the node at the block's place, among so many nodes."""

    def run(batches):
        for batch in batches:
            tops, n = [], batch["n"].to_pylist()
            nodes = batch["nodes"]
            for i in range(batch.num_rows):
                tops.append(sweep_up(nodes[i].values.field("digest").to_pylist(), min(steps, levels(n[i], fan)), fan)[-1][0])
            left = [-(-x // fan**steps) for x in n]
            yield pa.RecordBatch.from_arrays([batch["tree"], batch["block"], pa.array(left, pa.int64()), pa.array(tops, pa.binary())], ["tree", "pos", "n", "digest"])

    return run


def _descend(steps: int, fan: int):
    """A row for each node of a block, with its proof."""

    def run(batches):
        for batch in batches:
            n, above, nodes = batch["n"].to_pylist(), batch["above"].to_pylist(), batch["nodes"]
            for i in range(batch.num_rows):
                digests = nodes[i].values.field("digest").to_pylist()
                proofs = sweep_down(sweep_up(digests, min(steps, levels(n[i], fan)), fan), above[i], fan)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch["tree"][i], len(proofs)), nodes[i].values.field("pos"), pa.array(proofs, pa.binary())], ["tree", "pos", "proof"])

    return run


def _verify(steps: int, fan: int, root: bytes | None):
    def run(batches):
        for batch in batches:
            n, above, subroot, nodes = batch["n"].to_pylist(), batch["above"].to_pylist(), batch["subroot"].to_pylist(), batch["nodes"]
            for i in range(batch.num_rows):
                of = nodes[i].values
                digests = of.field("digest").to_pylist()
                proofs = [read_proof(x) for x in sweep_down(sweep_up(digests, min(steps, levels(n[i], fan)), fan), above[i], fan)]
                found = [fold(x if bad is None else bad, p) for x, bad, p in zip(digests, of.field("bad").to_pylist(), proofs, strict=True)]
                columns = {
                    "doc_id": of.field("doc_id"), "leaf": pa.array([x.hex() for x in digests]), "subroot": pa.array([subroot[i].hex()] * len(digests)), "root": pa.array([root.hex()] * len(digests)),
                    "proof_sha256": pa.array([hashed([s for _, siblings in p for s in siblings]).hex() for p in proofs]), "folded_root": pa.array([x.hex() for x in found]), "verified": pa.array([x == root for x in found]),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _blocks(nodes: DataFrame, steps: int, fan: int, *more: str) -> DataFrame:
    """tree, block, n, nodes (in order): one row a block of fan ** steps neighbours at most."""
    row = F.struct("pos", "digest", *more)
    return nodes.groupBy("tree", F.expr(f"pos div {fan**steps}").alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(row)).alias("nodes"))


def _up(nodes: DataFrame, steps: int, fan: int) -> list[DataFrame]:
    """nodes (tree, pos, n, digest), then what is left of them after each `steps` levels, until every tree has one node."""
    rounds = [nodes]
    while (nodes.agg(F.max("n")).first()[0] or 1) > 1:
        nodes = written(_blocks(nodes, steps, fan).mapInArrow(_climb(steps, fan), "tree string, pos long, n long, digest binary"))
        rounds.append(nodes)
    return rounds


def _with_proofs(nodes: DataFrame, proofs: DataFrame, steps: int, fan: int, *more: str) -> DataFrame:
    """The blocks of nodes, with the proofs of their tops (above)."""
    return _blocks(nodes, steps, fan, *more).join(proofs.withColumnsRenamed({"pos": "block", "proof": "above"}), ["tree", "block"])


def _down(rounds: list[DataFrame], proofs: DataFrame, steps: int, fan: int, to: int) -> DataFrame:
    """tree, pos, proof of the nodes of rounds[to], from the proofs of the last round's."""
    for nodes in rounds[to:-1][::-1]:
        proofs = written(_with_proofs(nodes, proofs, steps, fan).mapInArrow(_descend(steps, fan), "tree string, pos long, proof binary"))
    return proofs


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 of the fields in order: `-` for a null, else the number of UTF-8 bytes, a colon and the value."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[field(columns[c]) for c in LEAF_COLUMNS]), 256))


def manifest(docs: DataFrame, steps: int = STEPS, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row a row of docs.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Per source the leaves go up by doc_id (missing: first; equal ones
    by their leaves, so that equal rows stand together), `fan` neighbours to a node; the roots of the sources, in their order (missing
    source first), go up the same way. proof_sha256 is the digest of a leaf's siblings from the lowest level to the root.
    folded_root is what the proof gives for the row as it is after tampering: rows whose CRC-32 of doc_id is even lose their line
    feeds (rows without doc_id are left alone, and so is a row that has none). An empty text isn't a missing one. An empty table
    gives no row; other columns are ignored.

    Trees are built `steps` levels at a time, in blocks of fan ** steps neighbours, so a source of any size, a third of all rows too,
    is spread over tasks; texts are hashed where they are read, and only digests are shuffled. The driver gets the
    root and the largest number of nodes left.
    """
    own = {c: F.col(c) for c in LEAF_COLUMNS}
    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n"), leaf_digest(own | {"text": F.translate("text", "\n", "")}))
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # in the order of the sources, null first
    leaves = written(docs.select(key.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(own).alias("digest"), tampered.alias("bad")))
    nodes = written(placed(leaves, ["tree"], ["doc_id", "digest"]))
    rounds = _up(nodes.select("tree", "pos", "n", "digest"), steps, fan)
    subroots = rounds[-1].select(F.col("tree").alias("source_tree"), "digest").withColumn("tree", F.lit(""))
    tops = written(placed(subroots, ["tree"], ["source_tree"]))
    over = _up(tops.select("tree", "pos", "n", "digest"), steps, fan)
    root = over[-1].first()
    proofs = _down(over, over[-1].select("tree", "pos", F.lit(b"").alias("proof")), steps, fan, 0)
    of_source = written(tops.join(proofs, ["tree", "pos"]).select(F.col("source_tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof"))
    proofs = _down(rounds, of_source, steps, fan, 1)
    proofs = proofs.join(tops.select(F.col("source_tree").alias("tree"), F.col("digest").alias("subroot")), "tree")
    blocks = _with_proofs(nodes, proofs, steps, fan, "doc_id", "bad")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.mapInArrow(_verify(steps, fan, root["digest"] if root else None), schema)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _sql_leaf(text: str) -> str:
    fields = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in (*LEAF_COLUMNS[:-1], text)]
    return f"sha256({' || '.join(fields)})"


#: The CRC-32 of a decimal, bit by bit: 3988292384 is its polynomial.
_SQL_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
  lambda crc, byte: list_reduce([CAST(i AS BIGINT) FOR i IN range(8)], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)), CAST(4294967295 AS BIGINT)), 4294967295)"""

ORACLE = f"""
WITH RECURSIVE d AS (SELECT *, {_sql_leaf("text")} AS leaf, {_sql_leaf("replace(text, chr(10), '')")} AS bad, {_SQL_CRC} % 2 = 0 AS tampered FROM documents),
l AS (SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM l
  UNION ALL SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 3, n),
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over_them AS (SELECT 0 AS level, pos, n, subroot AS digest FROM s
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM over_them WHERE n > 1 GROUP BY level, pos // 3, n),
height AS (SELECT tree, max(level) AS h FROM up GROUP BY tree),
nodes AS (SELECT tree, level, pos, digest FROM up WHERE n > 1
  UNION ALL SELECT h.tree, h.h + o.level, o.pos, o.digest FROM over_them o, height h WHERE o.n > 1),
path AS (SELECT l.doc_id, l.tree, l.pos AS leaf_at, l.leaf, 0 AS level, l.pos, h.h, s.pos AS top, s.subroot, CASE WHEN l.tampered THEN l.bad ELSE l.leaf END AS folded, '' AS siblings
  FROM l JOIN height h ON h.tree = l.tree JOIN s ON s.tree = l.tree
  UNION ALL SELECT p.doc_id, p.tree, p.leaf_at, p.leaf, p.level + 1, spot // 3, p.h, p.top, p.subroot,
    sha256(string_agg(CASE WHEN n.pos = spot THEN p.folded ELSE n.digest END, '' ORDER BY n.pos)), p.siblings || coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos <> spot), '')
  FROM (SELECT *, CASE WHEN level = h THEN top ELSE pos END AS spot FROM path) p JOIN nodes n ON n.tree = p.tree AND n.level = p.level AND n.pos // 3 = spot // 3 GROUP BY p.doc_id, p.tree, p.leaf_at, p.leaf, p.level, spot, p.h, p.top, p.subroot, p.folded, p.siblings),
ends AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf_at ORDER BY level DESC) AS r FROM path)
SELECT doc_id, leaf, subroot, (SELECT digest FROM over_them WHERE n = 1) AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = (SELECT digest FROM over_them WHERE n = 1) AS verified
FROM ends WHERE r = 1
"""
