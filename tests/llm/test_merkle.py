"""The Merkle manifest against a plain recursion."""

import hashlib
import zlib

import pytest

from quillon.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree int, pos string, digest string, n int"


def rows():
    texts = [None, "", "a\nb", "no feed", "\n", "é€🙂\n", "x" * 5_000_000 + "\n"]
    out = [(i if i % 11 else None, texts[i % 7], "en" if i % 3 else None, "hot" if i < 300 else (None, "s1", "", "é", "z")[i % 5], i if i % 2 else None, 1, "p", "d", 3) for i in range(420)]
    return out + [out[4]] * 5 + [(7, "other\n", "en", "alone", 3, 1, "p", "d", 3)]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climbed(nodes, fan):
    """The top, and of each node its steps: place and run."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(steps, at, strict=True):
            path.append((i % fan, nodes[i // fan * fan : i // fan * fan + fan]))
        nodes = [sha(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        at = [i // fan for i in at]
    return nodes[0], steps


def plain(docs, fan=3):
    trees = {}
    for doc_id, text, lang, source, n_chars, *_ in docs:
        bad = text if doc_id is None or zlib.crc32(str(doc_id).encode()) % 2 or text is None else text.replace("\n", "")
        trees.setdefault(source, []).append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, bad)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        done[s] = climbed([x[1] for x in trees[s]], fan)
    root, over = climbed([done[s][0] for s in order], fan)
    out = []
    for s, upper in zip(order, over, strict=True):
        for (doc_id, x, bad), path in zip(trees[s], done[s][1], strict=True):
            folded = bad
            for place, run in path + upper:
                folded = sha(*run[:place], folded, *run[place + 1 :])
            siblings = [y for place, run in path + upper for k, y in enumerate(run) if k != place]
            out.append((doc_id, x, done[s][0], root, sha(*siblings), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("steps", "fan"), [(6, 3), (1, 3), (2, 3), (3, 2)])
def test_manifest(spark, steps, fan):
    df = spark.createDataFrame(rows(), DOCS).repartition(5)
    got = sorted(map(tuple, merkle.manifest(df, steps, fan).collect()), key=str)
    assert got == plain(rows(), fan)
    assert {r[-1] for r in got} == {True, False}


def test_few_rows(spark):
    for some in (rows()[:1], rows()[:2], rows()[-2:]):
        got = sorted(map(tuple, merkle.manifest(spark.createDataFrame(some, DOCS)).collect()), key=str)
        assert got == plain(some)
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_proofs_are_whole():
    leaves = [hashlib.sha256(bytes((i,))).digest() for i in range(23)]
    tree = merkle.sweep_up(leaves, merkle.levels(23))
    assert len(tree[-1]) == 1
    for x, proof in zip(leaves, merkle.sweep_down(tree, b""), strict=True):
        assert merkle.fold(x, merkle.read_proof(proof)) == tree[-1][0]
        assert merkle.fold(hashlib.sha256(x).digest(), merkle.read_proof(proof)) != tree[-1][0]
