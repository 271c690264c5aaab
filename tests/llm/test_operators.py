"""The operators against plain versions, on small tables with every odd case."""

import collections
import hashlib
import math
import pathlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers as tok
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import chat, forest, languages, licenses, media, near_copies, packing, ppm, sentence_pieces, suffixes, webp, words

DOCS = "doc_id long, text string, lang string, block int, score string, label int"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua " * 2
ODD = [None, "", " ", "x", "a b", "\n\n", "é€🙂 ß", LONG, LONG, LONG + "end", "Q" * 700, "ab" * 400, "A  b\t c　d\x00", "<s> ▁ </s>", "word " * 600]


def odd_rows():
    return [(i if i % 5 else None, t, "en" if i % 3 else None, 1, "s", 2) for i, t in enumerate(ODD)] + [(7, LONG, "en", 1, "s", 2)] * 2


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


def by_null(r):
    return tuple((x is not None, x) for x in r)


def utf8(t):
    return (t or "").encode()


# 1


def test_media_round_trip(odd, none):
    got = sorted(rows(media.media_digests(odd)), key=by_null)
    want = []
    for i, t, *_ in odd_rows():
        b = utf8(t)
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted(want, key=by_null) == [r[:5] for r in got]
    assert len({r[6] for r in got}) == len({r[3] for r in got}), "equal texts, equal files"
    assert rows(media.media_digests(none)) == []


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.integers(0, 3))
def test_media_any_bytes(data, kind):
    data = [data, data * 4, bytes(b % 3 for b in data), data.replace(b"\0", b"\n") * 2][kind]
    assert media.read_back(media.store(data)).tobytes()[: len(data)] == data


@pytest.mark.parametrize("seed", range(12))
def test_webp_parts(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(1, 30, 2)
    pixels = (rng.integers(0, 256, (h, w, 4)) if seed % 2 else np.cumsum(rng.integers(0, 3, (h, w, 4)), 1)).astype(np.uint8)
    b = int(rng.integers(2, 5))
    shape = (-(-h >> b), -(-w >> b))
    modes = np.zeros((*shape, 4), np.uint8)
    modes[..., webp.GREEN] = rng.integers(0, 14, shape)
    elements = rng.integers(0, 256, (*shape, 4), dtype=np.uint8)
    groups = rng.integers(0, 300, shape)
    for options in ({}, {"predictor": (b, modes)}, {"cross": (b, elements)}, {"subtract_green": True}, {"cache_bits": 1 + seed % 11}, {"meta": (b, groups)}, {"predictor": (b, modes), "cross": (b, elements), "subtract_green": True, "cache_bits": 4, "meta": (b, groups % 3)}):
        assert (webp.decode(webp.encode(pixels, **options)) == pixels).all(), options
    few = pixels % (2 + 7 * seed % 60)
    few[..., :2] = 0
    few[..., 3] = 9
    assert (webp.decode(webp.encode(few, palette=True)) == few).all()


def test_webp_refuses_what_is_cut():
    whole = webp.encode_gray(np.arange(5760, dtype=np.int64).reshape(10, 576).astype(np.uint8))
    with pytest.raises(webp.BadImage):
        webp.decode(whole[: len(whole) // 2])
    with pytest.raises(webp.BadImage):
        webp.decode(b"RIFF")


def test_near_places():
    assert len(webp.NEAR) == 120 and webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and webp.NEAR[-1] == (8, 7)


# 2


def vectors(n=700, d=16):
    v = np.random.default_rng(1).standard_normal((n, d)).astype(np.float32)
    out = [(i, [float(x) for x in v[i]]) for i in range(n)]
    out += [(900 + i, out[3][1]) for i in range(40)] + [(2000, None), (2100, [0.0] * d), (2200, [float("nan")] * d), (2300, [1.0, None] * (d // 2)), (2400, [1.0]), (None, out[5][1]), (300, out[300][1])]
    return out


def test_forest_recall(spark):
    data = vectors()
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as bucket", "2 as score")
    got = collections.defaultdict(list)
    for q, rank, i, s in sorted(rows(forest.nearest(df))):
        got[q].append((rank, i, s))
    fine = {i: np.array(v) for i, v in data if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    assert set(got) == {i for i in fine if i % 100 == 0}
    found = wanted = 0
    for q, hits in got.items():
        truth = sorted((float(np.sqrt(((fine[i] - fine[q]) ** 2).sum())), i) for i in fine if i != q)[:10]
        assert [r for r, _, _ in hits] == list(range(1, 11)) and [(s, i) for _, i, s in hits] == sorted((s, i) for _, i, s in hits)
        assert all(abs(s - np.sqrt(((fine[i] - fine[q]) ** 2).sum())) < 1e-12 for _, i, s in hits)
        found += len({i for _, i, _ in hits} & {i for _, i in truth})
        wanted += 10
    assert found / wanted >= 0.9
    assert [i for _, i, _ in got[900]] == [3, *range(901, 910)], "ties go to the smaller id"


def test_forest_small(spark):
    kind = "vec_id long, embedding array<double>"
    assert rows(forest.nearest(spark.createDataFrame([], kind))) == []
    assert rows(forest.nearest(spark.createDataFrame([(0, [1.0, 0.0])], kind))) == []
    assert rows(forest.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], kind))) == [(0, 1, 1, math.sqrt(2))]


# 3


def cut_plainly(data, depth=100):
    seen, out = set(), []
    for i, t in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, utf8(r[1]))):
        b = utf8(t)
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if b[p : p + depth] in seen:
                gone[p : p + depth] = b"\1" * depth
            seen.add(b[p : p + depth])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("at_once", [300, 1_000_000])
def test_suffixes(odd, none, spark, monkeypatch, at_once):
    monkeypatch.setattr(suffixes, "AT_ONCE", at_once)
    monkeypatch.setattr(suffixes, "BLOCK_MB", 0.002)
    rng = np.random.default_rng(2)
    base = "".join(rng.choice(list("abc é\n"), 4000))
    more = [(50, base), (51, base[:700] + "-" + base[700:]), (52, base[90:230] + "zz" + base[1000:1180]), (53, base[::-1]), (54, "x" * 99), (55, "x" * 100), (56, "x" * 230), (52, base[95:240])]
    data = [r[:2] for r in odd_rows()] + more
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert sorted(rows(suffixes.cut_repeats(df)), key=by_null) == sorted(cut_plainly(data), key=by_null)
    assert rows(suffixes.cut_repeats(none)) == []
    kept = suffixes.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows()) and kept.where("text IS NULL").isEmpty()


# 4


def classes_plainly(data):
    def grams(t):
        w = (t or "").lower().split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()

    g, root = [grams(t) for _, t in data], list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = sum((g[i] & g[j]).values())
            if (data[i][1] or "") == (data[j][1] or "") or both and both / sum((g[i] | g[j]).values()) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(data)), key=by_null)


def test_near_copies(spark, odd, none, sf_dir):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    data = [r[:2] for r in odd_rows() if "　" not in (r[1] or "")]
    for f in range(12):
        text = list(rng.choice(words, 120))
        for c in range(int(rng.integers(1, 45))):
            copy = list(text)
            for p in rng.integers(0, 120, int(rng.integers(0, 4))):
                copy[p] = "other"
            data.append((100 + 50 * f + c, " ".join(copy)))
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as digest")
    got = near_copies.near_classes(df)
    assert sorted(((r[0], r[1]) for r in rows(got)), key=by_null) == classes_plainly(data)
    assert rows(near_copies.near_classes(none)) == []
    one = near_copies.one_of_each(odd)
    assert one.columns == odd.columns and sum(r["text"] == LONG for r in one.collect()) <= 1


def test_near_copies_in_large_buckets(spark):
    """Texts of 256 shingles that share large buckets through their template. Five places changed in each leave two of them
    at most 0.79 alike (four places in common); the two of each template with two changes are 236 / 276 alike to one
    another, but to no other one, and share only the template's shingles."""
    rng, data, want = np.random.default_rng(7), [], []
    for f in range(3):
        places = [*{tuple(sorted(rng.choice(range(30, 247, 6), 5, replace=False))) for _ in range(500)}, (6, 12), (18, 24)]
        for i, changed in enumerate(places):
            text = [f"w{f}-{p}" for p in range(260)]
            for p in changed:
                text[p] = f"x{i}-{p}"
            data.append((1000 * f + i, " ".join(text)))
            want.append((1000 * f + i, 1000 * f + min(i, len(places) - 2)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert sorted((r[0], r[1]) for r in rows(near_copies.near_classes(df))) == want


@pytest.mark.parametrize("at_once", [1000, 7])
def test_rare_shingles_miss_no_pair(spark, monkeypatch, at_once):
    monkeypatch.setattr(near_copies, "AT_ONCE", at_once)
    rng = np.random.default_rng(8)
    texts = []
    for i in range(90):
        text = [f"w{i}" for i in range(60)]
        for p in rng.choice(60, int(rng.integers(1, 4)), replace=False):
            text[p] = str(rng.choice(["x", "y", f"z{i}"]))
        texts.append(" ".join(text[int(rng.integers(0, 6)) :]) + " again and" * int(rng.integers(1, 9)))
    texts = sorted(set(texts))
    df = spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)], "digest string, text string")
    members = df.select("digest", F.col("digest").alias("label"))
    got = {tuple(r)[:2] for r in near_copies.verified(near_copies._by_rare_shingles(members, df), df).collect()}
    grams = [collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    want = {(f"{i:03}", f"{j:03}") for j in range(len(texts)) for i in range(j) if sum((grams[i] & grams[j]).values()) >= 0.8 * sum((grams[i] | grams[j]).values())}
    assert got == want and want


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(4)
    h, w = np.concatenate([np.arange(300), np.arange(60, 360)]).astype(np.uint64), rng.integers(1, 12, 600)
    a, b = dict(zip(h[:300].tolist(), w[:300].tolist(), strict=True)), dict(zip(h[300:].tolist(), w[300:].tolist(), strict=True))
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    s = near_copies.signatures(np.repeat([0, 1], 300), h, w, 3, 8000)
    assert abs((s[0] == s[1]).mean() - true) < 0.025 and np.isinf(s[2]).all()


@pytest.mark.parametrize("n", [20, 50, 300])
def test_signatures_do_not_depend_on_other_texts(n):
    rng = np.random.default_rng(n)
    texts = 4000 // n
    h, w = rng.integers(0, 2**63, n * texts).astype(np.uint64), rng.integers(1, 4, n * texts)
    together = near_copies.signatures(np.repeat(np.arange(texts), n), h, w, texts, 216)
    for i in range(0, texts, 7):
        of = slice(i * n, i * n + n)
        alone = near_copies.signatures(np.zeros(n, np.int64), h[of], w[of], 1, 216)
        assert (alone[0].view(np.uint64) == together[i].view(np.uint64)).all()


# 5


def test_languages(spark, odd, none):
    train = {"en": "the house and the garden with of this", "de": "das haus und der garten mit dem nicht", "fr": "la maison et le jardin avec une est"}
    rng = np.random.default_rng(5)
    data = [(i, " ".join(rng.choice(t.split(), 30)), lang) for i in range(300) for lang, t in [list(train.items())[i % 3]]]
    df = spark.createDataFrame([*data, (1000, None, "en"), (1001, "12 !", "en"), (None, "das haus", None)], "doc_id long, text string, lang string")
    got = {r[0]: r[1:] for r in rows(languages.identify(df))}
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i][0] == (i in set(held)) for i, _, _ in data)
    assert np.mean([got[i][1] == lang for i, _, lang in data if i in set(held)]) > 0.97
    assert got[1000][1:] == got[1001][1:] == ("und", 0.0) and got[None][0] is False and got[None][1] == "de"
    assert all(0 <= s <= 1 for *_, s in got.values())
    assert rows(languages.identify(none)) == [] and languages.identify(odd).count() == len(odd_rows())
    kept = languages.keep_known(odd)
    assert kept.columns == odd.columns and kept.where("text IS NULL OR text = ''").isEmpty()


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert rows(languages.identify(df))[0][2:] == ("und", 0.0)


def test_temperature():
    z = np.array([[4.0, 0.0]] * 10)
    t = languages.fit_temperature(z, np.array([0] * 7 + [1] * 3))
    assert abs(languages.softmax(z / t)[0, 0] - 0.7) < 0.01


# 6


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.load(tok.path("piece_bpe_32k.model"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tabeé🙂<>s　\x00"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_chunks_are_exact(pieces, texts):
    table = sentence_pieces.ChunkTable(pieces)
    for t, (ids, decoded) in zip(texts, table.encode_decode(texts), strict=True):
        want = pieces.encode(t, add_bos=True, add_eos=True)
        assert ids == np.array(want, "<u4").tobytes() and decoded == pieces.decode(want)


def test_sentence_pieces(odd, none, pieces, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "HELD_CHUNKS", 5)
    want = []
    for i, t, *_ in odd_rows():
        ids = pieces.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(pieces.decode(ids).encode()).hexdigest()))
    model = tok.path("piece_bpe_32k.model")
    assert sorted(rows(sentence_pieces.encode_and_decode(odd, model)), key=by_null) == sorted(want, key=by_null)
    assert rows(sentence_pieces.encode_and_decode(none, model)) == []


# 7


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", "x"), (5, None, None, None), (None, 0, "user", "q <|im_end|>"), (6, 1, "u", "t"), (6, 1, "u", "t"), (7, 1, "u", "t")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "2 as last")
    got = {r["conv_id"]: r for r in chat.collapse_and_render(df).collect()}
    assert set(got) == {2, 4, 5, None, 6} and got[2]["n_copies"] == 2 and got[2]["n_turns"] == 3
    assert got[2]["rendered"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert got[None]["rendered"] == "<|im_start|>user\nq <| im_end|><|im_end|>\n" and got[5]["rendered"] == "<|im_start|>\n<|im_end|>\n"
    assert rows(chat.collapse_and_render(df.limit(0))) == []


# 8


def test_packing(odd, none):
    args = tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN
    got = packing.pack_documents(odd, *args).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = []
    for i, text, *_ in odd_rows():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    assert sorted((tuple(r)[:5] for r in got), key=by_null) == sorted(want, key=by_null)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    assert rows(packing.pack_documents(none, *args)) == []


def test_packing_special_tokens(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>" * 2, "x<|endoftext|>y  <|endoftext|>\n", "<|<|endoftext|>|>", "<|endoftext|", "no " * 2000 + "<|endoftext|>", ""]
    want = []
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (packing.op8_pack(spark, str(tmp_path)), corpus_pipeline.pack(spark, df, "")):
        assert sorted(tuple(r)[:5] for r in got.collect()) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_places_all(lengths):
    counts = np.bincount(lengths, minlength=65)
    placed, used = np.zeros(65, int), 0
    for shape, k in packing.plan(counts, 64):
        assert sum(shape) <= 64 and k > 0
        used += k
        for n in shape:
            placed[n] += k
    assert (placed == counts).all()
    assert used <= max(1, math.ceil(1.35 * sum(lengths) / 64) + 1)


# 9


def score_plainly(data):
    def low(t):
        return bytes(b + 32 if 65 <= b <= 90 else b for b in utf8(t))

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    def split(b):
        return [*re.findall(rb"[^\x20\x09-\x0D]+", b), "end"]

    train = [low(t) for i, t in data if i is not None and not held(i)]
    count = collections.Counter(w for b in train for w in split(b))
    n, v, k = sum(count.values()), len(count), ppm.ORDER
    seen = collections.defaultdict(collections.Counter)
    for b in train:
        s = [0] * k + [x + 1 for x in b] + [257]
        for p in range(k, len(s)):
            for j in range(k + 1):
                seen[tuple(s[p - j : p])][s[p]] += 1
    out = []
    for i, t in data:
        b, total = low(t), 0.0
        s = [0] * k + [x + 1 for x in b] + [257]
        for p in range(k, len(s)):
            gone: set = set()
            for j in range(k, -1, -1):
                every = seen.get(tuple(s[p - j : p]), {})
                live = {x: c for x, c in every.items() if x not in gone}
                if s[p] in live:
                    total += math.log10((2 * live[s[p]] - 1) / (2 * sum(live.values())))
                    break
                if live:
                    total += math.log10(len(live) / (2 * sum(live.values())))
                gone |= set(every)
            else:
                total -= math.log10(max(1, 257 - len(gone)))
        words = split(b)
        out.append((i, held(i), len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), total))
    return out


def test_ppm(spark, odd, none, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_MB", 0.001)
    rng = np.random.default_rng(6)
    data = [r[:2] for r in odd_rows()] + [(100 + i, " ".join(rng.choice("Tho er the Ing and ou rea\n nt".split(" "), 40))) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got, want = sorted(rows(ppm.score(df)), key=by_null), sorted(score_plainly(data), key=by_null)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=2e-6)
    assert rows(ppm.score(none)) == [] and ppm.score(odd).count() == len(odd_rows())


def test_ppm_without_training(spark):
    df = spark.createDataFrame([(None, "ab")], "doc_id long, text string")
    r = rows(ppm.score(df))[0]
    assert r[:5] == (None, False, 2, 0, 0) and math.isclose(r[6], -3 * math.log10(257), rel_tol=1e-6) and r[5] == 0.0


# 10


def test_licenses(spark, odd, none):
    mit = licenses.LICENSES["MIT"]
    texts = [mit, mit.upper().replace(",", " ;"), "Copyright (c) 2020 A B\n" + mit.replace("sublicense", "sub-license"), mit + " x", "foo\nReleased under the MIT Licence\nLicensed under CC BY-NC 4.0.", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'a' as license", "'b' as digest")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [got[i]["license"] for i in range(7)] == ["MIT"] * 3 + [None] * 4
    assert got[4]["n_notices"] == 2 and got[4]["notices"] == "CC-BY-NC-4.0-notice,MIT-notice" and got[5]["digest"] == got[6]["digest"]
    assert rows(licenses.scan(none)) == [] and licenses.scan(odd).count() == len(odd_rows())


def test_licenses_of_any_list(spark):
    """Texts without any of the usual words, known by their lines, by themselves and by digests, with repeated rows."""
    mine = {"Poem": "Roses, by any\nother NAME", "Line": "do as thou wilt"}
    docs = [(1, "x\nDo as  thou wilt!\nDo as thou wilt\ny"), (1, "x\nDo as  thou wilt!\nDo as thou wilt\ny"), (2, "roses by any other name."), (None, None), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as digest", "'z' as license", "3 as copies")
    got = sorted(rows(licenses.scan(df, mine).drop("digest")), key=by_null)
    assert got == sorted([(1, None, 2, "Line")] * 2 + [(2, "Poem", 1, "Poem")] + [(None, None, 0, "")] * 2, key=by_null)
    digests = {r["digest"]: r["license"] for r in licenses.known_digests(spark, mine).collect()}
    assert sorted(rows(licenses.scan(df, digests=digests).drop("digest")), key=by_null) == got


def test_license_files(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    there = [n for n in names if (folder / n).exists()]
    if not there:
        pytest.skip("no licence files on this machine")
    df = spark.createDataFrame([(i, (folder / n).read_text()) for i, n in enumerate(there)], "doc_id long, text string")
    assert [r["license"] for r in licenses.scan(df).orderBy("doc_id").collect()] == [names[n] for n in there]


@pytest.mark.parametrize("name", ["op7_chat_snapshots", "op10_license_digests"])
def test_sql(spark, sf_dir, name):
    from quillon.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(rows(df), key=by_null) == sorted(want, key=by_null)


# What rounds have found


def thue_morse(n):
    a, b = b"a", b"b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_word_hashes_tell_thue_morse_words_apart(spark):
    a, b = (x.decode() for x in thue_morse(10))
    assert len({h for h in words.shingles(pa.array([a, b]), 5)[1].tolist()}) == 2
    train = next(i for i in range(1, 50) if zlib.crc32(str(i).encode()) % 7 != 2)
    held = next(i for i in range(1, 50) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(train, a), (held, b)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.score(df).collect()}
    assert got[held]["n_known"] == 1 and got[held]["n_tokens"] == 2 and got[train]["n_known"] == 2


def test_repeats_without_ids_in_several_blocks(spark, monkeypatch):
    """A passage at the start of fifty documents without doc_id, and of fifty with the same one: one copy stays."""
    monkeypatch.setattr(suffixes, "BLOCK_MB", 0.003)
    rng = np.random.default_rng(5)
    text = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    passage, other = text(300), text(250)
    data = [(None, passage + text(300)) for _ in range(50)] + [(7, other + text(200)) for _ in range(50)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = rows(suffixes.cut_repeats(df))
    for i, n in ((None, 300), (7, 250)):  # what follows a passage begins alike now and then
        assert 49 * n <= sum(r[2] for r in got if r[0] == i) <= 49 * (n + 3) and sum(r[2] > 0 for r in got if r[0] == i) == 49


def test_a_line_with_many_contexts(spark, monkeypatch):
    """A line in the middle of every document, so that its edges have as many contexts as there are documents."""
    monkeypatch.setattr(suffixes, "BLOCK_MB", 0.004)
    rng = np.random.default_rng(6)
    text = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    line = text(180)
    data = [(i, text(int(rng.integers(0, 200))) + line + text(int(rng.integers(0, 200)))) for i in range(80)]
    got = sorted(rows(suffixes.cut_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(4))))
    assert got == sorted(cut_plainly(data))


def test_text_of_megabytes(spark):
    """Each operator on whole texts takes one of four megabytes beside small ones."""
    rng = np.random.default_rng(9)
    word = [bytes(rng.integers(97, 123, int(n), np.uint8)).decode() for n in rng.integers(2, 9, 3000)]
    long = " ".join(rng.choice(word, 700_000))
    df = spark.createDataFrame([(1, long, "en"), (2, "small text", "en"), (3, long, "de")], "doc_id long, text string, lang string").repartition(2)
    assert {r["doc_id"]: r["n_removed"] for r in suffixes.cut_repeats(df).collect()}[3] == len(long)
    assert {r["doc_id"]: r["class_id"] for r in near_copies.near_classes(df).collect()} == {1: 1, 2: 2, 3: 1}
    assert ppm.score(df).where("n_tokens > 600000").count() == 2 and languages.identify(df).count() == 3
    got = {r["doc_id"]: r for r in media.media_digests(df.where("doc_id < 3")).collect()}
    assert got[1]["n_bytes"] == len(long) and got[1]["payload_sha256"] == hashlib.sha256(long.encode() + b"\xff" * (-len(long) % 576)).hexdigest()


def test_images_that_a_prediction_suits():
    y, x = np.mgrid[0:40, 0:64]
    values = ((x * 3 + y * 5) % 256).astype(np.uint8)
    assert webp.best_prediction(values) is not None
    assert (webp.decode(webp.encode_gray(values))[..., webp.GREEN] == values).all()
    for mode in (webp.LEFT, webp.TOP):  # the short way of undoing one equals the long one
        pixels = np.random.default_rng(mode).integers(0, 256, (9, 7, 4), np.uint8)
        modes = np.zeros((3, 2, 4), np.uint8)
        modes[..., webp.GREEN] = mode
        assert (webp.undo_predictor(webp.apply_predictor(pixels, 2, modes), 7, 2, modes) == pixels).all()


def test_files_samples_ids_and_texts(spark, odd, none, pieces):
    samples = {r[0]: r[1] for r in media.pixels(media.stored(odd.where("doc_id IS NOT NULL"))).collect()}
    for i, t, *_ in odd_rows():
        if i is not None:
            b = utf8(t)
            assert bytes(samples[i]) == b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
    got = {r[0]: (r[1], r[2]) for r in sentence_pieces.encoded(odd.where("doc_id IS NOT NULL"), tok.path("piece_bpe_32k.model")).collect()}
    for i, t, *_ in odd_rows():
        if i is not None:
            ids = pieces.encode(t or "", add_bos=True, add_eos=True)
            assert got[i] == (ids, pieces.decode(ids))
    assert rows(media.pixels(media.stored(none))) == []


def test_chunks_without_spaces_are_not_kept(pieces, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "HELD_CHARACTERS", 3000)
    table = sentence_pieces.ChunkTable(pieces)
    for i in range(40):
        text = f"{i}" * 700 + f" word{i} " + "x" * 900
        ids, decoded = table.encode_decode([text])[0]
        assert np.frombuffer(ids, np.uint32).tolist() == pieces.encode(text, add_bos=True, add_eos=True) and decoded == text
        assert sum(map(len, table)) <= 3000 + 2 * len(text) and table.held == sum(map(len, table))


def fit_plainly(data, n, languages_of):
    """Follow-the-regularised-leader, coordinate by coordinate."""
    z, sq = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k, lang):
        l1 = 0 if k == "offset" else languages.L1
        v = z[k, lang]
        return 0.0 if abs(v) <= l1 else (math.copysign(l1, v) - v) / ((languages.BETA + math.sqrt(sq[k, lang])) / languages.ALPHA + languages.L2)

    for _ in range(languages.PASSES):
        for cells, x, y in data:
            row = [*zip(cells.tolist(), x.tolist(), strict=True), ("offset", 1.0)]
            w = {(k, a): weight(k, a) for k, _ in row for a in range(languages_of)}
            logits = [sum(v * w[k, a] for k, v in row) for a in range(languages_of)]
            e = [math.exp(v - max(logits)) for v in logits]
            for k, v in row:
                for a in range(languages_of):
                    slope = v * (e[a] / sum(e) - (a == y))
                    after = sq[k, a] + slope**2
                    z[k, a] += slope - (math.sqrt(after) - math.sqrt(sq[k, a])) / languages.ALPHA * w[k, a]
                    sq[k, a] = after
    return {(k, a): weight(k, a) for k, a in list(z)}


def test_fit_equals_a_plain_one():
    rng = np.random.default_rng(2)
    data = [(np.sort(rng.choice(60, 8, replace=False)), rng.random(8), int(rng.integers(0, 3))) for _ in range(40)]
    weights, offsets = languages.fit_ftrl(data, 3)
    want = fit_plainly(data, 60, 3)
    for (k, a), v in want.items():
        assert math.isclose(offsets[a] if k == "offset" else weights[k, a], v, abs_tol=1e-9)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet") if pathlib.Path("/root/testdata/sf0.01").exists() else pytest.skip("no tables")
    got = languages.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred != 'und'")
    right, n = got.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert n > 200 and right / n > 0.97


def test_a_rare_language_has_a_class(spark):
    sentence = {"en": "the house is near the river and we walk there", "it": "la casa vicino al fiume e noi camminiamo sempre"}
    data = [(i, f"{sentence['en']} {i}", "en") for i in range(400)] + [(1000 + i, f"{sentence['it']} {i}", "it") for i in range(12)]
    model = languages.train(spark.createDataFrame(data, "doc_id long, text string, lang string"), sample=40)
    assert model.languages == ["en", "it"] and model.predict("la casa al fiume")[0] == "it" and model.predict("we walk near the house")[0] == "en"


def test_forest_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(forest, "PART_MB", 0.01)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((30, 8))[rng.integers(0, 30, 900)] * 4 + rng.standard_normal((900, 8)) * 0.3
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for q, _, i, s in sorted(rows(forest.nearest(df))):
        got[q].append((i, s))
    found = 0
    for q, hits in got.items():
        truth = sorted((float(np.sqrt(((v[i] - v[q]) ** 2).sum())), i) for i in range(900) if i != q)[:10]
        found += len({i for i, _ in hits} & {i for _, i in truth})
        assert all(math.isclose(s, float(np.sqrt(((v[i] - v[q]) ** 2).sum())), rel_tol=1e-12) for i, s in hits)
    assert found >= 0.9 * 10 * len(got) and len(got) == 9
