"""The stages of the pipeline, each on what the one before keeps."""

import corpus_pipeline

DOCS = "doc_id long, text string, label int"


def test_near_dedup_keeps_one_of_each_class(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcde")
    data = [(None, a), (None, a), (None, b), (None, c + " near"), (9, c), (5, d), (5, e), (5, e + " near"), (6, d), (None, d), (None, None), (None, ""), (3, "x")]
    df = spark.createDataFrame([(*r, 1) for r in data], DOCS).repartition(3)
    got = corpus_pipeline.near_dedup(spark, df, "")
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    assert got.columns == df.columns and kept == sorted([(0, a), (0, b), (9, c), (5, d), (5, e), (0, ""), (3, "x")])


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        assert 0.8 * n <= docs.count() <= n, name
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert got.select("doc_id").distinct().count() == docs.count()


def test_run(spark, sf_dir):
    assert "sequence_id" in corpus_pipeline.run(spark, sf_dir).columns


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, label int, block int, row int, others string"


def odd_table(spark, docs):
    """Some of the given documents, with missing ids, missing and empty texts, repeated rows, and columns of clashing names."""
    rows = [(r["doc_id"] if i % 7 else None, r["text"], r["lang"], r["source"], r["n_chars"], 1, 2, 3, 4, "o") for i, r in enumerate(docs.orderBy("doc_id").limit(60).collect())]
    rows += [(None, None, None, None, None, 1, 2, 3, 4, "o"), (None, "", "en", "s", 0, 1, 2, 3, 4, "o"), (5000, "12 34 !!", "en", "s", 8, 1, 2, 3, 4, "o"), rows[3], rows[3], rows[7]]
    return spark.createDataFrame(rows, ODD_COLUMNS).repartition(4)


def test_stages_on_odd_tables(spark, sf_dir):
    docs = odd_table(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    none = docs.where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        got, empty = stage(spark, docs, sf_dir), stage(spark, none, sf_dir)
        assert empty.count() == 0, name
        if name != "pack":
            assert got.columns == docs.columns == empty.columns, name
        else:
            assert got.selectExpr("count_if(piece = 0)").first()[0] == docs.count()


def test_language_keeps_what_it_knows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, sf_dir).collect()}
    for r in docs.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert r["doc_id"] in kept or not letters or r["lang"] is None or len(r["text"]) < 40, r["doc_id"]
        assert letters or r["doc_id"] not in kept


def test_suffix_dedup_equals_a_plain_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    seen, want = set(), {}
    for r in docs.orderBy("doc_id").collect():
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept, at = "", 0
        for c in b.decode():
            n = len(c.encode())
            kept += "" if all(gone[at : at + n]) else c
            at += n
        want[r["doc_id"]] = kept
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup(spark, docs, sf_dir).collect()}
    assert got == want


def test_pack_takes_everything(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by) <= 1.02 * -(-total // 1024) + 1
