"""Stages of the pipeline on small cases."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import common, minhash, queries


def test_near_dedup_at_eighty(spark):
    base = [f"w{i}" for i in range(55)]
    close, far = list(base), [f"v{i}" for i in range(45)]
    close[30] = "changed"  # 51 shingles each, 46 of them shared: 46 / 56 = 0.82
    farther = list(far)
    farther[20] = "changed"  # 36 of 46: 0.78
    rows = [(i, " ".join(t)) for i, t in enumerate((base, close, far, farther), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3, 4]
    assert minhash.near_duplicates(docs).where("kept").count() == 4  # the contract of op10 is 0.85


def test_decontaminate_short_and_unnamed(spark, tmp_path):
    long = "the river bends twice before it meets the old stone bridge near the mill"
    spark.createDataFrame([(1, "Blue moon?"), (None, long), (2, "!!")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "once in a blue, moon they say"), (2, "a blue moonlit night, true-blue moons"), (3, f"see: {long.upper()}."), (4, "nothing of it"), (5, "blue moons; blue moon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()) == [2, 4]
    found = queries.op6_edit_decontamination(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r["at"]) for r in found if r.item_id) == [(1, 1, 0, 10), (5, 1, 0, 11)]
    assert [(r.doc_id, r.distance) for r in found if r.item_id is None] == [(3, 0)]


def test_near_duplicates_of_repeated_ids(spark):
    """An id with two texts links through either, a null text of it does no harm, and equal rows stay once."""
    a, b = ([f"{c}{i}" for i in range(80)] for c in "ab")
    a2, b2 = [*a[:-1], "x"], [*b[:-1], "y"]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, None), (2, " ".join(a2)), (3, " ".join(b2)), (4, "alone"), (4, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(1, 76): (1, True), (1, 0): (1, True), (2, 76): (1, False), (3, 76): (1, False), (4, 1): (4, True)}
    assert sorted((r.doc_id, r.text or "") for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted((i, t or "") for i, t in rows[:3] + rows[5:6])


def test_near_dedup_of_unnamed_rows(spark):
    """Rows without an id are near-duplicates like others; a document of an id stays before them; equal rows stay once."""
    words = lambda c: [f"{c}{i}" for i in range(100)]
    near = lambda c: " ".join([*words(c)[:-1], "z"])
    a, b, c = (" ".join(words(x)) for x in "abc")
    rows = [(None, a, 1), (7, near("a"), 2), (None, b, 3), (None, near("b"), 4), (None, c, 5), (None, c, 6), (None, None, 7), (None, "", 8), (8, "", 9), (9, c, 10), (9, c, 11), (9, "", 12), (3, near("c"), 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _name int")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = {r._name for r in got.collect()}
    assert kept - {3, 4} == {2, 7, 8, 9, 13} and len(kept & {3, 4}) == 1


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    """Stages take empty tables, null ids and columns whose names they use themselves, and pass all columns on."""
    spark.createDataFrame([(1, "the river bends twice before it meets the old stone bridge")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "in the morning the children walked along the river to the old mill and the miller gave them bread"
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, c long, mark string, head long, kept boolean, _name long"
    rows = [(1, text, "en", "s", 1, 1, 1, "m", 1, False, 1), (2, "x " + text, "en", "s", 1, 2, 2, "m", 2, None, 2), (None, "of bread and water " * 30, "en", None, None, None, None, None, None, None, None)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert (n > 0) == bool(data), name
            if name != "pack":
                assert out.columns == docs.columns, name


def test_texts_reach_python_in_small_batches(spark):
    """Each operator of the pipeline that hands texts to Python bounds a batch's bytes, unless the session has a limit."""
    key, rows = common.BATCH, spark.range(0, 3_000, 1, 1).selectExpr("id as doc_id", "repeat('word ', 1000) || id as text")
    steps = [
        lambda: corpus_pipeline.language_id(spark, rows.limit(1).withColumn("lang", F.lit("en")), ""),
        lambda: minhash.near_duplicates(rows.limit(1)),
        lambda: corpus_pipeline.pack(spark, rows.limit(1), ""),
    ]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    had = spark.conf.get(key) if key in spark.conf.getAll else None
    try:
        for step in steps:
            spark.conf.unset(key)
            step()
            met = rows.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in met) == 3_000 and max(r.bytes for r in met) < 2 * common.BATCH_BYTES
        spark.conf.set(key, "65536")
        steps[1]()
        assert spark.conf.get(key) == "65536"
    finally:
        spark.conf.set(key, had) if had else spark.conf.unset(key)
