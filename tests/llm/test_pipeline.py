import test_exact_dedup
import test_packing
import test_simhash
import test_suffix_dedup

import corpus_pipeline
from leafmeter.llm import toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: {r["doc_id"] for r in kept[name]}

    clean = {d for d, t in rows.items() if model.probability(toxicity.passages(t or "", model)[1]) < 0.5}
    assert ids("toxicity") == clean

    exact = {r[0] for r in test_exact_dedup.brute([(d, rows[d]) for d in clean]) if r[3]}
    assert ids("exact dedup") == exact and len(exact) < len(clean)

    classes = test_simhash.classes([(d, test_simhash.fingerprint(rows[d])) for d in exact])
    assert ids("simhash near-dedup") == {d for d, _, component in classes if d == component}

    left = [(d, rows[d]) for d in sorted(ids("simhash near-dedup"))]
    cut = test_suffix_dedup.brute_first(left, corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)
    cut = {d: text.decode(errors="ignore") for d, text in cut}
    assert cut != dict(left)
    assert {r["doc_id"]: r["text"] for r in kept["suffix-array dedup"]} == cut
    assert all(r["n_chars"] == len(r["text"]) for r in kept["suffix-array dedup"])

    assert test_packing.check(kept["packing"], sorted(cut.items())) < 0.05


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (2, "", None, None, None), (None, "alone", "en", "s", 5), (4, "x y " * 300, "en", "s", 1200)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for n, table in enumerate((rows, [])):
        folder = f"{tmp_path}/{n}"
        spark.createDataFrame(table, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert {r["doc_id"] for r in out} == ({1, None, 4} if table else set())


def test_repeated_rows_and_passages_keep_one_copy(spark, tmp_path):
    t = " ".join(f"w{i * i:07d}" for i in range(106)) + " tail!"
    u = " ".join(f"v{i * i:07d}" for i in range(60))
    rows = [(1, t, "a"), (1, t, "a"), (2, u, "b"), (3, "own start " + u + " own end", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, _ string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == [(1, t), (2, u), (3, "own start  own end")]
