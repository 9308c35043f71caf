import numpy as np
from pyspark.sql import functions as F

from leafmeter.llm import queries
from leafmeter.llm import quality_mil as mil

FOLDER = "/root/testdata/sf0.01"


def coded(*texts):
    raw = [t.encode() for t in texts]
    return mil.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_passages_cover_the_text_evenly():
    x, base = coded("a b " * 50, "", "word", "x " * 64, "x " * 65)
    assert np.diff(base).tolist() == [2, 1, 1, 1, 2]
    assert not x[2].any()
    words = np.expm1(x[:, 6]).round().astype(int).tolist()
    assert words == [50, 50, 0, 1, 64, 33, 32]


def test_features_by_hand():
    x, _ = coded("AB AB c# Dé 1")
    assert np.allclose(x[0, :6], [5 / 10, 1 / 10, 1 / 10, 1 / 10, 0, 2 / 10])
    again, new, capitals, symbol_end, point_end, single, twice = x[0, 8:15]
    assert np.allclose([again, new, capitals, symbol_end, point_end, single, twice], [0.2, 0.8, 0.4, 0.2, 0, 0.2, 0])
    # Windows that repeat count within their text only.
    x, _ = coded("a b c d e. a b c d e.", "a b c d e.")
    assert x[0, 14] > 0 and x[1, 14] == 0


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7, mil.FEATURES))
    base, y = np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    w = mil._first_weights(rng)

    def loss():
        p = mil._forward(w, x, base)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    slopes = mil._gradients(w, x, base, y)
    for name, value in w.items():
        flat = value.reshape(-1)
        for i in (0, flat.size // 2, flat.size - 1):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - slopes[name].reshape(-1)[i]) < 1e-6


def test_attention_finds_the_bad_passage():
    good, bad = "the river runs along old stones and quiet fields, ", "buy### now$$$ BUY!! "
    rng = np.random.default_rng(3)
    bags, labels = [], []
    for i in range(200):
        parts = [good * 7 for _ in range(rng.integers(2, 6))]
        if i % 2:
            parts[rng.integers(0, len(parts))] = bad * 21
        x, _ = coded(" ".join(parts))
        bags.append(x)
        labels.append(float(i % 2 == 0))
    model = mil.train(bags, np.array(labels))
    x, base = coded(good * 7 + bad * 21 + good * 14, good * 28)
    p, a = model.scores(x, base), model.attention(x, base)
    assert p[0] < 0.1 < 0.9 < p[1]
    assert np.allclose(np.add.reduceat(a, base[:-1]), 1)
    assert a[: base[1]].max() > 1.5 / base[1]


def test_held_out_accuracy(spark):
    out = queries.op12_quality_classifier(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    n = {
        (r["quality"], r["predicted"]): r["n"]
        for r in out.join(labels, "doc_id").filter("held_out").groupBy("quality", "predicted").agg(F.count("*").alias("n")).collect()
    }
    assert n.get((1, 0), 0) <= 0.03 * n[1, 1]
    assert n[0, 0] >= 0.75 * (n[0, 0] + n.get((0, 1), 0))


def test_score_is_the_formula(spark):
    """The score from the model's weights by hand, on texts of one and more passages."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(200)
    model = mil.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), ~mil.held_out())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    w = model.weights
    for row in mil.score(docs, model).limit(40).collect():
        x, _ = coded(texts[row["doc_id"]])
        e = np.tanh((x - model.mean) / model.scale @ w["embed"] + w["embed_0"])
        raw = [float(w["attend"] @ (np.tanh(h @ w["gate_t"]) / (1 + np.exp(-(h @ w["gate_s"]))))) for h in e]
        a = np.exp(raw - np.max(raw))
        z = (a / a.sum()) @ e
        assert abs(row["score"] - 1 / (1 + np.exp(-(z @ w["out"] + w["out_0"][0])))) < 1e-9
        assert row["top_passage"] == int(np.argmax(a)) and row["passages"] == len(e)


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "some words"), (3, " \n\t "), (4, "long words " * 100_000), (5, "a"), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "quality": F.lit(7), "key": F.lit(1)})
    labels = spark.createDataFrame([(1, 1, None), (1, 0, None), (4, 1, 0), (5, 1, 0), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    model = mil.fit(docs, labels)
    out = mil.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1, 2, 3)}) == 1
    none = mil.score(docs, mil.fit(docs, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert mil.score(docs.limit(0), model).collect() == []


def test_training_stays_within_its_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} " * (64 * (i + 1))) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    monkeypatch.setattr(mil, "TRAIN_PASSAGES", 9)
    bags, y = mil.training_bags(docs, labels, F.lit(True))
    assert 0 < sum(map(len, bags)) <= 9 and len(bags) == len(y)
