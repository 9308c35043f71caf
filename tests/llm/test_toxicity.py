import random

from leafmeter.llm import toxicity
from leafmeter.llm.queries import op4_toxicity


def brute_segments(scores):
    """Maximal scoring segments by definition: split at the best of all segments and go on at both sides."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return brute_segments(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


def test_segments_equal_brute_force():
    r = random.Random(1)
    for _ in range(400):
        scores = [r.choice([-4, -2, -1, 1, 2, 4]) * 1.0 + r.random() / 1000 for _ in range(r.randrange(0, 25))]
        got = [(a, b, round(s, 9)) for a, b, s in toxicity.maximal_segments(scores)]
        assert got == [(a, b, round(s, 9)) for a, b, s in brute_segments(scores)]


def test_held_out_accuracy_and_clean_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op4_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic = [p for t, p in held if t == 1]
    clean = [p for t, p in held if t == 0]
    assert sum(toxic) / len(toxic) > 0.7 and sum(clean) / len(clean) < 0.01
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (2, ""), (None, "you idiot"), (4, "idiot " * 40_000), (5, "fine words here")], "doc_id long, text string"
    ).selectExpr("*", "'z' AS toxic", "1 AS term")
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (5, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    for table in (labels, labels.limit(0)):
        model = toxicity.fit(docs, table)
        out = toxicity.score(docs, model).collect()
        assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
        assert len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.fit(none, labels)).collect() == []


def test_passage_places():
    model = toxicity.Model({"vile": 5.0, "scum": 5.0}, -0.5, 2.0, -3.0, (1.0, 0.0, 0.0, 0.0, 0.0))
    found, features = toxicity.passages("A calm start. You VILE scum! " + "and calm words " * 5, model)
    assert [(a, b) for a, b, _, _ in found] == [(18, 27)] and features[0] > 0
