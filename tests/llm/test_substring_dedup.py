import hashlib
import random

from leafmeter.llm import recurrence, substring_dedup
from leafmeter.llm.common import WORD
from leafmeter.llm.queries import op1_substring_dedup


def brute(rows, words=20):
    """Kept words per row, from all windows in order of (doc_id, start)."""
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    order = lambda d, i: (d is not None, d or 0, i)
    for d, w in texts:
        for i in range(len(w) - words + 1):
            key = tuple(w[i : i + words])
            first[key] = min(first.get(key, order(d, i)), order(d, i))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - words + 1):
            if first[tuple(w[i : i + words])] < order(d, i):
                gone.update(range(i, i + words))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def corpus(seed=1, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "ñu", "x y"]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 3, 19, 20, 21, 40, 200]))]
        if i % 3 == 0:
            a = r.randrange(0, 30)
            words[len(words) // 2 : len(words) // 2] = passage[a : a + r.randrange(15, 60)]
        if i % 5 == 0 and rows:
            words = WORD.findall(r.choice(rows)[1] or "") + words[:2]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(words)))
    rows += [(500, None), (501, ""), (502, " \n "), (None, rows[0][1]), (503, "a " * 90), (504, rows[9][1]), (504, rows[9][1])]
    return rows


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS text_key", "1 AS n")
    out = substring_dedup.remove_repeats(docs).collect()
    return sorted([(r["doc_id"], r["n_words"], sum(b - a for a, b in r["removed"]), r["kept"]) for r in out], key=str)


def test_equals_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_frequent_phrases_take_the_other_path(spark, monkeypatch):
    monkeypatch.setattr(recurrence, "HOT", 4)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 500)
    rows = corpus(2)
    assert run(spark, rows) == brute(rows)


def test_periodic_text_is_sent_once(spark, monkeypatch):
    rows = [(1, "a " * 200), (2, "a\n a  " * 90 + "b " + "a " * 70), (3, "one two three four five six seven " * 30)]
    rows += [(None, "two three four five six seven one " * 9), (3, "x " + "one two three four five six seven " * 20), (4, "a " * 30)]
    for hot in (1500, 10):
        monkeypatch.setattr(recurrence, "HOT", hot)
        monkeypatch.setattr(recurrence, "STRETCH", 8)
        monkeypatch.setattr(recurrence, "BATCH_BYTES", 200)
        assert run(spark, rows) == brute(rows)


def test_a_long_run_makes_few_places(spark):
    docs = spark.createDataFrame([(1, "no " * 500_000), (2, "yes no\n" * 100_000)], "doc_id long, text string")
    found = recurrence.map_slices(substring_dedup.keyed(docs), substring_dedup._phrases(20), recurrence.PHRASES)
    assert found.count() < 20
    out = {r["doc_id"]: (r["n_words"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert out == {1: (500_000, "no"), 2: (200_000, "yes no")}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in op1_substring_dedup(spark, folder).collect()], key=str)
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows)]
    assert got == want and any(r[2] for r in got)
