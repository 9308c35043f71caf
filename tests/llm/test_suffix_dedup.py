import hashlib
import random
import re
from collections import Counter

from leafmeter.llm import recurrence, suffix_dedup
from leafmeter.llm.queries import op6_suffix_array_dedup


def brute(rows, length=400):
    texts = [(d, (t or "").encode()) for d, t in rows]
    n = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def corpus(seed, n=80, passage=900, letters="abcdé \n"):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice(letters) for _ in range(k))
    common = text(passage)
    rows = []
    for i in range(n):
        t = text(r.choice([0, 10, 63, 64, 65, 200, 500]))
        if i % 3 == 0:
            a, b = sorted(r.sample(range(passage), 2))
            t = t[: len(t) // 2] + common[a:b] + t[len(t) // 2 :]
        if i % 7 == 0 and rows:
            t = r.choice(rows)[1] + t[:5]
        rows.append((i, t))
    # Runs that overlap themselves, repeated rows, NULLs, equal rows at a document's very ends.
    return rows + [(90, "x" * 1000), (91, None), (92, ""), (None, rows[-1][1]), (93, rows[3][1]), (93, rows[3][1]), (94, "xy" * 300)]


def run(spark, rows, length):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS text_key", "1 AS pos")
    out = suffix_dedup.remove_strings(docs, length).collect()
    return sorted(
        [(r["doc_id"], r["n_bytes"], sum(b - a for a, b in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in out], key=str
    )


def test_equals_brute_force(spark):
    for seed, length in ((1, 400), (2, 64), (3, 400)):
        rows = corpus(seed)
        assert run(spark, rows, length) == brute(rows, length)


def test_frequent_phrases_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(recurrence, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    for seed, length in ((4, 400), (5, 64)):
        rows = corpus(seed)
        assert run(spark, rows, length) == brute(rows, length)


def test_periodic_text_is_sent_once(spark, monkeypatch):
    line = "2024-01-01 00:00:00 INFO nothing to do, waiting for the next job of the queue\n"
    blanks = " " * 1500 + "x" + " " * 1500 + "x" + " " * 900 + "y" + " " * 500
    rows = [(1, line * 40), (2, "start " + line * 40), (3, blanks), (4, " " * 700), (5, "ab" * 600 + "c" + "ab" * 300), (6, "ab" * 201), (7, "z" * 900)]
    for hot in (1500, 20):
        monkeypatch.setattr(recurrence, "HOT", hot)
        monkeypatch.setattr(recurrence, "STRETCH", 100)
        monkeypatch.setattr(recurrence, "BATCH_BYTES", 3000)
        for length in (400, 64):
            assert run(spark, rows, length) == brute(rows, length)


def test_a_long_run_makes_few_places(spark):
    docs = spark.createDataFrame([(1, "-" * 3_000_000), (2, "- \n" * 700_000), (3, "-" * 500)], "doc_id long, text string")
    found = recurrence.map_slices(suffix_dedup.keyed(docs), suffix_dedup._phrases(400), recurrence.PHRASES)
    assert found.count() < 20
    out = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in suffix_dedup.remove_strings(docs).collect()}
    assert out == {1: [(0, 3_000_000)], 2: [(0, 2_100_000)], 3: [(0, 500)]}


def test_empty_table(spark):
    assert run(spark, [], 400) == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in op6_suffix_array_dedup(spark, folder).collect()], key=str)
    want = [(d, n, g, s, hashlib.sha256(k).hexdigest()) for d, n, g, s, k in brute(rows)]
    assert sorted(got) == sorted(want) and any(r[2] for r in got)


def brute_first(rows, length, least_words=0):
    """Cut what also starts earlier, in order of doc_id with NULL last; repeated rows are one document."""
    seen, cut = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        text = (t or "").encode()
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
        for a, b in runs:
            if sum(y > a and x < b for x, y in words) < least_words and b - a < 400:
                gone[a:b] = bytes(b - a)
        cut[d, t] = bytes(x for x, g in zip(text, gone) if not g)
    return sorted([(d, cut[d, t]) for d, t in rows], key=str)


def run_first(spark, rows, length, least_words=0):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS text_key", "1 AS _", "2 AS __")
    out = suffix_dedup.remove_strings(docs, length, carry=True, keep_first=True, least_words=least_words).collect()
    assert all(r["row"]["_"] == 1 for r in out)
    return sorted([(r["doc_id"], bytes(r["kept"])) for r in out], key=str)


def test_the_earliest_place_stays(spark, monkeypatch):
    for hot in (1500, 3):
        monkeypatch.setattr(recurrence, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1 << 21 if hot > 3 else 2000)
        for seed, length, words in ((6, 400, 0), (7, 64, 0), (8, 144, 50)):
            rows = corpus(seed)
            assert run_first(spark, rows, length, words) == brute_first(rows, length, words)
