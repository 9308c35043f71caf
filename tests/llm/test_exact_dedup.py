import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from leafmeter.llm import exact_dedup


def brute(rows):
    by = {}
    for doc_id, text in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for doc_id, text in rows:
        normal = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        size, none, best = min(by[normal])
        keep = None if none else best
        kept = doc_id == keep and len(text or "") == -size
        out.append((doc_id, keep, len(by[normal]), kept, hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    r = random.Random(5)
    texts = ["a b", "ab", " ab\n", "a b", "", " \t\x0b\x0c\r\n", None, "é x", "éx", "long " * 30_000, "long" * 30_000]
    rows = [(i, r.choice(texts)) for i in range(200)] + [(1000 + i, f"only {i}") for i in range(300)]
    rows += [(None, "ab"), (None, "null id"), (3, "ab"), (3, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' AS n", "1 AS digest", "2 AS keep_id")
    for history in (F.lit(False), F.lit(True), F.col("doc_id") % 2 == 0, F.col("doc_id") < 900):
        got = sorted([tuple(x)[:5] for x in exact_dedup.deduplicate(docs, history).collect()], key=str)
        assert got == brute(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.deduplicate(none, F.lit(True)).collect() == []


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 20)
    rows = [(i, f"t {i % 150}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(x)[:5] for x in exact_dedup.deduplicate(docs, F.col("doc_id") < 170).collect()], key=str)
    assert got == brute(rows)


def test_a_large_batch_on_little_history_is_spread(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 20)
    docs = spark.createDataFrame([(i, f"t {i}") for i in range(3000)], "doc_id long, text string")
    rows = exact_dedup.digests(docs)
    for history in (rows.limit(0), rows.filter("doc_id < 5")):
        n = exact_dedup.build_index(history, rows.count())[1]
        assert n == 150
        sizes = [r["count"] for r in rows.groupBy(exact_dedup._shard(n)).count().collect()]
        # Dealt by hash, 20 each on average.
        assert len(sizes) == 150 and max(sizes) < 50
    got = exact_dedup.duplicate_groups(rows.limit(0), rows)
    assert got.count() == got.filter("n = 1").count() == 3000


def test_perfect_hash_is_minimal_and_perfect():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        words = r.integers(0, 2**63, (n, 4)).astype(np.uint64)
        levels = exact_dedup.perfect_hash(words)
        assert sorted(exact_dedup.slots(levels, words)) == list(range(n))
