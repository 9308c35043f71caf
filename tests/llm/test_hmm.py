import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from leafmeter.llm import hmm
from leafmeter.llm.queries import op8_hidden_markov_model


def model(seed, k=3, c=5):
    r = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return norm(r.random(k)), norm(r.random((k, k))), norm(r.random((k, c)))


def enumerated(sequence, start, step, emit):
    """Probability and expected counts from every path of states."""
    total, counts = 0.0, [np.zeros_like(x) for x in (start, step, emit)]
    paths = []
    for path in itertools.product(range(len(start)), repeat=len(sequence)):
        p = start[path[0]] * emit[path[0], sequence[0]]
        for a, b, o in zip(path, path[1:], sequence[1:]):
            p *= step[a, b] * emit[b, o]
        total += p
        paths.append((path, p))
    for path, p in paths:
        counts[0][path[0]] += p / total
        for a, b in zip(path, path[1:]):
            counts[1][a, b] += p / total
        for s, o in zip(path, sequence):
            counts[2][s, o] += p / total
    return total, counts


def test_counts_and_likelihoods_equal_enumeration():
    r = random.Random(1)
    m = model(2)
    sequences = [np.array([r.randrange(5) for _ in range(n)]) for n in (1, 4, 6, 2, 6, 3)]
    whole = [enumerated(s, *m) for s in sequences]
    got = hmm.expected_counts(sequences, *m)
    want = np.concatenate([sum(w[1][i] for w in whole).ravel() for i in range(3)])
    assert np.allclose(got[:-1], want) and math.isclose(got[-1], sum(math.log10(w[0]) for w in whole))
    assert np.allclose(hmm.log_likelihoods(sequences, *m), [math.log10(w[0]) for w in whole])


def base(rows):
    """Contract columns by doc_id, counted plainly."""
    tokens = {d: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b" "] for d, t in rows}
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for d, t in tokens.items() if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    return {
        d: (held(d), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        for d, t in tokens.items()
    }


def compare(rows, out):
    want = base(rows)
    assert len(out) == len(rows)
    for r in out:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9, abs=1e-9) and math.isfinite(r["score"])


def test_query_and_gain_over_the_base(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = op8_hidden_markov_model(spark, folder).collect()
    compare(rows, out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_tables(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "A a A É é"), (None, "x y"), (10, "long words " * 20_000), (11, "tab\tand\x0bmore\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS block", "2 AS token")
    monkeypatch.setattr(hmm, "ROUNDS", 2)
    compare(rows, hmm.score_texts(docs, hmm.held_out(), rounds=2).collect())
    twice = docs.filter("doc_id = 3").union(docs.filter("doc_id = 3"))
    assert len(hmm.score_texts(twice, hmm.held_out(), rounds=1).collect()) == 2
    assert hmm.score_texts(docs.limit(0), hmm.held_out()).collect() == []


def test_token_probabilities_sum_to_one(spark):
    """All sequences of one token and the end, with unknown tokens of each class as one."""
    docs = spark.createDataFrame([(1, "aa bb aa"), (3, "cc bb dd ee")], "doc_id long, text string")
    blocks = hmm.token_blocks(docs, hmm.held_out()).cache()
    counts = Counter({bytes(r["token"]): r["n"] for r in blocks.filter("token IS NOT NULL").collect()})
    own = {}
    for token, n in counts.items():
        own.setdefault(hmm.token_class(token), []).append(n)
    for kind, found in own.items():
        scale = sum(found) + 0.1 * (len(found) + 1)
        assert math.isclose(sum((n + 0.1) / scale for n in found) + 0.1 / scale, 1)
