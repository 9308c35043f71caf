import random
import re

import numpy as np
import xxhash

from leafmeter.llm import simhash
from leafmeter.llm.graph import components
from leafmeter.llm.queries import op5_simhash


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance=3):
    values = sorted({p for _, p in prints})
    label = {v: v for v in values}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    least = {}
    for d, p in prints:
        if d is not None:
            least[find(p)] = min(least.get(find(p), d), d)
    return sorted(((d, f"{p:016x}", least.get(find(p))) for d, p in prints), key=str)


def test_equals_brute_force(spark, tmp_path):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "ABC"]
    rows = []
    for i in range(150):
        if rows and r.random() < 0.6:
            words = (r.choice(rows)[1] or "").split()
            for _ in range(r.choice([0, 1, 1, 2])):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 3, 60, 150]))]
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000, None), (2001, " \n"), (None, rows[7][1]), (None, "all alone here now"), (5, rows[3][1]), (5, rows[3][1]), (2002, "Many words " * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "'x' AS shard").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(x) for x in op5_simhash(spark, str(tmp_path)).collect()], key=str)
    assert got == classes([(d, fingerprint(t)) for d, t in rows])


def test_many_shards_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 60)
    r = random.Random(2)
    centre = r.getrandbits(64)
    values = {r.getrandbits(64) for _ in range(300)}
    for _ in range(600):  # chains and a dense group
        base = centre if r.random() < 0.5 else r.choice(sorted(values))
        for _ in range(r.randrange(1, 5)):
            base ^= 1 << r.randrange(64)
        values.add(base)
    signed = [(int(np.uint64(v).view(np.int64)),) for v in values]
    distinct = spark.createDataFrame(signed, "fingerprint long").repartition(5)
    found = {x["node"]: x["label"] for x in components(simhash.links(distinct)).collect()}
    by_label = {}
    for v in values:
        s = int(np.uint64(v).view(np.int64))
        by_label.setdefault(found.get(s, s), set()).add(f"{v:016x}")
    want = {}
    for _, p, c in classes([(v, v) for v in values]):
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, want.values()))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (400, 450)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(101)) and {got[i] for i in (400, 450, 500)} == {400}
