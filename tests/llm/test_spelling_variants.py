import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from leafmeter.llm import queries
from leafmeter.llm import spelling_variants as sv

FOLDER = "/root/testdata/sf0.001"


def words_of(rows, every):
    lower = {i: i + 32 for i in range(65, 91)}
    counts = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return counts


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    out = {}
    for w, n in counts.items():
        some = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if near(w, x)]
        best = min(some, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[w] = [w, form, w, n, len(some), counts[form] if form else None]
    for row in out.values():
        while out[row[2]][1]:
            row[2] = out[row[2]][1]
    return {tuple(r) for r in out.values()}


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    counts = {w: n for w, n in words_of(rows, 199).items() if len(w) >= 6 and n >= 5}
    want = brute(counts)
    assert got(queries.op13_spelling_variants(spark, FOLDER)) == want and any(r[1] for r in want)


def test_dense_words_in_many_shards(spark, monkeypatch):
    # All words of two letters up to length 5, one hot vector, and long words.
    words = {"".join("ab"[k >> i & 1] for i in range(n)): 5 ** (k % 4) for n in range(1, 6) for k in range(2**n)}
    words |= {"x" * 5000: 1, "x" * 4999 + "y": 30, "x" * 5001: 1, "straße": 50, "strasse": 9, "strase": 3, "élève": 2, "elève": 11, "bcb": 1}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute(words)
    assert got(sv.variants(table)) == want
    monkeypatch.setattr(sv, "SHARD_VECTORS", 3)
    assert got(sv.variants(table)) == want


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (2, "Word×÷ wORD"), (None, "word Élan ÉLAN"), (2, "Word×÷ wORD"), (3, "w" * 300_000)], "doc_id long, text string"
    ).withColumns({"word": F.lit(1), "n": F.lit("x")})
    counted = {r["word"]: r["n"] for r in sv.count_words(docs).collect()}
    assert counted == {"word×÷": 2, "word": 3, "Élan": 2, "w" * 300_000: 1}
    every = {r["word"]: r["n"] for r in sv.count_words(docs, every=2).collect()}
    rows = [(1, None), (2, ""), (2, "Word×÷ wORD"), (None, "word Élan ÉLAN"), (2, "Word×÷ wORD"), (3, "w" * 300_000)]
    assert every == {w: n for w, n in words_of(rows, 2).items()}
    assert sv.variants(docs.limit(0).select(F.col("text").alias("word"), F.lit(1).cast("long").alias("n"))).collect() == []


def test_search_spends_one_surplus_and_one_deficit():
    vectors = [[1, 2, 0], [2, 2, 0], [1, 1, 1], [0, 2, 1], [2, 1, 1], [2, 3, 0], [1, 2, 1], [1, 1, 0], [0, 1, 0]]
    root = sv.build_trie([(v, i) for i, v in enumerate(vectors)])
    assert sorted(sv.search_trie(root, [1, 2, 0])) == [0, 1, 2, 3, 6, 7]
