import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leafmeter.llm import conversation_trie as ct
from leafmeter.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own[c].append((role or "", text or ""))
    out = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + said[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    below = defaultdict(lambda: [0, 0])
    for node, own in members.items():
        saved = (len(own) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            below[node[:d]][0] += not kids[node]
            below[node[:d]][1] += saved
    rows = set()
    for node, own in members.items():
        ended = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        rows.add(
            (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), kids[node], below[node][0], below[node][1],
             hashlib.sha256(ended.encode()).hexdigest())
        )
    return rows


def run(spark, tmp_path, rows, name="a", extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.withColumns({"pos": F.lit("x"), "depth": F.lit(1), "rep": F.lit(2), "size": F.lit(None).cast("int"), "row": F.lit(0)})
    df.write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    out = queries.op11_conversation_trie(spark, f"{tmp_path}/{name}")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in out.select(columns).collect()]
    assert len(got) == len(set(got))
    return set(got)


def talks(seed, n=60, hot=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", ""])) for t in range(rng.randint(1, 6))]
    rows += [(100 + c, t, "user", "same") for c in range(hot) for t in range(9)]
    # One conversation far longer than the others, and one that is its beginning.
    rows += [(1000, t, "user", str(t % 3)) for t in range(150)] + [(2000, t, "user", str(t % 3)) for t in range(70)]
    return rows


def test_query_equals_brute_force(spark, tmp_path):
    rows = talks(1, hot=25)
    assert run(spark, tmp_path, rows) == brute(rebuilt(rows))


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rows = [
        (1, None, None, "x"), (1, 0, "user", None), (2, 0, None, None), (2, 0, None, None), (None, 0, "user", "lost"),
        (5, 1, "user", "long " * 50_000), (6, 0, "user", "y"), (7, 3, "user", "y"),
    ]
    assert run(spark, tmp_path, rows, extra=True) == brute(rebuilt(rows))


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == set()


def test_batches_do_not_matter(spark):
    rows = spark.createDataFrame(talks(2, n=40), SCHEMA)
    placed = ct.turns(rows).persist()
    convs = placed.select("conv_id").distinct()
    results = [{tuple(r) for r in ct.conversation_trie(convs, placed, n).collect()} for n in (1, 5)]
    assert results[0] == results[1] and len(results[0]) > 40


def test_search_finds_the_exit(spark):
    rows = spark.createDataFrame(
        [(1, t, "u", x) for t, x in enumerate("abcdefgh")] + [(2, t, "u", x) for t, x in enumerate("abcxy")]
        + [(3, t, "u", x) for t, x in enumerate("abcdefz")] + [(4, t, "u", x) for t, x in enumerate("ab")]
        + [(5, t, "u", x) for t, x in enumerate("abcdefgh!")] + [(6, 0, "u", "q")], SCHEMA,
    )
    own = ct.prefixes(ct.turns(rows)).persist()
    ends = ct.paths(rows.select("conv_id").distinct(), own)
    nodes = ct.build(ends.filter("conv_id <= 2"), own)
    assert sorted(r[0] for r in nodes.select("depth").collect()) == [0, 3, 5, 8]
    found = {r["conv_id"]: (r["at"], r["w_depth"]) for r in ct.locate(nodes, ends.filter("conv_id > 2"), own).collect()}
    assert found == {3: (6, 8), 4: (2, 3), 5: (8, None), 6: (0, None)}


@pytest.mark.parametrize("low, high, want", [(0, 1, 1), (0, 7, 4), (4, 7, 6), (6, 7, 7), (3, 9, 8), (8, 15, 12)])
def test_two_fattest(spark, low, high, want):
    assert spark.range(1).select(ct.two_fattest(F.lit(low).cast("long"), F.lit(high).cast("long"))).first()[0] == want


def test_plan_has_no_python_before_the_id_lists(spark):
    rows = spark.createDataFrame(talks(3, n=10), SCHEMA)
    plan = ct.prefixes(ct.turns(rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
