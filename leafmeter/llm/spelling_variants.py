"""Spelling variants by a frequency-vector trie: words one inserted, deleted or replaced letter apart, and their forms.

Letters are dealt into groups, and a word stands under the counts of its letters by group, one trie level per group.  One
edit takes at most one letter from a group and adds at most one to another, so a depth-first search from a word's
vector with one unit of surplus and one of deficit to spend reaches the leaves of all words one edit apart.  Leaf
words are then verified exactly.

The trie is cut into shards by its first levels.  It holds distinct vectors, of which there are far fewer than
words; words meet in Spark joins, so a leaf with any number of words is never held by one task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafmeter.llm.common import stored

#: Letter groups, the levels of the trie.
GROUPS = 12
#: Letters told apart, the most frequent ones; all others share the last group.
LETTERS = 1000
#: Vectors of one shard of the trie.
SHARD_VECTORS = 4_000
#: Distinct words a task counts before it sends them on.
HELD_WORDS = 300_000


# ---- words


def deleted_letter(run: str, h: int) -> str:
    """``run`` without the code point ``h`` modulo its length."""
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, least_length: int = 1, every: int | None = None) -> DataFrame:
    """``word, n`` of the runs of ``A-Z a-z`` and U+00C0 to U+00FF in all texts, ``A-Z`` lower-cased.

    With ``every``, a run whose checksum together with its doc_id is divisible by it loses one letter, which plants
    variants.  Words of under ``least_length`` code points are left out.  NULL texts have no words, a NULL doc_id
    counts as empty, and repeated rows count again.
    """
    run = re.compile("[a-zÀ-ÿ]{%d,}" % max(1, least_length))
    base = docs.filter(F.col("text").isNotNull()).select(
        F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text")
    )

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                # Of bytes, lower() changes A-Z alone.
                found = Counter(run.findall(text.as_py().lower().decode()))
                if every is None:
                    counts.update(found)
                else:
                    start = zlib.crc32(f"{doc}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % every == 0:
                            word = deleted_letter(word, h)
                            if len(word) < least_length:
                                continue
                        counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    return base.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- the trie


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters of each group but the last, which takes all others; groups are about equally frequent."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    most = letters.orderBy(F.desc("n"), "letter").limit(LETTERS).collect()
    load, out = [0] * groups, [""] * groups
    for row in most:
        k = min(range(groups), key=load.__getitem__)
        load[k] += row["n"]
        out[k] += row["letter"]
    return out[:-1]


def _vector(groups: list[str]) -> Column:
    size = F.length("word")
    counts = [size - F.length(F.translate("word", letters, "")) for letters in groups]
    rest = size
    for c in counts:
        rest = rest - c
    return F.array(*counts, rest)


def build_trie(vectors: list[tuple[list[int], int]]) -> dict:
    """Nested dictionaries, one level per count; a leaf is its vector's id."""
    root: dict = {}
    for counts, leaf in vectors:
        node = root
        for c in counts[:-1]:
            node = node.setdefault(c, {})
        node[counts[-1]] = leaf
    return root


def search_trie(root: dict, counts: list[int]) -> Iterator[int]:
    """Leaves whose counts exceed ``counts`` by one in at most one group and fall short by one in at most one, depth first."""
    levels = len(counts)
    stack = [(root, 0, 1, 1)]
    while stack:
        node, level, surplus, deficit = stack.pop()
        if level == levels:
            yield node
            continue
        c = counts[level]
        for to, up, down in ((c, surplus, deficit), (c + 1, surplus - 1, deficit), (c - 1, surplus, deficit - 1)):
            if up >= 0 and down >= 0 and to in node:
                stack.append((node[to], level + 1, up, down))


def _shard_levels(vectors: DataFrame) -> int:
    """The fewest first levels by which no shard holds more than ``SHARD_VECTORS`` vectors."""
    levels = 1
    while levels < GROUPS:
        top = vectors.groupBy(F.slice("counts", 1, levels)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if top <= SHARD_VECTORS:
            break
        levels += 1
    return levels


def _near_prefixes(levels: int) -> Column:
    """The prefixes of ``levels`` counts that a search from ``counts`` may enter and that do not sort before its own."""
    own = [F.col("counts")[i] for i in range(levels)]
    out = [F.array(*own)]
    for first in range(levels):
        # The first count that differs is larger, so of two shards one asks the other.
        up = [c + 1 if i == first else c for i, c in enumerate(own)]
        out.append(F.array(*up))
        for other in range(first + 1, levels):
            out.append(F.array(*[c - 1 if i == other else c for i, c in enumerate(up)]))
    return F.filter(F.array(*out), lambda p: F.forall(p, lambda c: c >= 0))


def _search(key: tuple, held: pa.Table, queries: pa.Table) -> pa.Table:
    one, two = [], []
    if held.num_rows and queries.num_rows:
        root = build_trie(list(zip(held.column("counts").to_pylist(), held.column("leaf").to_pylist())))
        for counts, leaf in zip(queries.column("asked").to_pylist(), queries.column("by").to_pylist()):
            for found in search_trie(root, counts):
                one.append(leaf)
                two.append(found)
    return pa.table({"u": pa.array(one, pa.int64()), "v": pa.array(two, pa.int64())})


def near_vectors(vectors: DataFrame) -> DataFrame:
    """Pairs ``u, v`` of leaves of ``vectors`` (leaf, counts) within a surplus and a deficit of one, a leaf and itself
    included; each pair at least one way round."""
    levels = _shard_levels(vectors)
    mine = vectors.withColumn("shard", F.slice("counts", 1, levels))
    asked = vectors.select(F.col("leaf").alias("by"), F.col("counts").alias("asked"), F.explode(_near_prefixes(levels)).alias("to"))
    return mine.groupBy("shard").cogroup(asked.groupBy("to")).applyInArrow(_search, "u long, v long")


# ---- words one edit apart


def near_words(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: every pair of distinct words of ``words`` (word, n), each once, that differ by exactly one
    inserted, deleted or replaced code point; each pair one way round."""
    placed = words.filter(F.length("word") > 0).withColumn("counts", _vector(letter_groups(words)))
    placed = stored(placed.withColumn("leaf", F.xxhash64("counts")), "words")
    size = F.aggregate("counts", F.lit(0), lambda s, c: s + c)
    vectors = stored(placed.select("leaf", "counts", size.alias("size")).distinct(), "vectors")
    found = near_vectors(vectors.drop("size"))
    unordered = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    sizes = vectors.select("leaf", "size")
    pairs = unordered.join(sizes.select(F.col("leaf").alias("u"), F.col("size").alias("u_size")), "u").join(
        sizes.select(F.col("leaf").alias("v"), F.col("size").alias("v_size")), "v"
    )
    pairs = stored(pairs.select("u", "v", F.least("u_size", "v_size").alias("short")), "pairs")
    half = F.floor(F.col("short") / 2).cast("int")

    def side(leaf: str, name: str) -> DataFrame:
        """Words of the leaf with the beginnings and ends of which one edit leaves one as it is."""
        rows = placed.select("leaf", F.col("word").alias(name), F.col("n").alias(f"{name}_n")).join(
            pairs.withColumn("half", half), F.col("leaf") == F.col(leaf)
        )
        word = F.col(name)
        begin = F.substring(word, F.lit(1), F.col("half"))
        end = F.substring(word, F.length(word) - F.col("short") + F.col("half") + 1, F.col("short") - F.col("half"))
        keys = F.array(*[F.struct(F.lit(i).alias("end"), F.xxhash64("u", "v", x).alias("key")) for i, x in enumerate((begin, end))])
        return rows.select(name, f"{name}_n", "half", (F.col("u") == F.col("v")).alias(f"{name}_same"), F.explode(keys).alias("at")).select(
            name, f"{name}_n", f"{name}_same", F.col("half").alias(f"{name}_half"), F.col("at.end").alias("end"), F.col("at.key").alias("key")
        )

    met = side("u", "a").join(side("v", "b").drop("b_same", "b_half"), ["end", "key"])
    # Words that share both halves meet twice.
    begins = F.substring(F.col("a"), F.lit(1), F.col("a_half")) == F.substring(F.col("b"), F.lit(1), F.col("a_half"))
    once = (F.col("end") == 0) | ~begins
    return met.filter((~F.col("a_same") | (F.col("a") < F.col("b"))) & once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``words`` (word, n), distinct words.

    ``form`` is the near word of largest ``n``, of equals the smallest in code-point order, if it has at least
    ``ratio`` times the word's ``n``; ``root`` is where following forms ends.  An empty table gives no rows.
    """
    words = stored(words.select("word", "n"), "vocabulary")
    links = near_words(words)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("least"), F.col("b").alias("near"))).alias("best")
    )
    often = -F.col("best.least") >= ratio * F.col("n")
    rows = stored(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.least")).alias("form_n"),
        ),
        "forms",
    )
    # Forms of forms by doubling; n grows by the ratio at each step, so there are no rings.
    jumps = stored(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("to")), "jumps")
    while True:
        on = jumps.select(F.col("word").alias("to"), F.col("to").alias("further"))
        step = stored(jumps.join(on, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "jumps")
        jumps = step.select("word", "to")
        if step.filter("moved").isEmpty():
            break
    return rows.join(jumps, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
