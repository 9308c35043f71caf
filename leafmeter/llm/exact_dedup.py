"""Exact dedup with a minimal perfect hash over historical distinct digests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafmeter.llm.common import mixed, stored

SPACES = " \t\n\x0b\x0c\r"
#: Digests that share one hash table.
SHARD_DIGESTS = 100_000

_INDEX = "shard long, sizes array<long>, bits binary, digests binary, doc_id array<long>, n_chars array<long>, n array<long>"
_GROUPS = "digest binary, keep_id long, n_chars long, n long"


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, code points of the text, SHA-256 of the text without white space, and the text's key; NULL text is
    empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.translate(text, SPACES, "").cast("binary"), 256)).alias("digest"),
        F.xxhash64(text).alias("text_key"),
    )


def _winner() -> Column:
    """Sorts first: most code points, then the smallest doc_id, NULL last."""
    return F.struct((-F.col("n_chars")).alias("size"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))


def _grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: its winner and how many rows have it."""
    return rows.groupBy("digest").agg(F.min(_winner()).alias("w"), F.count("*").alias("n")).select(
        "digest", F.col("w.id").alias("doc_id"), (-F.col("w.size")).alias("n_chars"), "n"
    )


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    h = np.full(len(words), level + 1, np.uint64)
    for j in range(words.shape[1]):
        h = mixed(h ^ words[:, j])
    return (h % np.uint64(size)).astype(np.int64)


def perfect_hash(words: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct rows of words.

    A level sets the bits on which exactly one remaining row falls; rows that collide go on to the next level.
    A row's slot is the number of bits set before its own.
    """
    levels, left = [], words
    while len(left):
        size = max(64, 2 * len(left))
        at = _place(left, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def slots(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The slot of every row: its own for members, any or -1 for others."""
    out = np.full(len(words), -1, np.int64)
    left, base = np.arange(len(words)), 0
    for level, bits in enumerate(levels):
        at = _place(words[left], level, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits)
        out[left[hit]] = base + rank[at[hit]] - 1
        base += int(rank[-1])
        left = left[~hit]
    return out


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _longs(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    words = _words(table.column("digest"))
    levels = perfect_hash(words)
    order = pa.array(np.argsort(slots(levels, words)))
    lists = {c: [_longs(table, c).take(order).to_pylist()] for c in ("doc_id", "n_chars", "n")}
    return pa.table(
        {
            "shard": pa.array([key[0].as_py()], pa.int64()),
            "sizes": pa.array([[len(b) for b in levels]], pa.list_(pa.int64())),
            "bits": pa.array([np.packbits(np.concatenate(levels)).tobytes()], pa.binary()),
            "digests": pa.array([words[order.to_numpy()].tobytes()], pa.binary()),
            **{c: pa.array(v, pa.list_(pa.int64())) for c, v in lists.items()},
        }
    )


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n))


def build_index(history: DataFrame, incoming: int = 0) -> tuple[DataFrame, int]:
    """The index over ``digests`` rows, one row per shard, and its number of shards.

    A slot holds the full digest and its winner's locator (doc_id, code points) and count.  Shards number by the
    history's distinct digests or by the ``incoming`` rows to be looked up, whichever are more, so neither side of a shard
    grows with the corpus.
    """
    groups = stored(_grouped(history), "digests")
    n = max(1, -(-max(groups.count(), incoming) // SHARD_DIGESTS))
    index = groups.withColumn("shard", _shard(n)).groupBy("shard").applyInArrow(_build, _INDEX)
    return stored(index, "index"), n


def _lookup(key: tuple, index: pa.Table, batch: pa.Table) -> pa.Table:
    """Groups of a shard: members of the index merged into their slots, the others as they are."""
    digest = batch.column("digest").combine_chunks()
    mine = _words(batch.column("digest"))
    if index.num_rows:
        row = index.slice(0, 1).to_pylist()[0]
        cuts = np.cumsum([0, *row["sizes"]])
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
        held = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        at = slots([bits[a:b] for a, b in zip(cuts[:-1], cuts[1:])], mine)
    else:
        row = {"doc_id": [], "n_chars": [], "n": []}
        held, at = np.zeros((0, 4), np.uint64), np.full(len(mine), -1, np.int64)
    member = at >= 0
    member[member] = (held[at[member]] == mine[member]).all(axis=1)
    out = [[h.tobytes(), d, c, n] for h, d, c, n in zip(held, row["doc_id"], row["n_chars"], row["n"])]
    rows = zip(digest.to_pylist(), *[batch.column(c).to_pylist() for c in ("doc_id", "n_chars", "n")])
    rank = lambda d, c: (-c, d is None, d or 0)
    for (h, d, c, n), known, slot in zip(rows, member.tolist(), at.tolist()):
        if not known:
            out.append([h, d, c, n])
            continue
        old = out[slot]
        if rank(d, c) < rank(old[1], old[2]):
            old[1], old[2] = d, c
        old[3] += n
    columns = list(zip(*out)) or [()] * 4
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table({c: pa.array(v, k) for c, v, k in zip(("digest", "keep_id", "n_chars", "n"), columns, kinds)})


def duplicate_groups(history: DataFrame, batch: DataFrame) -> DataFrame:
    """``digest, keep_id, n_chars, n`` of every distinct digest of two tables of ``digests`` rows.

    Spark groups the batch first, so a text with any number of copies is looked up once, and nonmembers are groups of
    their own.  Without any history, or with little, the batch is spread by its own size.
    """
    index, n = build_index(history, batch.count())
    incoming = _grouped(batch).withColumn("shard", _shard(n))
    return index.groupBy("shard").cogroup(incoming.groupBy("shard")).applyInArrow(_lookup, _GROUPS)


def deduplicate(docs: DataFrame, is_history: Column) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, text_key`` of every row of ``docs``.

    Texts are equal when they are identical without white space.  Of equal texts the row with the most code
    points stays, then the smallest doc_id (NULL last).  Rows with ``is_history`` true are indexed, the others looked
    up; the result is the same for any choice.  Rows that share both doc_id and text stand or fall together.
    """
    rows = digests(docs).withColumn("_old", F.coalesce(is_history, F.lit(False)))
    rows = stored(rows, "rows")
    groups = duplicate_groups(rows.filter("_old").drop("_old"), rows.filter("NOT _old").drop("_old"))
    # A text without copies is its own group; only the others need the join.
    several = stored(groups.filter("n > 1"), "groups").withColumnRenamed("n_chars", "most")
    joined = rows.join(several, "digest", "left")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_key",
    )
