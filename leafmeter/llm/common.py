"""Shared helpers: keyed documents, stored steps, and byte and word arrays of Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmeter.session import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Text handled at once inside a task, so a task's memory does not grow with its partition.
SLICE_BYTES = 1 << 19

_STEP = 0x9E3779B97F4A7C15


def documents_of(spark: SparkSession, folder: str) -> DataFrame:
    """The documents below ``folder``, in a session whose Python workers get small batches of them."""
    small_batches(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by rows and bytes, so that a worker's memory stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 22))


def keyed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """``doc_id``, ``text`` (NULL: empty) and ``text_key``; other columns are left out, or with ``carry`` kept in the
    struct ``row``.

    (doc_id, text_key) names a row for joins, so rows that share a doc_id but not a text stay apart, and
    repeated rows get equal results.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = [docs[c] for c in docs.columns if c.lower() not in ("doc_id", "text")]
    # A struct needs a field; this one's name is longer than any other.
    spare = F.lit(True).alias("_" * (1 + max(map(len, docs.columns))))
    row = [F.struct(*others, spare).alias("row")] if carry else []
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), *row
    )


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on the document key; a NULL doc_id equals a NULL doc_id."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text_key) is not among ``dropped``, with all their columns."""
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), key.alias("text_key"))
    return rows.join(dropped, same_document(rows, dropped), "left_anti").select("row.*")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared scratch folder and read it back, so that lost executors cost no earlier
    step, and let the driver drop the step's shuffle files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    spark.sparkContext._jvm.java.lang.System.gc()
    return spark.read.schema(schema).parquet(path)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch by bytes of ``text``: rows, their UTF-8 bytes end to end, and row offsets into these."""
    column = batch.column("text")
    _, where, content = column.buffers()
    offsets = np.frombuffer(where, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if where else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ByteHashes:
    """64-bit hashes of any byte ranges, from one running sum of (byte value times power of its place)."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        base = int(mixed(np.array([seed * _STEP % 2**64], np.uint64))[0]) | 1
        if base % 4 == 1:
            base ^= 2  # 3 modulo 4 keeps differences of powers from sharing many factors of two
        power, inverse = self._powers(base, len(data) + 1)
        values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed))
        self._inverse = inverse
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * power[: len(data)], out=self._sums[1:])

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        known = cls._tables.get(base)
        if known is None or len(known[0]) < n:
            n = max(n, (1 << 20) + 1)
            back = pow(base, -1, 2**64)
            known = tuple(
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64)
                for b in (base, back)
            )
            if n <= 1 << 22:
                cls._tables[base] = known
        return known

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._inverse[starts])

    def grams(self, q: int) -> np.ndarray:
        n = max(0, len(self._sums) - q)
        return mixed((self._sums[q:] - self._sums[:n]) * self._inverse[:n])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word, and each row's offset into the words (one more than rows)."""
    space = _SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    rows = offsets[:-1][np.diff(offsets) > 0]
    first[rows] = ~space[rows]
    rows = offsets[1:][np.diff(offsets) > 0] - 1
    last[rows] = ~space[rows]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def rolled(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values."""
    n = max(0, len(values) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(_STEP) + values[j : j + n]
    return mixed(total)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive keys."""
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return keys if size == width else np.minimum(keys[: len(keys) - (width - size)], keys[width - size :])


def merged(group: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite overlapping and touching ranges of each group; sorted by group and place."""
    if not len(group):
        return group, begin, end
    order = np.lexsort((begin, group))
    group, begin, end = group[order], begin[order], end[order]
    stride = int(end.max()) + 2
    at = np.unique(group, return_inverse=True)[1] * stride
    reach = np.maximum.accumulate(end + at)
    new = np.concatenate([[True], (begin + at)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return group[first], begin[first], np.maximum.reduceat(end + at, first) - at[first]


def pair_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 for distinct pairs of numbers below 2**32."""
    return np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_inverse=True)[1]


def counts_of(ids: np.ndarray) -> np.ndarray:
    """How often each row's id occurs."""
    return np.bincount(ids)[ids] if len(ids) else ids


def gathered(batches: Iterator[pa.RecordBatch], key: str, limit: int, weight: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` as tables of about ``limit`` bytes of ``weight``, never cutting a key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(weight).nbytes
        if size < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, size = rest.to_batches(), 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def ragged(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``flat[offsets[i]:offsets[i + 1]]`` for every i of ``index`` end to end, and their sizes."""
    size = offsets[index + 1] - offsets[index]
    ends = np.cumsum(size)
    shift = np.repeat(offsets[index] - (ends - size), size)
    return flat[np.arange(len(shift)) + shift], size


class Lists:
    """A growing list of integer lists with a number for each key, such as the token ids of a word."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.number: dict = {}
        self.flat = np.zeros(0, np.int64)
        self.offsets = np.zeros(1, np.int64)

    def add(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        values = np.fromiter((x for one in lists for x in one), np.int64, int(sizes.sum()))
        self.flat = np.concatenate([self.flat, values])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
