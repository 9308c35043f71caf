"""Candidate search for repeated windows of fixed length, over words or bytes.

Every window (20 words, 400 bytes) has one phrase: the short gram with the least hash in it, the
rightmost of equals.  The phrase depends on the window's content alone, so equal windows have equal phrases at
equal distance, and a window can only repeat where its phrase does.  Phrases are few (one per about
half a window), so counting them and keeping those that recur leaves exactly the text in which
repeats can lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from leafmeter.llm.common import same_document, sliding_least, slices, stored

PHRASES = "fp long, doc_id long, text_key long, pos int, lo int, hi int, step int, run int"
_PLACES = ("pos", "lo", "hi", "step", "run")
_ARROW = pa.schema([(c, pa.int64()) for c in ("fp", "doc_id", "text_key")] + [(c, pa.int32()) for c in _PLACES])
#: Phrases at more places than this are dealt over several groups, which Spark then compares.
HOT = 1500
#: Units of a document whose places of a hot phrase go to one group.
STRETCH = 1024
#: Segment bytes in one batch.
BATCH_BYTES = 1 << 22
_PLACE = 28


def phrases(grams: np.ndarray, gram: int, window: int, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of rows that lie end to end: row, gram hash, place in the row, least and largest distance from
    a window's start to its phrase.  ``offsets`` are the rows' first units; rows of under ``window`` units have none."""
    n = int(offsets[-1])
    if n >> _PLACE:
        raise ValueError(f"texts of over {1 << _PLACE} units are not supported")
    starts = max(0, n - window + 1)
    if not starts:
        return (np.zeros(0, np.int64),) * 5
    mask = np.uint64((1 << _PLACE) - 1)
    keys = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    chosen = (mask - (sliding_least(keys, window - gram + 1) & mask)).astype(np.int64)
    # A window must end in the row in which it starts.
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    valid = np.flatnonzero(np.arange(starts) + window <= offsets[row + 1])
    if not len(valid):
        return (np.zeros(0, np.int64),) * 5
    chosen, row = chosen[valid], row[valid]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(valid)]]) - 1
    at = chosen[first]
    return row[first], grams[at].view(np.int64), at - offsets[row[first]], at - valid[last], at - valid[first]


def runs(found: tuple[np.ndarray, ...], window: int, equal: Callable[[int, int, int, int], bool]) -> tuple[np.ndarray, ...]:
    """Places as ``phrases`` finds them, those of a run united: the first of it, with the distance to its second place
    (``step``) and to its last (``run``); both 0 where a place stands alone.

    In a run the windows around each place of a phrase are those around the place before, at most a window further on, so
    that the windows of a run cover one range.  Periodic text is one run per phrase of its period.
    ``equal(row, begin, end, shift)`` compares units of a row with those ``shift`` before them.
    """
    row, fp, pos, lo, hi = found
    order = np.lexsort((pos, hi, lo, fp, row))
    row, fp, pos, lo, hi = (x[order] for x in (row, fp, pos, lo, hi))
    follows = np.zeros(len(row), bool)
    follows[1:] = np.diff(pos) <= window
    for x in (row, fp, lo, hi):
        follows[1:] &= x[1:] == x[:-1]
    for i in np.flatnonzero(follows).tolist():
        follows[i] = equal(row[i], pos[i] - hi[i], pos[i] - lo[i] + window, pos[i] - pos[i - 1])
    first = np.flatnonzero(~follows)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    second = np.minimum(first + 1, last)
    return row[first], fp[first], pos[first], lo[first], hi[first], pos[second] - pos[first], pos[last] - pos[first]


def phrase_batch(rows: pa.RecordBatch, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    row, fp, *places = found
    take = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [pa.array(fp, pa.int64()), rows.column("doc_id").take(take), rows.column("text_key").take(take)]
        + [pa.array(x, pa.int32()) for x in places],
        schema=_ARROW,
    )


def marked_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with the phrases of theirs that occur at two places or more: arrays ``fp pos lo hi step run n``; a run
    counts as one place in ``n``."""
    counts = found.groupBy("fp").agg(F.count("*").alias("n"), F.max("run").alias("run"))
    recurring = stored(counts.filter("n > 1 OR run > 0").drop("run"), "recurring")
    # A set: repeated rows bring the same marks.
    marks = stored(
        found.join(recurring, "fp")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct(*_PLACES, "fp", "n")).alias("m"))
        .select("doc_id", "text_key", *[f"m.{c}" for c in (*_PLACES, "fp", "n")]),
        "marks",
    )
    return docs.join(marks, same_document(docs, marks)).select(docs["*"], *_PLACES, "fp", "n")


def dealt(segments: DataFrame, place: str) -> DataFrame:
    """Segments dealt and sorted by ``bucket``: their phrase, or a part of its places if it is ``hot``, by document and
    stretch of ``place``."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.col("n") > HOT
    part = F.pmod(F.xxhash64("doc_id", "text_key", F.floor(F.col(place) / STRETCH)), F.ceil(F.col("n") / HOT))
    bucket = F.when(hot, F.xxhash64("fp", part)).otherwise(F.col("fp"))
    return (
        segments.withColumns({"bucket": bucket, "hot": hot})
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
    )


def listed(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """All elements of a list column, row after row."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def list_rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The row of each element of a list column."""
    return np.repeat(np.arange(batch.num_rows), np.diff(batch.column(name).offsets.to_numpy()))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with ``spans``, the found (begin, end) ranges in any order; NULL where there are none."""
    per_doc = stored(
        spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans"
    )
    return docs.join(per_doc, same_document(docs, per_doc), "left").select(docs["*"], "spans")


def cut_texts(text: bytes, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[slice, pa.Array]]:
    """The pieces ``text[begin:end]`` in bounded batches, each with its place among all."""
    limit = BATCH_BYTES
    group = np.cumsum(end - begin) // limit
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    for x, y in zip(bounds, bounds[1:]):
        if y > x:
            yield slice(x, y), pa.array([text[a:b] for a, b in zip(begin[x:y].tolist(), end[x:y].tolist())], pa.binary())


def map_slices(docs: DataFrame, work: Callable[..., pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``work(rows, bytes, offsets)`` on bounded slices of the documents."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = work(*part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return docs.mapInArrow(run, schema)
