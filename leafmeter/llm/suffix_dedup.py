"""Suffix-array dedup by bucket-pointer refinement: cut byte strings that occur more than once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from leafmeter.llm import recurrence as rec
from leafmeter.llm.common import ByteHashes, counts_of, gathered, keyed, merged, mixed, pair_ids, stored, word_spans

LENGTH = 400
GRAM = 32
BLOCK = 16
#: Segment bytes refined together.
SHARD_BYTES = 1 << 21

_CELLS = "doc_id long, text_key long, lo int, hi int, pos int, begin int, end int, c1 long, c2 long, n long, cell binary"
_CELL_NAMES = [part.split()[0] for part in _CELLS.split(", ")]
_SEGMENTS = "fp long, n long, doc_id long, text_key long, pos int, lo int, hi int, first int, segment binary, end int"


def _phrases(length: int):
    gram = min(GRAM, length)

    def work(rows, data, offsets):
        text = data.tobytes()

        def equal(row, begin, end, shift):
            at = offsets[row]
            return text[at + begin : at + end] == text[at + begin - shift : at + end - shift]

        found = rec.phrases(ByteHashes(data).grams(gram), gram, length, offsets)
        return rec.phrase_batch(rows, rec.runs(found, length, equal))

    return work


def _segments(length: int, keep_first: bool):
    """For every marked phrase the bytes of the windows that hold it, widened to whole blocks; for a run these at its
    first place, and without ``segment`` the range from ``first`` to ``end`` that its repeated windows cover, with
    ``keep_first`` from its second place on."""

    def work(rows, data, offsets):
        row = rec.list_rows(rows, "fp")
        pos, lo, hi, step, run = (rec.listed(rows, c).astype(np.int64) for c in ("pos", "lo", "hi", "step", "run"))
        fp, n = rec.listed(rows, "fp"), rec.listed(rows, "n")
        first = np.maximum(0, pos - BLOCK * (hi // BLOCK + 1))
        last = np.minimum(np.diff(offsets)[row], pos - BLOCK * (lo // BLOCK) + length)

        def batch(some, first, segment, end):
            take = pa.array(row[some])
            return pa.RecordBatch.from_arrays(
                [pa.array(fp[some], pa.int64()), pa.array(n[some], pa.int64())]
                + [rows.column("doc_id").take(take), rows.column("text_key").take(take)]
                + [pa.array(x[some], pa.int32()) for x in (pos, lo, hi, first)]
                + [segment, end],
                names=["fp", "n", "doc_id", "text_key", "pos", "lo", "hi", "first", "segment", "end"],
            )

        for some, segment in rec.cut_texts(data.tobytes(), offsets[row] + first, offsets[row] + last):
            yield batch(some, first, segment, pa.nulls(len(segment), pa.int32()))
        some = np.flatnonzero(run)
        if len(some):
            end = pa.array((pos + run - lo + length)[some], pa.int32())
            begin = pos - hi + step if keep_first else pos - hi
            yield batch(some, begin, pa.nulls(len(some), pa.binary()), end)

    return work


def refined_buckets(blocks: np.ndarray, odd: np.ndarray, depth: int) -> np.ndarray:
    """Bucket numbers of the strings of ``depth`` blocks from every block on.

    The first buckets are the blocks themselves; each round sorts on the pair of a bucket and the bucket found one
    length further on, so a round doubles the length and reuses the last round's numbers.  ``odd``
    blocks are incomplete and equal none.  The last ``depth - 1`` places have no meaning.
    """
    halves = np.unique(blocks.reshape(-1), return_inverse=True)[1].reshape(-1, 2)
    ids = pair_ids(halves[:, 0], halves[:, 1])
    ids[odd] = len(ids) + np.arange(int(odd.sum()))
    return ids, _lengthened(ids, depth)


def _lengthened(ids: np.ndarray, depth: int) -> np.ndarray:
    known, size, total, have = ids, 1, None, 0
    while True:
        if depth & size:
            if total is None:
                total, have = known, size
            else:
                total = pair_ids(known, np.append(total[size:], np.zeros(size, total.dtype)))
                have += size
        if have == depth:
            return total
        known = pair_ids(known, np.append(known[size:], np.zeros(size, known.dtype)))
        size *= 2


def _places(table: pa.Table) -> np.ndarray:
    """Numbers of the rows by (doc_id, text_key, pos); repeated rows have the same."""
    columns = []
    for c in ("doc_id", "text_key", "pos"):
        column = table.column(c).combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
        columns.append(column.is_null().to_numpy(zero_copy_only=False))
        columns.append(column.fill_null(0).to_numpy(zero_copy_only=False))
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _later(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows with the id of a row at an earlier place."""
    first = np.full(int(ids.max()) + 1 if len(ids) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, ids, place)
    return place > first[ids]


def _refine(length: int, keep_first: bool):
    """Repeated windows among the segments of a shard, by exact comparison of buckets; with ``keep_first`` those that have
    an equal one at an earlier place.

    Segments of one phrase are aligned at it.  A cell is the ``BLOCK`` windows that start in one block: they
    share the core of whole blocks, and lie in the core with the block before and after.  A core
    in a bucket of its own has no repeats; a repeated union repeats all its windows; other cells are refined
    byte by byte with the bucket of their core.
    """
    depth = length // BLOCK - 1

    def shard(table: pa.Table) -> pa.RecordBatch:
        pos, lo, hi, first = (table.column(c).to_numpy().astype(np.int64) for c in ("pos", "lo", "hi", "first"))
        fp = np.unique(table.column("fp").to_numpy(), return_inverse=True)[1]
        low = -(hi // BLOCK + 1)  # first block, counted from the phrase
        count = depth + 1 - lo // BLOCK - low
        base = np.concatenate([[0], np.cumsum(count)])
        before = first - (pos + BLOCK * low)
        parts, odd = [], np.zeros(base[-1], bool)
        for k, segment in enumerate(table.column("segment").to_pylist()):
            size = int(count[k]) * BLOCK
            left = int(before[k])
            right = size - left - len(segment)
            parts.append(b"\0" * left + segment + b"\0" * right)
            if left:
                odd[base[k] : base[k] + -(-left // BLOCK)] = True
            if right:
                odd[base[k + 1] - -(-right // BLOCK) : base[k + 1]] = True
        place = _places(table) if keep_first else None

        def recurring(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
            return _later(ids, place[row]) if keep_first else counts_of(ids) > 1

        blocks = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)
        ids, cores = refined_buckets(blocks, odd, depth)

        cells = hi // BLOCK - lo // BLOCK + 1
        row = np.repeat(np.arange(len(pos)), cells)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells) + (lo // BLOCK)[row]
        at = base[row] - cell - low[row]
        key = pair_ids(pair_ids(fp[row], cell), cores[at])
        hot = np.flatnonzero(table.column("hot").to_numpy(zero_copy_only=False)[row])
        if len(hot):
            union = pair_ids(pair_ids(key[hot], ids[at[hot] - 1]), ids[at[hot] + depth])
            if keep_first:
                early = np.argsort(place[row[hot]], kind="stable")
                hot, union = hot[early], union[early]
            _, one, n = np.unique(union, return_index=True, return_counts=True)
            one = hot[one]
            start = BLOCK * at[one]
            text = blocks.view(np.uint8).reshape(-1)
            side = np.stack([table.column("fp").to_numpy()[row[one]].view(np.uint64), cell[one].astype(np.uint64)])
            core = [
                mixed(ByteHashes(text, seed).of(start, start + BLOCK * depth) ^ mixed(side[0] + side[1])).view(np.int64)
                for seed in (1, 2)
            ]
            open_cells = at[one], core, n, cell[one]
            hot = row[one]
        keep = np.flatnonzero(counts_of(key) > 1)
        row, cell, at, key = row[keep], cell[keep], at[keep], key[keep]
        union = pair_ids(pair_ids(key, ids[at - 1]), ids[at + depth])
        whole = recurring(union, row)
        found = [(row[whole], pos[row[whole]] - BLOCK * cell[whole] - BLOCK + 1, np.full(int(whole.sum()), length + BLOCK - 1))]
        # Cells whose core recurs: all stay as partners, the undecided among them get their answers here.
        byte = np.arange(BLOCK)
        for s in range(BLOCK):
            distance = BLOCK * cell + s
            some = np.flatnonzero((distance >= lo[row]) & (distance <= hi[row]))
            if not len(some):
                continue
            mask = np.where(byte >= BLOCK - s, 255, 0).astype(np.uint8).view(np.uint64)
            ends = (blocks[at[some] - 1] & mask) | (blocks[at[some] + depth] & ~mask)
            window = key[some]
            for half in (0, 1):
                window = pair_ids(window, np.unique(ends[:, half], return_inverse=True)[1])
            repeated = some[recurring(window, row[some])]
            found.append((row[repeated], pos[row[repeated]] - distance[repeated], np.full(len(repeated), length)))
        row, begin, size = (np.concatenate([f[i] for f in found]) for i in range(3))
        row, begin, end = merged(row, begin, begin + size)
        spans = len(row)
        if len(hot):
            # One row per distinct union of a hot phrase's cells, for comparison with other shards.
            at, core, n, edge = open_cells
            row = np.concatenate([row, hot])
            begin = np.concatenate([begin, pos[hot] - BLOCK * edge - BLOCK])
            end = np.concatenate([end, pos[hot] - BLOCK * edge + length])
        chosen = table.select(["doc_id", "text_key", "lo", "hi", "pos"]).take(pa.array(row)).combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in chosen.columns]
        if len(hot):
            text = blocks.view(np.uint8).reshape(-1).tobytes()
            unions = [text[BLOCK * (i - 1) : BLOCK * (i + depth + 1)] for i in at.tolist()]
            extra = [core[0], core[1], n]
        else:
            unions, extra = [], [np.zeros(0, np.int64)] * 3
        none = [None] * spans
        return pa.RecordBatch.from_arrays(
            columns
            + [pa.array(begin, pa.int32()), pa.array(end, pa.int32())]
            + [pa.array(none + x.tolist(), pa.int64()) for x in extra]
            + [pa.array(none + unions, pa.binary())],
            names=_CELL_NAMES,
        )

    limit = SHARD_BYTES

    def run(batches):
        for table in gathered(batches, "bucket", limit, "segment"):
            yield shard(table)

    return run


def _windows(length: int):
    """The windows of cells as two 64-bit hashes each."""

    def run(batches):
        for batch in batches:
            lo, hi, pos, begin = (batch.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "pos", "begin"))
            text = np.frombuffer(b"".join(batch.column("cell").to_pylist()), np.uint8)
            # Window starts 1 to BLOCK of a cell, as far as their phrase is the cell's.
            row = np.repeat(np.arange(len(pos)), BLOCK)
            start = np.tile(np.arange(1, BLOCK + 1), len(pos))
            distance = pos[row] - begin[row] - start
            keep = (distance >= lo[row]) & (distance <= hi[row])
            row, start = row[keep], start[keep]
            a = row * (length + BLOCK) + start
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ByteHashes(text, seed).of(a, a + length).view(np.int64)) for seed in (1, 2)]
                + [batch.column(c).take(take) for c in ("doc_id", "text_key", "n")]
                + [pa.array(begin[row] + start, pa.int32())],
                names=["h1", "h2", "doc_id", "text_key", "n", "begin"],
            )

    return run


def repeated_strings(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """Byte ranges ``(doc_id, text_key, begin, end)`` covered by a string of ``length`` bytes that starts at
    two places or more of the corpus, overlapping ones in one document included.

    ``length`` must be a multiple of 16 and at least 64.  Sampled suffixes (32-byte grams chosen by content)
    are counted over all documents; text around recurring grams is dealt by gram, and buckets of equal grams
    are refined exactly inside tasks.  A gram at over ``recurrence.HOT`` places is dealt over several shards; each
    then sends its distinct cells, whose cores and windows Spark counts by 128-bit hash.  Places in periodic text
    (``recurrence.runs``) repeat each other and count as one.

    With ``keep_first`` only strings that also start at an earlier place (smaller doc_id, or earlier in the document;
    NULL doc_id last) are covered.  Repeated rows are one document then.
    """
    if length % BLOCK or length < 4 * BLOCK:
        raise ValueError("length must be a multiple of 16 and at least 64")
    base = keyed(docs)
    found = rec.map_slices(base, _phrases(length), rec.PHRASES)
    segments = stored(rec.map_slices(rec.marked_documents(base, found), _segments(length, keep_first), _SEGMENTS), "segments")
    runs = segments.filter("segment IS NULL").withColumn("begin", F.col("first"))
    segments = segments.filter("segment IS NOT NULL").drop("end")
    found = stored(rec.dealt(segments, "pos").mapInArrow(_refine(length, keep_first), _CELLS), "strings")
    # Hot phrases: cells whose core recurs anywhere, then their windows.
    cells = found.filter("cell IS NOT NULL")
    cores = cells.groupBy("c1", "c2").agg(F.sum("n").alias("total")).filter("total > 1").drop("total")
    windows = stored(
        cells.join(cores, ["c1", "c2"], "left_semi").mapInArrow(
            _windows(length), "h1 long, h2 long, doc_id long, text_key long, n long, begin int"
        ),
        "windows",
    )
    if keep_first:
        at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "begin")
        first = windows.groupBy("h1", "h2").agg(F.min(at).alias("first"))
        far = windows.join(first, ["h1", "h2"]).filter(at > F.col("first"))
    else:
        often = windows.groupBy("h1", "h2").agg(F.sum("n").alias("total")).filter("total > 1").drop("total")
        # Windows that repeat within their shard are found already.
        far = windows.filter("n = 1").join(often, ["h1", "h2"], "left_semi")
    columns = ["doc_id", "text_key", "begin", "end"]
    far = far.withColumn("end", F.col("begin") + length)
    return found.filter("cell IS NULL").select(columns).unionByName(far.select(columns)).unionByName(runs.select(columns))


def remove_strings(
    docs: DataFrame, length: int = LENGTH, carry: bool = False, keep_first: bool = False, least_words: int = 0
) -> DataFrame:
    """Documents without bytes of repeated strings: ``doc_id, text_key, n_bytes, removed, kept``, and with ``carry``
    the other columns in the struct ``row``.

    ``removed`` lists the maximal (begin, end) byte ranges taken out, ``kept`` is the rest as binary (a
    cut may fall inside a character).  One row per input row, NULL text counting as empty; repeated rows are
    documents of their own, so texts of at least ``length`` bytes in them repeat each other.

    With ``keep_first`` the earliest place of a string stays (``repeated_strings``).  With ``least_words`` a range goes
    only if it touches that many words or has at least ``LENGTH`` bytes.
    """
    joined = rec.with_spans(keyed(docs, carry), repeated_strings(docs, length, keep_first))
    extra = ["row"] if carry else []

    def work(rows, data, offsets):
        row = rec.list_rows(rows, "spans")
        values = rows.column("spans").flatten()
        begin, end = (values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        row, begin, end = merged(row, begin, end)
        if least_words and len(row):
            starts, ends, _ = word_spans(data, offsets)
            words = np.searchsorted(starts, end + offsets[row]) - np.searchsorted(ends, begin + offsets[row], side="right")
            long = (words >= least_words) | (end - begin >= LENGTH)
            row, begin, end = row[long], begin[long], end[long]
        text = data.tobytes()
        cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
        kept = []
        for k in range(rows.num_rows):
            own = text[offsets[k] : offsets[k + 1]]
            at, pieces = 0, []
            for i in range(cut[k], cut[k + 1]):
                pieces.append(own[at : begin[i]])
                at = end[i]
            kept.append(b"".join([*pieces, own[at:]]))
        removed = pa.ListArray.from_arrays(
            pa.array(cut, pa.int32()),
            pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["begin", "end"]),
        )
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("text_key"), pa.array(np.diff(offsets)), removed, pa.array(kept, pa.binary())]
            + [rows.column(c) for c in extra],
            names=["doc_id", "text_key", "n_bytes", "removed", "kept", *extra],
        )

    schema = "doc_id long, text_key long, n_bytes long, removed array<struct<begin:int,end:int>>, kept binary"
    fields = T.StructType([*T.StructType.fromDDL(schema).fields, *[joined.schema[c] for c in extra]])
    return rec.map_slices(joined, work, fields)
