"""Repeated-phrase automata: find and remove word passages that occur earlier in the corpus."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafmeter.llm import recurrence as rec
from leafmeter.llm.common import ByteHashes, gathered, keyed, merged, rolled, stored, word_spans

WORDS = 20
GRAM = 5
#: Segment bytes that share one automaton.
SHARD_BYTES = 1 << 20

_BYTE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPANS = "doc_id long, text_key long, begin int, end int"


def _phrases(words: int):
    gram = min(GRAM, words)

    def work(rows, data, offsets):
        starts, ends, first = word_spans(data, offsets)
        grams = rolled(ByteHashes(data).of(starts, ends), gram)
        text = data.tobytes()

        def equal(row, begin, end, shift):
            a, b = first[row] + begin, first[row] + end - 1
            one, other = text[starts[a] : ends[b]], text[starts[a - shift] : ends[b - shift]]
            return one == other or _BYTE_WORD.findall(one) == _BYTE_WORD.findall(other)

        return rec.phrase_batch(rows, rec.runs(rec.phrases(grams, gram, words, first), words, equal))

    return work


def _segments(words: int):
    """For every marked phrase the words of the windows that hold it; for a run these at its first place, and without
    ``segment`` the range that its later windows cover."""

    def work(rows, data, offsets):
        starts, ends, first = word_spans(data, offsets)
        row = rec.list_rows(rows, "fp")
        pos, lo, hi, step, run = (rec.listed(rows, c).astype(np.int64) for c in ("pos", "lo", "hi", "step", "run"))
        fp, n = rec.listed(rows, "fp"), rec.listed(rows, "n")
        begin = pos - hi

        def batch(some, begin, segment, end):
            take = pa.array(row[some])
            return pa.RecordBatch.from_arrays(
                [pa.array(fp[some], pa.int64()), pa.array(n[some], pa.int64())]
                + [rows.column("doc_id").take(take), rows.column("text_key").take(take)]
                + [pa.array(begin[some], pa.int32()), segment, end],
                names=["fp", "n", "doc_id", "text_key", "begin", "segment", "end"],
            )

        a, b = starts[first[row] + begin], ends[first[row] + pos - lo + words - 1]
        for some, segment in rec.cut_texts(data.tobytes(), a, b):
            yield batch(some, begin, segment, pa.nulls(len(segment), pa.int32()))
        some = np.flatnonzero(run)
        if len(some):
            end = pa.array((pos + run - lo + words)[some], pa.int32())
            yield batch(some, begin + step, pa.nulls(len(some), pa.binary()), end)

    return work


def _search(words: int):
    """Confirm the recurring windows of a shard, compile them, and stream its segments through the automaton.

    Results are merged word ranges; for hot phrases also each distinct window's digest and first place.
    """

    def shard(table: pa.Table) -> pa.RecordBatch:
        # In order of (document, place), so that the first sight of a window is its earliest place.
        table = table.sort_by([("doc_id", "ascending"), ("begin", "ascending")], null_placement="at_start").combine_chunks()
        letters: dict[bytes, str] = {}
        texts = []
        segments = table.column("segment").to_pylist()
        for segment in segments:
            found = _BYTE_WORD.findall(segment)
            for word in found:
                if word not in letters:
                    n = len(letters) + 1
                    letters[word] = chr(n if n < 0xD800 else n + 0x800)
            texts.append("".join([letters[word] for word in found]))
        begins = table.column("begin").to_pylist()
        ids = [(-1, 0) if d is None else (0, d) for d in table.column("doc_id").to_pylist()]
        # A window's first place as one number; its complement once the window recurs.
        seen: dict[str, int] = {}
        recurring = ahocorasick.Automaton()
        for k, text in enumerate(texts):
            for i in range(len(text) - words + 1):
                passage, place = text[i : i + words], k << 20 | i
                earliest = seen.setdefault(passage, place)
                if earliest >= 0 and earliest != place:
                    k0, i0 = earliest >> 20, earliest & 0xFFFFF
                    recurring.add_word(passage, (ids[k0], begins[k0] + i0))
                    seen[passage] = ~earliest
        rows, places = [], []
        if len(recurring):
            recurring.make_automaton()
            for k, text in enumerate(texts):
                for last, earliest in recurring.iter(text):
                    place = begins[k] + last - words + 1
                    if (ids[k], place) > earliest:
                        rows.append(k)
                        places.append(place)
        start = np.array(places, np.int64)
        row, begin, end = merged(np.array(rows, np.int64), start, start + words)
        hot = table.column("hot").to_pylist()
        lead_row, lead_begin, lead = [], [], []
        if any(hot):
            names = {letter: word for word, letter in letters.items()}
            for passage, place in seen.items():
                place = place if place >= 0 else ~place
                if hot[place >> 20]:
                    lead_row.append(place >> 20)
                    lead_begin.append(begins[place >> 20] + (place & 0xFFFFF))
                    lead.append(hashlib.blake2b(b" ".join([names[c] for c in passage]), digest_size=16).digest())
        row = np.concatenate([row, np.array(lead_row, np.int64)])
        begin = np.concatenate([begin, np.array(lead_begin, np.int64)])
        end = np.concatenate([end, np.array(lead_begin, np.int64) + words])
        keys = table.select(["doc_id", "text_key"]).take(pa.array(row)).combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], pa.int64()) for c in keys.columns]
        window = pa.array([None] * (len(row) - len(lead)) + lead, pa.binary())
        return pa.RecordBatch.from_arrays(
            columns + [pa.array(begin, pa.int32()), pa.array(end, pa.int32()), window],
            names=["doc_id", "text_key", "begin", "end", "window"],
        )

    limit = SHARD_BYTES

    def run(batches):
        for table in gathered(batches, "bucket", limit, "segment"):
            yield shard(table)

    return run


def repeated_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Word ranges ``(doc_id, text_key, begin, end)`` covered by a window of ``words`` words whose sequence
    starts earlier: at a smaller doc_id, or earlier in the same document.

    Phrases (5-word grams chosen by content) are counted over all documents; the windows around
    recurring ones are routed by phrase, a shard of them at a time is confirmed, compiled into an
    Aho-Corasick automaton whose letters are words, and all its segments are streamed through.  A phrase at
    over ``recurrence.HOT`` places is dealt over several shards; each then sends one row per distinct window,
    and Spark finds the earliest of these.  Places in periodic text (``recurrence.runs``) count as one: the
    windows after the first place repeat its windows.

    NULL doc_id sorts before all others.  Rows that share a doc_id are one place: equal windows at equal
    starts of these are not repeats of each other.
    """
    base = keyed(docs)
    found = rec.map_slices(base, _phrases(words), rec.PHRASES)
    marked = rec.marked_documents(base, found)
    segments = stored(
        rec.map_slices(marked, _segments(words), "fp long, n long, doc_id long, text_key long, begin int, segment binary, end int"),
        "segments",
    )
    runs = segments.filter("segment IS NULL")
    segments = segments.filter("segment IS NOT NULL").drop("end")
    found = stored(rec.dealt(segments, "begin").mapInArrow(_search(words), _SPANS + ", window binary"), "passages")
    place = F.struct("doc_id", "begin")
    leads = found.filter("window IS NOT NULL")
    earliest = leads.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = leads.join(earliest, "window").filter(place > F.col("first"))
    columns = ["doc_id", "text_key", "begin", "end"]
    return found.filter("window IS NULL").select(columns).unionByName(later.select(columns)).unionByName(runs.select(columns))


def remove_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Documents without words of passages that occur earlier: ``doc_id, n_words, removed, kept``.

    ``removed`` lists the (begin, end) word ranges taken out, ``kept`` the other words joined by one space.
    One row per input row; NULL and empty texts have no words and keep the empty text.
    """
    base = keyed(docs)
    joined = rec.with_spans(base, repeated_passages(docs, words))

    def work(rows, data, offsets):
        starts, ends, first = word_spans(data, offsets)
        spans = rows.column("spans")
        row = rec.list_rows(rows, "spans")
        values = spans.flatten()
        begin, end = (values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        row, begin, end = merged(row, begin, end)
        gone = np.zeros(len(starts) + 1, np.int64)
        np.add.at(gone, first[row] + begin, 1)
        np.add.at(gone, first[row] + end, -1)
        keep = np.cumsum(gone)[:-1] == 0
        text = data.tobytes()
        a, b = starts.tolist(), ends.tolist()
        cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
        removed = pa.ListArray.from_arrays(
            pa.array(cut, pa.int32()),
            pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["begin", "end"]),
        )
        kept = []
        for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
            chosen = (np.flatnonzero(keep[x:y]) + x).tolist()
            kept.append(b" ".join([text[a[i] : b[i]] for i in chosen]).decode())
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(np.diff(first), pa.int64()), removed, pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "removed", "kept"],
        )

    return rec.map_slices(joined, work, "doc_id long, n_words long, removed array<struct<begin:int,end:int>>, kept string")
