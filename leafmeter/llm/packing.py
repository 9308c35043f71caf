"""Shortest-pack-first packing over the length histogram."""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leafmeter.llm.common import SLICE_BYTES, keyed, slices, stored

SIZE = 2048
END = 1
#: Groups into which the documents of one length are dealt to number them.
PARTS = 1024
#: White-space runs of this many characters go to the ``tokenizers`` library: near a million, the pattern's look-ahead
#: overflows the stack of ``tiktoken``.
LONG_RUN = 100_000
#: Characters after which a text is cut at the next place that no token can span.
SLICE = 1 << 19

_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = "doc_id long, text_key long, start long, length long, ids binary, doc_tokens long"


def byte_vocabulary(content: dict) -> dict[bytes, int]:
    """Bytes and ids of all ordinary tokens of a byte-level ``tokenizers`` file, whose ids follow the merges."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(hidden)}
    special = {t["content"] for t in content["added_tokens"]}
    vocabulary = content["model"]["vocab"]
    return {bytes(byte_of[c] for c in token): number for token, number in vocabulary.items() if token not in special}


def encoder(tokenizer: str, pattern: str) -> Callable[[str], Iterator[list[int]]]:
    """The ids of a text, in bounded lists, as the ``tokenizers`` library finds them without adding special tokens.

    The library splits a text at the strings of added tokens first, so these become their ids.  What lies between
    is encoded by ``tiktoken``, cut before white space that follows another character, where no token goes on; very
    long white space by the library itself, cut between bytes that no token holds side by side (a run without such
    a place, as of line breaks, goes whole).
    """
    import tiktoken

    with open(tokenizer, encoding="utf-8") as f:
        content = json.load(f)
    added = {t["content"]: t["id"] for t in content["added_tokens"]}
    if content["normalizer"] or any(t[k] for t in content["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("normalizers and added tokens with conditions are not supported")
    vocabulary = byte_vocabulary(content)
    model = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
    names = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
    long_run, slice_ = LONG_RUN, SLICE
    long = re.compile(f"[{_SPACE}]{{{long_run},}}")
    gap = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
    library = joined = None

    def white(text: str) -> Iterator[list[int]]:
        nonlocal library, joined
        if library is None:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(tokenizer)
            joined = {pair for token in vocabulary for pair in zip(token, token[1:])}
        start = 0
        while start < len(text):
            end = min(start + slice_, len(text))
            while end < len(text) and (text[end - 1].encode()[-1], text[end].encode()[0]) in joined:
                end += 1
            yield library.encode(text[start:end], add_special_tokens=False).ids
            start = end

    def words(text: str) -> Iterator[list[int]]:
        start = 0
        while len(text) - start > slice_ and (found := gap.search(text, start + slice_)):
            yield model.encode_ordinary(text[start : found.start()])
            start = found.start()
        yield model.encode_ordinary(text[start:])

    def ordinary(text: str) -> Iterator[list[int]]:
        start = 0
        if len(text) >= long_run:
            for found in long.finditer(text):
                # The last white space before a word may belong to it.
                end = found.end() - (found.end() < len(text))
                yield from words(text[start : found.start()])
                yield from white(text[found.start() : end])
                start = end
        yield from words(text[start:])

    def encode(text: str) -> Iterator[list[int]]:
        start = 0
        for found in names.finditer(text):
            yield from ordinary(text[start : found.start()])
            yield [added[found.group()]]
            start = found.end()
        yield from ordinary(text[start:])

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, pattern: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Token ids of whole texts, cut into pieces of ``size`` ids and a rest: ``doc_id, text_key, start,
    length, ids, doc_tokens``, with ids as little-endian unsigned 32-bit numbers.

    ``tokenizer`` is the path of a byte-level ``tokenizers`` file and ``pattern`` splits text before its merges.
    The strings of added tokens become their ids, as in the library.  Every text, NULL and empty ones too, gets
    ``end`` as its last id, so every row has a piece.
    """

    def run(batches):
        encode = encoder(tokenizer, pattern)

        def ids(text):
            return np.concatenate([*(np.array(part, "<u4") for part in encode(text)), np.array([end], "<u4")])

        for batch in batches:
            for rows, _, _ in slices(batch, SLICE_BYTES):
                found = [ids(t) for t in rows.column("text").to_pylist()]
                yield _cut(rows, np.concatenate(found).tobytes(), np.cumsum([len(f) for f in found]), size)

    return keyed(docs).mapInArrow(run, _PIECES)


def _cut(rows: pa.RecordBatch, ids: bytes, ends: np.ndarray, size: int) -> pa.RecordBatch:
    total = np.diff(ends, prepend=0)
    count = -(-total // size)
    row = np.repeat(np.arange(len(total)), count)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
    length = np.minimum(size, total[row] - start)
    at = 4 * ((ends - total)[row] + start)
    take = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id").take(take), rows.column("text_key").take(take), pa.array(start), pa.array(length)]
        + [pa.array([ids[a : a + n] for a, n in zip(at.tolist(), (4 * length).tolist())], pa.binary()), pa.array(total[row])],
        names=["doc_id", "text_key", "start", "length", "ids", "doc_tokens"],
    )


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns with their counts: (how many sequences, lengths in each).

    Lengths are placed longest first into the shortest packs; where none has room new packs are opened, each
    with as many of the length as fit.
    Only counts are kept, so the work depends on the number of lengths (at most ``size``), not on the corpus.
    """
    packs: dict[int, list[list]] = defaultdict(list)
    gaps: list[int] = []

    def add(gap: int, count: int, lengths: tuple[int, ...]) -> None:
        if not packs[gap]:
            heapq.heappush(gaps, -gap)
        packs[gap].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while gaps and not packs[-gaps[0]]:
                heapq.heappop(gaps)
            widest = -gaps[0] if gaps else 0
            if widest < length:
                fit = size // length
                for n, k in ((left // fit, fit), (1, left % fit)):
                    if n and k:
                        add(size - k * length, n, (length,) * k)
                break
            pattern = packs[widest][-1]
            n = min(left, pattern[0])
            pattern[0] -= n
            if not pattern[0]:
                packs[widest].pop()
            add(widest - length, n, (*pattern[1], length))
            left -= n
    return [(n, lengths) for found in packs.values() for n, lengths in found]


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Columns: length, first rank, first sequence, offset; the ranks of a length go to its places in turn."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for n, lengths in sorted(patterns, key=lambda p: (-sum(p[1]), p[1])):
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, text_key, start, length``.

    Every row of 1 to ``size`` units lies in exactly one sequence, gapless from offset 0.  Pieces of a length
    are interchangeable: they are numbered (by parts, so that a frequent length never lies in one task) and the
    number selects the place among the planned patterns.
    """
    pieces = stored(pieces, "pieces").withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_key", "start"), F.lit(PARTS)))
    per_part = pieces.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    per_part = stored(per_part.withColumn("_before", F.coalesce(before, F.lit(0))), "lengths")
    # At most ``size`` rows.
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(histogram, size))
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "text_key", "start")
    ranked = (
        pieces.withColumn("_own", F.row_number().over(own))
        .join(per_part.drop("n"), ["length", "_part"])
        .withColumn("_rank", F.col("_before") + F.col("_own") - 1)
        .drop("_before", "_own", "_part")
        .select(*pieces.drop("_part").columns, "_rank")
    )

    # One sorted key per slot: ranks of a length are below 2**48.
    keys = (slots[:, 0] << 48) | slots[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            at = slots[np.searchsorted(keys, (length << 48) | rank, side="right") - 1] if len(length) else slots[:0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    fields = ", ".join(f"{c} {kind}" for c, kind in ranked.drop("_rank").dtypes)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")
