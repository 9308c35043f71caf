"""SimHash near-dedup: fingerprints linked within a Hamming distance, found with vantage-point trees."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from leafmeter.llm.common import keyed, slices, stored
from leafmeter.llm.graph import components

SHINGLE = 3
DISTANCE = 3
#: Fingerprints that choose the vantage points of the shards, at most.
SAMPLE = 16_384
#: Fingerprints a shard should own; shards number 1024 at most.
SHARD = 32_000
_LEAF = 64
_PAIRS = 1 << 20

_BYTE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_key, fingerprint`` (the 64 bits as a signed number) of every row's whole text.

    A-Z are lower-cased; shingles of ``shingle`` words, repeats included, joined by one space (the whole sequence if
    there are fewer words) are hashed by XXH64 with seed 42, and a bit is 1 if set in over half of them.  NULL and
    texts without words have fingerprint 0.
    """

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for rows, data, offsets in slices(batch):
                text = data.tobytes().lower()
                bounds = offsets.tolist()
                hashes, counts = [], []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    words = _BYTE_WORD.findall(text, a, b)
                    n = len(words)
                    if n > shingle:
                        joined = b" ".join(words)
                        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
                        starts = np.concatenate([[0], ends[: n - shingle] + 1]).tolist()
                        hashes += [digest(joined[x:y], 42) for x, y in zip(starts, ends[shingle - 1 :].tolist())]
                        counts.append(n - shingle + 1)
                    elif n:
                        hashes.append(digest(b" ".join(words), 42))
                        counts.append(1)
                    else:
                        counts.append(0)
                counts = np.array(counts, np.int64)
                bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                some = np.flatnonzero(counts)
                first = (np.cumsum(counts) - counts)[some]
                out = np.zeros(len(counts), np.uint64)
                if len(some):
                    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
                    major = (2 * ones > counts[some][:, None]).astype(np.uint8)
                    out[some] = np.packbits(major, axis=1, bitorder="little").view("<u8").reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("text_key"), pa.array(out.view(np.int64))],
                    names=["doc_id", "text_key", "fingerprint"],
                )

    return keyed(docs).mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def _far(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def _split(points: np.ndarray, tries: int = 4) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that halve the points best; None if they can't be told apart."""
    best = None
    for v in points[np.linspace(0, len(points) - 1, tries).astype(int)]:
        d = np.sort(_far(points, v))
        radius = int(d[len(d) // 2])
        for r in (radius, radius + 1):
            inside = int(np.searchsorted(d, r))
            worst = min(inside, len(d) - inside)
            if worst and (best is None or worst > best[0]):
                best = worst, v, r
    return best and best[1:]


class Tree:
    """The upper part of a vantage-point tree: inner points lie nearer than the radius to the vantage point."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[np.uint64, int, int, int]] = []
        self.leaves = 0
        self.root = self._grow(sample, leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        """A node's number, or the complement of a leaf's."""
        cut = _split(points) if leaves > 1 and len(points) > 1 else None
        if cut is None:
            self.leaves += 1
            return ~(self.leaves - 1)
        v, r = cut
        inner = _far(points, v) < r
        a = self._grow(points[inner], leaves // 2)
        b = self._grow(points[~inner], leaves - leaves // 2)
        self.nodes.append((v, r, a, b))
        return len(self.nodes) - 1

    def route(self, points: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, leaf, at home): each point's own leaf and every other that can hold one within ``distance``."""
        out = []
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, index, home = todo.pop()
            if not len(index):
                continue
            if node < 0:
                out.append((index, np.full(len(index), ~node), home))
                continue
            v, r, a, b = self.nodes[node]
            d = _far(points[index], v)
            # Whatever lies within the distance of a point differs from it by at most as much seen from v.
            inner, outer = d - distance < r, d + distance >= r
            todo.append((a, index[inner], (home & (d < r))[inner]))
            todo.append((b, index[outer], (home & (d >= r))[outer]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))


def _unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows the least label among them, in place."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(labels, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def linked(points: np.ndarray, own: np.ndarray, distance: int) -> np.ndarray:
    """A label per point, equal for points joined by links between one of ``own`` and any other.

    The rows at home are split by vantage points down to small leaves; a search follows both sides only where
    the triangle bound allows.  Links are folded into labels as they come, so a dense group needs no list of pairs.
    """
    labels = np.arange(len(points))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    todo = [(own, np.arange(len(points)))]
    while todo:
        mine, seekers = todo.pop()
        cut = _split(points[mine]) if len(mine) > _LEAF and len(seekers) > 1 else None
        if cut is None:
            # Rows that can't be told apart further: in blocks against all seekers.
            step = max(1, (1 << 22) // max(1, len(seekers)))
            for i in range(0, len(mine), step):
                block = mine[i : i + step]
                x, y = np.nonzero(_far(points[block][:, None], points[seekers][None, :]) <= distance)
                held.append((block[x], seekers[y]))
                size += len(x)
                if size > _PAIRS:
                    _unite(labels, *map(np.concatenate, zip(*held)))
                    held, size = [], 0
            continue
        v, r = cut
        inside = _far(points[mine], v) < r
        d = _far(points[seekers], v)
        todo.append((mine[inside], seekers[d - distance < r]))
        todo.append((mine[~inside], seekers[d + distance >= r]))
    if held:
        _unite(labels, *map(np.concatenate, zip(*held)))
    return labels


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) over distinct ``fingerprint`` rows whose components are those of all links.

    Vantage points come from a bounded sample; every fingerprint is dealt to its own shard and, as a
    seeker, to each shard whose boundary it is near.  A shard sends a star per local component, not pairs.
    """
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fingerprint")).limit(SAMPLE).collect()
    leaves = min(1024, -(-n // SHARD))
    tree = Tree(np.array([r[0] for r in sample], np.int64).view(np.uint64), leaves)

    def route(batches):
        for batch in batches:
            points = batch.column(0).to_numpy().astype(np.int64)
            index, leaf, home = tree.route(points.view(np.uint64), distance)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int64()), pa.array(points[index], pa.int64()), pa.array(home.astype(bool))],
                names=["shard", "fingerprint", "home"],
            )

    def search(table: pa.Table) -> pa.Table:
        values = table.column("fingerprint").to_numpy().astype(np.int64)
        home = table.column("home").combine_chunks().to_numpy(zero_copy_only=False)
        labels = linked(values.view(np.uint64), np.flatnonzero(home), distance)
        other = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.table({"a": pa.array(values[other]), "b": pa.array(values[labels[other]])})

    dealt = distinct.select("fingerprint").mapInArrow(route, "shard long, fingerprint long, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, text_key, fingerprint, component_id`` of every row.

    Rows whose fingerprints differ in at most ``distance`` bits are linked; ``component_id`` is the smallest doc_id
    that can be reached (NULL only if all reached are NULL).  Equal fingerprints are searched once.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    distinct = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(stored(links(distinct.select("fingerprint"), distance), "links"))
    labelled = distinct.join(found, distinct["fingerprint"] == found["node"], "left").select(
        "fingerprint", "least", F.coalesce("label", "fingerprint").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = stored(labelled.join(least, "label").select("fingerprint", "component_id"), "classes")
    return rows.join(classes, "fingerprint").select("doc_id", "text_key", "fingerprint", "component_id")
