"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from leafmeter.llm.common import SLICE_BYTES, keyed, mixed, ragged, rolled, slices

SHINGLE = 5
CONTAINMENT = 0.8
#: A passage that is there is missed by the bands with at most this probability.
MISS = 1e-6
#: Bytes of all templates together, which every task holds.
TEMPLATE_BYTES = 1 << 22

# Notices by which public licenses are applied to a work.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    " associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions"
    " and the following disclaimer.",
}

#: Whole public licenses and the headers by which they are applied, a file each.
LICENSES = Path(__file__).parent / "licenses"

_MOST = np.uint64(2**64 - 1)
_WORD = re.compile(r"\w+")
_SCHEMA = "doc_id long, text_key long, license string, containment double, n_passages long, begin int, end int"


@cache
def all_templates() -> dict[str, str]:
    """The notices above and the whole texts and headers in ``LICENSES``, by file name."""
    return TEMPLATES | {path.stem: path.read_text() for path in sorted(LICENSES.glob("*.txt"))}


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(_WORD.finditer(text.lower()))
    return [m.group() for m in found], [m.span() for m in found]


class Class:
    """Templates with the same shingle length and block size.

    Windows are two neighbouring blocks of ``block`` shingles, so any stretch as long as a template lies in one.
    ``bands`` is set so that a stretch with the demanded containment collides in one with probability 1 - MISS.
    """

    def __init__(self, shingle: int, block: int, templates: list[tuple[str, list[str]]]):
        self.shingle, self.block = shingle, block
        self.templates = []
        least = 1.0
        for name, words in templates:
            grams = [tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
            need = math.ceil(CONTAINMENT * len(set(grams)))
            least = min(least, need / (2 * block + len(set(grams)) - need))
            self.templates.append((name, len(grams), frozenset(grams), need))
        self.bands = max(1, math.ceil(math.log(MISS) / math.log(1 - least))) if least < 1 else 1
        r = np.random.default_rng(11)
        self.factors = r.integers(0, 2**63, self.bands).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        hashes = [rolled(word_hashes(words, {}), shingle) for _, words in templates]
        self.signatures = np.array([[(h * f).min() for h in hashes] for f in self.factors], np.uint64)
        #: The shingles that give the templates' least values: a window that shares a band holds one of them.
        self.shingles = np.unique([h[(h * f).argmin()] for h in hashes for f in self.factors])

    def candidates(self, hashes: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
        """Per template the first shingles of all windows that share a band with it.

        ``places`` are those of ``hashes`` that may be in ``shingles``; only blocks with one, and their neighbours, are worked out.
        """
        found = [[] for _ in self.templates]
        own = places[np.isin(hashes[places], self.shingles)] // self.block
        if not len(own):
            return [np.zeros(0, np.int64) for _ in self.templates]
        bounds = np.append(np.arange(0, len(hashes), self.block), len(hashes))
        near = np.unique(np.concatenate([own - 1, own, own + 1]))
        near = near[(near >= 0) & (near < len(bounds) - 1)]
        inside, sizes = ragged(hashes, bounds, near)
        first = np.cumsum(sizes) - sizes
        joined = near[1:] == near[:-1] + 1
        for factor, signature in zip(self.factors, self.signatures):
            least = np.minimum.reduceat(inside * factor, first)
            window = np.minimum(least, np.append(np.where(joined, least[1:], _MOST), _MOST))
            for k, value in enumerate(signature):
                hit = near[window == value]
                if len(hit):
                    found[k].append(hit)
        return [np.unique(np.concatenate(f)) * self.block if f else np.zeros(0, np.int64) for f in found]


class Screen:
    """Finds the places that hold a shingle which any class of one shingle length asks for."""

    _SHIFT = np.uint64(44)

    def __init__(self, groups: list[Class]):
        self.shingles = np.unique(np.concatenate([g.shingles for g in groups]))
        # By their upper 20 bits first: one look-up a shingle.
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.shingles >> self._SHIFT).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(self.table[(hashes >> self._SHIFT).astype(np.int64)])
        return some[np.isin(hashes[some], self.shingles)]


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, 5)
    return mixed(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))


def classes(templates: dict[str, str]) -> list[Class]:
    if sum(len(t.encode()) for t in templates.values()) > TEMPLATE_BYTES:
        raise ValueError("templates are too large to be held by every task; scan with parts of them")
    groups = defaultdict(list)
    for name, text in sorted(templates.items()):
        words = words_of(text)[0]
        if words:
            shingle = min(SHINGLE, len(words))
            block = 1 << (len(words) - shingle).bit_length()
            groups[shingle, block].append((name, words))
    return [Class(shingle, block, found) for (shingle, block), found in sorted(groups.items())]


def stretches(grams: list[tuple], wanted: frozenset, size: int, need: int) -> list[tuple[int, int]]:
    """(first gram, distinct wanted grams) of every ``size`` neighbouring grams with ``need`` wanted ones or more."""
    out, inside, distinct = [], defaultdict(int), 0
    for i, gram in enumerate(grams):
        if gram in wanted:
            inside[gram] += 1
            distinct += inside[gram] == 1
        if i >= size and grams[i - size] in wanted:
            old = grams[i - size]
            inside[old] -= 1
            distinct -= inside[old] == 0
        if distinct >= need and (i >= size - 1 or i == len(grams) - 1):
            out.append((max(0, i - size + 1), distinct))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document and license found in it: the largest share of a template's shingles in any stretch of as
    many shingles, the number of passages (overlapping stretches united), and the code points of the first
    one in the lower-cased text.  ``templates`` (name: text) are ``all_templates()`` by default.

    Words are compared without case and punctuation; shingles have five words (a shorter template is one
    shingle), and a share of 0.8 or more counts.  NULL and empty texts have no rows; repeated rows each have theirs.
    """
    groups = classes(all_templates() if templates is None else templates)
    lengths = {g.shingle for g in groups}
    screens = {k: Screen([g for g in groups if g.shingle == k]) for k in lengths}

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            for rows, _, _ in slices(batch, SLICE_BYTES):
                if len(known) > 300_000:
                    known.clear()
                texts = rows.column("text").to_pylist()
                words = [_WORD.findall(t.lower()) for t in texts]
                bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
                values = word_hashes([w for one in words for w in one], known)
                yield _verified(rows, texts, words, bounds, values, groups, screens)

    return keyed(docs).mapInArrow(run, _SCHEMA)


def _verified(rows, texts, words, bounds, values, groups, screens) -> pa.RecordBatch:
    out = []
    hashes = {shingle: rolled(values, shingle) for shingle in screens}
    places = {shingle: screen.places(hashes[shingle]) for shingle, screen in screens.items()}
    for group in groups:
        # Windows over the texts end to end; what crosses a border is sorted out by the exact check.
        for k, begin in enumerate(group.candidates(hashes[group.shingle], places[group.shingle])):
            name, size, wanted, need = group.templates[k]
            per_row = defaultdict(dict)
            last = np.minimum(begin + 2 * group.block + group.shingle - 2, len(values) - 1)
            ranges = zip(begin.tolist(), np.searchsorted(bounds, begin, side="right").tolist(), np.searchsorted(bounds, last, side="right").tolist())
            for at, a, b in ranges:
                for row in range(a - 1, b):
                    low = max(0, at - int(bounds[row]))
                    high = min(len(words[row]), at - int(bounds[row]) + 2 * group.block + group.shingle - 1)
                    own = words[row][low:high]
                    grams = [tuple(own[i : i + group.shingle]) for i in range(len(own) - group.shingle + 1)]
                    for i, n in stretches(grams, wanted, size, need):
                        stop = min(low + i + size, low + len(grams))
                        per_row[row][low + i] = max(per_row[row].get(low + i, (0, 0)), (n, stop))
            for row, found in per_row.items():
                passages, best = [], 0
                for first in sorted(found):
                    n, stop = found[first]
                    best = max(best, n)
                    stop += group.shingle - 1
                    if passages and first <= passages[-1][1]:
                        passages[-1][1] = max(passages[-1][1], stop)
                    else:
                        passages.append([first, stop])
                spans = words_of(texts[row])[1]
                first, stop = passages[0]
                out.append((row, name, best / len(wanted), len(passages), spans[first][0], spans[stop - 1][1]))
    take = pa.array([o[0] for o in out], pa.int64())
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id").take(take), rows.column("text_key").take(take)]
        + [pa.array([o[i + 1] for o in out], kind) for i, kind in enumerate(kinds)],
        names=["doc_id", "text_key", "license", "containment", "n_passages", "begin", "end"],
    )
