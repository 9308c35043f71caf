"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmeter.llm.common import SLICE_BYTES, Lists, keyed, ragged, slices

SPACE = "▁"
#: An unknown character scores this much less than the least piece.
UNKNOWN_PENALTY = 10.0
#: Places added to a rank in the law by which ranks become probabilities.
RANK_SHIFT = 2.7
#: Units of more bytes are searched one by one.
SHORT = 64

# Pieces hold the space marker only in front and no line break, so these cuts lose no path.
_UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


@dataclass
class Vocabulary:
    """Pieces and log scores, ids of the 256 byte pieces, and the trie as ``base``, ``check`` and ``value``.

    From node s the child by byte c is t = base[s] + c + 1 if check[t] == s; value[t] is the id of the piece
    that ends there, or -1.
    """

    pieces: list[bytes]
    scores: np.ndarray
    bytes_at: np.ndarray
    usable: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @property
    def unknown(self) -> float:
        return float(self.scores[self.usable].min()) - UNKNOWN_PENALTY


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trie of the keys: a node's children get the next base at which all their places are free."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, number in keys.items():
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][c]
        ends[node] = number
    parent = {0: 0}  # place: the place of its parent
    place = [0] * len(children)
    base = [0] * len(children)
    low = 1
    todo = [0]
    for node in todo:
        own = children[node]
        if not own:
            continue
        first = min(own)
        start, tries = max(low, first + 1), 0
        while start in parent or any(start - first + c in parent for c in own):
            start += 1
            tries += 1
        if tries > 50:
            low = max(low, start - 50)  # the holes left behind are not worth another look
        base[node] = start - first - 1
        for c, child in own.items():
            place[child] = base[node] + c + 1
            parent[place[child]] = place[node]
            todo.append(child)
    # Room for any byte from any node, so that a step never leaves the arrays.
    size = max(parent) + 300
    out = [np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)]
    for node, at in enumerate(place):
        out[0][at], out[1][at], out[2][at] = base[node], parent[at], ends[node]
    return tuple(out)


def rank_log_scores(scores: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Log probabilities of the usable pieces from their order: the r-th best has one in proportion to 1 / (r + RANK_SHIFT).

    A file of merges scores its pieces by rank alone.  Zipf's law turns the ranks into scores that can be added; the
    file stays as it is and nothing is fitted.  Other pieces score 0.  Single precision, as files hold them.
    """
    best = np.flatnonzero(usable)[np.argsort(-scores[usable], kind="stable")]
    weight = np.log(np.arange(len(best)) + RANK_SHIFT)
    out = np.zeros(len(scores))
    out[best] = -weight - np.log(np.exp(-weight).sum())
    return out.astype(np.float32).astype(float)


def load(model: str) -> Vocabulary:
    """The vocabulary of a sentencepiece file that has all 256 byte pieces, with the log scores of the file or, if that holds
    whole numbers as a file of merges does, ``rank_log_scores``."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model)
    n = own.get_piece_size()
    texts = [own.id_to_piece(i) for i in range(n)]
    usable = np.array([not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i)) for i in range(n)])
    bytes_at = np.full(256, -1, np.int64)
    for i in range(n):
        if own.is_byte(i):
            bytes_at[int(texts[i][3:5], 16)] = i
    if (bytes_at < 0).any():
        raise ValueError("the model needs byte pieces")
    scores = np.array([own.get_score(i) for i in range(n)], float)
    if (scores[usable] == np.round(scores[usable])).all():
        scores = rank_log_scores(scores, usable)
    return build([t.encode() for t in texts], scores, bytes_at, usable)


def build(pieces: list[bytes], scores: np.ndarray, bytes_at: np.ndarray, usable: np.ndarray) -> Vocabulary:
    keys = {}
    for i in np.flatnonzero(usable):
        text = pieces[i].decode()
        if SPACE in text.lstrip(SPACE) or "\n" in text:
            raise ValueError(f"piece {i} has a space marker or line break inside")
        keys[pieces[i]] = int(i)
    return Vocabulary(pieces, scores, bytes_at, usable, *double_array(keys))


def _starts(unit: bytes) -> list[bool]:
    return [b & 0xC0 != 0x80 for b in unit]


def best_path(unit: bytes, v: Vocabulary) -> tuple[list[int], float]:
    """Ids and score of the best segmentation of one unit; of equal ones that with the longest last piece.

    A character without a piece of its own may be taken as unknown, and then counts as its bytes.
    """
    n = len(unit)
    first = _starts(unit) + [True]
    base, check, value, scores = v.base, v.check, v.value, v.scores
    best = [float("-inf")] * (n + 1)
    best[0] = 0.0
    last: list[tuple[int, int]] = [(0, -1)] * (n + 1)
    unknown = v.unknown
    for s in range(n):
        if not first[s]:
            continue
        end = s + 1
        while not first[end]:
            end += 1
        node, single = 0, False
        for k in range(s, n):
            t = base[node] + unit[k] + 1
            if check[t] != node:
                break
            node = t
            piece = value[t]
            if piece >= 0:
                single = single or k + 1 == end
                if best[s] + scores[piece] > best[k + 1]:
                    best[k + 1], last[k + 1] = best[s] + scores[piece], (s, int(piece))
        if not single and best[s] + unknown > best[end]:
            best[end], last[end] = best[s] + unknown, (s, -1)
    out: list[int] = []
    at = n
    while at:
        s, piece = last[at]
        out += [piece] if piece >= 0 else [int(v.bytes_at[b]) for b in reversed(unit[s:at])]
        at = s
    return out[::-1], best[n]


def best_paths(units: list[bytes], v: Vocabulary) -> tuple[list[list[int]], np.ndarray]:
    """``best_path`` of many units of at most ``SHORT`` bytes at once: from each place all walk the trie together."""
    size = np.array([len(u) for u in units])
    width = int(size.max(initial=0))
    text = np.zeros((len(units), width + 1), np.int64)
    for i, u in enumerate(units):
        text[i, : len(u)] = np.frombuffer(u, np.uint8)
    first = (text & 0xC0) != 0x80
    best = np.full((len(units), width + 1), -np.inf)
    best[:, 0] = 0.0
    back = np.zeros((len(units), width + 1), np.int64)
    piece_at = np.full((len(units), width + 1), -1, np.int64)
    following = np.full((len(units), width + 1), width, np.int64)  # the next character's first byte
    for k in range(width - 1, -1, -1):
        ahead = (k + 1 >= size) | first[:, k + 1] if k + 1 < width else np.ones(len(units), bool)
        following[:, k] = np.where(ahead, k + 1, following[:, k + 1])
    unknown = v.unknown

    def offer(rows, s, end, gain, piece):
        better = best[rows, s] + gain > best[rows, end]
        rows, end = rows[better], end[better]
        best[rows, end] = best[rows, s] + (gain[better] if np.ndim(gain) else gain)
        back[rows, end] = s
        piece_at[rows, end] = piece[better] if np.ndim(piece) else piece

    for s in range(width):
        rows = np.flatnonzero((size > s) & first[:, s])
        single = np.zeros(len(units), bool)
        node = np.zeros(len(rows), np.int64)
        every = rows
        for k in range(s, width):
            t = v.base[node] + text[rows, k] + 1
            ok = (v.check[t] == node) & (size[rows] > k)
            rows, node = rows[ok], t[ok]
            if not len(rows):
                break
            piece = v.value[node]
            has = piece >= 0
            hit = rows[has]
            single[hit[following[hit, s] == k + 1]] = True
            offer(hit, s, np.full(len(hit), k + 1), v.scores[piece[has]], piece[has])
        lone = every[~single[every]]
        offer(lone, s, following[lone, s], unknown, -1)
    ids: list[list[int]] = []
    ends, starts, found = size.tolist(), back.tolist(), piece_at.tolist()
    for i, u in enumerate(units):
        at, out = ends[i], []
        while at:
            s, piece = starts[i][at], found[i][at]
            out += [piece] if piece >= 0 else [int(v.bytes_at[b]) for b in reversed(u[s:at])]
            at = s
        ids.append(out[::-1])
    return ids, best[np.arange(len(units)), size]


def encode_units(units: list[str], v: Vocabulary) -> tuple[list[list[int]], np.ndarray]:
    raw = [u.encode() for u in units]
    ids: list[list[int]] = [[] for _ in raw]
    scores = np.zeros(len(raw))
    order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
    for a in range(0, len(order), 4096):
        some = order[a : a + 4096]
        short = [i for i in some if len(raw[i]) <= SHORT]
        for i, found, score in zip(short, *best_paths([raw[i] for i in short], v)):
            ids[i], scores[i] = found, score
        for i in some[len(short) :]:
            ids[i], scores[i] = best_path(raw[i], v)
    return ids, scores


def units_of(text: str) -> list[str]:
    """A text with marked spaces, one in front, cut where no piece crosses; the empty text has none."""
    return _UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, text_key, ids, score`` of every row: the best pieces of the whole text (little-endian 32-bit
    numbers) and the sum of their scores.  NULL and empty texts have no pieces and score 0.

    Distinct units are searched once per task while they are remembered.
    """
    v = load(model)

    def run(batches):
        known = Lists(200_000)
        scores = np.zeros(0)
        for batch in batches:
            for rows, data, offsets in slices(batch, SLICE_BYTES):
                if len(known.number) > known.limit:
                    known.clear()
                    scores = scores[:0]
                units, counts = [], []
                for text in rows.column("text").to_pylist():
                    found = units_of(text)
                    units += found
                    counts.append(len(found))
                number = known.number
                new = list(dict.fromkeys(u for u in units if u not in number))
                for u in new:
                    number[u] = len(number)
                ids, own = encode_units(new, v)
                known.add(ids)
                scores = np.concatenate([scores, own])
                codes = np.fromiter(map(number.__getitem__, units), np.int64, len(units))
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
                flat, sizes = ragged(known.flat, known.offsets, codes)
                ends = np.concatenate([[0], np.cumsum(sizes)])[bounds] * 4
                content = flat.astype("<i4").tobytes()
                sums = [float(scores[codes[a:b]].sum()) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        rows.column("text_key"),
                        pa.array([content[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()),
                        pa.array(sums, pa.float64()),
                    ],
                    names=["doc_id", "text_key", "ids", "score"],
                )

    return keyed(docs).mapInArrow(run, "doc_id long, text_key long, ids binary, score double")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds ``text`` and ``n_byte_pieces`` to rows with ``ids``: byte pieces as bytes, markers as spaces, without the
    marker in front.  A text that holds the marker character itself comes back with spaces there."""
    v = load(model)
    contents = [p if u else b"" for p, u in zip(v.pieces, v.usable)]
    for b, i in enumerate(v.bytes_at):
        contents[i] = bytes([b])
    is_byte = np.zeros(len(contents), np.int64)
    is_byte[v.bytes_at] = 1

    def run(batches):
        for batch in batches:
            texts, n = [], []
            for value in batch.column("ids").to_pylist():
                ids = np.frombuffer(value, "<i4")
                text = b"".join([contents[i] for i in ids.tolist()]).decode(errors="replace").replace(SPACE, " ")
                texts.append(text[1:])
                n.append(int(is_byte[ids].sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string()), pa.array(n, pa.int64())],
                names=[*batch.schema.names, "text", "n_byte_pieces"],
            )

    fields = ", ".join(f"{c} {kind}" for c, kind in encoded.dtypes)
    return encoded.mapInArrow(run, f"{fields}, text string, n_byte_pieces long")
