"""Hidden Markov language model: Baum-Welch over all training texts, exact scaled forward scores."""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafmeter.llm.common import keyed, stored

STATES = 8
CLASSES = 1024
ROUNDS = 4
#: Training sequences are cut to this many tokens.
SEGMENT = 64
#: Text bytes of a block, whose distinct tokens are numbered together.
BLOCK_BYTES = 1 << 24

_BYTE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_TOKENS = (
    "block string, doc_id long, text_key long, held_out boolean, tokens binary, classes binary,"
    " token binary, number int, class int, n long"
)
_NAMES = [part.split()[0] for part in _TOKENS.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
_END = b" "


def token_class(token: bytes) -> int:
    """The class of a token: 0 for the end, else by its last three bytes."""
    return 0 if token == _END else 1 + zlib.crc32(token[-3:]) % (CLASSES - 1)


def token_blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Texts as numbers: blocks of documents with the distinct tokens of each block.

    A document's row holds its tokens' numbers within the block and their classes; a token's row its number, class and
    count in the block's training texts.  A-Z are lower-cased; every text, NULL and empty ones too, has one end.
    """

    def run(batches):
        numbers: dict[bytes, int] = {}
        rows: list[tuple] = []
        size = 0

        def block():
            name = uuid.uuid4().hex
            kinds = np.fromiter(map(token_class, numbers), np.uint16, len(numbers))
            n = np.zeros(len(numbers), np.int64)
            docs_out = []
            for doc_id, key, held, codes in rows:
                if not held:
                    n += np.bincount(codes, minlength=len(numbers)) if len(codes) * 20 > len(numbers) else 0
                    if len(codes) * 20 <= len(numbers):
                        np.add.at(n, codes, 1)
                docs_out.append((doc_id, key, held, codes.astype("<u4").tobytes(), kinds[codes].astype("<u2").tobytes()))
            none = [None] * len(numbers)
            empty = [None] * len(rows)
            columns = list(zip(*docs_out))
            values = [[name] * (len(rows) + len(numbers))] + [list(c) + none for c in columns]
            values += [empty + list(numbers), empty + list(range(len(numbers))), empty + kinds.tolist(), empty + n.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, _KINDS)], names=_NAMES)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text_key", "held")]
            for doc_id, key, held, text in zip(*columns, batch.column("text").to_pylist()):
                words = _BYTE_WORD.findall(text.encode().lower())
                words.append(_END)
                codes = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, len(words))
                rows.append((doc_id, key, held, codes))
                size += len(text)
                if size > BLOCK_BYTES:
                    yield block()
                    numbers, rows, size = {}, [], 0
        if rows:
            yield block()

    return keyed(docs).withColumn("held", held_out).mapInArrow(run, _TOKENS)


@dataclass(frozen=True)
class Model:
    """Start, transition and class probabilities of the states; counts of tokens and of the classes' tokens."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray


def _segments(codes: np.ndarray) -> list[np.ndarray]:
    return [codes[i : i + SEGMENT] for i in range(0, len(codes), SEGMENT)]


def expected_counts(segments: list[np.ndarray], start, step, emit) -> np.ndarray:
    """Expected counts of one Baum-Welch pass over short sequences, as one row: starts, steps and emissions,
    and the log10 likelihood last.  All sequences move on together, one token at a time."""
    k = len(start)
    segments = sorted(segments, key=len, reverse=True)
    size = np.array([len(s) for s in segments])
    width = int(size[0])
    seen = np.zeros((len(segments), width), np.int64)
    for i, s in enumerate(segments):
        seen[i, : len(s)] = s
    alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(width)]  # sequences longer than t
    forward = np.zeros((width, len(segments), k))
    scale = np.ones((width, len(segments)))
    by_class = emit.T
    for t in range(width):
        a = alive[t]
        now = by_class[seen[:a, t]] * (start if t == 0 else forward[t - 1, :a] @ step)
        scale[t, :a] = now.sum(axis=1)
        forward[t, :a] = now / scale[t, :a, None]
    starts, steps, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, emit.shape[1]))
    back = np.ones((len(segments), k))
    for t in range(width - 1, -1, -1):
        a = alive[t]
        posterior = forward[t, :a] * back[:a]
        for i in range(k):
            emits[i] += np.bincount(seen[:a, t], posterior[:, i], emit.shape[1])
        if t == 0:
            starts += posterior.sum(axis=0)
            break
        ahead = by_class[seen[:a, t]] * back[:a] / scale[t, :a, None]
        steps += step * (forward[t - 1, :a].T @ ahead)
        back[:a] = ahead @ step.T
    return np.concatenate([starts, steps.ravel(), emits.ravel(), [np.log10(scale).sum()]])


def log_likelihoods(sequences: list[np.ndarray], start, step, emit) -> np.ndarray:
    """Exact log10 probability of whole class sequences by the scaled forward recursion, longest first together."""
    size = np.array([len(s) for s in sequences])
    order = np.argsort(-size, kind="stable")
    flat = np.concatenate([sequences[i] for i in order]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(size[order])])[:-1].astype(np.int64)
    alive = len(order) - np.cumsum(np.bincount(size, minlength=1)) if len(order) else []
    out = np.zeros(len(order))
    by_class = emit.T.copy()
    state = None
    for t in range(int(size.max(initial=0))):
        a = int(alive[t])
        now = by_class[flat[first[:a] + t]] * (start if t == 0 else state[:a] @ step)
        total = now.sum(axis=1)
        out[:a] += np.log10(total)
        state = now / total[:, None]
    result = np.zeros(len(order))
    result[order] = out
    return result


def _initial(class_total: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    share = (class_total + 1) / (class_total + 1).sum()
    emit = share * np.exp(r.normal(0, 1, (states, len(share))))
    step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return np.full(states, 1 / states), step, emit / emit.sum(axis=1, keepdims=True)


def train(blocks: DataFrame, totals: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the class sequences of all training documents in ``token_blocks``.

    Each round every partition adds up its expected counts and Spark sums them by cell; what reaches the driver is
    one table of states by classes.  ``totals`` holds (class, distinct tokens, tokens) of the training texts.
    """
    class_total, class_distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in totals.collect():  # at most CLASSES rows
        class_total[r["class"]], class_distinct[r["class"]] = r["n"], r["distinct"]
    start, step, emit = _initial(class_total, states)
    sequences = blocks.filter("tokens IS NOT NULL AND NOT held_out").select("classes")
    for _ in range(rounds if class_total.sum() else 0):
        held = start, step, emit

        def run(batches, held=held):
            total, waiting, size = None, [], 0
            for batch in batches:
                for value in batch.column("classes").to_pylist():
                    waiting += _segments(np.frombuffer(value, "<u2"))
                    size += len(value)
                    if size > 1 << 19:
                        counts = expected_counts(waiting, *held)
                        total = counts if total is None else total + counts
                        waiting, size = [], 0
            if waiting:
                counts = expected_counts(waiting, *held)
                total = counts if total is None else total + counts
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "value"])

        summed = sequences.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        counts = np.zeros(states + states * states + states * CLASSES + 1)
        for r in summed.collect():
            counts[r["cell"]] = r["value"]
        cut = np.cumsum([states, states * states])
        start = counts[: cut[0]] + 1
        step = counts[cut[0] : cut[1]].reshape(states, states) + 1
        # A prior in proportion to all tokens leaves no class without probability in any state.
        emit = counts[cut[1] : -1].reshape(states, CLASSES) + 10 * (class_total + 0.1) / (class_total + 0.1).sum()
        start, step, emit = start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True)
    return Model(start, step, emit, int(class_total.sum()), int(class_distinct.sum()), class_total, class_distinct)


def _scorer(model: Model):
    base_scale = model.total + 0.1 * (model.distinct + 1)
    class_scale = model.class_total + 0.1 * (model.class_distinct + 1)
    emit = model.emit

    def score(docs: pa.Table, tokens: pa.Table) -> pa.Table:
        count = np.zeros(tokens.num_rows)
        kind = np.zeros(tokens.num_rows, np.int64)
        number = tokens.column("number").to_numpy()
        count[number] = tokens.column("c").to_numpy()
        kind[number] = tokens.column("class").to_numpy()
        base = np.log10((count + 0.1) / base_scale)
        own = np.log10((count + 0.1) / class_scale[kind])
        sequences = [np.frombuffer(v, "<u4") for v in docs.column("tokens").to_pylist()]
        paths = log_likelihoods([kind[s] for s in sequences], model.start, model.step, emit)
        known = count > 0
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "text_key": docs.column("text_key"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array([len(s) for s in sequences], pa.int64()),
                "n_known": pa.array([int(known[s].sum()) for s in sequences], pa.int64()),
                "train_tokens": pa.array([model.total] * len(sequences), pa.int64()),
                "base_score": pa.array([float(base[s].sum()) for s in sequences], pa.float64()),
                "score": pa.array([float(own[s].sum() + p) for s, p in zip(sequences, paths)], pa.float64()),
            }
        )

    return score


def score_texts(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Every row with its number of tokens, those known from training texts, a smoothed unigram score and the
    model's score, both log10 probabilities of the whole text.

    Training texts are the rows for which ``held_out`` is false.  The model emits token classes from latent states, and
    tokens within their class by smoothed training counts, so the probabilities of all tokens, unknown ones as
    one, sum to 1.  Counts of all tokens stay in Spark: they are joined to the distinct tokens of each
    block and meet the block's documents, so no task or driver holds the vocabulary.
    """
    blocks = stored(token_blocks(docs, held_out), "blocks")
    tokens = blocks.filter("token IS NOT NULL").select("block", "token", "number", "class", "n")
    counts = stored(tokens.groupBy("token").agg(F.sum("n").alias("c"), F.first("class").alias("class")).filter("c > 0"), "counts")
    totals = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("distinct"))
    model = train(blocks, totals, states, rounds)
    known = stored(
        tokens.drop("n")
        .join(counts.drop("class"), "token", "left")
        .select("block", "number", "class", F.coalesce("c", F.lit(0)).alias("c")),
        "known",
    )
    texts = blocks.filter("tokens IS NOT NULL").select("block", "doc_id", "text_key", "held_out", "tokens")
    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _scorer(model),
        "doc_id long, text_key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def held_out() -> Column:
    """True for one document in ten, and for those without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
