"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of which only the bag has a label.  Every passage is encoded; a gated attention, learned
from the labels of texts, says how much each passage weighs; the weighted passage representation gives the score.  So
one bad passage in a long text can decide, and attention tells which it was.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafmeter.llm.common import ByteHashes, mixed, rolled, slices, stored, word_spans

#: Words of a passage, at most; a text is cut evenly.
PASSAGE_WORDS = 64
#: Labelled texts the model is fitted on, at most, and all their passages together.
TRAIN_ROWS = 8_000
TRAIN_PASSAGES = 150_000
#: Buckets of the hashed words of a passage.
BUCKETS = 32
#: Sizes of a passage's representation and of its attention.
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 256, 0.01, 1e-4
#: Words of a window that counts as repeated where the text has it twice.
REPEAT_WORDS = 5

_CLASSES = 6
_CLASS = np.full(256, 4, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>")):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 5
FEATURES = _CLASSES + 9 + BUCKETS


# ---- passages


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of texts that lie end to end, and each text's offset into the passages.

    Shares of byte classes; logarithm of the words, bytes a word, words equal to the one before, distinct words, words of
    capitals, words that end in a symbol, words of one byte, windows that the text has twice; words hashed to buckets.  A
    text without words is one passage of zeros.
    """
    starts, ends, per_row = word_spans(data, offsets)
    sizes = np.diff(per_row)
    count = np.maximum(1, -(-sizes // PASSAGE_WORDS))
    base = np.concatenate([[0], np.cumsum(count)])
    total, words = int(base[-1]), len(starts)
    x = np.zeros((total, FEATURES), np.float32)
    if not words:
        return x, base
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(words) - per_row[row]
    at = base[row] + place * count[row] // sizes[row]
    n = np.maximum(1, np.bincount(at, minlength=total)).astype(np.float32)

    def summed(values: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=values, minlength=total).astype(np.float32)

    length = ends - starts
    size = np.maximum(1, summed(length))
    kind = _CLASS[data]
    per_class = []
    for k in range(_CLASSES):
        upto = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        per_class.append(upto[ends] - upto[starts])
        x[:, k] = summed(per_class[k]) / size
    h = ByteHashes(data).of(starts, ends)
    again = np.zeros(words, bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    _, first = np.unique(mixed(h ^ mixed(at.astype(np.uint64) + np.uint64(1))), return_index=True)
    new = np.zeros(words, bool)
    new[first] = True
    twice = np.zeros(words, bool)
    if words >= REPEAT_WORDS:
        windows = rolled(h, REPEAT_WORDS)
        own = np.flatnonzero(row[: len(windows)] == row[REPEAT_WORDS - 1 :])
        keys = mixed(windows[own] ^ mixed(row[own].astype(np.uint64) + np.uint64(1)))
        _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice[own] = times[inverse] > 1
    flags = (again, new, (per_class[0] == length) & (length > 1), kind[ends - 1] == 3, kind[ends - 1] == 4, length == 1, twice)
    at_feature = _CLASSES
    x[:, at_feature] = np.log1p(n)
    x[:, at_feature + 1] = np.log1p(size / n)
    for k, flag in enumerate(flags):
        x[:, at_feature + 2 + k] = summed(flag) / n
    bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
    sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    hashed = np.bincount(at * BUCKETS + bucket, weights=sign, minlength=total * BUCKETS).reshape(total, BUCKETS)
    x[:, -BUCKETS:] = hashed / n[:, None]
    x[np.bincount(at, minlength=total) == 0] = 0
    return x, base


# ---- the network


@dataclass(frozen=True)
class Model:
    """Centre and scale of the features, and the weights by name."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The probability that a text is good, one per bag."""
        return _forward(self.weights, (x - self.mean) / self.scale, base)["p"]

    def attention(self, x: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The weight of every passage within its text; weights of a text sum to one."""
        return _forward(self.weights, (x - self.mean) / self.scale, base)["a"]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, base: np.ndarray) -> dict[str, np.ndarray]:
    bag = np.repeat(np.arange(len(base) - 1), np.diff(base))
    e = np.tanh(x @ w["embed"] + w["embed_0"])
    t, s = np.tanh(e @ w["gate_t"]), _sigmoid(e @ w["gate_s"])
    raw = (t * s) @ w["attend"]
    if len(raw):
        raw = np.exp(raw - np.maximum.reduceat(raw, base[:-1])[bag])
        a = raw / np.add.reduceat(raw, base[:-1])[bag]
        z = np.add.reduceat(a[:, None] * e, base[:-1], axis=0)
    else:
        a, z = raw, np.zeros((0, HIDDEN))
    return {"bag": bag, "e": e, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["out"] + w["out_0"])}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, base: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy of bags."""
    f = _forward(w, x, base)
    bag, e, t, s, a = (f[k] for k in ("bag", "e", "t", "s", "a"))
    d = (f["p"] - y) / len(y)
    d_z = d[:, None] * w["out"]
    pull = (d_z[bag] * e).sum(axis=1)
    d_raw = a * (pull - np.add.reduceat(a * pull, base[:-1])[bag])
    d_gate = d_raw[:, None] * w["attend"]
    d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
    d_e = (a[:, None] * d_z[bag] + d_t @ w["gate_t"].T + d_s @ w["gate_s"].T) * (1 - e * e)
    return {
        "embed": x.T @ d_e, "embed_0": d_e.sum(axis=0), "gate_t": e.T @ d_t, "gate_s": e.T @ d_s,
        "attend": (t * s).T @ d_raw, "out": f["z"].T @ d, "out_0": d.sum(keepdims=True),
    }


def _first_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def some(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    return {
        "embed": some(FEATURES, HIDDEN), "embed_0": np.zeros(HIDDEN), "gate_t": some(HIDDEN, GATE), "gate_s": some(HIDDEN, GATE),
        "attend": some(GATE), "out": some(HIDDEN), "out_0": np.zeros(1),
    }


def train(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit by Adam on batches of bags; the same bags in the same order give the same model."""
    x = np.concatenate(bags).astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    base = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    x = (x - mean) / scale
    rng = np.random.default_rng(1)
    w = _first_weights(rng)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    steps = EPOCHS * -(-len(bags) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            rows = np.concatenate([np.arange(base[k], base[k + 1]) for k in some])
            cut = np.concatenate([[0], np.cumsum(base[some + 1] - base[some])])
            g = _gradients(w, x[rows], cut, labels[some])
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for k, v in w.items():
                slope = g[k] + DECAY * v
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope * slope
                w[k] = v - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


# ---- over tables


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *more
    )


def training_bags(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[list[np.ndarray], np.ndarray]:
    """Encoded passages of at most ``TRAIN_ROWS`` labelled texts, chosen by hash of doc_id, with their labels.

    Copies of a text count once, with their lowest label.  Whole texts are taken in order of a hash as long as all
    passages together are at most ``TRAIN_PASSAGES``.
    """
    some = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(usable)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRAIN_ROWS)
    )
    # At most TRAIN_ROWS rows of two numbers.
    texts = _texts(docs).join(F.broadcast(some), "doc_id").groupBy("text").agg(F.min("quality").alias("quality"))

    def work(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                x, base = encode(data, offsets)
                kept = [x[a:b].tobytes() if b - a <= TRAIN_PASSAGES else None for a, b in zip(base[:-1], base[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.diff(base), pa.int64()), rows.column("quality"), rows.column("key"), pa.array(kept, pa.binary())],
                    names=["passages", "quality", "key", "x"],
                )

    coded = texts.withColumn("key", F.xxhash64("text")).mapInArrow(work, "passages long, quality int, key long, x binary")
    coded = stored(coded, "bags")
    held, chosen = 0, []
    # Sizes first, so that no more than the bound is fetched.
    for row in coded.select("key", "passages").orderBy("key").limit(TRAIN_ROWS).collect():
        if held + row["passages"] <= TRAIN_PASSAGES:
            held += row["passages"]
            chosen.append((row["key"],))
    if not chosen:
        return [], np.zeros(0)
    wanted = coded.sparkSession.createDataFrame(chosen, "key long")
    found = coded.join(F.broadcast(wanted), "key").orderBy("key").select("x", "quality").collect()
    return [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in found], np.array([float(r["quality"] == 1) for r in found])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model | None:
    """The model of the labelled texts for which ``usable`` (on ``doc_id``) holds; None without labels of both kinds."""
    bags, y = training_bags(docs, labels, F.lit(True) if usable is None else usable)
    if not len(y) or y.min() == y.max():
        return None
    return train(bags, y)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score, passages, top_passage`` of every row: the probability that the text is good, its number of
    passages, and the place of the one that weighs most.

    Rows stay as they are: repeated rows get equal scores, NULL and empty texts that of a passage of zeros, and
    without a model every text scores one half.  Whole texts are encoded; a task holds some hundred bytes a byte of its longest.
    """

    def work(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                x, base = encode(data, offsets)
                if model is None:
                    p, top = np.full(rows.num_rows, 0.5), np.zeros(rows.num_rows, np.int64)
                else:
                    f = _forward(model.weights, (x - model.mean) / model.scale, base)
                    p = f["p"]
                    # The first of the heaviest passages.
                    order = np.lexsort((np.arange(len(f["a"])), -f["a"], f["bag"]))
                    top = order[base[:-1]] - base[:-1] if len(order) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.round(p, 12), pa.float64()), pa.array(np.diff(base), pa.int64()), pa.array(top, pa.int64())],
                    names=["doc_id", "score", "passages", "top_passage"],
                )

    return _texts(docs).mapInArrow(work, "doc_id long, score double, passages long, top_passage long")


def held_out() -> Column:
    """True for one document in four, and for those without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))
