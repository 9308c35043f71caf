"""Toxic passages by maximum-scoring segment search over token log-odds."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafmeter.llm.common import stored

_TOKEN = re.compile(r"[^\W\d_]+")
#: Labelled rows the classifier is fitted on, at most.
TRAIN_ROWS = 20_000
#: Terms of the model, at most: those with the largest z-scores.
TERMS = 20_000
#: Terms whose log-odds lie under this many standard errors count as any other token.
Z = 3.5
#: Tokens that the Dirichlet prior weighs as much as, besides one for every term.
PRIOR = 500.0
#: A passage is significant if a clean text of its length holds such a one with at most this probability.
SIGNIFICANT = 0.05

_SEGMENTS = "array<struct<begin:int,end:int,score:double,p:double>>"


@dataclass(frozen=True)
class Model:
    """Log-odds of terms and of any other token; rate and constant of the extreme-value law; the logistic map
    from a text's features to a probability, constant last."""

    terms: dict[str, float]
    other: float
    rate: float
    log_k: float
    weights: tuple[float, ...]

    def excess(self, score: float, tokens: int) -> float:
        """Nats by which a passage's score exceeds the usual maximum of a clean text of so many tokens."""
        return self.rate * score - self.log_k - math.log(max(tokens, 1))

    def p_value(self, score: float, tokens: int) -> float:
        return -math.expm1(-math.exp(min(700.0, -self.excess(score, tokens)))) if score > 0 else 1.0

    def probability(self, features: tuple[float, ...]) -> float:
        logit = sum(w * x for w, x in zip(self.weights, (*features, 1.0)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), in one pass.

    Each has a positive score and cannot be extended or shortened for a higher one.  A new positive score joins the
    nearest earlier candidate that starts from a lower running total and ends lower, as long as there is one.
    """
    found: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        begin, left, right = i, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((begin, i + 1, left, right))
                break
            begin, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


def passages(text: str, model: Model) -> tuple[list[tuple[int, int, float, float]], tuple[float, ...]]:
    """Significant passages as (first and end code point, score, p-value), and the text's features: the summed
    excess of its significant passages (of its best one if none is), the best score, the other
    passages' scores together, and the logarithm of the tokens."""
    tokens, spans = [], []
    for m in _TOKEN.finditer(text.lower()):
        tokens.append(m.group())
        spans.append(m.span())
    get, other = model.terms.get, model.other
    scores = [get(t, other) for t in tokens]
    segments = maximal_segments(scores) if any(s > 0 for s in scores) else []
    best = max((s for _, _, s in segments), default=0.0)
    out, total = [], 0.0
    for a, b, score in segments:
        p = model.p_value(score, len(tokens))
        if p <= SIGNIFICANT:
            out.append((spans[a][0], spans[b - 1][1], score, p))
            total += model.excess(score, len(tokens))
    if not out:
        total = model.excess(best, len(tokens))
    return out, (total, best, sum(s for _, _, s in segments) - best, math.log(max(1, len(tokens))))


def _log_odds(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[dict[str, float], float]:
    """Log-odds of toxic against clean text with an informative Dirichlet prior in proportion to all tokens, of the
    terms that reach ``Z`` and of all others together."""
    every = toxic + clean
    scored, rest = [], [toxic, clean]
    for term, a, b in counts:
        prior = PRIOR * (a + b) / every + 1
        odds = math.log((a + prior) / (toxic + PRIOR - a - prior + 1e-9)) - math.log((b + prior) / (clean + PRIOR - b - prior + 1e-9))
        z = odds / math.sqrt(1 / (a + prior) + 1 / (b + prior))
        if abs(z) >= Z and a + b > 1:
            scored.append((abs(z), term, odds))
            rest[0] -= a
            rest[1] -= b
    chosen = sorted(scored, key=lambda s: (-s[0], s[1]))[:TERMS]
    other = math.log((rest[0] + 1) / (toxic + 2)) - math.log((rest[1] + 1) / (clean + 2))
    # Clean text must lose along the way, or any long text would be one passage.
    return {term: odds for _, term, odds in chosen}, min(other, -0.01)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights and the constant by Newton's method with a weak pull to zero."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    design = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        gradient = design.T @ (p - y) + 0.1 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / np.abs(step).max()) if np.abs(step).max() else step
        if np.abs(step).max() < 1e-9:
            break
    return (*(float(v) for v in w[:-1] / scale), float(w[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """``text, toxic`` of at most ``TRAIN_ROWS`` labelled documents, chosen by hash of doc_id."""
    some = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(usable)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRAIN_ROWS)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most TRAIN_ROWS rows of two numbers.
    # Copies of a text count once.
    return texts.join(F.broadcast(some), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def _count_terms(batches):
    counts: dict[str, list[int]] = {}

    def rows():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), *[pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1)]],
            names=["term", "toxic", "clean"],
        )

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            # Once per text: a term that one text repeats says little about others.
            for term in set(_TOKEN.findall(text.lower())):
                counts.setdefault(term, [0, 0])[0 if toxic == 1 else 1] += 1
        if len(counts) > 300_000:
            yield rows()
            counts.clear()
    yield rows()


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model:
    """Fit on the labelled documents for which ``usable`` (on ``doc_id``) holds.

    Terms are counted and ranked by Spark; at most ``TERMS`` of them and ``TRAIN_ROWS`` rows of (features, label)
    reach the driver.  Without labels of both kinds every text gets a score under one half.
    """
    train = stored(training_rows(docs, labels, F.lit(True) if usable is None else usable), "train")
    every = train.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term")
    counts = stored(every.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "terms")
    toxic, clean = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not toxic or not clean:
        return Model({}, -1.0, 1.0, 0.0, (0.0, 0.0, 0.0, 0.0, -1.0))
    # Only terms that can reach Z go to the driver: in a balance far from the usual.
    share = toxic / (toxic + clean)
    n = F.col("toxic") + F.col("clean")
    spread = F.abs(F.col("toxic") - n * share) / F.sqrt(n * share * (1 - share))
    ranked = counts.filter((n > 1) & (spread > Z / 2)).orderBy(spread.desc(), "term").limit(TERMS)
    chosen = [tuple(r) for r in ranked.select("term", "toxic", "clean").collect()]
    terms, other = _log_odds(chosen, toxic, clean)
    rough = Model(terms, other, 1.0, 0.0, ())

    def best(batches):
        for batch in batches:
            scores, sizes = [], []
            for text in batch.column("text").to_pylist():
                tokens = _TOKEN.findall(text.lower())
                own = [rough.terms.get(t, rough.other) for t in tokens]
                found = maximal_segments(own) if any(s > 0 for s in own) else []
                scores.append(max((s for _, _, s in found), default=0.0))
                sizes.append(len(tokens))
            yield pa.RecordBatch.from_arrays(
                [pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), batch.column("toxic")], names=["best", "n", "toxic"]
            )

    rate, log_k = _extreme_values(train.filter("toxic = 0").mapInArrow(best, "best double, n long, toxic int"))
    model = Model(terms, other, rate, log_k, ())

    def features(batches):
        for batch in batches:
            values = [passages(t, model)[1] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    rows = train.mapInArrow(features, "x array<double>, toxic int").collect()
    weights = _logistic(np.array([r["x"] for r in rows], float), np.array([r["toxic"] == 1 for r in rows], float))
    return Model(terms, other, rate, log_k, weights)


def _extreme_values(best: DataFrame) -> tuple[float, float]:
    """Rate and log constant of the law P(max > s) = 1 - exp(-K n exp(-rate s)) for clean texts of n tokens.

    Of texts with a positive segment, the quartiles of maxima give the rate; the share of texts without
    one then gives K, since exp(-K n) of them have none.
    """
    positive = best.filter("best > 0").agg(F.count("*"), F.percentile("best", F.lit(0.75)) - F.percentile("best", F.lit(0.25))).first()
    total, tokens = best.agg(F.count("*"), F.sum("n")).first()
    rate = (math.log(-math.log(0.25)) - math.log(-math.log(0.75))) / positive[1] if positive[1] else 1.0
    none = max(0.5, (total or 0) - positive[0]) / max(1, total or 0)
    per_text = max(1.0, (tokens or 0) / max(1, total or 0))
    return min(rate, 5.0), math.log(max(1e-12, -math.log(min(none, 1 - 1e-9)) / per_text))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, passages`` of every row: the probability that a text is toxic and its significant
    passages, as code point ranges of the lower-cased text.

    Rows stay as they are: repeated rows get equal scores, NULL and empty texts that of a text without passages.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = [passages(t, model) for t in batch.column("text").to_pylist()]
            lists = [[dict(zip(("begin", "end", "score", "p"), s)) for s in segments] for segments, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([model.probability(x) for _, x in found], pa.float64()), pa.array(lists, kind)],
                names=["doc_id", "score", "passages"],
            )

    return base.mapInArrow(run, f"doc_id long, score double, passages {_SEGMENTS}")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score under one half, with all their columns."""

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.probability(passages(t or "", model)[1]))

    return docs.filter(probability(F.col("text").cast("string")) < 0.5)


def held_out() -> Column:
    """True for one document in five, and for those without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
