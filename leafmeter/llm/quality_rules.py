"""Quality rules: word and line counts, and tokeniser fertility within bands per language or script and fixed outer limits."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafmeter.llm.common import SLICE_BYTES, WORD, Lists, mixed, ragged, rolled, slices, stored

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Bands reach this many median deviations from the median of a language: in symmetric data three interquartile ranges
#: beyond the quartiles.
REACH = 7.0
#: Texts with fewer pieces have too noisy measures to set a band; all are judged by it.
LEAST_PIECES = 100
#: Part of a measure's median by which languages of one script may differ beyond the scatter within each.
OTHER_LANGUAGE = 0.5
#: Sound rows from which a language, or else a script, has a band of its own.
LEAST_ROWS = 30
#: Scripts by the lead bytes of their characters in UTF-8 (ASCII letters besides), and the largest share of byte pieces that is
#: accepted in any language.  A text mostly of bytes is out of the vocabulary's reach; East Asian characters are too
#: many for one, so that half of ordinary text may be bytes.
SCRIPTS = {
    "latin": (range(0xC3, 0xCB), 0.6),
    "greek_cyrillic": (range(0xCD, 0xD6), 0.6),
    "hebrew_arabic": (range(0xD6, 0xE0), 0.6),
    "south_asian": (range(0xE0, 0xE2), 0.6),
    "east_asian": (range(0xE3, 0xEE), 0.9),
    "other": (range(0xF0, 0xF5), 0.6),
}

MEASURES = ("chars_per_piece", "byte_share", "entropy")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_pieces", "n_byte_pieces")
_SCHEMA = "doc_id long, lang string, script string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", entropy double"


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(sums[bounds])


def _repeat_words(codes: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Words per row in windows that the row has twice or more."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashes = rolled(mixed(codes.astype(np.uint64)), window)
    inside = np.flatnonzero(row[: len(hashes)] == row[window - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    key = hashes[inside] ^ mixed(row[inside].astype(np.uint64) + np.uint64(1))
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    start = inside[n[back] > 1]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + window, -1)
    return _per_row(np.cumsum(cover)[:-1] > 0, bounds)


def _entropy(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits per piece of each row's own distribution of pieces; 0 without pieces."""
    total = np.diff(bounds)
    row = np.repeat(np.arange(len(total)), total)
    pair, n = np.unique((row << 32) | ids, return_counts=True)
    share = n / total[pair >> 32]
    return np.bincount(pair >> 32, -share * np.log2(share), len(total))


def _scripts(data: np.ndarray, offsets: np.ndarray) -> list[str | None]:
    """The script of most letters of every row, NULL without letters."""
    counts = []
    for name, (lead, _) in SCRIPTS.items():
        of = np.zeros(256, bool)
        of[list(lead)] = True
        if name == "latin":
            of[[*range(65, 91), *range(97, 123)]] = True
        counts.append(_per_row(of[data], offsets))
    counts, names = np.array(counts), list(SCRIPTS)
    return [names[i] if some else None for i, some in zip(counts.argmax(0), counts.any(0))]


def measures(docs: DataFrame, model: str) -> DataFrame:
    """Counts and tokeniser measures of every whole text; one row per input row.

    ``model`` is the path of a sentencepiece file with byte fallback; words are encoded one by one.  NULL and empty
    texts have 0 everywhere and no script.  A table without ``lang`` counts as one language.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text.alias("text"))
    symbol = np.zeros(256, np.int64)
    symbol[[ord(c) for c in SYMBOLS]] = 1

    def run(batches):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())], np.int64)
        known = Lists(150_000)
        chars = np.zeros(0, np.int64)
        for batch in batches:
            for rows, data, offsets in slices(batch, SLICE_BYTES):
                if len(known.number) > known.limit:
                    known.clear()
                    chars = chars[:0]
                words, counts, repeated = [], [], []
                for one in rows.column("text").to_pylist():
                    found = WORD.findall(one)
                    words += found
                    counts.append(len(found))
                    lines = [line for line in one.split("\n") if WORD.search(line)]
                    repeated.append(len(lines) - len(set(lines)))
                number = known.number
                new = list(dict.fromkeys(w for w in words if w not in number))
                for w in new:
                    number[w] = len(number)
                known.add(pieces.encode(new, num_threads=1) if new else [])
                chars = np.concatenate([chars, np.fromiter(map(len, new), np.int64, len(new))])
                codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                bounds = np.concatenate([[0], np.cumsum(counts)])
                ids, sizes = ragged(known.flat, known.offsets, codes)
                ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
                columns = [
                    np.array(counts, np.int64),
                    _per_row(chars[codes], bounds),
                    _per_row(symbol[data], offsets),
                    np.array(repeated, np.int64),
                    _repeat_words(codes, bounds, WINDOW),
                    np.diff(ends),
                    _per_row(byte[ids], ends),
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), rows.column("lang"), pa.array(_scripts(data, offsets), pa.string()),
                        *map(pa.array, columns), pa.array(_entropy(ids, ends)),
                    ],
                    names=["doc_id", "lang", "script", *_COUNTS, "entropy"],
                )

    return base.mapInArrow(run, _SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bands(rows: DataFrame, by: str = "lang", least: float = 0.01) -> DataFrame:
    """Per language (or other column ``by``) the accepted range ``<by>_<measure>_low`` to ``.._high`` of each measure.

    Medians over all rows long enough and not failed by the base rules or the outer limits, widened by ``REACH`` median
    absolute deviations, and by the part ``least`` of the median so that a uniform language keeps a width.  A source of
    under half of a language's rows cannot move its band to itself, as it could with quartiles from a quarter on.
    Under ``LEAST_ROWS`` such rows there is no band, so that a few rows do not judge themselves.
    """
    sound = rows.filter((F.col("n_pieces") >= LEAST_PIECES) & ~base_failed() & _within_limits())
    key = f"band_{by}"
    middle = sound.groupBy(by).agg(F.count("*").alias("n_rows"), *[F.percentile_approx(m, 0.5, 10_000).alias(f"{m}_mid") for m in MEASURES])
    middle = middle.filter(F.col("n_rows") >= LEAST_ROWS).drop("n_rows").withColumnRenamed(by, key)
    apart = sound.join(middle, sound[by].eqNullSafe(middle[key]))
    spread = apart.groupBy(key, *[f"{m}_mid" for m in MEASURES]).agg(
        *[F.percentile_approx(F.abs(F.col(m) - F.col(f"{m}_mid")), 0.5, 10_000).alias(m) for m in MEASURES]
    )
    out = [F.col(key)]
    for m in MEASURES:
        mid = F.col(f"{m}_mid")
        width = REACH * F.col(m) + F.abs(mid) * least
        out += [(mid - width).alias(f"{by}_{m}_low"), (mid + width).alias(f"{by}_{m}_high")]
    return spread.select(out)


def _within_limits() -> Column:
    """Whether the share of byte pieces is within the fixed limit of the script."""
    limit = F.lit(SCRIPTS["other"][1])
    for name, (_, share) in SCRIPTS.items():
        limit = F.when(F.col("script") == name, share).otherwise(limit)
    return F.col("byte_share") <= limit


def judged(docs: DataFrame, model: str) -> DataFrame:
    """``measures`` with ``base_failed`` and ``kept``: every measure inside its band and within the outer limits.

    Every text is judged by its language's band; in a language without one by its script's, wider because languages
    differ within a script; without either by the outer limits only.  Under ``LEAST_PIECES`` pieces the least
    entropy falls with the logarithm of their number, as the largest possible one does.  A byte share of up to 0.02 is
    inside any band.
    """
    rows = stored(
        measures(docs, model).withColumns(
            {
                "chars_per_piece": F.when(F.col("n_pieces") > 0, F.col("word_chars") / F.col("n_pieces")).otherwise(0.0),
                "byte_share": F.when(F.col("n_pieces") > 0, F.col("n_byte_pieces") / F.col("n_pieces")).otherwise(0.0),
            }
        ),
        "measures",
    )
    by_lang, by_script = bands(rows), bands(rows, "script", OTHER_LANGUAGE)
    inside = F.lit(True)
    # Short texts scatter more.
    noise = 0.5 / F.sqrt(F.greatest("n_pieces", F.lit(1)))
    reached = F.log2(F.greatest("n_pieces", F.lit(1))) / math.log2(LEAST_PIECES)
    for m in MEASURES:
        low, high = (F.coalesce(f"lang_{m}_{side}", f"script_{m}_{side}") for side in ("low", "high"))
        if m == "entropy":
            low = F.least(low, low * reached)
        ok = F.col(m).between(low - noise, high + noise)
        inside = inside & (ok | (F.col(m) <= 0.02) if m == "byte_share" else ok)
    kept = ~base_failed() & _within_limits() & F.coalesce(inside, F.lit(True))
    joined = rows.join(by_lang, rows["lang"].eqNullSafe(by_lang["band_lang"]), "left")
    joined = joined.join(by_script, rows["script"].eqNullSafe(by_script["band_script"]), "left")
    return joined.select(*rows.columns, base_failed().alias("base_failed"), kept.alias("kept"))
