import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from leafmeter.llm import pieces
from leafmeter.llm.queries import op10_sentencepiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(MODEL)


def small(names, scores):
    """A vocabulary of byte pieces and a few others."""
    texts = [b"<%d>" % b for b in range(256)] + [n.encode() for n in names]
    return pieces.build(
        texts, np.array([0.0] * 256 + scores), np.arange(256), np.array([False] * 256 + [True] * len(names))
    )


def brute(unit, v):
    """The best score over all segmentations."""
    text = unit.decode()
    known = {p.decode(): s for p, s, u in zip(v.pieces, v.scores, v.usable) if u}
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for a in range(end):
            piece = text[a:end]
            gain = known.get(piece, v.unknown if end - a == 1 else float("-inf"))
            best[end] = max(best[end], best[a] + gain)
    return best[-1]


def random_texts(seed, n, letters):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.choice([1, 2, 7, 30, 90]))) for _ in range(n)]


def test_both_searches_equal_brute_force():
    r = random.Random(1)
    names = sorted({"".join(r.choice("▁abcé") for _ in range(1)) + "".join(r.choice("abcé") for _ in range(r.randrange(0, 4))) for _ in range(60)})
    v = small(names, [-r.random() * 10 for _ in names])
    units = [u.encode() for t in random_texts(2, 300, "abcé漢 \n") for u in pieces.units_of(t)]
    ids, scores = pieces.best_paths([u for u in units if len(u) <= pieces.SHORT], v)
    for unit, path, score in zip([u for u in units if len(u) <= pieces.SHORT], ids, scores):
        alone, own = pieces.best_path(unit, v)
        assert alone == path and own == pytest.approx(score) and score == pytest.approx(brute(unit, v))


def test_equals_the_library(vocabulary):
    """The same vocabulary and scores as a unigram model of the library."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for piece, score in zip(proto.pieces, vocabulary.scores):
        piece.score = score
    own = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = random_texts(3, 200, "the and of ing  éàß漢\U0001f600.,'\n") + ["a  b   c", " lead", "trail ", "▁", "\n\n"]
    for text in texts:
        ids, _ = pieces.encode_units(pieces.units_of(text), vocabulary)
        want = own.encode(text)
        got = [i for u in ids for i in u]
        # The library adds in single precision, so of paths with equal scores it may take another.
        assert got == want or total(got, vocabulary) == pytest.approx(total(want, vocabulary), abs=1e-4), text


def total(ids, v):
    return sum(v.scores[i] for i in ids)


def test_ranks_become_log_probabilities(vocabulary):
    own = vocabulary.scores[vocabulary.usable]
    assert np.exp(own).sum() == pytest.approx(1, abs=1e-3) and own.max() < 0
    scores = pieces.rank_log_scores(np.array([0.0, -2.0, -1.0, 5.0]), np.array([True, True, True, False]))
    assert scores[0] > scores[2] > scores[1] and scores[3] == 0


def test_a_file_with_log_scores_keeps_them(tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, piece in enumerate(proto.pieces):
        piece.score = -0.5 - i / 8
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    scores = pieces.load(str(path)).scores
    assert scores[300] == -0.5 - 300 / 8


def test_scores_of_whole_texts(spark, vocabulary):
    """Every text's score against the best over all segmentations into pieces, with the file's whole vocabulary."""
    known = {p.decode(): s for p, s, u in zip(vocabulary.pieces, vocabulary.scores, vocabulary.usable) if u}
    texts = ["the quick brown fox", "naïve  café\n", "漢字 and 🤖", "x" * 40, "word " * 50, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.encode(docs, MODEL).collect():
        text = texts[r["doc_id"]]
        text = "▁" + text.replace(" ", "▁") if text else ""
        best = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for a in range(max(0, end - 30), end):
                gain = known.get(text[a:end], vocabulary.unknown if end - a == 1 else float("-inf"))
                best[end] = max(best[end], best[a] + gain)
        assert r["score"] == pytest.approx(best[-1])


def test_double_array_holds_exactly_the_keys():
    r = random.Random(4)
    keys = {bytes(r.randrange(256) for _ in range(r.randrange(1, 6))): i for i in range(500)}
    base, check, value = pieces.double_array(keys)

    def find(key):
        node = 0
        for c in key:
            t = base[node] + c + 1
            if check[t] != node:
                return -1
            node = t
        return value[node]

    assert all(find(k) == i for k, i in keys.items())
    assert all(find(k[:-1]) == keys.get(k[:-1], -1) for k in keys if len(k) > 1)


def test_query_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(random_texts(5, 60, "ab é漢 \n\t\U0001f600the and"))]
    rows += [(100, None), (101, ""), (102, " "), (None, "no id"), (103, "x" * 30_000), (104, "many words " * 10_000), (1, rows[1][1])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS score").write.parquet(f"{tmp_path}/documents.parquet")
    out = op10_sentencepiece(spark, str(tmp_path)).collect()
    got = sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in out)
    assert got == sorted((str(d), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert {r["n_pieces"] for r in out if r["doc_id"] in (100, 101)} == {0}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode(pieces.encode(none, MODEL), MODEL).collect() == []
