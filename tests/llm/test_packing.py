import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from leafmeter.llm import packing
from leafmeter.llm.queries import op2_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, size=2048):
    """Pieces hold every id once, and sequences are gapless and not too long."""
    model = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, text in texts:
        ids = model.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            own = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(own)
            at += r["length"]
        assert at == len(ids)
    total = padding = 0
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= size
        total += at
        padding += size - at if at & (at - 1) else 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padding / total


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = op2_packing(spark, folder).collect()
    assert len({r["doc_id"] for r in rows}) == len(texts)
    assert check(rows, texts) < 0.02


def test_odd_texts(spark, tmp_path):
    r = random.Random(1)
    letters = "abc XYZ'sté  \n\t\r\x0b\x1c\x1f\x85\xa0 　​,.!1٣2\U0001f600'll"
    texts = [(i, "".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 300])))) for i in range(300)]
    texts += [(1000, None), (1001, "word " * 20_000), (1002, "x" * 50_000), (1003, " " * 5000), (None, "a null id")]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS length").write.parquet(f"{tmp_path}/documents.parquet")
    check(op2_packing(spark, str(tmp_path)).collect(), texts)


def test_added_tokens_and_very_long_white_space(spark, tmp_path):
    texts = [(1, "a<|endoftext|>b"), (2, "<|endoftext|><|endoftext|>"), (3, "x <|endoftext|> \n y <|endoftext|"), (4, "a" + " " * 1_100_000 + "b")]
    texts += [(5, "\n" * 1_100_001 + "\tb <|endoftext|>"), (6, "one " * 200_000 + " \u3000" * 600_000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(op2_packing(spark, str(tmp_path)).collect(), texts)


def test_slices_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(packing, "LONG_RUN", 4)
    monkeypatch.setattr(packing, "SLICE", 3)
    encode, model, r = packing.encoder(PATH, public_tokenizers.PATTERN), Tokenizer.from_file(PATH), random.Random(2)
    parts = ["<|endoftext|>", "word", "'s", " ", " ", "\n", "\n", "\r\n", "\u3000", "\x85", "\x1c", "é", "12", "--", "\u200b"]
    for _ in range(3000):
        text = "".join(r.choice(parts) * r.choice([1, 1, 2, 7]) for _ in range(r.randrange(25)))
        assert [i for part in encode(text) for i in part] == model.encode(text, add_special_tokens=False).ids


def test_repeated_rows_and_empty_tables(spark):
    pieces = packing.token_pieces(spark.createDataFrame([(1, "same"), (1, "same"), (1, "other")], "doc_id long, text string"), PATH, public_tokenizers.PATTERN)
    out = packing.pack(pieces).collect()
    assert sorted((r["offset"], r["length"]) for r in out) == [(0, 2), (2, 2), (4, 2)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.token_pieces(none, PATH, public_tokenizers.PATTERN)).collect() == []


def test_plan_keeps_every_piece():
    r = random.Random(3)
    for _ in range(50):
        size = r.choice([16, 2048])
        histogram = {r.randrange(1, size + 1): r.randrange(1, 50) for _ in range(30)}
        placed = defaultdict(int)
        for n, lengths in packing.plan(histogram, size):
            assert n > 0 and sum(lengths) <= size
            for length in lengths:
                placed[length] += n
        assert placed == histogram
