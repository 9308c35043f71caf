import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from leafmeter.llm import quality_rules
from leafmeter.llm.common import WORD

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [i for w in words for i in model.encode(w)]
    share = [n / len(ids) for n in Counter(ids).values()]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "n_pieces": len(ids),
        "n_byte_pieces": sum(model.is_byte(i) for i in ids),
        "entropy": -sum(s * math.log2(s) for s in share) if ids else 0.0,
        "base_failed": failed,
    }


def compare(spark, rows, schema="doc_id long, text string, lang string"):
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS n_words", "'x' AS entropy")
    out = quality_rules.judged(docs, MODEL).collect()
    assert len(out) == len(rows)
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(brute(r[1]))
    for r in out:
        got = r.asDict()
        assert any(
            all(abs(got[c] - w[c]) < 1e-9 for c in w if c != "base_failed") and got["base_failed"] == w["base_failed"] for w in want[r["doc_id"]]
        ), (got, want[r["doc_id"]])
        assert not (got["kept"] and got["base_failed"])
    return out


def test_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    r = random.Random(2)
    odd = "ab #*\n\t\x0b é漢\U0001f600|<> "
    rows += [(1000 + i, "".join(r.choice(odd) for _ in range(r.choice([0, 5, 100]))), "en") for i in range(50)]
    rows += [(2000, None, None), (2001, "", "xx"), (2002, "a " * 30_000, "en"), (None, "one two " * 9, "en"), (7, "x y", None), (7, "x y", None)]
    compare(spark, rows)


def test_keeps_clean_and_rejects_odd_text(spark):
    r = random.Random(4)
    words = "the house stands near a river where people walk every day and talk about old times with friends".split()
    clean = [(i, " ".join(r.choice(words) for _ in range(200)), "en") for i in range(60)]
    odd = [(100, " ".join("\u0fff" + chr(0x1000 + r.randrange(500)) for _ in range(200)), "en")]
    out = {x["doc_id"]: x["kept"] for x in compare(spark, clean + odd)}
    assert all(out[i] for i, _, _ in clean) and not out[100]


def test_short_texts_are_judged_and_one_source_cannot_set_the_band(spark):
    r = random.Random(5)
    words = "the house stands near a river where people walk every day and talk about old times with friends or go home alone".split()
    clean = [(i, " ".join(r.choice(words) for _ in range(200)), "en") for i in range(60)]
    short = [(100 + i, " ".join(r.sample(words, 21)), "en") for i in range(5)]
    rare = lambda n: " ".join(chr(0x1000 + r.randrange(500)) for _ in range(n))
    symbols = [(200, " ".join(r.choice("#*$%&|<>+-=/") for _ in range(60)), "en"), (201, rare(22), "en")]
    source = [(300 + i, rare(200), "en") for i in range(30)]
    out = {x["doc_id"]: x["kept"] for x in compare(spark, clean + short + symbols + source)}
    assert all(out[d] for d, _, _ in clean + short)
    assert not any(out[d] for d, _, _ in symbols + source)


def test_few_rows_do_not_judge_themselves(spark):
    r = random.Random(6)
    words = "the house stands near a river where people walk every day and talk about old times with friends or go home alone".split()
    german = "das haus steht an einem fluss wo leute jeden tag gehen und mit freunden oder allein nach hause reden".split()
    clean = [(i, " ".join(r.choice(words) for _ in range(200)), "en") for i in range(60)]
    clean += [(100 + i, " ".join(r.choice(german) for _ in range(200)), "de") for i in range(3)]
    rare = lambda n: " ".join(chr(0x1000 + r.randrange(500)) for _ in range(n))
    own = [(200 + i, rare(200), "q1") for i in range(3)] + [(210, rare(22), "q2")] + [(300 + i, rare(200), "q3") for i in range(40)]
    letters = lambda: " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(200))
    few = [(400 + i, letters(), "q4") for i in range(3)]
    out = {x["doc_id"]: (x["kept"], x["script"]) for x in compare(spark, clean + own + few)}
    assert all(out[d] == (True, "latin") for d, _, _ in clean)
    assert all(out[d] == (False, "south_asian") for d, _, _ in own)
    # Judged by the script's band.
    assert all(out[d] == (False, "latin") for d, _, _ in few)


def test_scripts():
    texts = ["abc", "é", "Ж б a", "שלום", "नमस्ते", "漢字 kana", "12 . \u2014", "", "\U00010330"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got = quality_rules._scripts(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert got == ["latin", "latin", "greek_cyrillic", "hebrew_arabic", "south_asian", "latin", None, None, "other"]


def test_no_language_column_and_empty_table(spark):
    assert quality_rules.judged(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
    out = quality_rules.judged(spark.createDataFrame([(1, "word " * 5)], "doc_id long, text string"), MODEL).collect()
    assert [x["kept"] for x in out] == [False]
