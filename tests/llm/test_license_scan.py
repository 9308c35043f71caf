import random

import pytest

from leafmeter.llm import license_scan
from leafmeter.llm.queries import op7_license_scan


def brute(text, templates):
    """Per template the best share over all stretches of as many shingles, and where the first passage lies."""
    words, spans = license_scan.words_of(text or "")
    out = {}
    for name, template in templates.items():
        own = license_scan.words_of(template)[0]
        if not own:
            continue
        k = min(5, len(own))
        grams = [tuple(own[i : i + k]) for i in range(len(own) - k + 1)]
        mine = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        if len(set(mine) & set(grams)) < 0.8 * len(set(grams)) - 1e-9:
            continue  # no stretch can hold enough
        size = len(grams)
        hits = []
        for i in range(max(1, len(mine) - size + 1)):
            share = len(set(mine[i : i + size]) & set(grams)) / len(set(grams))
            if share >= 0.8 - 1e-12:
                hits.append((i, min(i + size, len(mine)) + k - 1, share))
        if hits:
            passages = []
            for a, b, _ in hits:
                if passages and a <= passages[-1][1]:
                    passages[-1][1] = max(passages[-1][1], b)
                else:
                    passages.append([a, b])
            a, b = passages[0]
            out[name] = (max(h[2] for h in hits), len(passages), spans[a][0], spans[b - 1][1])
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(50)] + ["the", "License", "version", "Licensed"]
    rows = []
    for i in range(150):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 3, 40, 300]))]
        for _ in range(r.choice([0, 1, 1, 2])):
            notice = r.choice(list(license_scan.TEMPLATES.values())).split()
            for _ in range(r.choice([0, 0, 1, 2])):
                notice[r.randrange(len(notice))] = r.choice(vocabulary)
            at = r.randrange(len(words) + 1)
            words[at:at] = notice[: r.choice([len(notice), len(notice), 6])]
        rows.append((i, " ".join(words).upper() if i % 9 == 0 else " ".join(words)))
    return rows + [(900, None), (901, ""), (None, "licensed under cc by nc 4 0"), (902, "filler " * 30_000 + "Released under the MIT License!")]


def check(rows, out, templates):
    want = {(d, name): v for d, t in rows for name, v in brute(t, templates).items()}
    got = {(r["doc_id"], r["license"]): (pytest.approx(r["containment"]), r["n_passages"], r["begin"], r["end"]) for r in out}
    assert got == want and len(out) == len(want)


def test_equals_brute_force(spark):
    for templates in (license_scan.TEMPLATES, {"short": "copyright someone", "none": "", "two": "a b a b a b a b a"}):
        rows = corpus(1) + [(950, "Copyright, SOMEONE a b a b a b a b a b a")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS license", "2 AS begin")
        check(rows, license_scan.scan(docs, templates).collect(), templates)
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, license_scan.scan(docs).collect(), license_scan.all_templates())


def edited(text, share, seed):
    """The text with that share of its words replaced, in short runs."""
    r = random.Random(seed)
    words = text.split()
    changed = 0
    while changed < share * len(words):
        at = r.randrange(len(words))
        n = min(r.randrange(3, 9), len(words) - at)
        words[at : at + n] = [f"changed{r.randrange(99)}" for _ in range(n)]
        changed += n
    return " ".join(words)


def test_whole_licenses_equal_brute_force(spark):
    """Every license whole, edited a little and much, cut in half, among other words, and all of them in one text."""
    every = license_scan.all_templates()
    rows, filler = [], "some other words of a page that has a license " * 30
    for n, (name, text) in enumerate(sorted(every.items())):
        rows += [
            (10 * n, text), (10 * n + 1, f"{filler}{edited(text, 0.05, n)} {filler}"), (10 * n + 2, f"{filler}{edited(text, 0.3, n)}"),
            (10 * n + 3, text[: len(text) // 2] + filler),
        ]
    short = [t for t in every.values() if len(t) < 3000]
    rows.append((9_000, filler.join(short * 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = license_scan.scan(docs).collect()
    check(rows, out, every)
    found = {(r["doc_id"], r["license"]) for r in out}
    assert all((10 * n, name) in found for n, name in enumerate(sorted(every)))
    assert len(license_scan.classes(every)) > 8 and len(every) >= 25


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = op7_license_scan(spark, folder).collect()
    check(rows, out, license_scan.all_templates())
    assert out


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")] * 2, "doc_id long, text string")
    assert len(license_scan.scan(docs).collect()) == 2
    assert license_scan.scan(docs.limit(0)).collect() == []
