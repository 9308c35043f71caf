import hashlib
import random

import pytest
from helpers import rows, shares

from leafmeter.limits import DAY, LIMITS, Limits
from leafmeter.operators import access, claims, intake
from leafmeter.sources import tables

UPLOADS = "attempt_id bigint, ip string, ts bigint, content_type string, bearer string, ua string, html string"
GOOD_KEY = "Bearer key_" + "A" * 43


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def uploads(spark, items):
    full = [(i, ip, ts, kind, bearer, "curl/8", html) for i, ip, ts, kind, bearer, html in items]
    return spark.createDataFrame(full, UPLOADS)


def codes(df):
    return {r.attempt_id: r.code for r in df.collect()}


def replay(items, gap=30):
    """The limiter applied one attempt after the other; True = valid upload."""
    last, out = {}, {}
    for i, ip, ts, valid in sorted(items, key=lambda x: (x[2], x[0])):
        if ip in last and last[ip] > ts - gap:
            out[i] = 429
        elif valid:
            out[i], last[ip] = 201, ts
        else:
            out[i] = 400
    return out


def as_uploads(spark, items):
    return uploads(spark, [(i, ip, ts, "text/html", None, "<p>x" if ok else "") for i, ip, ts, ok in items])


@pytest.mark.parametrize("seed", range(4))
def test_limiter_equals_replay(spark, seed):
    rnd = random.Random(seed)
    items = []
    for i in range(1500):
        # One sender makes a third of the attempts, around two midnights.
        ip = "hot" if i % 3 == 0 else f"ip{rnd.randrange(20)}"
        items.append((i, ip, rnd.choice([1, 2]) * DAY + rnd.randrange(-900, 900), rnd.random() < 0.7))
    assert codes(intake.admit_uploads(as_uploads(spark, items), "s")) == replay(items)


def test_limiter_chains_over_midnights(spark):
    # Every 29 s for three days: the sender is never free when a day starts.
    items = [(i, "hot", DAY - 500 + 29 * i, True) for i in range(6000)]
    assert codes(intake.admit_uploads(as_uploads(spark, items), "s")) == replay(items)


def test_exactly_the_gap_later_passes(spark):
    items = [(1, "a", 100, True), (2, "a", 129, True), (3, "a", 130, True), (4, "a", 130, True), (5, "b", 101, True)]
    assert codes(intake.admit_uploads(as_uploads(spark, items), "s")) == {1: 201, 2: 429, 3: 201, 4: 429, 5: 201}


def test_rejected_attempts_do_not_block(spark):
    items = [(1, "a", 100, False), (2, "a", 100, True), (3, "a", 100, False)]
    assert codes(intake.admit_uploads(as_uploads(spark, items), "s")) == {1: 400, 2: 201, 3: 429}


def test_validation_order(spark):
    html = "text/html"
    cases = [
        (html, "Bearer nope", "", 401),
        ("image/png", GOOD_KEY, "<p>", 415),
        (None, None, "<p>", 415),
        ("application/json", None, None, 400),
        (html, None, "", 400),
        (html, None, "<p>" + "x" * 999_998, 413),
        (html, None, "<p>" + "é" * 500_000, 413),
        (html, None, "<p>" + "x" * 999_997, 201),
        (html, None, "no tag <", 415),
        (html, None, " " * 4095 + "<p>", 415),
        (html, None, " " * 4094 + "<p>", 201),
        ("text/plain; x", GOOD_KEY, "<p>", 201),
    ]
    df = uploads(spark, [(i, f"ip{i}", 5, kind, b, h) for i, (kind, b, h, _) in enumerate(cases)])
    got = intake.admit_uploads(df, "s")
    assert codes(got) == {i: c[3] for i, c in enumerate(cases)}
    last = got.filter("attempt_id = 11").first()
    assert (last.content_size, last.client, last.owner_key_hash) == (3, "curl", sha(GOOD_KEY[7:]))


def test_prior_acceptance_blocks(spark):
    prior = spark.createDataFrame([(sha("s:a"), 100)], "ip_hash string, last_ts bigint")
    items = [(1, "a", 90, True), (2, "a", 129, True), (3, "a", 130, True), (4, "a", 159, True), (5, "b", 100, True)]
    got = codes(intake.admit_uploads(as_uploads(spark, items), "s", prior=prior))
    assert got == {1: 429, 2: 429, 3: 201, 4: 429, 5: 201}


def test_window_limits_equal_replay(spark):
    rnd = random.Random(1)
    limits = Limits(list_per_ip=6, list_per_key=4, write_per_ip=3)
    log = []
    for i in range(1200):
        ip = "hot" if i % 3 == 0 else f"ip{rnd.randrange(4)}"
        key = None if rnd.random() < 0.2 else f"k{rnd.randrange(3)}"
        log.append((i, ip, key, rnd.randrange(400), rnd.choice(["list", "claim", "write"]), rnd.random() < 0.05))
    want, used = {}, {}

    def take(name, limit):
        used[name] = used.get(name, 0) + 1
        return used[name] <= limit

    for i, ip, key, ts, route, broken in sorted(log, key=lambda x: (x[3], x[0])):
        w = ts // 60
        if broken:
            want[i] = 200
        elif route == "write":
            want[i] = 200 if take(("w", ip, w), 3) else 429
        elif not take(("ip", ip, w), 6):
            want[i] = 429
        else:
            want[i] = 429 if key is not None and not take(("key", key, w), 4) else 200
    df = spark.createDataFrame(log, "request_id bigint, ip_hash string, key_hash string, ts bigint, route string, limiter_error boolean")
    got = {r.request_id: r.code for r in intake.fixed_window_limits(df, limits).collect()}
    assert got == want and 429 in got.values()


REPORTS = "request_id bigint, slug string, reason string, email string, email_is_text boolean, reporter_ip_hash string, ts bigint"


def test_reports(spark):
    s = shares(spark, {"slug": "a"}, {"slug": "d", "status": "deleted"})
    old = spark.createDataFrame([("d", "z")], "slug string, reporter_ip_hash string")
    raw = spark.createDataFrame(
        [
            (1, "a", " \n\t", None, True, "x", 1), (2, "a", None, None, True, "x", 1), (3, "a", "y" * 2001, None, True, "x", 1),
            (4, "a", "bad", "e", False, "x", 1), (5, "nope", "bad", None, True, "x", 1), (6, "a", " late ", None, True, "x", 9),
            (7, "a", "\u00a0first\n", "e@x", True, "x", 5), (8, "a", "tie", None, True, "x", 5), (9, "d", "again", None, True, "z", 2),
            (10, "d", "y" * 2000, None, True, "x", 2),
        ],
        REPORTS,
    )
    got = intake.intake_reports(raw, s, old)
    assert sorted(rows(got, "request_id", "code", "deduped")) == [
        (1, 400, False), (2, 400, False), (3, 413, False), (4, 400, False), (5, 404, False), (6, 200, True),
        (7, 200, False), (8, 200, True), (9, 200, True), (10, 200, False),
    ]
    stored = intake.new_reports(got).orderBy("id")
    assert [(r.id, r.reason[:5], r.status, r.reporter_email) for r in stored.collect()] == [(7, "first", "open", "e@x"), (10, "yyyyy", "open", None)]


CLAIMS = "request_id bigint, ts bigint, owner_key_hash string, tokens array<string>"


def claim(spark, log, *rows_):
    s = shares(spark, *rows_)
    return claims.claim_shares(spark.createDataFrame(log, CLAIMS), s), s, spark.createDataFrame(log, CLAIMS)


def test_claim_outcomes(spark):
    got, s, log = claim(
        spark,
        [
            (1, 10, "A", ["t1", "t1", "t2", "t3", "nope", "t4"]), (2, 11, "B", ["t1", "t2"]), (3, 12, "A", ["t1"]),
            (4, 1, "C", [""]), (5, 1, "C", ["t1"] * 51), (6, 1, "C", []), (7, 1, "C", None),
        ],
        {"slug": "s1", "edit_token_hash": sha("t1")}, {"slug": "s2", "edit_token_hash": sha("t2"), "owner_key_hash": "B"},
        {"slug": "s3", "edit_token_hash": sha("t3"), "status": "pending"}, {"slug": "s4", "edit_token_hash": sha("t4"), "owner_key_hash": "A"},
    )
    assert sorted(rows(got.filter("pos is not null"), "request_id", "pos", "outcome", "slug")) == [
        (1, 0, "claimed", "s1"), (1, 1, "claimed", "s1"), (1, 2, "owned-by-other", None), (1, 3, "not-found", None),
        (1, 4, "not-found", None), (1, 5, "already-yours", "s4"), (2, 0, "owned-by-other", None), (2, 1, "already-yours", "s2"),
        (3, 0, "already-yours", "s1"),
    ]
    assert sorted(rows(got.filter("outcome = 'bad-request'"), "request_id")) == [(4,), (5,), (7,)]
    assert sorted(rows(claims.claimed_owners(log, s))) == [("s1", "A", 12), ("s2", "B", 11), ("s4", "A", 10)]
    tally = {r.owner_key_hash: r for r in claims.claim_tally(got).collect()}
    assert (tally["A"].claimed, tally["A"].already_yours, tally["A"].added, tally["A"].calls) == (2, 2, 4, 1)


def test_claims_equal_replay(spark):
    rnd = random.Random(3)
    owner = {f"t{i}": rnd.choice([None, None, "A", "B"]) for i in range(30)}
    rows_ = [{"slug": f"s{t}", "edit_token_hash": sha(t), "owner_key_hash": o} for t, o in owner.items()]
    # A third of all tokens is the same one.
    log = [
        (i, rnd.randrange(50), rnd.choice("ABC"), ["t0" if rnd.random() < 0.33 else f"t{rnd.randrange(35)}" for _ in range(4)])
        for i in range(120)
    ]
    want = {}
    for rid, _, key, tokens in sorted(log, key=lambda x: (x[1], x[0])):
        before = dict(owner)
        for pos, t in enumerate(tokens):
            if t not in owner:
                want[rid, pos] = "not-found"
            elif owner[t] in (None, key):
                want[rid, pos] = "already-yours" if before[t] == key else "claimed"
                owner[t] = key
            else:
                want[rid, pos] = "owned-by-other"
    got, s, df = claim(spark, log, *rows_)
    assert {(r.request_id, r.pos): r.outcome for r in got.collect()} == want
    ends = {r.slug: r.owner_key_hash for r in claims.claimed_owners(df, s).collect()}
    assert all(owner[slug[1:]] == key for slug, key in ends.items())


ACCESS = "request_id bigint, route string, slug string, bearer string, token string, version string, size bigint"


def test_access_matrix(spark):
    s = shares(
        spark,
        {"slug": "own", "edit_token_hash": sha("tok"), "owner_key_hash": sha(GOOD_KEY[7:]), "latest_version": 3},
        {"slug": "free", "edit_token_hash": sha("tok"), "latest_version": 1},
        {"slug": "gone", "edit_token_hash": sha("tok"), "status": "deleted"}, {"slug": "pend", "edit_token_hash": sha("tok"), "status": "pending"},
    )
    o = spark.createDataFrame([("shares/own.html",), ("shares/own/v3.html",)], "key string")
    cases = [
        ("versions", "own", GOOD_KEY, None, None, None, 200), ("versions", "own", GOOD_KEY, "wrong", None, None, 200),
        ("versions", "free", GOOD_KEY, "tok", None, None, 403), ("versions", "free", None, "tok", None, None, 200),
        ("versions", "free", None, "bad", None, None, 403), ("versions", "free", None, None, None, None, 400),
        ("versions", "none", None, "tok", None, None, 404), ("versions", "gone", None, "bad", None, None, 410),
        ("versions", "pend", None, "tok", None, None, 409), ("versions", "own", "", "tok", None, None, 401),
        ("raw", "own", GOOD_KEY, None, "1", None, 200), ("raw", "own", GOOD_KEY, None, "2", None, 404),
        ("raw", "own", GOOD_KEY, None, "4", None, 404), ("raw", "own", None, None, "x", None, 404),
        ("raw", "own", None, None, "0", None, 404), ("raw", "own", "Bearer x", None, "x", None, 401),
        ("raw", "own", GOOD_KEY, None, "003", None, 200), ("restore", "own", GOOD_KEY, None, "3", None, 400),
        ("restore", "own", GOOD_KEY, None, "1", None, 200), ("delete", "gone", None, "bad", None, None, 200),
        ("delete", "pend", None, "tok", None, None, 200), ("delete", "free", None, "bad", None, None, 403),
        ("delete", "none", None, "tok", None, None, 404), ("delete", "free", None, None, None, None, 400),
        ("edit", "free", None, None, None, 5, 400), ("edit", "free", None, "tok", None, None, 400),
        ("edit", "free", None, "tok", None, 1_000_001, 413), ("edit", "gone", None, "tok", None, 5, 404),
        ("edit", "pend", None, "tok", None, 5, 409), ("edit", "free", None, "bad", None, 5, 403),
        ("edit", "free", "Bearer x", "tok", None, 5, 200), ("list", "x", None, "tok", None, None, 401),
        ("list", "x", GOOD_KEY, None, None, None, 200), ("claim", "x", "Bearer key_short", None, None, None, 401),
    ]
    df = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(cases)], ACCESS)
    got = {r.request_id: r.code for r in access.audit_access(df, s, o).collect()}
    assert got == {i: c[6] for i, c in enumerate(cases)}
    assert sum(r.n for r in access.access_counts(access.audit_access(df, s, o)).collect()) == len(cases)
    assert LIMITS.max_html_bytes == 1_000_000


def test_new_shares_take_slugs_one_by_one(spark):
    import random

    rng = random.Random(4)
    uploads = [(i, rng.randrange(40), 201 if rng.random() < 0.8 else 429, rng.choice([None, "k"])) for i in range(60)]
    wanted = {i: [rng.choice([None, *"abcdefghijklmnopqrstuvwxyz"]) for _ in range(rng.randint(0, 4))] for i in range(60)}
    known = {"a", "b"}
    want = {}
    for i, ts, code, owner in sorted(uploads, key=lambda u: (u[1], u[0])):
        slug = next((s for s in wanted[i] if s is not None and s not in known), None)
        if code == 201 and slug is not None:
            known.add(slug)
            want[slug] = (ts, "committed" if i % 3 else "pending", ts if i % 3 else None, ts if owner else None)
    verdicts = spark.createDataFrame(
        [(i, f"ip{i}", ts, code, 5, "web", owner) for i, ts, code, owner in uploads],
        "attempt_id bigint, ip_hash string, ts bigint, code bigint, content_size bigint, client string, owner_key_hash string",
    )
    grants = spark.createDataFrame(
        [(i, wanted[i], f"t{i}", i % 3 != 0) for i in range(60)], "attempt_id bigint, slugs array<string>, edit_token_hash string, stored boolean"
    )
    out = intake.new_shares(verdicts, grants, shares(spark, {"slug": "a"}, {"slug": "b"}))
    assert out.columns == [f.name for f in tables.SHARES.fields]
    got = {r.slug: (r.created_at, r.status, r.committed_at, r.owner_claimed_at) for r in out.collect()}
    assert got == want and 10 < len(got)
