import random

import pytest
from helpers import NOW, objects, rows, shares

from leafmeter.limits import LIMITS
from leafmeter.operators import versions

OPS = "op_id bigint, slug string, ts bigint, op string, arg bigint, size bigint"


def keys(slug, numbers):
    return [f"shares/{slug}.html" if v == 1 else f"shares/{slug}/v{v}.html" for v in numbers]


def replay(ops, latest, status, stored):
    """The log applied one op after the other; ``stored`` maps (slug, version) to a size."""
    latest, stored, out = dict(latest), dict(stored), {}
    for op_id, slug, _, op, arg, size in sorted(ops, key=lambda o: (o[2], o[0])):
        state = status.get(slug)
        if state is None:
            out[op_id] = (404, None, None, None)
            continue
        if state != "committed":
            code = (410 if op == "restore" else 404) if state == "deleted" else 409
            out[op_id] = (code, None, None, None)
            continue
        n = latest[slug]
        if op == "restore":
            if arg < 1 or arg > n:
                out[op_id] = (404, None, None, None)
                continue
            if arg == n:
                out[op_id] = (400, None, None, None)
                continue
            if (slug, arg) not in stored:
                out[op_id] = (404, None, None, None)
                continue
            size = stored[slug, arg]
        free = [v for v in (n + 1, n + 2, n + 3) if (slug, v) not in stored]
        if not free:
            out[op_id] = (409, None, None, None)
            continue
        latest[slug] = free[0]
        stored[slug, free[0]] = size
        out[op_id] = (200, free[0], arg if op == "restore" else None, size)
    return out, latest


def compare(spark, ops, latest, status, stored):
    s = shares(spark, *[{"slug": k, "status": status[k], "latest_version": latest[k]} for k in status])
    o = objects(spark, [(keys(k, [v])[0], size, 0) for (k, v), size in stored.items()] + [("shares/a/sub/v9.html", 1, 0), ("shares/a/notes.txt", 1, 0)])
    log = versions.apply_version_log(spark.createDataFrame(ops, OPS), s, o)
    got = {r.op_id: (r.code, r.new_version, r.restored_from, r.content_size) for r in log.collect()}
    want, ends = replay(ops, latest, status, stored)
    assert got == want
    after = {r.slug: r.latest_version for r in versions.versions_after(log, s).collect()}
    assert after == {k: ends[k] for k in status}
    return got


@pytest.mark.parametrize("seed, chunk", [(0, 50_000), (1, 7), (2, 1), (3, 20)])
def test_log_equals_replay(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(versions, "CHUNK", chunk)
    rnd = random.Random(seed)
    slugs = list("abcdef") + ["hot"]
    status = {s: "committed" for s in slugs} | {"d": "deleted", "e": "pending"}
    latest = {s: rnd.randrange(1, 6) for s in slugs}
    stored = {}
    for s in slugs:
        for v in range(1, latest[s] + 1):
            if rnd.random() < 0.8:
                stored[s, v] = rnd.randrange(1000)
        for v in range(latest[s] + 1, latest[s] + 40):
            if rnd.random() < (0.15 if s != "b" else 0.5):
                stored[s, v] = rnd.randrange(1000)
    ops = []
    for i in range(500):
        s = "hot" if i % 3 == 0 else rnd.choice(slugs + ["unknown"])
        if rnd.random() < 0.45:
            ops.append((i, s, rnd.randrange(200), "edit", None, rnd.randrange(1000, 2000)))
        else:
            ops.append((i, s, rnd.randrange(200), "restore", rnd.randrange(-1, 60), None))
    got = compare(spark, ops, latest, status, stored)
    assert {200, 404, 409, 410} <= {c for c, *_ in got.values()}


def test_undo_chain(spark, monkeypatch):
    """Every restore targets the version before the live one, so each depends on all before it."""
    monkeypatch.setattr(versions, "CHUNK", 16)
    ops = [(0, "a", 0, "edit", None, 77)] + [(i, "a", i, "restore", i, None) for i in range(1, 120)]
    got = compare(spark, ops, {"a": 1}, {"a": "committed"}, {("a", 1): 5})
    assert all(c == 200 for c, *_ in got.values())


def test_occupied_numbers_are_stepped_over_up_to_a_limit(spark):
    stored = {("a", 1): 1, ("a", 3): 9, ("a", 4): 9, ("a", 6): 9, ("a", 7): 9, ("a", 8): 9}
    ops = [(i, "a", i, "edit", None, i) for i in range(4)]
    got = compare(spark, ops, {"a": 1}, {"a": "committed"}, stored)
    assert [got[i][:2] for i in range(4)] == [(200, 2), (200, 5), (409, None), (409, None)]


def test_listing(spark):
    s = shares(spark, {"slug": "a", "latest_version": 12}, {"slug": "b", "latest_version": 1})
    o = objects(spark, keys("a", range(1, 13)) + keys("a", [99]) + ["shares/a/notes.txt"] + keys("b", [1]))
    got = sorted(rows(versions.version_listing(s, o), "slug", "version", "live"))
    assert got == [("a", v, v == 12) for v in range(3, 13)] + [("b", 1, True)]


def test_storage_audit(spark):
    s = shares(
        spark, {"slug": "a", "latest_version": 2}, {"slug": "gone", "status": "deleted"}, {"slug": "lost", "latest_version": 3}
    )
    o = objects(spark, keys("a", [1, 2, 3]) + ["shares/a/x.txt"] + keys("gone", [1]) + keys("who", [2]))
    got = dict(rows(versions.storage_audit(s, o), "key", "class"))
    assert got == {
        "shares/a.html": "history", "shares/a/v2.html": "live", "shares/a/v3.html": "orphan", "shares/a/x.txt": "unrecognised",
        "shares/gone.html": "of_deleted_share", "shares/who/v2.html": "no_such_share", "shares/lost/v3.html": "missing_live",
    }


def sweep(spark, share_rows, keys_, now=NOW, flags=()):
    """One sweep: keys left, shares after, counts."""
    s, o = shares(spark, *share_rows), objects(spark, keys_)
    f = spark.createDataFrame(list(flags), "slug string, listing_complete boolean, delete_ok boolean")
    plan = versions.sweep_plan(s, o, now)
    marks = {r.slug: r for r in versions.sweep_markers(versions.sweep_eligible(s, now), plan, f).collect()}
    failed = {x[0] for x in flags if not x[2]}
    doomed = {r.key for r in plan.filter("why <> 'held_back'").collect() if r.slug not in failed}
    left = [k for k in keys_ if (k[0] if isinstance(k, tuple) else k) not in doomed]
    after = [
        dict(r, versions_pruned_below=marks[r["slug"]].versions_pruned_below, orphan_since=marks[r["slug"]].orphan_since)
        if r["slug"] in marks
        else r
        for r in share_rows
    ]
    return left, after, versions.sweep_counts(s, o, now).first(), marks


def test_sweep_keeps_the_newest_and_converges(spark):
    share = {"slug": "a", "latest_version": 12}
    left, after, counts, _ = sweep(spark, [share], keys("a", range(1, 13)) + ["shares/a/notes.txt"])
    assert left == keys("a", range(3, 13)) + ["shares/a/notes.txt"]
    assert (counts.taken, counts.skipped, counts.pruned) == (1, 0, 2)
    again = sweep(spark, after, left)
    assert again[0] == left and tuple(again[2]) == (0, 0, 0)


def test_sweep_waits_for_the_limit(spark):
    assert tuple(sweep(spark, [{"slug": "a", "latest_version": 10}], keys("a", range(1, 11)))[2]) == (0, 0, 0)


def test_young_orphan_is_held_back_then_collected(spark):
    share = {"slug": "a", "latest_version": 12, "orphan_since": NOW}
    young = keys("a", range(1, 13)) + [(keys("a", [99])[0], 1, NOW)]
    left, after, _, marks = sweep(spark, [share], young)
    assert left[-1][0].endswith("v99.html") and marks["a"].orphan_since == NOW and marks["a"].versions_pruned_below == 3
    left, after, _, marks = sweep(spark, after, left, now=NOW + LIMITS.pending_age_seconds + 60)
    assert left == keys("a", range(3, 13)) and marks["a"].orphan_since is None


def test_deleted_share_goes_whole(spark):
    for count in (1, 3):
        share = {"slug": "a", "status": "deleted", "latest_version": count}
        left, after, counts, _ = sweep(spark, [share], keys("a", range(1, count + 1)))
        assert left == [] and counts.pruned == count
        assert tuple(sweep(spark, after, left)[2]) == (0, 0, 0)


def test_incomplete_listing_and_failed_delete_keep_the_share(spark):
    share = {"slug": "a", "status": "deleted", "latest_version": 3}
    for flags in ([("a", False, True)], [("a", True, False)]):
        _, after, _, marks = sweep(spark, [share], keys("a", [1, 2, 3]), flags=flags)
        assert marks["a"].versions_pruned_below == 1
        assert sweep(spark, after, [])[2].taken == 1


def _passed_one_by_one(rows):
    passed, done = set(), {}
    for slug, op_id, _, need in sorted(rows, key=lambda r: (r[0], r[2])):
        if done.get(slug, 0) >= need:
            passed.add((slug, op_id))
            done[slug] = done.get(slug, 0) + 1
    return passed


def test_chunks_are_chained_as_functions(spark, monkeypatch):
    """4,000 conditional restores of one share in chunks of 100, beside small shares; no Python group exceeds a chunk."""
    import random

    rng = random.Random(5)
    rows, passed = [], 0
    for nth in range(1, 4001):
        need = max(-2, passed + rng.choice([-40, -3, -1, 0, 0, 1, 2]) if rng.random() < 0.9 else rng.randrange(4000))
        passed += passed >= need
        rows.append(("hot", 10_000 + nth, nth, need))
    rows += [("b", i, i, i // 2) for i in range(1, 160)] + [("c", i, i, 0) for i in range(1, 90)] + [("d", 1, 1, 1)]
    table = spark.createDataFrame(rows, "slug string, op_id bigint, nth bigint, need bigint")
    sizes = spark.sparkContext.accumulator(0)
    finder = versions._threshold_finder()

    def counted():
        def find(pdf):
            if len(pdf) > 100:
                sizes.add(1)
            return finder(pdf)

        return find

    monkeypatch.setattr(versions, "_threshold_finder", counted)
    monkeypatch.setattr(versions, "CHUNK", 100)
    got = {tuple(r) for r in versions._accepted_conditionals(table).collect()}
    assert got == _passed_one_by_one(rows) and 500 < len(got) < 4200
    assert sizes.value == 0
    for size in (1, 7):
        monkeypatch.setattr(versions, "CHUNK", size)
        some = table.filter("slug <> 'hot' or nth <= 90")
        assert {tuple(r) for r in versions._accepted_conditionals(some).collect()} == _passed_one_by_one(
            [r for r in rows if r[0] != "hot" or r[2] <= 90]
        )
