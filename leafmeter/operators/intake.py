"""Verdicts over whole logs of uploads, rate-limited requests and abuse reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from leafmeter.functions import columns as C
from leafmeter.limits import DAY, LIMITS, SYNC_KEY_BEARER, Limits
from leafmeter.session import settled
from leafmeter.sources.tables import SHARES


def _upload_fault(limits: Limits) -> Column:
    """Status code of the first check an upload fails, NULL where it passes them all."""
    html, kind = F.col("html"), F.coalesce("content_type", F.lit(""))
    json = kind.contains("application/json")
    plain = kind.contains("text/html") | kind.contains("text/plain")
    return (
        F.when(F.col("bearer").isNotNull() & ~C.good_bearer(F.col("bearer"), SYNC_KEY_BEARER), 401)
        .when(~json & ~plain, 415)
        .when(F.coalesce(html, F.lit("")) == "", 400)
        .when(C.utf8_bytes(html) > limits.max_html_bytes, 413)
        .when(~F.left(html, F.lit(limits.sniff_chars)).rlike(r"<[A-Za-z0-9_]"), 415)
    )


def _accepted_seconds(candidates: DataFrame, gap: int) -> DataFrame:
    """Uploads accepted of the first valid ones per second: ``(ip_hash, ts, first_id)``.

    An upload is accepted if none was accepted in the ``gap`` seconds before, which depends on the
    acceptances before it.  The only state carried from one day to the next is how many seconds the
    sender stays blocked, 0 to gap-1.  So each (sender, day) first works out, on its own, where every
    possible carry-in leads; a sender's days are then chained; and each day is replayed with its known
    carry-in.  A (sender, day) holds at most 86,400 distinct seconds, however many attempts there were.
    """
    by_day = (
        candidates.select(
            "ip_hash",
            C.day_of(F.col("ts")).alias("day"),
            (F.col("ts") % DAY).cast("int").alias("sec"),
            "first_id",
        )
        .groupBy("ip_hash", "day")
        .agg(F.sort_array(F.collect_list(F.struct("sec", "first_id"))).alias("secs"))
    )

    def block_until(free: Column) -> Column:
        """First second of the next day an upload may be accepted again, after starting at ``free``."""
        end = F.aggregate(
            "secs",
            free.cast("int"),
            lambda a, s: F.when(s["sec"] >= a, s["sec"] + gap).otherwise(a),
        )
        return F.greatest(end - DAY, F.lit(0))

    # A carry-in that ends before the first attempt changes nothing, and mostly none reaches it.
    first_sec = F.col("secs")[0]["sec"]
    leads = F.when(
        first_sec < gap - 1,
        F.transform(
            F.sequence(F.lit(0), F.lit(gap - 1)),
            lambda r: F.when(r > first_sec, block_until(r)),
        ),
    )
    # Other days neither hand on a block nor can be changed by one, so few days are chained.
    days = by_day.select(
        "ip_hash", "day", block_until(F.lit(0)).alias("free_lead"), leads.alias("leads")
    ).filter("free_lead > 0 or leads is not null")
    chain = days.groupBy("ip_hash").agg(
        F.sort_array(F.collect_list(F.struct("day", "free_lead", "leads"))).alias("days")
    )
    start = F.struct(
        F.lit(None).cast("bigint").alias("at"),
        F.lit(0).alias("carry"),
        F.array().cast("array<struct<day:bigint,carry:int>>").alias("out"),
    )

    def step(acc: Column, d: Column) -> Column:
        carry = F.when(d["day"] == acc["at"] + 1, acc["carry"]).otherwise(F.lit(0))
        lead = F.coalesce(F.element_at(d["leads"], carry + 1), d["free_lead"])
        entry = F.struct(d["day"].alias("day"), carry.alias("carry"))
        return F.struct(
            d["day"].alias("at"),
            lead.alias("carry"),
            F.when(carry > 0, F.concat(acc["out"], F.array(entry))).otherwise(acc["out"]).alias("out"),
        )

    # Only days on which the sender starts blocked come out.
    entries = chain.select(
        "ip_hash", F.inline(F.aggregate("days", start, step, lambda acc: acc["out"]))
    )
    replay = F.aggregate(
        "secs",
        F.struct(
            F.coalesce("carry", F.lit(0)).cast("int").alias("free"),
            F.array().cast("array<struct<sec:int,first_id:bigint>>").alias("taken"),
        ),
        lambda acc, s: F.when(
            s["sec"] >= acc["free"],
            F.struct(
                (s["sec"] + gap).cast("int").alias("free"),
                F.concat(acc["taken"], F.array(s)).alias("taken"),
            ),
        ).otherwise(acc),
        lambda acc: acc["taken"],
    )
    return (
        by_day.join(entries, ["ip_hash", "day"], "left")
        .select("ip_hash", "day", F.inline(replay))
        .select("ip_hash", (F.col("day") * DAY + F.col("sec")).alias("ts"), "first_id")
    )


def admit_uploads(
    uploads: DataFrame, salt: str, limits: Limits = LIMITS, prior: DataFrame | None = None
) -> DataFrame:
    """Status code per upload attempt, with what an accepted one stores.

    ``uploads`` holds ``attempt_id, ip, ts, content_type, bearer, ua, html``; ``html`` is NULL where a
    JSON body has none.  ``prior`` holds ``(ip_hash, last_ts)``, the last acceptance of earlier runs.
    """
    gap = limits.upload_gap_seconds
    # The pages themselves are not shuffled.
    checked = uploads.select(
        "attempt_id",
        C.ip_hash(F.col("ip"), salt).alias("ip_hash"),
        "ts",
        _upload_fault(limits).cast("bigint").alias("fault"),
        C.utf8_bytes(F.col("html")).alias("size"),
        C.client_channel(F.col("ua")).alias("client"),
        C.bearer_key_hash(F.col("bearer"), SYNC_KEY_BEARER).alias("owner_key_hash"),
    )
    held = F.lit(False)
    if prior is not None:
        # An earlier run's acceptance also blocks attempts that arrive late.
        checked = checked.join(prior.select("ip_hash", "last_ts"), "ip_hash", "left")
        held = F.coalesce(F.col("last_ts") > F.col("ts") - gap, F.lit(False))
    # Read the pages once: what follows needs only these few columns, twice.
    checked = settled(checked.withColumn("held", held))
    # Within a second only the first valid attempt can be accepted.
    candidates = (
        checked.filter("fault is null and not held")
        .groupBy("ip_hash", "ts")
        .agg(F.min("attempt_id").alias("first_id"))
    )
    # At most one upload is accepted per slot of ``gap`` seconds, and it blocks attempts of its own
    # slot and of the next one only.
    own = F.col("slot") == C.whole_div(F.col("at"), gap)
    blockers = (
        _accepted_seconds(candidates, gap)
        .select("ip_hash", F.col("ts").alias("at"), "first_id")
        .withColumn("slot", F.explode(F.array(*[C.whole_div(F.col("at"), gap) + k for k in (0, 1)])))
        .groupBy("ip_hash", "slot")
        .agg(
            F.max(F.when(own, F.col("at"))).alias("own_at"),
            F.max(F.when(own, F.col("first_id"))).alias("own_id"),
            F.max(F.when(~own, F.col("at"))).alias("before_at"),
        )
    )
    judged = checked.withColumn("slot", C.whole_div(F.col("ts"), gap)).join(
        blockers, ["ip_hash", "slot"], "left"
    )
    limited = F.coalesce(
        (F.col("before_at") > F.col("ts") - gap)
        | (F.col("own_at") < F.col("ts"))
        | ((F.col("own_at") == F.col("ts")) & (F.col("own_id") < F.col("attempt_id"))),
        F.lit(False),
    )
    code = F.when(F.col("held") | limited, 429).otherwise(F.coalesce("fault", F.lit(201))).cast("bigint")
    stored = F.col("code") == 201
    return judged.withColumn("code", code).select(
        "attempt_id",
        "ip_hash",
        "ts",
        "code",
        F.when(stored, F.col("size")).alias("content_size"),
        F.when(stored, F.col("client")).alias("client"),
        F.when(stored, F.col("owner_key_hash")).alias("owner_key_hash"),
    )


def upload_limiter_summary(verdicts: DataFrame) -> DataFrame:
    """Accepted, limited and invalid attempts per sender and UTC day."""
    code = F.col("code")
    return verdicts.groupBy("ip_hash", C.day_text(C.day_of(F.col("ts"))).alias("day")).agg(
        F.count_if(code == 201).alias("accepted"),
        F.count_if(code == 429).alias("limited"),
        F.count_if(~code.isin(201, 429)).alias("invalid"),
    )


def _within_limit(requests: DataFrame, key: str, limit: int, period: int, flag: str) -> DataFrame:
    """Flag requests among the first ``limit`` of their key and time window; NULL where not counted.

    Only the limit-th request of each busy window is looked for (the rank limit runs before the
    shuffle), and every request is then compared with that one.
    """
    window = C.whole_div(F.col("ts"), period)
    counted = F.col("counted") & F.col(key).isNotNull()
    order = Window.partitionBy(key, "win").orderBy("ts", "request_id")
    last_allowed = (
        requests.filter(counted)
        .select(key, window.alias("win"), "ts", "request_id")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") == limit)
        .select(key, "win", F.struct("ts", "request_id").alias("edge"))
    )
    return (
        requests.withColumn("win", window)
        .join(last_allowed, [key, "win"], "left")
        .withColumn(
            flag,
            F.when(counted, F.coalesce(F.struct("ts", "request_id") <= F.col("edge"), F.lit(True))),
        )
        .drop("win", "edge")
    )


def fixed_window_limits(requests: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Verdict per request of the rate-limited routes: ``(request_id, ip_ok, key_ok, code)``.

    List and claim requests pass a limit per address and then one per key; write requests only one
    per address.  Windows are aligned to the epoch.  A request whose limiter failed passes uncounted.
    """
    period = limits.rate_window_seconds
    healthy = ~F.col("limiter_error")
    writes = _within_limit(
        requests.filter("route = 'write'").withColumn("counted", healthy),
        "ip_hash", limits.write_per_ip, period, "ip_ok",
    ).withColumn("key_ok", F.lit(None).cast("boolean"))
    first = _within_limit(
        requests.filter("route <> 'write'").withColumn("counted", healthy),
        "ip_hash", limits.list_per_ip, period, "ip_ok",
    )
    second = _within_limit(
        first.withColumn("counted", F.coalesce("ip_ok", F.lit(False))),
        "key_hash", limits.list_per_key, period, "key_ok",
    )
    refused = (~F.coalesce("ip_ok", F.lit(True))) | (~F.coalesce("key_ok", F.lit(True)))
    return second.unionByName(writes).select(
        "request_id", "ip_ok", "key_ok", F.when(refused, 429).otherwise(200).cast("bigint").alias("code")
    )


def intake_reports(
    raw: DataFrame, shares: DataFrame, existing: DataFrame, limits: Limits = LIMITS
) -> DataFrame:
    """Verdict per report: ``(request_id, code, deduped)`` and the columns a stored one takes."""
    first = F.struct("ts", "request_id")
    known = shares.select("slug", F.lit(True).alias("known"))
    checked = (
        raw.withColumn("reason_text", C.trimmed(F.col("reason")))
        .join(known, "slug", "left")
        .withColumn(
            "fault",
            F.when(F.coalesce("reason_text", F.lit("")) == "", 400)
            .when(F.length("reason") > limits.reason_chars, 413)
            .when(~F.col("email_is_text"), 400)
            .when(F.col("known").isNull(), 404),
        )
    )
    pair = ["slug", "reporter_ip_hash"]
    winners = (
        checked.filter("fault is null")
        .groupBy(*pair)
        .agg(F.min(first).alias("winner"))
        .join(existing.select(*pair), pair, "left_anti")
    )
    judged = checked.join(winners, pair, "left")
    stored = F.col("fault").isNull() & (F.coalesce(F.col("winner") == first, F.lit(False)))
    return judged.select(
        "request_id",
        F.coalesce("fault", F.lit(200)).cast("bigint").alias("code"),
        (F.col("fault").isNull() & ~stored).alias("deduped"),
        stored.alias("stored"),
        *pair,
        F.col("reason_text").alias("reason"),
        F.col("email").alias("reporter_email"),
        "ts",
    )


def new_reports(verdicts: DataFrame) -> DataFrame:
    """Rows the accepted reports add to the report table."""
    return verdicts.filter("stored").select(
        F.col("request_id").alias("id"),
        "slug",
        "reason",
        "reporter_ip_hash",
        F.col("ts").alias("reported_at"),
        F.lit("open").alias("status"),
        "reporter_email",
    )


def new_shares(verdicts: DataFrame, grants: DataFrame, shares: DataFrame) -> DataFrame:
    """The rows that accepted uploads add to ``shares``; no slug is given twice.

    ``grants`` holds ``attempt_id, slugs, edit_token_hash, stored``: the slugs an upload would take in turn, and whether its
    page was stored.  In order of (ts, attempt_id) each accepted upload takes its first slug that no share has and
    no earlier upload took; one without a slug left adds no row.  A page that was not stored leaves the share pending.

    Every upload asks for its first open slug, the earliest asker of a slug holds it, and the others go on; as a holder only
    ever gives way to an earlier upload, the rounds end with what asking one by one would give.
    """
    accepted = settled(verdicts.filter("code = 201").join(grants, "attempt_id"))
    open_slugs = settled(
        accepted.select("attempt_id", "ts", F.posexplode("slugs").alias("turn", "slug"))
        .filter("slug is not null")
        .join(shares.select("slug"), "slug", "left_anti")
    )
    while True:
        asked = open_slugs.groupBy("attempt_id").agg(F.min(F.struct("turn", "slug", "ts")).alias("a")).select("attempt_id", "a.*")
        holders = asked.groupBy("slug").agg(F.min(F.struct("ts", "attempt_id")).alias("holder"))
        refused = settled(
            asked.join(holders, "slug").filter(F.col("holder.attempt_id") != F.col("attempt_id")).select("attempt_id", "turn")
        )
        if refused.isEmpty():
            break
        open_slugs = settled(open_slugs.join(refused, ["attempt_id", "turn"], "left_anti"))
    none = {k: F.lit(None).cast("bigint").alias(k) for k in ("deleted_at", "vault_updated_at", "orphan_since")}
    one = {k: F.lit(1).cast("bigint").alias(k) for k in ("latest_version", "versions_pruned_below")}
    row = {
        **none,
        **one,
        "status": F.when(F.col("stored"), "committed").otherwise("pending").alias("status"),
        "created_at": F.col("ts").alias("created_at"),
        "committed_at": F.when(F.col("stored"), F.col("ts")).alias("committed_at"),
        "sender_ip_hash": F.col("ip_hash").alias("sender_ip_hash"),
        "owner_claimed_at": F.when(F.col("owner_key_hash").isNotNull(), F.col("ts")).alias("owner_claimed_at"),
        "vault_ciphertext": F.lit(None).cast("string").alias("vault_ciphertext"),
    }
    given = accepted.join(asked.select("attempt_id", "slug"), "attempt_id")
    return given.select(*[row.get(f.name, F.col(f.name)) for f in SHARES.fields])
