"""Bulk claiming of shares by edit tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafmeter.functions import columns as C
from leafmeter.limits import LIMITS

OUTCOMES = ("claimed", "already-yours", "owned-by-other", "not-found")


def _claim_rows(claims: DataFrame, max_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Tokens of well-formed requests with their hash, and the ids of malformed requests."""
    tokens = F.col("tokens")
    bad = (
        tokens.isNull()
        | F.exists(tokens, lambda t: t.isNull() | (t == ""))
        | (F.size(tokens) > max_tokens)
    )
    rows = claims.filter(~bad).select(
        "request_id", "ts", F.col("owner_key_hash").alias("caller"), F.posexplode(tokens).alias("pos", "token")
    )
    rows = rows.withColumn("edit_token_hash", C.sha256_hex(F.col("token"))).drop("token")
    return rows, claims.filter(bad).select("request_id")


def _first_claims(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """Per token hash of a committed share: its slug, owner, and the first request that claimed it.

    Ownership never changes hands once set, so the earliest request decides; no replay is needed.
    """
    first = rows.groupBy("edit_token_hash").agg(
        F.min(F.struct("ts", "request_id", "caller")).alias("first")
    )
    live = shares.filter("status = 'committed'").select("edit_token_hash", "slug", "owner_key_hash")
    return live.join(first, "edit_token_hash")


def claim_shares(claims: DataFrame, shares: DataFrame, max_tokens: int = LIMITS.claim_tokens) -> DataFrame:
    """Outcome per token, in token order: ``(request_id, pos, outcome, slug)``.

    Requests are taken in (ts, request_id) order.  A malformed request gives one row with
    the outcome 'bad-request' and no position.
    """
    rows, bad = _claim_rows(claims, max_tokens)
    decided = _first_claims(rows, shares)
    judged = rows.join(decided, "edit_token_hash", "left")
    mine, caller = F.col("owner_key_hash"), F.col("caller")
    winner = F.coalesce(mine, F.col("first")["caller"])
    outcome = (
        F.when(F.col("slug").isNull(), "not-found")
        .when(winner != caller, "owned-by-other")
        .when(mine.isNotNull() | (F.col("first")["request_id"] != F.col("request_id")), "already-yours")
        .otherwise("claimed")
    )
    results = judged.select(
        "request_id",
        caller.alias("owner_key_hash"),
        F.col("pos").cast("bigint").alias("pos"),
        outcome.alias("outcome"),
        F.when(winner == caller, F.col("slug")).alias("slug"),
    )
    refused = bad.select(
        "request_id",
        F.lit(None).cast("string").alias("owner_key_hash"),
        F.lit(None).cast("bigint").alias("pos"),
        F.lit("bad-request").alias("outcome"),
        F.lit(None).cast("string").alias("slug"),
    )
    return results.unionByName(refused)


def claimed_owners(claims: DataFrame, shares: DataFrame, max_tokens: int = LIMITS.claim_tokens) -> DataFrame:
    """Owner and time of claim each share ends with: ``(slug, owner_key_hash, owner_claimed_at)``.

    The owner claiming again moves the time forward, as the update that grants the claim does.
    """
    rows, _ = _claim_rows(claims, max_tokens)
    owner = F.coalesce("owner_key_hash", F.col("first")["caller"])
    # Latest claim per (token, caller); the share's owner picks its own row.
    latest = rows.groupBy("edit_token_hash", "caller").agg(F.max("ts").alias("claimed_at"))
    return (
        _first_claims(rows, shares)
        .withColumn("caller", owner)
        .join(latest, ["edit_token_hash", "caller"])
        .select("slug", F.col("caller").alias("owner_key_hash"), F.col("claimed_at").alias("owner_claimed_at"))
    )


def claim_tally(outcomes: DataFrame, per_call: int = LIMITS.claim_tokens) -> DataFrame:
    """Outcomes per caller, shares added, and calls a client needs for that many tokens."""
    named = outcomes.filter(F.col("outcome").isin(*OUTCOMES))

    def count(outcome: str):
        return F.count_if(F.col("outcome") == outcome).alias(outcome.replace("-", "_"))

    return (
        named.groupBy("owner_key_hash")
        .agg(*[count(o) for o in OUTCOMES], F.count("*").alias("tokens"))
        .select(
            "owner_key_hash",
            *[o.replace("-", "_") for o in OUTCOMES],
            (F.col("claimed") + F.col("already_yours")).alias("added"),
            F.ceil(F.col("tokens") / per_call).cast("bigint").alias("calls"),
        )
    )
