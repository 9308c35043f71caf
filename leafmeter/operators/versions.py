"""Version history of shares, and the sweep that prunes stored objects."""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from leafmeter.functions import columns as C
from leafmeter.functions.ordered import running_total
from leafmeter.limits import LIMITS, Limits
from leafmeter.session import settled


def object_inventory(objects: DataFrame) -> DataFrame:
    """Listing with slug and version read from the key; NULL version = not recognised."""
    version = C.key_version(F.col("key"))
    return objects.select(
        C.key_slug(F.col("key")).alias("slug"),
        version.alias("version"),
        "key",
        "size",
        "uploaded",
        version.isNotNull().alias("recognised"),
    )


def version_listing(shares: DataFrame, objects: DataFrame, keep: int = LIMITS.keep_versions) -> DataFrame:
    """Newest versions of each share, orphans and unrecognised objects left out."""
    stored = object_inventory(objects).filter("recognised")
    newest = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("version"), "key"))
    return (
        stored.join(shares.select("slug", "latest_version"), "slug")
        .filter("version <= latest_version")
        .withColumn("place", newest)
        .filter(F.col("place") <= keep)
        .select(
            "slug",
            "version",
            F.col("uploaded").alias("created_at"),
            "size",
            (F.col("version") == F.col("latest_version")).alias("live"),
        )
    )


def storage_audit(shares: DataFrame, objects: DataFrame) -> DataFrame:
    """Class of every object, and committed shares whose live object is missing."""
    known = shares.select("slug", "status", "latest_version")
    version, latest = F.col("version"), F.col("latest_version")
    kind = (
        F.when(~F.col("recognised"), "unrecognised")
        .when(F.col("status").isNull(), "no_such_share")
        .when(F.col("status") == "deleted", "of_deleted_share")
        .when(version > latest, "orphan")
        .when(version == latest, "live")
        .otherwise("history")
    )
    classed = object_inventory(objects).join(known, "slug", "left").select("slug", "key", kind.alias("class"))
    missing = (
        known.filter("status = 'committed'")
        .select("slug", C.object_key(F.col("slug"), latest).alias("key"))
        .join(objects.select("key"), "key", "left_anti")
        .select("slug", "key", F.lit("missing_live").alias("class"))
    )
    return classed.unionByName(missing)


# ---- sweep ---------------------------------------------------------------------------------------


def sweep_eligible(shares: DataFrame, now: int, limits: Limits = LIMITS) -> DataFrame:
    """Shares with old versions, objects after deletion, or an aged orphan."""
    status, latest, pruned = F.col("status"), F.col("latest_version"), F.col("versions_pruned_below")
    return shares.filter(
        ((status == "committed") & (latest - pruned >= limits.keep_versions))
        | ((status == "deleted") & (pruned <= latest))
        | F.coalesce(F.col("orphan_since") < now - limits.pending_age_seconds, F.lit(False))
    ).withColumn(
        "keep_from",
        F.when(status == "deleted", latest + 1).otherwise(latest - limits.keep_versions + 1),
    )


def sweep_plan(
    shares: DataFrame, objects: DataFrame, now: int, limits: Limits = LIMITS
) -> DataFrame:
    """Objects of the swept shares that go, with the reason, and young orphans held back.

    Version 1 lies outside the share's folder, so its key is named whether it exists or not;
    ``present`` tells.
    """
    taken = sweep_eligible(shares, now, limits).select("slug", "latest_version", "keep_from")
    stored = object_inventory(objects).select("slug", "version", "key", "uploaded")
    version = F.col("version")
    why = (
        F.when(version < F.col("keep_from"), "old_version")
        .when(F.col("uploaded") < now - limits.pending_age_seconds, "orphan")
        .otherwise("held_back")
    )
    foldered = (
        stored.filter("version >= 2")
        .join(taken, "slug")
        .filter("version < keep_from or version > latest_version")
        .select("slug", "key", why.alias("why"), F.lit(True).alias("present"))
    )
    flat = (
        taken.filter("keep_from > 1")
        .select("slug", C.object_key(F.col("slug"), F.lit(1)).alias("key"))
        .join(stored.filter("version = 1").select("key", F.lit(True).alias("found")), "key", "left")
        .select("slug", "key", F.lit("first_version").alias("why"), F.col("found").isNotNull().alias("present"))
    )
    return foldered.unionByName(flat)


def sweep_counts(
    shares: DataFrame, objects: DataFrame, now: int, limits: Limits = LIMITS
) -> DataFrame:
    """One row ``(taken, skipped, pruned)``: every eligible share is taken, so none is skipped."""
    taken = sweep_eligible(shares, now, limits).agg(F.count("*").alias("taken"))
    pruned = sweep_plan(shares, objects, now, limits).agg(
        F.count_if(F.col("why") != "held_back").alias("pruned")
    )
    return taken.select(
        "taken",
        F.lit(0).cast("bigint").alias("skipped"),
        pruned.scalar().alias("pruned"),
    )


def sweep_markers(taken: DataFrame, plan: DataFrame, flags: DataFrame) -> DataFrame:
    """Markers of the swept shares after the run: ``(slug, versions_pruned_below, orphan_since)``."""
    return sweep_outcomes(taken, plan, flags).drop("finished")


def sweep_outcomes(taken: DataFrame, plan: DataFrame, flags: DataFrame) -> DataFrame:
    """``sweep_markers`` with ``finished``: the listing was complete, nothing was held back and no delete failed.

    ``flags`` holds ``(slug, listing_complete, delete_ok)``; shares without a row count as done.
    A share whose delete failed keeps its markers and is taken again.
    """
    per_slug = plan.groupBy("slug").agg(
        F.bool_or(F.col("why") == "held_back").alias("held"),
        F.bool_or(F.col("why") != "held_back").alias("doomed"),
    )
    no, yes = F.lit(False), F.lit(True)
    state = (
        taken.select("slug", "status", "latest_version", "keep_from", "versions_pruned_below", "orphan_since")
        .join(per_slug, "slug", "left")
        .join(flags, "slug", "left")
        .withColumn("held", F.coalesce("held", no))
        .withColumn("complete", F.coalesce("listing_complete", yes))
        .withColumn("failed", F.coalesce("doomed", no) & ~F.coalesce("delete_ok", yes))
        .withColumn("finished", F.col("complete") & ~F.col("held") & ~F.col("failed"))
    )
    advance = F.when(F.col("status") == "deleted", F.col("finished")).otherwise(
        F.col("complete") & ~F.col("failed")
    )
    return state.select(
        "slug",
        F.when(advance, F.greatest(F.lit(1), F.col("keep_from")))
        .otherwise(F.col("versions_pruned_below"))
        .cast("bigint")
        .alias("versions_pruned_below"),
        F.when(~F.col("finished"), F.col("orphan_since")).alias("orphan_since"),
        "finished",
    )


# ---- version log ---------------------------------------------------------------------------------

CHUNK = 50_000
_THRESHOLD_SCHEMA = "slug string, op_id bigint, chunk bigint, threshold bigint"


# Built inside a function so that it travels to the workers by value.


def _threshold_finder():
    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per conditional op of one chunk: how many conditional ops must pass before the chunk for
        it to pass.

        With k passed before the chunk, an op passes if k plus the ops of the chunk passed so far
        reaches its ``need``.  Passing is monotone in k, so each op has one threshold, and the ops
        passed so far are those with a threshold of at most k.
        """
        pdf = pdf.sort_values("nth")
        thresholds: list[int] = []
        out = []
        for need in pdf["need"]:
            low, high = 0, max(0, int(need))
            while low < high:
                mid = (low + high) // 2
                if mid + bisect_right(thresholds, mid) >= need:
                    high = mid
                else:
                    low = mid + 1
            insort(thresholds, low)
            out.append(low)
        return pd.DataFrame(
            {"slug": pdf["slug"], "op_id": pdf["op_id"], "chunk": pdf["chunk"], "threshold": out}
        )

    return find


def _composed(steps: DataFrame) -> DataFrame:
    """Blocks of chunks joined two by two: ``slug, block, threshold, n``.

    A block turns k ops passed before it into k plus the ``n`` of its thresholds up to k.  In the joined block a
    threshold of the right one becomes the least k that the left one turns into as much.
    """
    pair = C.whole_div(F.col("block"), 2)
    left, right = steps.filter("block % 2 = 0"), steps.filter("block % 2 = 1")
    upto = running_total(left, ["slug", "block"], [F.asc("threshold")], {"n": "upto"})
    # The left block passes this value at its threshold.
    before = F.col("threshold") + F.col("upto") - F.col("n")
    none = F.lit(None).cast("bigint")
    merged = upto.select("slug", "block", before.alias("value"), "threshold", F.col("n").alias("passed"), F.lit(0).alias("side"), "n").unionByName(
        right.select("slug", (F.col("block") - 1).alias("block"), F.col("threshold").alias("value"), none.alias("threshold"), F.lit(0).cast("bigint").alias("passed"), F.lit(1).alias("side"), "n")
    )
    seen = running_total(
        merged, ["slug", "block"], [F.asc("value"), F.asc("side")], {"passed": "total"}, {"threshold": "last"}
    )
    lifted = F.greatest(F.coalesce("last", F.lit(0)), F.col("value") - F.col("total"))
    threshold = F.when(F.col("side") == 0, F.col("threshold")).otherwise(lifted)
    return seen.groupBy("slug", pair.alias("block"), threshold.alias("threshold")).agg(F.sum("n").alias("n"))


def _chunk_bases(found: DataFrame) -> DataFrame:
    """Conditional ops passed before each chunk: ``slug, chunk, base``, for slugs of several chunks.

    A scan over the chunks as functions: blocks of 2, 4, 8 ... chunks are composed, then the passed ops are handed down
    from the largest blocks to their halves.  No step holds a slug in one group.
    """
    several = found.filter("chunk > 0").select("slug").distinct()
    rows = found.join(several, "slug", "left_semi")
    steps = settled(rows.groupBy("slug", F.col("chunk").alias("block"), "threshold").agg(F.count("*").alias("n")))
    chunks = settled(steps.select("slug", F.col("block").alias("chunk")).distinct())
    levels = int(chunks.agg(F.max("chunk")).first()[0] or 0).bit_length()
    functions = [steps]
    for _ in range(levels - 1):
        functions.append(settled(_composed(functions[-1])))
    bases = several.select("slug", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("base"))
    for level in reversed(range(levels)):
        above = bases.withColumnRenamed("block", "parent")
        blocks = chunks.select("slug", C.whole_div(F.col("chunk"), 2**level).alias("block")).distinct()
        blocks = blocks.withColumn("parent", C.whole_div(F.col("block"), 2)).join(above, ["slug", "parent"])
        left = functions[level].filter("block % 2 = 0").withColumn("parent", C.whole_div(F.col("block"), 2)).drop("block")
        passed = (
            left.join(above, ["slug", "parent"]).filter("threshold <= base").groupBy("slug", "parent").agg(F.sum("n").alias("passed"))
        )
        more = F.when(F.col("block") % 2 == 1, F.coalesce("passed", F.lit(0))).otherwise(0)
        bases = settled(
            blocks.join(passed, ["slug", "parent"], "left").select("slug", "block", (F.col("base") + more).cast("bigint").alias("base"))
        )
    return bases.withColumnRenamed("block", "chunk")


def _accepted_conditionals(conditional: DataFrame) -> DataFrame:
    """Ids of the conditional restores that pass: ``(slug, op_id)``.

    ``conditional`` holds ``slug, op_id, nth, need``: the nth conditional op of its slug passes if at
    least ``need`` conditional ops passed before it.  A slug's ops are cut into chunks of bounded
    size; a chunk is worked out without knowing what came before, and chunks of one slug are
    chained as functions of the ops passed before (``_chunk_bases``).
    """
    chunked = conditional.withColumn("chunk", C.whole_div(F.col("nth") - 1, CHUNK)).select(
        "slug", "op_id", "chunk", "nth", "need"
    )
    found = settled(
        chunked.groupBy("slug", "chunk").applyInPandas(_threshold_finder(), _THRESHOLD_SCHEMA)
    )
    bases = _chunk_bases(found)
    return (
        found.join(bases, ["slug", "chunk"], "left")
        .filter(F.col("threshold") <= F.coalesce("base", F.lit(0)))
        .select("slug", "op_id")
    )


def _marked_numbers(strays: DataFrame, asked: DataFrame) -> DataFrame:
    """Strays and asked-for numbers with ``strays_upto``, the occupied numbers of the slug up to them."""
    marks = strays.select(
        "slug", "first_latest", F.col("version").alias("number"), F.lit(1).alias("is_stray"), F.lit(0).cast("bigint").alias("op_id")
    )
    both = marks.unionByName(
        asked.select("slug", "first_latest", F.col("arg").alias("number"), F.lit(0).alias("is_stray"), "op_id")
    )
    return running_total(
        both, ["slug"], [F.asc("number"), F.desc("is_stray"), F.asc("op_id")], {"is_stray": "strays_upto"}
    )


def _number_of(strays: DataFrame, accepted: DataFrame) -> DataFrame:
    """Version number of the nth accepted op of a slug: the nth number above the first latest
    version that no object occupies."""
    # A stray with f free numbers below it shifts every op after the f-th.
    shift = strays.select(
        "slug",
        (F.col("version") - F.col("first_latest") - F.col("stray_no")).alias("nth"),
        F.lit(1).alias("is_stray"),
        F.col("version").alias("op_id"),
    )
    both = shift.unionByName(accepted.select("slug", "nth", F.lit(0).alias("is_stray"), "op_id"))
    # Ops with the same count as a stray come before it.
    return (
        running_total(
            both, ["slug"], [F.asc("nth"), F.asc("is_stray"), F.asc("op_id")], {"is_stray": "shift"}
        )
        .filter("is_stray = 0")
        .select("slug", "op_id", "shift")
    )


def _own_objects(objects: DataFrame) -> DataFrame:
    """Objects at the very key a write of their version uses."""
    at_own_key = F.col("key") == C.object_key(F.col("slug"), F.col("version"))
    return object_inventory(objects).filter(at_own_key).select("slug", "version", "size")


def _op_outcomes(ops: DataFrame, shares: DataFrame, stored: DataFrame, limits: Limits) -> DataFrame:
    """One row per op with its code and, for writes, the new version number."""
    tries = limits.write_attempts
    known = shares.select("slug", "status", F.col("latest_version").alias("first_latest"))
    log = ops.join(known, "slug", "left")
    status, arg, first_latest = F.col("status"), F.col("arg"), F.col("first_latest")
    refused = (
        F.when(status.isNull(), 404)
        .when(status == "deleted", F.when(F.col("op") == "edit", 404).otherwise(410))
        .when(status != "committed", 409)
        .when((F.col("op") == "restore") & (arg.isNull() | (arg < 1)), 404)
    )
    log = settled(log.withColumn("refused", refused))

    # Occupied numbers above the first latest version, and the first run of them too long to step over.
    touched = log.filter("refused is null").select("slug", "first_latest").distinct()
    strays = stored.join(touched, "slug").filter("version > first_latest").select("slug", "version", "first_latest")
    # Restores of versions above the first latest one depend on the writes before them.
    ahead = log.filter("refused is null and op = 'restore' and arg > first_latest")
    marked = _marked_numbers(strays, ahead)
    strays = marked.filter("is_stray = 1").select(
        "slug", "first_latest", F.col("number").alias("version"), F.col("strays_upto").alias("stray_no")
    )
    upto = marked.filter("is_stray = 0").select("slug", "op_id", "strays_upto")
    blocks = (
        strays.groupBy("slug", "first_latest", (F.col("version") - F.col("stray_no")).alias("run"))
        .agg(F.count("*").alias("length"))
        .filter(F.col("length") >= tries)
        .groupBy("slug")
        .agg(F.min(F.col("run") - F.col("first_latest")).alias("max_writes"))
    )

    live = log.filter("refused is null").join(blocks, "slug", "left")
    old = stored.select("slug", F.col("version").alias("arg"), F.lit(True).alias("found"))
    staged = (
        live.join(upto, ["slug", "op_id"], "left")
        .join(old, ["slug", "arg"], "left")
        .withColumn("free_upto", arg - first_latest - F.col("strays_upto"))
        .withColumn(
            "kind",
            F.when(F.col("op") == "edit", "write")
            .when(arg > first_latest, "ahead")
            .when(arg == first_latest, "current")
            .when(F.col("found").isNotNull(), "write")
            .otherwise("gone"),
        )
    )
    # A restore of the first latest version is refused until the first write has passed.
    need = F.when(F.col("kind") == "current", F.lit(1)).when(F.col("kind") == "ahead", F.col("free_upto") + 1)
    present = F.when(F.col("kind") == "current", F.col("found").isNotNull()).otherwise(F.lit(True))
    reachable = F.coalesce(need <= F.col("max_writes"), F.lit(True))
    staged = (
        staged.withColumn("need", need)
        .withColumn("sure", (F.col("kind") == "write").cast("int"))
        .withColumn("open", (F.col("need").isNotNull() & present & reachable).cast("int"))
    )
    in_order = [F.asc("ts"), F.asc("op_id")]
    placed = running_total(staged, ["slug"], in_order, {"sure": "sure_upto", "open": "open_upto"})
    conditional = placed.filter("open = 1").select(
        "slug", "op_id", F.col("open_upto").alias("nth"), (F.col("need") - F.col("sure_upto")).alias("need")
    )
    passed = _accepted_conditionals(conditional).withColumn("passed", F.lit(1))
    judged = placed.join(passed, ["slug", "op_id"], "left").withColumn(
        "wrote", F.greatest(F.col("sure"), F.coalesce("passed", F.lit(0)))
    )
    counted = running_total(judged, ["slug"], in_order, {"wrote": "nth"})
    fits = (F.col("wrote") == 1) & F.coalesce(F.col("nth") <= F.col("max_writes"), F.lit(True))
    numbers = _number_of(strays, counted.filter(fits).select("slug", "nth", "op_id"))
    # Writes done when a restore was refused tell whether its version was the live one or none at all.
    done = F.least(F.col("nth"), F.coalesce("max_writes", F.col("nth")))
    stray_itself = F.coalesce(F.col("found"), F.lit(False))
    is_live = F.when(F.col("kind") == "current", done == 0).otherwise(
        (done == F.col("free_upto")) & ~stray_itself
    )
    code = (
        F.when((F.col("wrote") == 1) & fits, 200)
        .when(F.col("wrote") == 1, 409)
        .when(F.col("kind").isin("current", "ahead") & is_live, 400)
        .otherwise(404)
    )
    applied = counted.join(numbers, ["slug", "op_id"], "left").select(
        "op_id",
        "slug",
        "ts",
        "op",
        "size",
        code.cast("bigint").alias("code"),
        F.when(fits, first_latest + F.col("nth") + F.col("shift")).alias("new_version"),
        F.when(fits & (F.col("op") == "restore"), arg).alias("restored_from"),
    )
    turned_away = log.filter("refused is not null").select(
        "op_id", "slug", "ts", "op", "size",
        F.col("refused").cast("bigint").alias("code"),
        F.lit(None).cast("bigint").alias("new_version"),
        F.lit(None).cast("bigint").alias("restored_from"),
    )
    return settled(applied.unionByName(turned_away))


def _sizes(outcomes: DataFrame, stored: DataFrame) -> DataFrame:
    """Byte size of every version written: an edit's own, a restore's from the version it copies.

    Chains of restores are followed by doubling, so a chain of n links takes log n joins.
    """
    stored = stored.withColumnRenamed("size", "old_size")
    written = outcomes.filter("new_version is not null")
    nodes = (
        written.select("slug", F.col("new_version").alias("version"), "op", "size", "restored_from")
        .join(
            stored.select("slug", F.col("version").alias("restored_from"), "old_size"),
            ["slug", "restored_from"],
            "left",
        )
        .select(
            "slug",
            "version",
            F.when(F.col("op") == "edit", F.col("size")).otherwise(F.col("old_size")).alias("bytes"),
            F.col("restored_from").alias("source"),
        )
    )
    nodes = settled(nodes)
    while not nodes.filter("bytes is null").isEmpty():
        ahead = nodes.select(
            "slug", F.col("version").alias("source"), F.col("bytes").alias("s_bytes"), F.col("source").alias("s_source")
        )
        open_nodes = nodes.filter("bytes is null").join(ahead, ["slug", "source"])
        step = open_nodes.select("slug", "version", F.col("s_bytes").alias("bytes"), F.coalesce("s_source", "source").alias("source"))
        nodes = settled(nodes.filter("bytes is not null").unionByName(step))
    return nodes.select("slug", F.col("version").alias("new_version"), F.col("bytes").alias("content_size"))


def apply_version_log(
    ops: DataFrame, shares: DataFrame, objects: DataFrame, limits: Limits = LIMITS
) -> DataFrame:
    """Outcome of each edit or restore, taken per share in (ts, op_id) order.

    ``ops`` holds ``op_id, slug, ts, op, arg, size``.  A write takes the lowest free number of the
    next ``write_attempts`` after the latest version and never overwrites; a restore copies an older
    version to a new number.  Gives ``(op_id, slug, code, new_version, restored_from, content_size)``.
    """
    # Only objects of shares the log names; both are read several times below.
    stored = settled(
        _own_objects(objects).join(ops.select("slug").distinct(), "slug", "left_semi")
    )
    outcomes = _op_outcomes(ops, shares, stored, limits)
    return outcomes.join(_sizes(outcomes, stored), ["slug", "new_version"], "left").select(
        "op_id", "slug", "code", "new_version", "restored_from", "content_size"
    )


def versions_after(log: DataFrame, shares: DataFrame) -> DataFrame:
    """Latest version and size of each share after the log."""
    last = (
        log.filter("new_version is not null")
        .groupBy("slug")
        .agg(F.max("new_version").alias("v"), F.max_by("content_size", "new_version").alias("s"))
    )
    return shares.select("slug", "latest_version", "content_size").join(last, "slug", "left").select(
        "slug",
        F.coalesce("v", "latest_version").alias("latest_version"),
        F.coalesce("s", "content_size").alias("content_size"),
    )

