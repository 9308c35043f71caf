"""The continuous jobs.

Sinks that need a merge keep a log of small per-batch tables (``BatchLog``): a batch writes its own folder
``batch=<id>`` with overwrite, so a repeated batch replaces itself, readers fold the log, and every some batches the
committed ones are folded into one table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from leafmeter.functions import columns as col
from leafmeter.limits import LIMITS, Limits
from leafmeter.operators import hits as hit_ops
from leafmeter.operators import intake
from leafmeter.sources.tables import Folder


def _start(df: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


#: Batches after which a log is folded.
FOLD_EVERY = 16


class BatchLog:
    """The log of one stream, which alone writes below ``path`` and keeps its checkpoint.

    ``batch=<id>`` holds what a batch logged, ``upto=<id>`` all batches up to this one, folded.  ``fold`` merges logged rows
    to rows of the same columns, in any order and grouping.  Only batches before the running one are folded; these are
    committed and never repeated, so a repeated batch, or a repeated folding, changes nothing.
    """

    def __init__(self, path: str, fold: Callable[[DataFrame], DataFrame], every: int | None = None) -> None:
        self.path, self.fold, self.every = path.rstrip("/"), fold, every or FOLD_EVERY

    def _found(self, spark: SparkSession) -> tuple[int, list[int]]:
        """The last batch that is folded (-1: none) and the batches logged after it."""
        folder = Folder(spark, self.path)
        ids = {"upto": [], "batch": []}
        for name in folder.parts("", 1):
            kind, number = name.split("=")
            if kind in ids and folder.has(f"{name}/_SUCCESS"):
                ids[kind].append(int(number))
        upto = max(ids["upto"], default=-1)
        return upto, sorted(i for i in ids["batch"] if i > upto)

    def folders(self, spark: SparkSession, before: int | None = None) -> list[str]:
        """The folders that hold the log, of batches below ``before`` only."""
        upto, batches = self._found(spark)
        names = [f"upto={upto}"] if upto >= 0 else []
        return [f"{self.path}/{n}" for n in names + [f"batch={i}" for i in batches if before is None or i < before]]

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The folded log, or None while nothing is logged."""
        folders = self.folders(spark, before)
        return self.fold(spark.read.parquet(*folders)) if folders else None

    def write(self, rows: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % self.every == 0:
            self.compact(rows.sparkSession, batch_id - 1)
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Fold the batches up to ``upto``, all of them committed."""
        done, batches = self._found(spark)
        if upto <= done or not any(i <= upto for i in batches):
            return
        names = [f"upto={done}"] * (done >= 0) + [f"batch={i}" for i in batches if i <= upto]
        rows = self.fold(spark.read.parquet(*[f"{self.path}/{n}" for n in names]))
        rows.write.mode("overwrite").parquet(f"{self.path}/upto={upto}")
        # Readers may still be in what this folding replaced, so only what the last one replaced goes.
        folder = Folder(spark, self.path)
        for name in folder.parts("", 1):
            kind, number = name.split("=")
            if int(number) < done or (kind == "batch" and int(number) <= done):
                folder.remove(name)


def _folded(log: BatchLog, spark: SparkSession) -> DataFrame:
    rows = log.read(spark)
    if rows is None:
        raise FileNotFoundError(f"no batch has been logged below {log.path}")
    return rows


def stream_enrich(hits: DataFrame, shares: DataFrame, salt: str) -> DataFrame:
    """Hits to view rows, joined with the committed shares as they are when a batch starts."""
    return hit_ops.enrich_hits(hits, shares, salt)


def stream_daily_views(views: DataFrame, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """Human views per slug and UTC day, logged whenever a count changes, days still open included.

    ``views`` needs ``viewed_at`` in seconds.  A day takes rows until the watermark, ``delay`` behind the latest row, has
    passed its end; later ones show in the query's progress as ``numRowsDroppedByWatermark``.
    """
    days = (
        views.filter("is_bot = 0")
        .withColumn("at", F.timestamp_seconds("viewed_at"))
        .withWatermark("at", delay)
        .groupBy("slug", F.window("at", "1 day"))
        .agg(F.count("*").alias("views"))
        .select("slug", F.date_format("window.start", "yyyy-MM-dd").alias("date"), "views")
    )
    return _start(days, checkpoint, "update", daily_log(path).write)


def daily_log(path: str) -> BatchLog:
    """Counts only grow, so the largest logged one is the current one."""
    return BatchLog(path, lambda rows: rows.groupBy("slug", "date").agg(F.max("views").alias("views")))


def read_daily_views(spark: SparkSession, path: str) -> DataFrame:
    return _folded(daily_log(path), spark)


def stream_counters(views: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running human and bot views per slug.  Keeps no state: each batch logs its own sums."""
    write = counter_log(path).write

    def each(batch: DataFrame, batch_id: int) -> None:
        human = F.col("is_bot") == 0
        write(
            batch.groupBy("slug").agg(
                F.count_if(human).alias("views"),
                F.count_if(~human).alias("bot_views"),
                F.max(F.when(human, F.col("viewed_at"))).alias("last_viewed"),
            ),
            batch_id,
        )

    return _start(views, checkpoint, "append", each)


def counter_log(path: str) -> BatchLog:
    sums = [F.sum("views").alias("views"), F.sum("bot_views").alias("bot_views"), F.max("last_viewed").alias("last_viewed")]
    return BatchLog(path, lambda rows: rows.groupBy("slug").agg(*sums))


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    return _folded(counter_log(path), spark)


def stream_unique_viewers(views: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """First sight of each (slug, viewer) among humans, counted per batch.

    Viewers are never forgotten, so the state grows with the distinct pairs.
    """
    first = views.filter("is_bot = 0").select("slug", "ip_hash").dropDuplicates(["slug", "ip_hash"])
    write = viewer_log(path).write

    def each(batch: DataFrame, batch_id: int) -> None:
        write(batch.groupBy("slug").agg(F.count("*").alias("unique_viewers")), batch_id)

    return _start(first, checkpoint, "append", each)


def viewer_log(path: str) -> BatchLog:
    return BatchLog(path, lambda rows: rows.groupBy("slug").agg(F.sum("unique_viewers").alias("unique_viewers")))


def read_unique_viewers(spark: SparkSession, path: str) -> DataFrame:
    return _folded(viewer_log(path), spark)


def stream_upload_limiter(
    uploads: DataFrame, salt: str, path: str, checkpoint: str, limits: Limits = LIMITS
) -> StreamingQuery:
    """Upload verdicts per batch, given each sender's last acceptance in earlier batches.

    A batch runs the batch job, so a sender with most of the uploads is spread over its days.  The state, one last
    acceptance a sender, is a folded log, so a batch reads a bounded number of files, and of these only senders that
    can still be blocked.
    """
    state = sender_log(path)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.agg(F.min("ts")).first()[0]
        if first is None:
            return
        # A repeated batch must not see what its first try wrote.
        known = state.read(spark, batch_id)
        if known is not None:
            known = known.filter(F.col("last_ts") >= first - limits.upload_gap_seconds)
        judged = intake.admit_uploads(batch, salt, limits, known)
        judged.write.mode("overwrite").parquet(f"{path}/verdicts/batch={batch_id}")
        done = spark.read.parquet(f"{path}/verdicts/batch={batch_id}").filter("code = 201")
        state.write(done.groupBy("ip_hash").agg(F.max("ts").alias("last_ts")), batch_id)

    return _start(uploads, checkpoint, "append", each)


def sender_log(path: str) -> BatchLog:
    return BatchLog(f"{path}/state", lambda rows: rows.groupBy("ip_hash").agg(F.max("last_ts").alias("last_ts")))


def read_upload_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/verdicts").drop("batch")


def stream_reports(
    raw: DataFrame, shares: DataFrame, existing: DataFrame, path: str, checkpoint: str
) -> StreamingQuery:
    """First valid report per (slug, reporter), as a log of the first of each batch.

    The log is folded to the earliest, so an earlier report arriving late still wins.  A batch is reduced to pairs before
    it meets the shares, so the reports of a share that many report spread over their reporters.
    """
    log = report_log(path)
    return _start(raw, checkpoint, "append", lambda batch, batch_id: log.write(first_reports(batch, shares, existing), batch_id))


def first_reports(raw: DataFrame, shares: DataFrame, existing: DataFrame) -> DataFrame:
    """``slug, reporter_ip_hash, first`` of the valid reports of ``raw`` on known shares that ``existing`` lacks."""
    pair = ["slug", "reporter_ip_hash"]
    reason = col.trimmed(F.col("reason"))
    pairs = (
        raw.filter((F.coalesce(reason, F.lit("")) != "") & (F.length("reason") <= LIMITS.reason_chars))
        .filter("email_is_text")
        .withColumn("first", F.struct("ts", F.col("request_id").alias("id"), reason.alias("reason"), F.col("email").alias("reporter_email")))
        .groupBy(*pair)
        .agg(F.min("first").alias("first"))
    )
    return pairs.join(existing.select(*pair), pair, "left_anti").join(shares.select("slug"), "slug", "left_semi")


def report_log(path: str) -> BatchLog:
    return BatchLog(path, lambda rows: rows.groupBy("slug", "reporter_ip_hash").agg(F.min("first").alias("first")))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return _folded(report_log(path), spark).select(
        "first.id",
        "slug",
        "first.reason",
        "reporter_ip_hash",
        F.col("first.ts").alias("reported_at"),
        F.lit("open").alias("status"),
        "first.reporter_email",
    )


def stream_stale_uploads(
    begins: DataFrame, ends: DataFrame, delay: str = "1 hour", age: int = LIMITS.pending_age_seconds
) -> DataFrame:
    """Uploads without an end within ``age`` seconds: ``(slug, created_at)``.

    ``begins`` holds ``slug, created_at`` and ``ends`` holds ``slug, ended_at``, in seconds.  A row comes
    out when both watermarks, ``delay`` behind the latest row, have passed its deadline, so rows may come that late,
    and an idle side needs clock rows, whose slug is empty.
    """
    b = begins.select(F.col("slug").alias("slug"), "created_at", F.timestamp_seconds("created_at").alias("b_at")).withWatermark("b_at", delay)
    e = ends.select(F.col("slug").alias("e_slug"), F.timestamp_seconds("ended_at").alias("e_at")).withWatermark("e_at", delay)
    in_time = (
        (F.col("slug") == F.col("e_slug"))
        & (F.col("e_at") >= F.col("b_at"))
        & (F.col("e_at") <= F.col("b_at") + F.expr(f"interval {age} seconds"))
    )
    # Naming the event time keeps this filter above the watermark, which must see the clock rows.
    no_clock = (F.col("slug") != "") | F.col("b_at").isNull()
    return (
        b.join(e, in_time, "left_outer")
        .filter(F.col("e_at").isNull() & no_clock)
        .select("slug", "created_at")
    )


def stream_write_limits(requests: DataFrame, delay: str, path: str, checkpoint: str, limits: Limits = LIMITS) -> StreamingQuery:
    """Requests per address and time window, logged whenever a count changes."""
    period = limits.rate_window_seconds
    counts = (
        requests.withColumn("at", F.timestamp_seconds("ts"))
        .withWatermark("at", delay)
        .groupBy("ip_hash", F.window("at", f"{period} seconds").alias("w"))
        .agg(F.count("*").alias("n"))
        .select("ip_hash", F.unix_seconds("w.start").alias("window_start"), "n")
    )
    return _start(counts, checkpoint, "update", window_log(path).write)


def window_log(path: str) -> BatchLog:
    """Counts only grow, so the largest logged one is the current one."""
    return BatchLog(path, lambda rows: rows.groupBy("ip_hash", "window_start").agg(F.max("n").alias("n")))


def read_write_limits(spark: SparkSession, path: str, limits: Limits = LIMITS) -> DataFrame:
    n = _folded(window_log(path), spark)
    return n.withColumn("over", F.col("n") > limits.write_per_ip)


def append_rows(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run an append-mode stream into parquet until the input at start is used up."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


