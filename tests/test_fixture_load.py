"""The derived tables load their jobs evenly: no task gets a whole table or slice."""

from helpers import rows
from pyspark.sql import functions as F

from leafmeter import queries
from leafmeter.functions import columns as C
from leafmeter.sources.fixtures import Fixtures

FOLDER = "/root/testdata/sf0.001"


def test_no_task_gets_most_of_the_uploads(spark):
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        uploads = Fixtures(spark, FOLDER).uploads
        tasks = [n for _, n in rows(uploads.groupBy(F.spark_partition_id()).count())]
        assert sum(tasks) == 1000 and max(tasks) < 500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _seen(spark, tmp_path, run):
    """Numbers and files of each batch that a stream gets."""
    seen = []

    def each(batch, number):
        got = batch.select("id", F.input_file_name()).collect()
        seen.append((sorted(r[0] for r in got), len({r[1] for r in got})))

    def start(df):
        return df.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()

    f = Fixtures(spark, FOLDER)
    run(f, spark.range(0, 1000, 1, 6).withColumn("at", 100 + F.col("id")), start)
    return seen


def test_slices_by_time_are_one_batch_of_many_files(spark, tmp_path):
    seen = _seen(spark, tmp_path, lambda f, df, start: queries._in_order(f, start, (df, "at"), batches=2))
    assert [ids for ids, _ in seen] == [list(range(500)), list(range(500, 1000))]
    assert min(n for _, n in seen) >= 3


def test_batches_are_dealt_without_a_shuffle(spark, tmp_path):
    seen = _seen(spark, tmp_path, lambda f, df, start: queries._in_batches(f, df, start))
    assert len(seen) == 3 and sorted(i for ids, _ in seen for i in ids) == list(range(1000))
    assert all(len(ids) > 200 and n == 6 for ids, n in seen)


def test_agents_and_referrers_are_judged_before_the_events_meet_them(spark):
    f = Fixtures(spark, FOLDER)
    v = f._derive_views()
    # Above the joins no row is searched for patterns.
    above = v._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "RLIKE" not in above and "Contains" not in above and "bot" not in above.replace("is_bot", "")
    again = v.select("id", C.is_bot(F.col("ua")).cast("bigint").alias("is_bot"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, v.select("id", "is_bot").collect()))
