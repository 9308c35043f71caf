"""Running totals over groups of any size.

A window partitioned by a key puts the whole key into one task.  Here rows are range-partitioned on
(key, order) instead, so a key holding a third of the table spreads over a third of the tasks; each
range adds the total of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from leafmeter.session import settled


def running_total(
    df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, str], maxima: dict[str, str] | None = None
) -> DataFrame:
    """Add inclusive totals per ``keys`` up to each row, in ``order``.

    ``totals`` maps a column to sum to the name of its total, ``maxima`` one to the name of its largest value so far
    (NULL while there is none).  ``keys`` must be non-NULL and (keys, order) unique, or the totals of equal
    rows are arbitrary.
    """
    maxima = maxima or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range bounds come from sampling, so the cut must be computed exactly once.
    cut = settled(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn(
            "_cut", F.spark_partition_id()
        )
    )
    earlier = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    within = (
        Window.partitionBy(*keys, "_cut")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = (
        cut.groupBy(*keys, "_cut")
        .agg(
            *[F.sum(value).alias(f"_sum_{value}") for value in totals],
            *[F.max(value).alias(f"_max_{value}") for value in maxima],
        )
        .select(
            *keys,
            "_cut",
            *[
                F.coalesce(F.sum(f"_sum_{value}").over(earlier), F.lit(0)).alias(f"_before_{value}")
                for value in totals
            ],
            *[F.max(f"_max_{value}").over(earlier).alias(f"_most_{value}") for value in maxima],
        )
    )
    rows = cut.join(offsets, [*keys, "_cut"])
    sums = {
        out: (F.sum(value).over(within) + F.col(f"_before_{value}")).cast("bigint")
        for value, out in totals.items()
    }
    # greatest() skips NULL.
    tops = {out: F.greatest(F.max(value).over(within), F.col(f"_most_{value}")) for value, out in maxima.items()}
    helpers = [f"_before_{value}" for value in totals] + [f"_most_{value}" for value in maxima]
    return rows.withColumns({**sums, **tops}).drop("_cut", *helpers)
