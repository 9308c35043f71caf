"""Small tables for the tests."""

from pyspark.sql import functions as F

from leafmeter.sources import tables

NOW = 1_800_000_000
DAY = 86_400


def _table(spark, schema, rows, defaults):
    full = [{**defaults, **row} for row in rows]
    loose = [f.name + " " + f.dataType.simpleString() for f in schema.fields]
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in full], ", ".join(loose))


def shares(spark, *rows):
    defaults = {f.name: None for f in tables.SHARES.fields}
    defaults.update(
        status="committed", edit_token_hash="t", created_at=NOW - 1000, sender_ip_hash="s", content_size=1,
        client="web", latest_version=1, versions_pruned_below=1,
    )
    return _table(spark, tables.SHARES, rows, defaults)


def views(spark, *rows):
    defaults = {f.name: None for f in tables.VIEWS.fields}
    defaults.update(slug="a", viewed_at=NOW, ip_hash="v", is_bot=0)
    numbered = [{"id": i, **row} for i, row in enumerate(rows)]
    return _table(spark, tables.VIEWS, numbered, defaults)


def objects(spark, keys, uploaded=NOW - 10_000, size=10):
    rows = [k if isinstance(k, tuple) else (k, size, uploaded) for k in keys]
    return spark.createDataFrame(rows, "key string, size bigint, uploaded bigint")


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return [tuple(r) for r in picked.collect()]


def column(spark, values, fn, kind="string"):
    """Values of ``fn`` over one column of inputs, in input order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    out = df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in out]
