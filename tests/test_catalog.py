"""Parquet layout of the learning schema: write, read back, same rows."""

import uuid

from pyspark.sql import functions as F

from kelasflow.schema import SCHEMAS
from kelasflow.sources.catalog import read_tables, write_tables
from kelasflow.plans.tables import tables_for
from kelasflow.session import checkpoint_root
from tests.conftest import SF001, rows


def test_write_read_round_trip(spark):
    t = tables_for(spark, SF001)
    root = f"{checkpoint_root(spark)}/catalog-{uuid.uuid4().hex}"
    write_tables(t, root)
    back = read_tables(spark, root)
    for name, schema in SCHEMAS.items():
        assert back[name].schema == schema, name
        if name in ("kelas", "guru_details", "tugas_kelas", "diskusi"):
            assert rows(back[name]) == rows(t[name]), name
        else:
            assert back[name].count() == t[name].count(), name


def test_cache_follows_session(spark):
    a = tables_for(spark, SF001)
    assert tables_for(spark, SF001) is a


def test_filters_and_pruning_reach_the_parquet_scan(spark):
    import contextlib
    import datetime as dt
    import io

    from kelasflow.operators import activity, progress
    t = tables_for(spark, SF001)
    root = f"{checkpoint_root(spark)}/catalog-{uuid.uuid4().hex}"
    write_tables(t, root)
    back = read_tables(spark, root)

    def plan(df):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        return buf.getvalue()

    p = plan(progress.assignment_progress(back, "deadline", dt.date(1998, 6, 15), 3))
    assert "GreaterThanOrEqual(deadline,1998-06-15)" in p and "LessThanOrEqual(deadline,1998-06-18)" in p
    p = plan(activity.admin_counts(back, dt.date(2024, 1, 30)))
    assert "GreaterThanOrEqual(created_at,2024-01-30T00:00)" in p
    assert "ReadSchema: struct<role:string>" in p              # only the column the count needs
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_the_join_of_items_and_orders_has_tasks_of_bounded_size(spark, monkeypatch):
    """More partitions for more rows, not those that the session asks for."""
    from kelasflow.sources import fixtures
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 100)
    orders = spark.range(1500).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"))
    items = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("l_linenumber"))
    a, b = fixtures._dealt_by_order(items, orders)
    joined = a.join(b, a.l_orderkey == b.o_orderkey)
    assert joined.count() == 6000
    most = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 3 * 100
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 10_000)
    assert fixtures._dealt_by_order(items, orders) == (items, orders)
