"""Queries and their SQL where values are tied."""

import duckdb
import pytest
from pyspark.sql import functions as F

from egresslake.plans import document_queries, fit_queries


def test_exact_wilcoxon_sql_with_ties(spark, tmp_path):
    k = F.col("id")
    price = 150_000 + F.when(k % 3 == 0, -1).otherwise(1) * (1 + k % (2 + k % 7)) * 10.5
    path = f"{tmp_path}/orders.parquet"
    spark.range(400).select((k % 37).alias("o_custkey"), price.alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(path)
    rows = fit_queries.q_exact_wilcoxon(spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    want = {r[0]: r[1:] for r in c.execute(fit_queries.SQL["q_exact_wilcoxon"]).fetchall()}
    assert len(rows) == len(want) == 37
    for r in rows:
        assert (r.n, r.w, r.p) == pytest.approx(want[r.o_custkey], abs=2e-8)


def test_raster_means_do_not_depend_on_order(spark, tmp_path):
    """Means that lie half way between two roundings: exact, half up, in the query and in its SQL."""
    k = F.col("id")
    hundredths = F.when(k % 20_000 == 0, k / 20_000 % 2 + 1).otherwise(k % 11 - F.when(k % 11 > 5, 0).otherwise(-1)) / 100
    li = spark.range(9 * 20_000).select((k / 20_000).cast("long").alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"), F.round(hundredths, 2).alias("l_discount"), F.round(hundredths, 2).alias("l_tax"))
    events = spark.range(2000).select("id", F.lit(1.0).alias("value"), F.to_json(F.struct((k % 11).alias("k"))).alias("props"))
    li.repartition(7).write.parquet(f"{tmp_path}/lineitem.parquet")
    events.select(k.alias("event_id"), k.alias("user_id"), F.lit("a").alias("event_type"), "value", F.timestamp_seconds(k + 1_704_067_200).alias("ts").cast("timestamp_ntz"), "props").write.parquet(f"{tmp_path}/events.parquet")
    cents = li.groupBy("l_partkey").agg(F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("s")).collect()
    want = {r.l_partkey: (r.s + 1) // 2 / 1_000_000 if r.s % 2 else r.s // 2 / 1_000_000 for r in cents}
    assert any(r.s % 2 for r in cents)
    got = {r.ix: r.gas_concentration for r in document_queries.raster(spark, str(tmp_path)).collect()}
    assert got == want
    c = duckdb.connect()
    for t in ("lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for q in ("q_route_penalty", "q_field_samples"):
        rows = {tuple(r) for r in document_queries.QUERIES[q](spark, str(tmp_path)).collect()}
        assert rows == set(c.execute(document_queries.SQL[q]).fetchall()) and len(rows) == 2000
