"""Queries and their SQL on rows that the given tables do not have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from egresslake.plans import document_queries


@pytest.mark.parametrize("name", ["q_route_penalty", "q_field_samples"])
def test_unknown_heights_and_finer_discounts(spark, tmp_path, name):
    """Events without k or without props; discounts and taxes of more than two digits."""
    k = F.col("id")
    li = spark.range(900).select(k.alias("l_partkey"), F.floor(k / 9).alias("l_suppkey"), ((k % 41 * 10 + 5) / 1000).alias("l_discount"), ((k % 23 * 10 + 5) / 1000).alias("l_tax"))
    props = F.when(k % 3 == 0, F.to_json(F.struct((k % 100).alias("k")))).when(k % 3 == 1, F.lit("{}"))
    events = spark.range(3000).select(k.alias("event_id"), k.alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"), F.timestamp_seconds(k + 1_704_067_200).cast("timestamp_ntz").alias("ts"), props.alias("props"))
    c = duckdb.connect()
    for t, df in (("lineitem", li), ("events", events)):
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rows = sorted((tuple(r) for r in document_queries.QUERIES[name](spark, str(tmp_path)).collect()), key=lambda r: r[0])
    assert rows == sorted(c.execute(document_queries.SQL[name]).fetchall(), key=lambda r: r[0]) and len(rows) == 3000
