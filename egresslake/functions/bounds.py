"""Broadcasts of tables whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a scenario's own tables (exits, hazards, shapes, messages, steps) that may go to every task.
SMALL_ROWS = 20_000


def bounded(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, to be broadcast; an error where it has more rows than that. Counting stops at the bound."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a table that is compared with every row may have at most {most} rows")
    return F.broadcast(df)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to several tasks per core: a small file is one task, however much work its rows are."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
