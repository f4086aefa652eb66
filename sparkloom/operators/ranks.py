"""Ranks of all rows without ordering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from sparkloom.operators.storage import cut


def with_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with each row's place from 0 in the order of the columns, which must tell rows apart.

    Rows are range-partitioned and written, so that a row's partition stays the same; one count per partition goes to the driver.
    """
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged, _ = cut(df.repartitionByRange(partitions, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    before, starts = 0, []
    for r in ranged.groupBy("__part").count().orderBy("__part").collect():
        starts.append((r["__part"], before))
        before += r["count"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __before long"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__own", own).join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")
