"""Tables between steps, in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one of our own, kept for the session, if the master is local, and an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are numbered in one task, about.
NUMBERED_ROWS = 1_000_000


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with ``name``, the place of each row from 1 in an order. Rows are cut to ranges, numbered there, and shifted by the rows of the ranges before, so no task sees them all. Rows that are equal in the order
    are numbered one after the other."""
    ranges = max(1, min(10_000, -(-df.count() // NUMBERED_ROWS)))
    rows = materialize(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_range", before.alias("_before"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_inside", inside).join(F.broadcast(shifts), "_range").select(*df.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(name))
