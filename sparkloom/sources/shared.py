"""Written tables that cut lineage, in a folder every machine reaches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where that is unset, one process
    on one machine (tests) gets a temporary folder; on a cluster it is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        place = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written and read again: what follows starts from files
    and survives the loss of any executor."""
    place = new_place(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def tasks_for(spark: SparkSession, rows: int, rows_a_task: int) -> int:
    """Parts that keep a task's share at ``rows_a_task``; one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_a_task))


def dealt(df: DataFrame, rows_a_task: int, *keys: Column | str) -> DataFrame:
    """Rows dealt out by keys so that a task's share does not grow with the table,
    whatever the splits of its files or the number of shuffle partitions.  Counts
    the rows, so ``df`` should be a table or cheap."""
    return df.repartition(tasks_for(df.sparkSession, df.count(), rows_a_task), *keys)
