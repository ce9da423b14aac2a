"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings while a table is written: shuffle files go with the write.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and all of Spark is on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = tempfile.mkdtemp(prefix="cellsail-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Long texts go to Python in batches of 1000 rows, unless the session has a number of its own."""
    if spark.conf.get(ARROW_ROWS, None) in (None, "10000"):
        spark.conf.set(ARROW_ROWS, "1000")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs nothing that was written. The
    tables stay, as checkpoints do, until the folder is cleaned. Shuffle files of
    the write go when it ends, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)
