"""Tables between steps, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_on_this_machine: dict[str, str] = {}


def _temporary(application: str) -> str:
    """One folder for an application, which goes with this process."""
    if application not in _on_this_machine:
        _on_this_machine[application] = tempfile.mkdtemp(prefix="cellsail-")
        atexit.register(shutil.rmtree, _on_this_machine[application], ignore_errors=True)
    return _on_this_machine[application]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path there; where the setting is unset and all of Spark is on this machine, as in tests, in a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = _temporary(spark.sparkContext.applicationId)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as Parquet, read back: its lineage ends here, so that a lost executor costs nothing that was written. by: one folder for each value of a column, read alone where that is asked for."""
    path = shared_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
