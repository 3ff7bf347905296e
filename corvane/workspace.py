"""Where tables that outlive a plan are kept: the folder that all machines share, named by ``spark.checkpoint.dir``.

Where that is unset a temporary folder is made, but only for a master on this machine: on a cluster it
would be another folder on every machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # by application


def workspace(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
        base = _own[app]
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written there and read again: its lineage ends, and nothing is worked out twice."""
    path = f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
