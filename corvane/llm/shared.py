"""The folder that all executors share, and small helpers for tables kept in it.

Lineage is cut by writing a table there: a lost executor then costs a re-read,
never a re-computation of the whole job. The folder is the one the cluster names
in ``spark.checkpoint.dir``. Where that is unset a temporary one is made, but only for a
master on this machine, as in tests: on a cluster it would be another folder on every machine.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # by application: the session's settings stay as they are


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
        base = _own[app]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written_to(df: DataFrame, name: str) -> str:
    """The path of ``df`` as a new Parquet table in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage ends there."""
    return df.sparkSession.read.schema(df.schema).parquet(written_to(df, name))


def read_shared(uri: str, columns: list[str] | None = None) -> pa.Table:
    """A table of the shared folder, read by a worker for itself: nothing passes the driver."""
    from pyarrow import fs, parquet

    where, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return parquet.read_table(path, columns=columns, filesystem=where)


def local_path(uri: str) -> str:
    """The POSIX path of a ``file:`` URI; memory-mapped files need a folder mounted on every machine."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: memory-mapped models need spark.checkpoint.dir to be a file: URI of a folder mounted on every machine")
    return uri


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches of whole texts small: a batch of 256 documents of 100 kB is 25 MB. Read when a plan runs, so it stays set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns of these names, whatever their case: an output column replaces an input column of its name."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])
