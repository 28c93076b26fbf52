"""Session construction and lineage cutting."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tracewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. On a cluster leave `master` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=base | conf).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    `spark.checkpoint.dir` of the session is used where it is set. Only where it
    is unset and the master is local is a temporary folder made (tests): on a
    cluster a machine-local folder would be lost with its machine, so there an
    unset folder is an error.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    known = context.getCheckpointDir()
    if known:
        return known
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tracewell-")
    context.setCheckpointDir(made)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    shared = checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def written(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back; with `by`, in a folder for each of its values.

    A columnar form of `cut` for tables that are read several times: later reads
    prune columns and skip row groups. The folder belongs to the application.
    """
    spark = df.sparkSession
    where = os.path.join(own_folder(spark), uuid.uuid4().hex)
    df.write.partitionBy(*by or []).parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def kept(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of an application start from, written by the first of them.

    It is told by its name and the directory it comes from; a write that did not
    end leaves no `_SUCCESS` and is done again.
    """
    where = os.path.join(own_folder(spark), f"{name}-{hashlib.sha256(source.encode()).hexdigest()[:16]}")
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(where, "_SUCCESS"))
    df = make()
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        df.write.mode("overwrite").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def own_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one."""
    return os.path.join(checkpoint_dir(spark), "tracewell-" + spark.sparkContext.applicationId)


def drop_written(spark: SparkSession) -> None:
    """Deletes what `written` made, once no DataFrame that reads it is used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
