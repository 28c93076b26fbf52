"""JSON-lines tables with fixed schemas, and staged publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schemas

TABLES = {"links": schemas.LINKS, "entities": schemas.ENTITIES, "call_candidates": schemas.CANDIDATES, "nodes": schemas.NODES, "edges": schemas.EDGES, "events": schemas.EVENTS}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A JSON-lines table by its schema; a damaged line is an error."""
    return spark.read.schema(TABLES[name]).option("mode", "FAILFAST").json(path)


def publish(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Writes beside `path`, then renames: readers see the old table or the whole new one."""
    spark = df.sparkSession
    staging, old = f"{path}.staging-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    writer = df.write.format(form)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(staging)
    jvm = spark._jvm.org.apache.hadoop.fs
    here, new, backup = jvm.Path(path), jvm.Path(staging), jvm.Path(old)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(here)
    if had and not fs.rename(here, backup):
        raise OSError(f"cannot set {path} aside")
    if not fs.rename(new, here):
        if had:
            fs.rename(backup, here)
        raise OSError(f"cannot publish {path}")
    if had:
        fs.delete(backup, True)


def manifest(tables: dict[str, DataFrame], version: int = schemas.FACT_VERSION) -> DataFrame:
    """One row per table: version, rows and an order-free digest of its content."""
    out = None
    for name, df in tables.items():
        row = F.xxhash64(*[F.col(c) for c in df.columns])
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))
        one = one.select(F.lit(name).alias("table_name"), F.lit(version).alias("version"), "n_rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def verify(tables: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """The first thing that is wrong with each table: missing, version, rows or digest; none for sound tables."""
    now = manifest(tables)
    k = known.select("table_name", *[F.col(c).alias(f"k_{c}") for c in ("version", "n_rows", "digest")])
    wrong = (
        F.when(F.col("version").isNull() | F.col("k_version").isNull(), "missing")
        .when(F.col("version") != F.col("k_version"), "version")
        .when(F.col("n_rows") != F.col("k_n_rows"), "rows")
        .when(F.col("digest") != F.col("k_digest"), "digest")
    )
    return now.join(k, "table_name", "full_outer").select("table_name", wrong.alias("reason")).where("reason is not null")
