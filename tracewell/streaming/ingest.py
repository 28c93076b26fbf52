"""The event log as a stream: validation, exactly-once append, running activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell import schemas

#: What does not count when two deliveries of an event are compared.
VOLATILE = {"content_digest"}


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def envelope_error(schema_name: str | None = None) -> Column:
    """Why an envelope is refused, null for a good one. The first reason counts."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    time = F.coalesce(F.col("event_time"), F.lit(""))
    out = F.when(F.lit(schema_name is not None) & ~F.col("schema_name").eqNullSafe(F.lit(schema_name)), "schema")
    return (
        out.when(empty("event_id"), "event_id empty")
        .when(empty("session_id"), "session_id empty")
        .when(~F.col("event_id").eqNullSafe(F.concat_ws(":", "session_id", F.col("sequence").cast("string"))), "event_id does not match")
        .when(empty("event_type"), "type empty")
        .when(~(time.contains("T") & (time.endswith("Z") | time.contains("+"))), "timestamp")
        .when(F.col("sequence").isNull() | (F.col("sequence") < 0), "sequence")
    )


def semantic_digest(columns: list[str]) -> Column:
    """A digest of an event without its volatile fields."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns) if c not in VOLATILE])), 256)


def classify(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """`batch` with digest and state: new, duplicate (same digest), conflict (other digest) or invalid.

    Within the batch the least digest of an event id is the one that may be new.
    """
    checked = batch.withColumn("error", envelope_error()).withColumn("digest", semantic_digest(batch.columns))
    known = stored.select("event_id", F.col("digest").alias("_old"))
    first = checked.where("error is null").groupBy("event_id").agg(F.min("digest").alias("_first"))
    both = checked.join(first, "event_id", "left").join(known, "event_id", "left")
    base = F.coalesce("_old", "_first")
    state = F.when(F.col("error").isNotNull(), "invalid").when(F.col("digest") != base, "conflict").when(F.col("_old").isNotNull(), "duplicate").otherwise("new")
    return both.withColumn("state", state).drop("_old", "_first")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def ingest(source: DataFrame, log: str, checkpoint: str, refused: str | None = None, **trigger) -> StreamingQuery:
    """Appends the new events of a stream to the Parquet log, each event id once.

    A part of the log belongs to a query and a batch of it. A batch that is run
    again after a failure finds its events in the log by both and replaces just
    that part, so nothing is doubled; a query that begins anew, its checkpoint
    lost, has another id and replaces nothing. The log is empty only where its
    folder does not exist: any fault of reading it ends the batch.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch = batch.persist()
        if _exists(spark, log):
            # Two columns, of the ids of this batch only.
            own = (F.col("query_id") == query) & (F.col("batch_no") == number)
            stored = spark.read.parquet(log).where(~own).select("event_id", "digest").join(batch.select("event_id").distinct(), "event_id", "left_semi")
        else:
            stored = spark.createDataFrame([], "event_id string, digest string")
        sorted_ = classify(batch, stored)
        new = sorted_.where("state = 'new'").dropDuplicates(["event_id"]).drop("state", "error")
        new.write.mode("overwrite").parquet(f"{log}/query_id={query}/batch_no={number}")
        if refused:
            sorted_.where("state in ('conflict', 'invalid')").write.mode("overwrite").parquet(f"{refused}/query_id={query}/batch_no={number}")
        batch.unpersist()

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def once_within(events: DataFrame, at: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Each event of a stream once; its key is forgotten when copies can be `late` no more, so state does not grow without end."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def replay(spark: SparkSession, log: str) -> DataFrame:
    """All committed events."""
    return spark.read.parquet(log)


def windowed_activity(events: DataFrame, every: str = "1 day", watermark: str | None = "7 days") -> DataFrame:
    """Events per window and type, with a watermark for what comes late (None: the stream has one). `events` has `at` (timestamp)."""
    marked = events if watermark is None else events.withWatermark("at", watermark)
    return marked.groupBy(F.window("at", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def running_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key, kept in the state store and updated by each batch."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, checkpoint: str, mode: str, into: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream of counts over what is there and returns its last result, written to `into`.

    Mode `update` writes only what a batch changed: of each key the greatest `n` is the last.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(into if mode == "complete" else f"{into}/batch_no={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema).parquet(into)
    return out if keys is None else out.groupBy(*keys).agg(F.max("n").alias("n")).select(*stream.columns)
