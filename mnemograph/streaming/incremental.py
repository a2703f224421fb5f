"""Incremental views of a growing log on Structured Streaming.

Sinks write one folder per micro-batch and overwrite it on a retry, so a batch
replayed after a failure leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.operators import log_ops, retrieval
from mnemograph.sources import schema


def log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A canonical Parquet log as a stream; what arrived since the last run is one batch."""
    ddl = ", ".join(f"`{n}` {k}" for n, k in schema.COLUMNS.items())
    reader = spark.readStream.schema(ddl)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None],
        mode: str = "append") -> None:
    """Process everything that has arrived, then stop."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(each).start())
    query.awaitTermination()


def batch_sink(out: str) -> Callable[[DataFrame, int], None]:
    def each(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return each


def index_postings(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Inverted-index rows of new events only; one batch never rewrites another."""
    def each(df: DataFrame, batch: int) -> None:
        docs = df.withColumn("text", log_ops.search_body())
        retrieval.postings(docs, "seq", F.col("text")).write.mode("overwrite").parquet(
            f"{out}/batch={batch}")
    run(stream, checkpoint, each)


def track_loops(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Loop status by id. A close settles its loop however late it comes.

    The state is one row of counts per loop id; without a lateness limit none
    may expire. Each batch emits the ids it touched.
    """
    counts = (
        stream.filter(F.col("type").isin("open_loop", "loop_closed") & F.col("id").isNotNull())
        .groupBy("id").agg(F.count_if(F.col("type") == "open_loop").alias("opens"),
                           F.count_if(F.col("type") == "loop_closed").alias("closes"),
                           F.max(F.when(F.col("type") == "open_loop", F.col("seq")))
                           .alias("last_open")))
    run(counts, checkpoint, batch_sink(out), "update")


def track_threads(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Members and last activity per thread; dormancy is judged when read."""
    rolled = (
        stream.select("ts", F.explode(F.array_distinct("thread_ids")).alias("thread_id"))
        .groupBy("thread_id").agg(F.count(F.lit(1)).alias("n_events"),
                                  F.max("ts").alias("last_ts")))
    run(rolled, checkpoint, batch_sink(out), "update")


def newest(spark: SparkSession, out: str, key: str, batches: list[int] | None = None) -> DataFrame:
    """The latest emitted row of every key, in all batches or in some."""
    rows = spark.read.parquet(out) if batches is None else spark.read.option("basePath", out).parquet(
        *[f"{out}/batch={b}" for b in batches])
    fields = [c for c in rows.columns if c not in (key, "batch")]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*fields), "batch").alias("r"))
            .select(key, *[F.col(f"r.{f}") for f in fields]))
