"""Chunk-at-a-time ingest as Structured Streaming: a file is processed once, failures are kept apart and tried again.

The steps that run on a stream are stateless, so a stream gives the rows that the batch gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def run_available(spark: SparkSession, source: str, schema: str, step: Step, target: str, checkpoint: str, files_per_batch: int = 64) -> dict:
    """Apply the step to the Parquet files not yet seen and append the result; returns batches and rows of this run."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    q = step(src).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    done = [p for p in q.recentProgress if p["numInputRows"]]
    return {"batches": len(done), "rows": sum(p["numInputRows"] for p in done)}


def run_isolated(spark: SparkSession, source: str, schema: str, step: Step, target: str, failures: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """As run_available, but a batch whose step fails is written to the failure table (batch, path, error) and passed over.

    A batch overwrites its own part batch=<id> of the target, so one that is run again leaves no row twice.
    """

    def each(df: DataFrame, batch: int) -> None:
        # what the batch reads is kept as its source's paths, that a failure can name them
        try:
            step(df.drop("_path")).write.mode("overwrite").parquet(f"{target}/batch={batch}")
        except Exception as e:
            paths = df.select("_path").distinct()
            paths.select(F.lit(batch).cast("long").alias("batch"), F.col("_path").alias("path"), F.lit(f"{type(e).__name__}: {str(e)[:500]}").alias("error")).write.mode("overwrite").parquet(f"{failures}/part={batch}")

    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).select("*", F.col("_metadata.file_path").alias("_path"))
    src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def retry_failed(spark: SparkSession, schema: str, step: Step, target: str, failures: str) -> int:
    """Run the step once more over the files of the failure table; what succeeds leaves it. Returns the files that still fail."""
    from noteloom.sources.readers import hadoop_path, listed

    left = 0
    for part in listed(spark, failures):
        if "part=" not in part:
            continue
        paths = [r[0] for r in spark.read.parquet(part).select("path").distinct().collect()]
        try:
            step(spark.read.schema(schema).parquet(*paths)).write.mode("overwrite").parquet(f"{target}/batch={part.rsplit('=', 1)[1]}")
        except Exception:
            left += len(paths)
            continue
        p, fs = hadoop_path(spark, part)
        fs.delete(p, True)
    return left


def unprocessed(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Batch form of resuming: the rows whose keys the output does not hold yet."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")
