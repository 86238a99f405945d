"""Structured Streaming forms of the append operators, run to the end of what has landed."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}_{uuid.uuid4().hex}")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a parquet file or folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path + "*")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that has landed and gives what it wrote; checkpoint and output lie in the shared folder."""
    spark = stream.sparkSession
    out = _folder(spark, name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, name + "_at")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def deduped(stream: DataFrame, key: list[str], at: str | None = None, late: str | None = None) -> DataFrame:
    """The first row of each key. With a time column and a delay the state is dropped once the watermark has passed a key's row by that
    delay, within which repeats are recognised; without, every key is kept for the life of the stream."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key) if at else stream.dropDuplicates(key)


def tumbling(stream: DataFrame, at: str, late: str, width: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums per window; a window is given once the watermark has passed its end."""
    g = stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), *by, "n", "total")


def still_open(batch: DataFrame, closed: DataFrame, at: str, width: str, by: list[str], value: str) -> DataFrame:
    """The windows of tumbling() over the landed rows that the stream has not given, because its watermark never passed their end."""
    g = batch.where(F.col(at).isNotNull()).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    g = g.select(F.col("window.start").alias("start"), *by, "n", "total")
    return g.join(closed.select("start").distinct(), "start", "left_anti")


def append_once(stream: DataFrame, key: list[str], path: str) -> None:
    """foreachBatch sink that adds rows whose key the table at path lacks: a replayed batch adds nothing."""
    from tidemark.sources import feeds

    def batch(df: DataFrame, _: int) -> None:
        feeds.append_months(df.sparkSession, df, path, key, F.lit("all"))

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", _folder(stream.sparkSession, "append_at")).trigger(availableNow=True).start()
    q.awaitTermination()
