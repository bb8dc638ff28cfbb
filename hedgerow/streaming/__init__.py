"""Policies on Structured Streaming: scanning is stateless, so the batch plan runs on each micro-batch."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.policy import Policy


def guard_stream(stream: DataFrame, policy: Policy, text_col: str = "text", redact: bool = False) -> DataFrame:
    """The stream with findings, blocked and, asked for, redacted_text."""
    return policy.apply(stream, text_col, redact)


def guard_files(spark: SparkSession, path: str, schema: str, policy: Policy, out: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """Scan the Parquet files of a folder that are there, and stop: exactly once, by the checkpoint."""
    stream = spark.readStream.schema(schema).parquet(path)
    judged = guard_stream(stream, policy, text_col, True)
    return judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def block_rate(judged: DataFrame, time_col: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Texts and blocked texts per window of event time; late rows count until the watermark passes."""
    w = judged.withWatermark(time_col, delay) if judged.isStreaming else judged
    return w.groupBy(F.window(time_col, width).alias("w")).agg(F.count("*").alias("texts"), F.count_if("blocked").alias("blocked")).select(F.col("w.start").alias("start"), "texts", "blocked")


def shared_dir(spark) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="hedgerow-")
    return base.rstrip("/")
