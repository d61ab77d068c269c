"""Operators on streams of files: those that need no state run on a streaming DataFrame as they are."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names. Where none is named, one on this machine is used if all of Spark runs here."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), "rastrum-stream")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files under path, with the schema that they have now."""
    schema = spark.read.parquet(path).schema
    # a pattern, since a stream takes a plain path for a folder, and a table may be a single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def run_stream(spark: SparkSession, source: DataFrame, op: Callable[[DataFrame], DataFrame], out: str | None = None) -> DataFrame:
    """Sends all that the stream has now through ``op`` into Parquet files, exactly once, and returns them. ``out`` keeps the stream's
    progress beside it, so a later call with the same path goes on with new files only."""
    out = out or shared_path(spark, "stream")
    result = op(source)
    query = result.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/rows")
