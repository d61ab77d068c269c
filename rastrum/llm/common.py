"""Helpers shared by the corpus operators: bounded batches, results in the shared folder, joins on very frequent keys."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that a Python worker takes up together.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """For the registered queries and stages, not for operators: gives the session a bound on the bytes of Arrow batches if it has none
    of its own. Operators bound what a worker takes up themselves."""
    if spark.conf.get(_ARROW_BYTES, None) is None:
        spark.conf.set(_ARROW_BYTES, str(BATCH_BYTES))
    return spark


def sliced(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, or bytes of strings and binaries, at most; one row at least."""
    for batch in batches:
        if batch.num_rows <= rows and batch.nbytes <= size:
            yield batch
            continue
        lengths = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        ends = np.cumsum(sum(lengths, np.zeros(batch.num_rows, np.int64)))
        s, before = 0, 0
        while s < batch.num_rows:
            e = max(s + 1, min(s + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(s, e - s)
            s, before = e, int(ends[e - 1])


def release_memory() -> None:
    """Gives freed memory of a Python worker back to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], rows: int = BATCH_ROWS) -> Callable[[Iterator], Iterator]:
    """A function of bounded batches that gives memory back when its task ends, since the worker waits for others with what it holds."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(sliced(batches, rows))
        finally:
            release_memory()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named, one on this machine is used if all of Spark runs here."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), "rastrum-checkpoint")
    return at.rstrip("/")


#: With it Spark deletes an execution's shuffle files when the execution ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def gathered(df: DataFrame, files: int | None = None) -> DataFrame:
    """df in so many partitions at most, twice as many as there are cores unless given, for light results behind a shuffle: each file that
    a task writes costs several system calls and, on local disks, processes."""
    return df.coalesce(files or max(16, 2 * df.sparkSession.sparkContext.defaultParallelism))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends there and survives lost executors. The written rows
    stand for the shuffles before them, whose files are deleted. What nothing reads any more, ``drop`` deletes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes the folders of frames that ``cut`` returned and that nothing reads any more."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """df itself if its rows come straight from files, else written and read again: then a task that is run anew sees the same rows in
    the same order."""
    return cut(df, "settled") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


#: Rows of a key that may count as very many, and parts that they are dealt to.
HOT_ROWS, PARTS = 200, 64


def hot_keys(counts: DataFrame, key: str, n: str) -> list:
    """Keys with over a thousandth of all rows, so less than a thousand; counts has a row a key, with its number of rows in ``n``."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > max(HOT_ROWS, total // 1000)).select(key).collect()]


def dealt(df: DataFrame, key: str, hot: list, by: str) -> DataFrame:
    """df with the number of a part: rows of hot keys are dealt to PARTS parts by a hash of the column ``by``."""
    part = F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")
    return df.withColumn("part", F.when(F.col(key).isin(hot), part).otherwise(F.lit(0)) if hot else F.lit(0))


def spread(df: DataFrame, key: str, hot: list) -> DataFrame:
    """df, the side of a join with a row a key, with rows of hot keys once for each part."""
    all_ = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    return df.withColumn("part", F.explode(all_))


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(tidy(run), schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts; null is empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
