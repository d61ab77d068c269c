"""Bytes and bits as columns: both bit orders, with explicit positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def power2(k: Column) -> Column:
    """2 ** k as a long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def byte_array(x: Column) -> Column:
    """A binary column as an array of ints 0 to 255, in time linear in its length."""
    return F.transform(F.regexp_extract_all(F.hex(x), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))


def bits_msb(x: Column, terminate: bool = True) -> Column:
    """Bits of a binary column, most significant first, with a NUL byte's bits after it if ``terminate``."""
    got = byte_array(x)
    if terminate:
        got = F.concat(got, F.array(F.lit(0)))
    return F.flatten(F.transform(got, lambda b: F.transform(F.array(*map(F.lit, range(7, -1, -1))), lambda k: F.getbit(b, k).cast("int"))))


def bits_lsb(x: Column) -> Column:
    """Bits of a binary column, least significant first."""
    return F.flatten(F.transform(byte_array(x), lambda b: F.transform(F.array(*map(F.lit, range(8))), lambda k: F.getbit(b, k).cast("int"))))


def int_bits_lsb(x: Column) -> Column:
    """The 32 bits of a number, least significant first."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.getbit(x.cast("long"), k).cast("int"))


def message_bits(spark: SparkSession, message: str | bytes, order: str = "msb") -> DataFrame:
    """(pos, bit) of a message: most significant first with a NUL after it, or least significant first. A NUL inside would end the
    message on extraction, so it is refused in the first form."""
    raw = message.encode() if isinstance(message, str) else message
    if order == "msb":
        if 0 in raw:
            raise ValueError("a NUL byte would end the message")
        bits = [b >> k & 1 for b in raw + b"\0" for k in range(7, -1, -1)]
    else:
        bits = [b >> k & 1 for b in raw for k in range(8)]
    return bit_table(spark, bits)


def bit_table(spark: SparkSession, bits: list[int] | str) -> DataFrame:
    text = "".join(str(int(b)) for b in bits)
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), "")).alias("pos", "b")).where("b <> ''").select("pos", F.col("b").cast("int").alias("bit"))


def bytes_from_bits(bits: DataFrame, keys: list[str], order: str = "msb") -> DataFrame:
    """(keys, pos, b): whole bytes of (keys, pos, bit); a partial last byte is dropped."""
    weight = power2(7 - F.col("k") if order == "msb" else F.col("k"))
    got = bits.withColumn("byte", F.expr("cast(pos div 8 as int)")).withColumn("k", (F.col("pos") % 8).cast("int"))
    return got.groupBy(*keys, "byte").agg(F.sum(F.col("bit") * weight).cast("int").alias("b"), F.count("*").alias("n")).where("n = 8").select(*keys, F.col("byte").alias("pos"), "b")


def text_from_bits(bits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, message): bits most significant first up to the first NUL byte, as text."""
    got = bytes_from_bits(bits, keys)
    ends = got.groupBy(*keys).agg(F.min(F.when(F.col("b") == 0, F.col("pos"))).alias("stop"))
    kept = got.join(ends, keys) if keys else got.crossJoin(F.broadcast(ends))
    kept = kept.where("stop is null or pos < stop")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: F.lpad(F.hex(x["b"]), 2, "0")), "")
    return kept.groupBy(*keys).agg(F.decode(F.unhex(text), "utf-8").alias("message"))
