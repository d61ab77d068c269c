"""Histograms, fidelity and capacity figures of pixel tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import smooth


def histogram(px: DataFrame) -> DataFrame:
    """(image_id, v, n) of the values that occur."""
    return px.groupBy("image_id", "v").agg(F.count("*").alias("n"))


def histogram_dense(px: DataFrame) -> DataFrame:
    """(image_id, v, n) for all of 0..255."""
    full = histogram(px).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m"))
    return full.select("image_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.struct(v.alias("v"), F.coalesce(F.try_element_at("m", v), F.lit(0).cast("long")).alias("n")))).alias("x")).select("image_id", "x.*")


def peak(px: DataFrame, top: int | None = None) -> DataFrame:
    """(image_id, peak, n): the most frequent value, the smallest on ties, of those up to ``top`` if given."""
    h = histogram(px if top is None else px.where(F.col("v") <= top))
    return h.groupBy("image_id").agg(F.max(F.struct("n", (-F.col("v")).alias("m"))).alias("x")).select("image_id", (-F.col("x.m")).alias("peak"), "x.n")


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = [k for k in a.columns if k != "v"]
    return a.select(*keys, F.col("v").alias("x")).join(b.select(*keys, F.col("v").alias("y")), keys)


def psnr(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, mse, psnr): a mean squared error up to 1e-10 gives infinity."""
    got = _pairs(a, b).groupBy("image_id").agg(F.avg((F.col("x") - F.col("y")).cast("double") ** 2).alias("mse"))
    return got.withColumn("psnr", F.when(F.col("mse") <= 1e-10, float("inf")).otherwise(10 * F.log10(255.0 * 255.0 / F.col("mse"))))


def ssim_block(a: DataFrame, b: DataFrame, side: int = 8) -> DataFrame:
    """(image_id, ssim): mean over blocks of the structural similarity of Wang et al., with population moments."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    m = _pairs(a, b).groupBy("image_id", F.expr(f"r div {side}").alias("br"), F.expr(f"c div {side}").alias("bc")).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.avg(x * y).alias("xy"))
    mx, my = F.col("mx"), F.col("my")
    s = (2 * mx * my + c1) * (2 * (F.col("xy") - mx * my) + c2) / ((mx * mx + my * my + c1) * (F.col("xx") - mx * mx + F.col("yy") - my * my + c2))
    return m.groupBy("image_id").agg(F.avg(s).alias("ssim"))


def ssim(a: DataFrame, b: DataFrame, sigma: float = 1.5, radius: int = 5) -> DataFrame:
    """(image_id, ssim): mean structural similarity of Wang et al. with a Gaussian window; windows at the border are mirrored."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(radius + 1)]
    total = w[0] + 2 * sum(w[1:])
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    m = _pairs(a, b).select("image_id", "r", "c", x.alias("mx"), y.alias("my"), (x * x).alias("xx"), (y * y).alias("yy"), (x * y).alias("xy"))
    for name in ("mx", "my", "xx", "yy", "xy"):
        m = smooth(m, name, tuple(k / total for k in w))
    mx, my = F.col("mx"), F.col("my")
    s = (2 * mx * my + c1) * (2 * (F.col("xy") - mx * my) + c2) / ((mx * mx + my * my + c1) * (F.col("xx") - mx * mx + F.col("yy") - my * my + c2))
    return m.groupBy("image_id").agg(F.avg(s).alias("ssim"))


def block_variance(px: DataFrame, side: int = 8) -> DataFrame:
    """(image_id, br, bc, variance): population variance of each block; edge blocks may be smaller."""
    return px.groupBy("image_id", F.expr(f"cast(r div {side} as int)").alias("br"), F.expr(f"cast(c div {side} as int)").alias("bc")).agg(F.var_pop("v").alias("variance"))


def capacity(px: DataFrame, k: int = 1) -> DataFrame:
    """(image_id, lsb_bits, dct_parity_bits, dct_lsb_bits, shift_bits): what each way of embedding holds; whole blocks for the cosine ways."""
    base = px.groupBy("image_id").agg((F.count("*") * k).alias("lsb_bits"), (F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    blocks = F.expr("cast((h div 8) * (w div 8) as long)")
    return base.withColumn("dct_parity_bits", blocks).withColumn("dct_lsb_bits", blocks * 10).join(peak(px, 254).select("image_id", F.col("n").alias("shift_bits")), "image_id", "left").select("image_id", "lsb_bits", "dct_parity_bits", "dct_lsb_bits", F.coalesce("shift_bits", F.lit(0).cast("long")).alias("shift_bits"))


def rate(px: DataFrame, bits: int) -> DataFrame:
    """(image_id, bpp): embedded bits a pixel."""
    return px.groupBy("image_id").agg((F.lit(float(bits)) / F.count("*")).alias("bpp"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, n_different, max_diff): pixels that one side lacks count as different."""
    keys = [k for k in a.columns if k != "v"]
    got = a.select(*keys, F.col("v").alias("x")).join(b.select(*keys, F.col("v").alias("y")), keys, "full")
    return got.groupBy("image_id").agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("n_different"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_diff"))
