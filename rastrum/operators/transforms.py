"""Bit planes, three Haar transforms, the 8 x 8 cosine transform and error diffusion on pixel tables.

The three Haar transforms differ in scale and rounding and share no arithmetic. Each works on 2 x 2 squares: one aggregation brings the
four values of a square together, and the four results are dealt to their quadrants."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import clamp
from .geometry import sizes


def bit_planes(px: DataFrame) -> DataFrame:
    """(image_id, r, c, plane, v): plane 1 is the least significant bit; v is 255 or 0."""
    return px.select("image_id", "r", "c", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("plane"), "v").withColumn("v", (F.getbit("v", F.col("plane") - 1).cast("int") * 255).cast("int"))


def _squares(px: DataFrame) -> DataFrame:
    """(image_id, r, c, x00, x01, x10, x11): 2 x 2 squares of an even-sized picture."""
    at = lambda i, j: F.max(F.when((F.col("r") % 2 == i) & (F.col("c") % 2 == j), F.col("v"))).alias(f"x{i}{j}")
    return px.groupBy("image_id", F.expr("cast(r div 2 as int)").alias("sr"), F.expr("cast(c div 2 as int)").alias("sc")).agg(at(0, 0), at(0, 1), at(1, 0), at(1, 1)).withColumnsRenamed({"sr": "r", "sc": "c"})


def _quadrants(df: DataFrame, size: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    """Columns of low-low, low-high (right), high-low (below) and high-high results put into quadrants of one raster."""
    got = df.join(size, "image_id")
    half_h, half_w = F.expr("cast(h div 2 as int)"), F.expr("cast(w div 2 as int)")
    cells = [F.struct((F.col("r") + (half_h if k > 1 else 0)).alias("r"), (F.col("c") + (half_w if k % 2 else 0)).alias("c"), F.col(n).alias("v")) for k, n in enumerate(names)]
    return got.select("image_id", F.explode(F.array(*cells)).alias("x")).select("image_id", "x.*")


def _from_quadrants(px: DataFrame, size: DataFrame) -> DataFrame:
    """(image_id, r, c, ll, lh, hl, hh) from one raster with quadrants; lh is right, hl below."""
    got = px.join(size, "image_id").withColumn("hh_", F.expr("cast(h div 2 as int)")).withColumn("hw_", F.expr("cast(w div 2 as int)"))
    low_r, low_c = F.col("r") < F.col("hh_"), F.col("c") < F.col("hw_")
    at = lambda a, b, n: F.max(F.when((low_r == a) & (low_c == b), F.col("v"))).alias(n)
    return got.groupBy("image_id", (F.col("r") % F.col("hh_")).alias("sr"), (F.col("c") % F.col("hw_")).alias("sc")).agg(at(True, True, "ll"), at(True, False, "lh"), at(False, True, "hl"), at(False, False, "hh")).withColumnsRenamed({"sr": "r", "sc": "c"})


def _spread(df: DataFrame, values: tuple[Column, Column, Column, Column]) -> DataFrame:
    cells = [F.struct((F.col("r") * 2 + k // 2).cast("int").alias("r"), (F.col("c") * 2 + k % 2).cast("int").alias("c"), v.alias("v")) for k, v in enumerate(values)]
    return df.select("image_id", F.explode(F.array(*cells)).alias("x")).select("image_id", "x.*")


def haar_ortho(px: DataFrame) -> DataFrame:
    """Orthonormal Haar transform, rows then columns, quadrants in one raster of doubles."""
    a, b, c, d = (F.col(x).cast("double") for x in ("x00", "x01", "x10", "x11"))
    sq = _squares(px).select("image_id", "r", "c", ((a + b + c + d) / 2).alias("ll"), ((a - b + c - d) / 2).alias("lh"), ((a + b - c - d) / 2).alias("hl"), ((a - b - c + d) / 2).alias("hh"))
    return _quadrants(sq, sizes(px), ("ll", "lh", "hl", "hh"))


def haar_ortho_inverse(px: DataFrame) -> DataFrame:
    ll, lh, hl, hh = map(F.col, ("ll", "lh", "hl", "hh"))
    return _spread(_from_quadrants(px, sizes(px)), ((ll + lh + hl + hh) / 2, (ll - lh + hl - hh) / 2, (ll + lh - hl - hh) / 2, (ll - lh - hl + hh) / 2))


def haar_average(px: DataFrame, levels: int = 1) -> DataFrame:
    """(image_id, level, band, r, c, v): averaging Haar transform; LH is the vertical difference of row averages, HL the vertical average of
    row differences. Each further level works on the LL band, which is listed for the last level only."""
    out, now = None, px
    for level in range(1, levels + 1):
        a, b, c, d = (F.col(x).cast("double") for x in ("x00", "x01", "x10", "x11"))
        bands = {"LL": (a + b + c + d) / 4, "LH": (a + b - c - d) / 4, "HL": (a - b + c - d) / 4, "HH": (a - b - c + d) / 4}
        sq = _squares(now).select("image_id", "r", "c", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), v.alias("v")) for k, v in bands.items()])).alias("x")).select("image_id", F.lit(level).alias("level"), "x.band", "r", "c", "x.v")
        now = sq.where("band = 'LL'").select("image_id", "r", "c", "v")
        part = sq if level == levels else sq.where("band <> 'LL'")
        out = part if out is None else out.unionByName(part)
    return out


def haar_picture(px: DataFrame, levels: int) -> DataFrame:
    """(image_id, r, c, v): all bands of an averaging Haar transform in one picture: LL of the last level above left, of each level HL right of
    it, LH below, HH diagonal. LL is rounded half up, each other band of a picture stretched to 0 to 255."""
    band = ["image_id", "level", "band"]
    bands = haar_average(px, levels)
    ends = bands.groupBy(*band).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), (F.max("r") + 1).alias("bh"), (F.max("c") + 1).alias("bw"))
    stretched = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    shown = F.when(F.col("band") == "LL", F.col("v")).otherwise(stretched)
    down, right = F.when(F.col("band").isin("LH", "HH"), F.col("bh")).otherwise(0), F.when(F.col("band").isin("HL", "HH"), F.col("bw")).otherwise(0)
    return bands.join(ends, band).select("image_id", (F.col("r") + down).cast("int").alias("r"), (F.col("c") + right).cast("int").alias("c"), clamp(F.floor(F.round(shown, 6) + 0.5)).alias("v"))


def integer_haar(px: DataFrame) -> DataFrame:
    """Lifting Haar transform, rows then columns, quadrants in one raster of ints: difference of the pair, and its second plus the floor of
    half the difference."""
    low = lambda x, y: y + F.shiftright(x - y, 1)
    a, b, c, d = map(F.col, ("x00", "x01", "x10", "x11"))
    rows = _squares(px).select("image_id", "r", "c", low(a, b).alias("l0"), (a - b).alias("h0"), low(c, d).alias("l1"), (c - d).alias("h1"))
    l0, h0, l1, h1 = map(F.col, ("l0", "h0", "l1", "h1"))
    sq = rows.select("image_id", "r", "c", low(l0, l1).alias("ll"), low(h0, h1).alias("lh"), (l0 - l1).alias("hl"), (h0 - h1).alias("hh"))
    return _quadrants(sq, sizes(px), ("ll", "lh", "hl", "hh"))


def integer_haar_inverse(px: DataFrame, saturate: bool = True) -> DataFrame:
    """Inverse of integer_haar; values are clamped to pixels if ``saturate``."""
    second = lambda low, high: low - F.shiftright(high, 1)
    q = _from_quadrants(px, sizes(px))
    cols = q.select("image_id", "r", "c", second(F.col("ll"), F.col("hl")).alias("l1"), F.col("hl"), second(F.col("lh"), F.col("hh")).alias("h1"), F.col("hh"))
    cols = cols.select("image_id", "r", "c", (F.col("hl") + F.col("l1")).alias("l0"), "l1", (F.col("hh") + F.col("h1")).alias("h0"), "h1")
    b, d = second(F.col("l0"), F.col("h0")), second(F.col("l1"), F.col("h1"))
    values = (F.col("h0") + b, b, F.col("h1") + d, d)
    return _spread(cols, tuple(clamp(v) if saturate else v for v in values))


def dct_basis(spark: SparkSession, n: int = 20) -> DataFrame:
    """(r, c, v): the n x n cosine basis pictures in an n x n grid."""
    px = spark.range(n**4).select(*(F.expr(f"cast(id div {n**k} % {n} as int)").alias(x) for k, x in enumerate(("y", "x", "j", "i"))))
    scale = lambda k: F.when(F.col(k) == 0, math.sqrt(1 / n)).otherwise(math.sqrt(2 / n))
    wave = lambda x, k: F.cos((2 * F.col(x) + 1) * F.col(k) * math.pi / (2 * n))
    return px.select((F.col("i") * n + F.col("x")).alias("r"), (F.col("j") * n + F.col("y")).alias("c"), (scale("i") * scale("j") * wave("x", "i") * wave("y", "j")).alias("v"))


def _matrix(n: int = 8) -> list[list[float]]:
    """Rows of the orthonormal cosine transform of n points."""
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos((2 * x + 1) * k * math.pi / (2 * n)) for x in range(n)] for k in range(n)]


def _dct_pass(px: DataFrame, along: str, across: str, inverse: bool) -> DataFrame:
    """One-dimensional 8-point transforms: one aggregation per line of a block, then arithmetic without joins or Python."""
    m = _matrix()
    at = F.col(along) % 8
    line = px.groupBy("image_id", across, F.expr(f"cast({along} div 8 as int)").alias("_b")).agg(*(F.max(F.when(at == k, F.col("v"))).alias(f"x{k}") for k in range(8)))
    terms = lambda k: sum((F.col(f"x{x}") * (m[x][k] if inverse else m[k][x]) for x in range(1, 8)), F.col("x0") * (m[0][k] if inverse else m[k][0]))
    out = line.select("image_id", across, "_b", F.posexplode(F.array(*map(terms, range(8)))).alias("_k", "v"))
    return out.select("image_id", (F.col("_b") * 8 + F.col("_k")).cast("int").alias(along), across, "v").select("image_id", "r", "c", "v")


def dct8(px: DataFrame) -> DataFrame:
    """Cosine transform of each whole 8 x 8 block, coefficients in the pixels' places."""
    return _dct_pass(_dct_pass(px.withColumn("v", F.col("v").cast("double")), "c", "r", False), "r", "c", False)


def idct8(px: DataFrame) -> DataFrame:
    return _dct_pass(_dct_pass(px, "r", "c", True), "c", "r", True)


def snapped(x: Column) -> Column:
    """A coefficient as the nearest whole number, halves away from zero, after noise below a millionth is taken off."""
    return F.round(F.round(x, 6)).cast("int")


#: Pixels that a task dithers together, about.
DITHER = 1 << 21


def floyd_steinberg(px: DataFrame) -> DataFrame:
    """Error diffusion in raster order with 32-bit floats: over 127 white, else black; 7, 3, 5, 1 sixteenths of the error go east, south-west,
    south and south-east. Each pixel depends on all before it, so a picture is one task's work; many small ones of one size are stacked
    and go through their pixels together."""

    def stacked(pdf: pd.DataFrame, h: int, w: int) -> pd.DataFrame:
        """Pictures of one size."""
        ids, k = np.unique(pdf["image_id"], return_inverse=True)
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        x = np.zeros((h + 1, w + 2, len(ids)), np.float32)
        x[r, c + 1, k] = pdf["v"]
        out = np.zeros((h, w, len(ids)), np.int32)
        e7, e3, e5, e1 = (np.float32(k / 16) for k in (7, 3, 5, 1))
        for i in range(h):
            row, below = x[i], x[i + 1]
            for j in range(1, w + 1):
                old = row[j]
                new = np.where(old > 127, 255, 0)
                out[i, j - 1] = new
                err = old - new.astype(np.float32)
                row[j + 1] += err * e7
                below[j - 1] += err * e3
                below[j] += err * e5
                below[j + 1] += err * e1
        return pdf.assign(v=out[r, c, k])[["image_id", "r", "c", "v"]]

    def dither(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([stacked(some, int(h), int(w)) for (h, w), some in pdf.groupby(["h", "w"])])

    size = sizes(px)
    tasks = size.groupBy("h", "w").agg(F.ceil(F.sum(F.col("h").cast("long") * F.col("w")) / DITHER).cast("long").alias("_tasks"))
    size = size.join(tasks, ["h", "w"]).withColumn("_task", F.pmod(F.xxhash64("image_id"), F.col("_tasks"))).drop("_tasks")
    return px.select("image_id", "r", "c", "v").join(size, "image_id").groupBy("h", "w", "_task").applyInPandas(dither, "image_id long, r int, c int, v int")
