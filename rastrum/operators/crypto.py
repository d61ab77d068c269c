"""Ciphers and secret sharing on pixel and number tables. Random choices come from md5 counters, so they are the same on any
partitioning and in any engine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
#: 2 x 2 patterns of the two-share scheme, row by row; 0 is black, 1 white.
PATTERNS_22 = ((0, 1, 1, 0), (1, 0, 0, 1), (0, 0, 1, 1), (1, 1, 0, 0), (0, 1, 0, 1), (1, 0, 1, 0))
#: Patterns of the four-share scheme, each followed by its complement, and which shares of a black pixel get the complement.
PATTERNS_24 = ((0, 0, 1, 1), (1, 1, 0, 0), (0, 1, 0, 1), (1, 0, 1, 0), (0, 1, 1, 0), (1, 0, 0, 1))
SCHEMES_24 = ((0, 0, 1, 1), (0, 1, 0, 1), (0, 1, 1, 0))


def random_int(key: str, *parts: Column, below: int) -> Column:
    """A number of 0 to below - 1 from 28 bits of md5 of the key and the parts."""
    text = F.concat_ws(":", F.lit(key), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long") % below).cast("int")


def xor_constant(px: DataFrame, key: int = 127) -> DataFrame:
    """Every value XOR the key; its own inverse."""
    return px.withColumn("v", F.col("v").bitwiseXOR(F.lit(key)))


def xor_stream(px: DataFrame, key: str, width: int) -> DataFrame:
    """Every value XOR a key-stream byte of its flat place; its own inverse."""
    return px.withColumn("v", F.col("v").bitwiseXOR(random_int(key, F.col("r").cast("long") * width + F.col("c"), below=256)))


def xor_mersenne(px: DataFrame, seed: int) -> DataFrame:
    """Every value XOR the high byte of the next number of the 32-bit Mersenne twister, in raster order; its own inverse. The twister has no way
    to jump, so a picture is one task; pictures run in parallel, all with the same stream."""

    def cipher(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"])
        stream = np.random.RandomState(seed).randint(0, 1 << 32, len(pdf), np.uint32) >> 24
        return pdf.assign(v=pdf["v"].to_numpy() ^ stream.astype(np.int32))

    return px.select("image_id", "r", "c", "v").groupBy("image_id").applyInPandas(cipher, "image_id long, r int, c int, v int")


def mod_pow(base: Column, exponent: Column | int) -> Column:
    """base ** exponent modulo PRIME by squaring; products stay below 2 ** 62."""
    e = F.lit(exponent) if isinstance(exponent, int) else exponent
    start = F.struct((base.cast("long") % PRIME).alias("b"), F.lit(1).cast("long").alias("a"))
    step = lambda s, k: F.struct((s["b"] * s["b"] % PRIME).alias("b"), F.when(F.getbit(e.cast("long"), k) == 1, s["a"] * s["b"] % PRIME).otherwise(s["a"]).alias("a"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), start, step, lambda s: s["a"])


def mod_inverse(x: Column) -> Column:
    return mod_pow(F.pmod(x.cast("long"), F.lit(PRIME)), PRIME - 2)


def shamir_split(secrets: DataFrame, key: str, n: int = 5, m: int = 5) -> DataFrame:
    """(secret_id, x, y): n points of a polynomial of degree m - 1 whose value at 0 is the secret; other coefficients are 1..PRIME-1."""
    if not 1 <= m <= n < PRIME:
        raise ValueError("1 <= m <= n")
    coef = F.array(*[(random_int(key, F.col("secret_id"), F.lit(k), below=PRIME - 1) + 1).cast("long") for k in range(m - 1, 0, -1)], F.col("secret").cast("long"))
    x = F.col("x").cast("long")
    y = F.aggregate(coef, F.lit(0).cast("long"), lambda a, c: (a * x + c) % PRIME)
    return secrets.where(f"secret >= 0 and secret < {PRIME}").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(n)))).select("secret_id", "x", y.alias("y"))


def _weights(sets: DataFrame) -> DataFrame:
    """sets with ``weights``: of each array ``xs`` of distinct places, Lagrange's weights at 0."""
    one = F.lit(1).cast("long")

    def product(i: Column, factor) -> Column:
        return F.aggregate("xs", one, lambda a, o: F.when(o == i, a).otherwise(a * F.pmod(factor(o), F.lit(PRIME)) % PRIME))

    return sets.withColumn("weights", F.transform("xs", lambda i: product(i, lambda o: -o) * mod_inverse(product(i, lambda o: i - o)) % PRIME))


def shamir_recover(shares: DataFrame, m: int = 5) -> DataFrame:
    """(secret_id, secret): Lagrange's polynomial at 0 through the m points of least x; null with fewer distinct ones, or with two values at one
    of them. Weights depend on the places alone: they are worked out once for each set of places and joined."""
    points = F.slice(F.array_sort(F.collect_set(F.struct(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")))), 1, m)
    got = shares.groupBy("secret_id").agg(points.alias("p")).select("secret_id", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))
    sets = _weights(got.select("xs").distinct().where((F.size("xs") == m) & (F.size(F.array_distinct("xs")) == m)))
    terms = F.zip_with("ys", "weights", lambda y, w: F.pmod(y, F.lit(PRIME)) * w % PRIME)
    return got.join(sets, "xs", "left").select("secret_id", (F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: a + t) % PRIME).alias("secret"))


def _choose(patterns: tuple, index: Column) -> Column:
    """The sub-pixels of a pattern as an array of 0 and 255."""
    return F.element_at(F.array(*[F.array(*[F.lit(255 * x) for x in p]) for p in patterns]), index + 1)


def _flip(p: Column, yes: Column) -> Column:
    return F.when(yes, F.transform(p, lambda x: 255 - x)).otherwise(p)


def _shares(px: DataFrame, arrays: list[Column]) -> DataFrame:
    """(image_id, share_id, r, c, v): each pixel as 2 x 2 sub-pixels of each share."""
    got = px.select("image_id", "r", "c", F.posexplode(F.array(*arrays)).alias("s", "p"))
    got = got.select("image_id", (F.col("s") + 1).alias("share_id"), "r", "c", F.posexplode("p").alias("i", "v"))
    return got.select("image_id", "share_id", F.expr("cast(r * 2 + i div 2 as int)").alias("r"), F.expr("cast(c * 2 + i % 2 as int)").alias("c"), "v")


def visual_2_of_2(px: DataFrame, key: str) -> DataFrame:
    """Two shares of a picture of 0 and 255: white pixels get the same pattern in both, black ones a pattern and its complement."""
    p = _choose(PATTERNS_22, random_int(key, F.col("r"), F.col("c"), below=6))
    return _shares(px, [p, _flip(p, F.col("v") == 0)])


def visual_2_of_4(px: DataFrame, key: str, scheme: str = "reference") -> DataFrame:
    """Four shares: white pixels get one of six patterns in all; black ones a pattern or its complement after one of three schemes. With
    'reference' share 1 of a black pixel is always one of three patterns; 'balanced' swaps pattern and complement at random."""
    if scheme not in ("reference", "balanced"):
        raise ValueError(scheme)
    white, pair, way = (random_int(f"{key}{s}", F.col("r"), F.col("c"), below=n) for s, n in (("w", 6), ("p", 3), ("s", 3)))
    black = F.col("v") == 0
    base = _choose(PATTERNS_24, F.when(black, pair * 2).otherwise(white))
    if scheme == "balanced":
        base = _flip(base, black & (random_int(f"{key}b", F.col("r"), F.col("c"), below=2) == 1))
    flips = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in SCHEMES_24]), way + 1)
    return _shares(px, [_flip(base, black & (flips[k] == 1)) for k in range(4)])


def overlay(shares: DataFrame, a: int, b: int) -> DataFrame:
    """(image_id, r, c, v): two shares laid over each other, dark where either is; one aggregation instead of a join."""
    return shares.where(F.col("share_id").isin(a, b)).groupBy("image_id", "r", "c").agg(F.min("v").alias("v"))
