"""Spatial filters on pixel tables. Borders are mirrored without repeating the edge; results are clamped to 0..255.

The kernels are separable or a centre less a box, so a filter is two window passes, along rows and along columns, instead of a join with
every neighbour. A pass works on stretches of STRIPE pixels of a row or column, to which copies of the pixels around them are dealt, so
no window orders a whole row or column of a large picture."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), x)).cast("int")


#: Pixels of a row or column that a window orders, besides copies of its neighbours.
STRIPE = 4096


def _striped(px: DataFrame, along: str, radius: int) -> DataFrame:
    """px with the number of a stripe along an axis, ``_k``; pixels within radius of another stripe also go there, as copies: ``_own`` is false."""
    at, k = F.col(along) % STRIPE, F.expr(f"cast({along} div {STRIPE} as int)")
    stripes = F.array_compact(F.array(k, F.when((at < radius) & (k > 0), k - 1), F.when(at >= STRIPE - radius, k + 1)))
    return px.withColumn("_k", F.explode(stripes)).withColumn("_own", F.col("_k") == k)


def _pass(px: DataFrame, along: str, across: str, weights: tuple[float, ...], to: str, source: str) -> DataFrame:
    """Weighted sum of a symmetric kernel (centre first, then outwards) along one axis."""
    px = _striped(px, along, len(weights) - 1)
    w = W.partitionBy("image_id", across, "_k").orderBy(along)
    x = F.col(source)
    lag, lead = (lambda k, f=f: f(source, k).over(w) for f in (F.lag, F.lead))
    total = x * weights[0]
    for k in range(1, len(weights)):
        # a neighbour k steps outside the edge is the one k steps inside it: the place 2 steps before the second one is itself
        inner = [F.lag(source, j).over(w) for j in range(1, k)]
        before = F.coalesce(lag(k), *(F.when(inner[j - 1].isNotNull(), lead(k - 2 * j) if k > 2 * j else lag(2 * j - k) if k < 2 * j else x) for j in range(k - 1, 0, -1)), lead(k), x)
        inner = [F.lead(source, j).over(w) for j in range(1, k)]
        after = F.coalesce(lead(k), *(F.when(inner[j - 1].isNotNull(), lag(k - 2 * j) if k > 2 * j else lead(2 * j - k) if k < 2 * j else x) for j in range(k - 1, 0, -1)), lag(k), x)
        total = total + (before + after) * weights[k]
    return px.withColumn(to, total).where("_own").drop("_k", "_own")


def sharpen(px: DataFrame) -> DataFrame:
    """3 x 3 kernel with 9 in the centre and -1 around it: ten times the centre less the box sum."""
    box = _pass(_pass(px, "c", "r", (1, 1), "_s", "v"), "r", "c", (1, 1), "_b", "_s")
    return box.select("image_id", "r", "c", clamp(10 * F.col("v") - F.col("_b")).alias("v"))


def binomial_blur(px: DataFrame, radius: int) -> DataFrame:
    """Blur with binomial weights over 2 * radius + 1 pixels each way, rounded half up. radius: up to 5, so that sums are ints."""
    if not 1 <= radius <= 5:
        raise ValueError("radius must be 1 to 5")
    weights = tuple(math.comb(2 * radius, radius + k) for k in range(radius + 1))
    got = _pass(_pass(px, "c", "r", weights, "_s", "v"), "r", "c", weights, "_b", "_s")
    total = 1 << 4 * radius
    return got.select("image_id", "r", "c", F.expr(f"cast((_b + {total // 2}) div {total} as int)").alias("v"))


def gaussian5(px: DataFrame) -> DataFrame:
    return binomial_blur(px, 2)


def gaussian11(px: DataFrame) -> DataFrame:
    return binomial_blur(px, 5)


def smooth(px: DataFrame, source: str, weights: tuple[float, ...]) -> DataFrame:
    """px with ``source`` replaced by its weighted sum along rows and columns; weights of the centre first, then outwards."""
    got = _pass(_pass(px, "c", "r", weights, "_s", source), "r", "c", weights, "_b", "_s")
    return got.withColumn(source, F.col("_b")).drop("_s", "_b")


def normalise(px: DataFrame) -> DataFrame:
    """Stretched so that a picture's least and greatest values become 0 and 255, rounded half up; a flat picture becomes 0."""
    ends = px.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), F.floor(F.round((F.col("v") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo")), 6) + 0.5)).otherwise(0)
    return px.join(ends, "image_id").select("image_id", "r", "c", clamp(scaled).alias("v"))


def threshold(px: DataFrame, limit: int = 128) -> DataFrame:
    return px.withColumn("v", F.when(F.col("v") > limit, 255).otherwise(0))


def to_gray(px: DataFrame) -> DataFrame:
    """Luma of B, G, R channels with integer weights 114, 587, 299 of 1000, rounded half up."""
    weight = F.element_at(F.array(*map(F.lit, (114, 587, 299))), F.col("ch") + 1)
    return px.groupBy("image_id", "r", "c").agg(F.sum(F.col("v") * weight).alias("s")).select("image_id", "r", "c", F.expr("cast((s + 500) div 1000 as int)").alias("v"))


def edges(px: DataFrame, limit: int = 30) -> DataFrame:
    """255 where central differences along rows and columns add up to more than the limit, else 0."""

    def differences(px: DataFrame, along: str, across: str, to: str) -> DataFrame:
        w = W.partitionBy("image_id", across, "_k").orderBy(along)
        diff = F.abs(F.coalesce(F.lead("v").over(w), F.col("v")) - F.coalesce(F.lag("v").over(w), F.col("v")))
        return _striped(px, along, 1).withColumn(to, diff).where("_own").drop("_k", "_own")

    got = differences(differences(px, "c", "r", "_x"), "r", "c", "_y")
    return got.select("image_id", "r", "c", F.when(F.col("_x") + F.col("_y") > limit, 255).otherwise(0).alias("v"))


#: Rows of a picture whose regions are labelled by one task.
BAND = 512


def _labelled(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each pixel's 8-connected region; pixels in raster order."""
    label = np.arange(len(r))
    key = r * (int(c.max()) + 3) + c
    pairs = []
    for step in (1, int(c.max()) + 2, int(c.max()) + 3, int(c.max()) + 4):  # right, and the three below
        at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
        near = np.flatnonzero(key[at] == key + step)
        pairs.append(np.stack([near, at[near]], axis=1))
    return _together(label, np.concatenate(pairs))


def _together(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Labels, which are places, made the least of all that pairs of places connect."""
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def regions(px: DataFrame) -> DataFrame:
    """(image_id, x, y, w, h, area): bounding boxes of 8-connected regions of non-zero pixels, area in pixels. Bands of BAND rows are labelled
    apart; of each band's regions only the boxes and the columns at its borders go to the task that puts a picture's together."""
    spots = "array<int>"

    def band(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"])
        k, first = pdf["k"].iloc[0], pdf["k"].iloc[0] * BAND
        got = pdf.assign(label=_labelled((pdf["r"] - first).to_numpy().astype(np.int64), pdf["c"].to_numpy().astype(np.int64))).groupby("label")
        edge = lambda row: got.apply(lambda g: g["c"][g["r"] == row].tolist(), include_groups=False)
        boxes = got.agg(x=("c", "min"), y=("r", "min"), x1=("c", "max"), y1=("r", "max"), area=("r", "size"))
        return boxes.assign(image_id=pdf["image_id"].iloc[0], k=k, top=edge(first), bottom=edge(first + BAND - 1))[["image_id", "k", "x", "y", "x1", "y1", "area", "top", "bottom"]]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        below = {(k - 1, c): i for i, (k, top) in enumerate(zip(pdf["k"], pdf["top"], strict=True)) for c in top}
        pairs = [(i, j) for i, (k, bottom) in enumerate(zip(pdf["k"], pdf["bottom"], strict=True)) for c in bottom for d in (-1, 0, 1) if (j := below.get((k, c + d))) is not None]
        label = _together(np.arange(len(pdf)), np.array(pairs, int).reshape(-1, 2))
        got = pdf.groupby(label).agg(x=("x", "min"), y=("y", "min"), x1=("x1", "max"), y1=("y1", "max"), area=("area", "sum"))
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "x": got.x, "y": got.y, "w": got.x1 - got.x + 1, "h": got.y1 - got.y + 1, "area": got.area})

    set_ = px.where("v > 0").select("image_id", "r", "c", F.expr(f"cast(r div {BAND} as int)").alias("k"))
    parts = set_.groupBy("image_id", "k").applyInPandas(band, f"image_id long, k int, x int, y int, x1 int, y1 int, area long, top {spots}, bottom {spots}")
    return parts.groupBy("image_id").applyInPandas(whole, "image_id long, x int, y int, w int, h int, area long")


def plate_boxes(px: DataFrame, top: int = 10, aspect: float = 4.0) -> DataFrame:
    """Of a picture's ``top`` largest edge regions those that are over ``aspect`` times as wide as high."""
    w = W.partitionBy("image_id").orderBy(F.desc("area"), "y", "x")
    return regions(edges(gaussian11(px))).withColumn("rank", F.row_number().over(w)).where(f"rank <= {top} and w / h > {aspect}").drop("rank")
