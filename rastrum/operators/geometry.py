"""Size, order and blocks of pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows of a picture whose counts are summed up together.
GROUP = 4096


def sizes(px: DataFrame) -> DataFrame:
    """(image_id, h, w)."""
    return px.groupBy("image_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))


def with_size(px: DataFrame) -> DataFrame:
    return px.join(sizes(px), "image_id")


def crop_even(px: DataFrame) -> DataFrame:
    """Without the last row or column where their number is odd."""
    return crop_multiple(px, 2)


def crop_multiple(px: DataFrame, side: int) -> DataFrame:
    """Cropped to whole blocks of ``side``."""
    return with_size(px).where(f"r < h - h % {side} and c < w - w % {side}").select(*px.columns)


def pad_replicate(px: DataFrame, side: int) -> DataFrame:
    """Padded right and below to whole blocks with copies of the edge. Only edge pixels are multiplied."""
    to = lambda at, n: F.when(F.col(at) == F.col(n) - 1, F.sequence(F.col(at), (F.ceil(F.col(n) / side) * side - 1).cast("int"))).otherwise(F.array(F.col(at)))
    rest = [x for x in px.columns if x not in ("r", "c")]
    rows = with_size(px).select(*rest, "c", "w", F.explode(to("r", "h")).alias("r"))
    return rows.select(*rest, "r", F.explode(to("c", "w")).alias("c")).select(*px.columns)


def blocks(px: DataFrame, side: int) -> DataFrame:
    """(image_id, br, bc, vec): blocks of side x side, or what the edge leaves of them, flattened row by row."""
    got = px.select("image_id", F.expr(f"cast(r div {side} as int)").alias("br"), F.expr(f"cast(c div {side} as int)").alias("bc"), F.struct("r", "c", "v").alias("x"))
    return got.groupBy("image_id", "br", "bc").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("vec"))


def unblocks(df: DataFrame, side: int, vec: str = "vec") -> DataFrame:
    """Whole blocks back to pixels (image_id, r, c, v)."""
    got = df.select("image_id", "br", "bc", F.posexplode(vec).alias("i", "v"))
    return got.select("image_id", F.expr(f"cast(br * {side} + i div {side} as int)").alias("r"), F.expr(f"cast(bc * {side} + i % {side} as int)").alias("c"), "v")


def resize_bilinear(px: DataFrame, height: int, width: int) -> DataFrame:
    """Scaled to height x width."""
    return _resized(px, F.lit(height), F.lit(width))


def resize_to_levels(px: DataFrame, levels: int) -> DataFrame:
    """Scaled, not cropped, to the largest multiples of 2 ** levels that aren't larger; pictures with a side below that vanish."""
    side = 1 << levels
    return _resized(px, F.expr(f"h div {side} * {side}"), F.expr(f"w div {side} * {side}"))


def _resized(px: DataFrame, height: Column, width: Column) -> DataFrame:
    """Scaled to height x width, which may depend on h and w: each new pixel is the weighted mean of the four around its centre, rounded half
    up. Every source pixel is read once and sends its weighted value to the new pixels that it is near to, so no grid is made or joined."""

    def axis(at: str, n: str, size: str) -> Column:
        """(to, weight) of the new places to which the old place ``at`` contributes."""
        scale = F.col(n) / F.col(size)
        # places whose centres lie less than one old place away, and one more for rounding; the first and last old place take all beyond
        low = F.when(F.col(at) == 0, 0).otherwise(F.greatest(F.lit(0), F.floor((F.col(at) - 0.5) * scale - 0.5) - 1)).cast("int")
        high = F.when(F.col(at) == F.col(size) - 1, F.col(n) - 1).otherwise(F.least(F.col(n) - 1, F.ceil((F.col(at) + 1.5) * scale - 0.5) + 1)).cast("int")

        def weighed(i: Column) -> Column:
            x = F.greatest(F.lit(0.0), F.least((i + 0.5) * F.col(size) / F.col(n) - 0.5, F.col(size) - 1.0))
            part = x - F.floor(x)
            return F.struct(i.alias("to"), F.when(F.floor(x) == F.col(at), 1 - part).when(F.floor(x) + 1 == F.col(at), part).otherwise(0.0).alias("weight"))

        return F.filter(F.transform(F.sequence(low, high), weighed), lambda k: k["weight"] > 0)

    size = sizes(px).withColumn("th", height.cast("int")).withColumn("tw", width.cast("int")).where("th > 0 and tw > 0")
    rows = px.select("image_id", "r", "c", "v").join(size, "image_id").select("image_id", "c", "w", "tw", "v", F.explode(axis("r", "th", "h")).alias("y"))
    sent = rows.select("image_id", "y", "v", F.explode(axis("c", "tw", "w")).alias("x"))
    got = sent.groupBy("image_id", F.col("y.to").alias("r"), F.col("x.to").alias("c")).agg(F.sum(F.col("y.weight") * F.col("x.weight") * F.col("v")).alias("s"))
    return got.select("image_id", "r", "c", F.floor(F.round("s", 6) + 0.5).cast("int").alias("v"))


def mosaic(px: DataFrame, index: str, columns: int, height: int, width: int) -> DataFrame:
    """Tiles numbered by the column ``index``, all height x width, put into one picture with ``columns`` of them in a row."""
    return px.select("image_id", F.expr(f"cast(({index} div {columns}) * {height} + r as int)").alias("r"), F.expr(f"cast(({index} % {columns}) * {width} + c as int)").alias("c"), "v")


def number_in_order(df: DataFrame, keys: list[str], row: str, order: list[str], name: str) -> DataFrame:
    """Numbers rows from 0 by (row, order) for each value of keys in steps, so that a single large picture isn't ordered by one task: counts
    of rows are summed up along groups of GROUP values of ``row``, inside the groups, and a rank inside each row is added."""
    counts = df.groupBy(*keys, row).agg(F.count("*").alias("_n")).withColumn("_g", F.expr(f"{row} div {GROUP}"))
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy(*keys, "_g").agg(F.sum("_n").alias("_gn")).withColumn("_gb", ahead("_gn", W.partitionBy(*keys).orderBy("_g"))).drop("_gn")
    inside_group = counts.withColumn("_own", ahead("_n", W.partitionBy(*keys, "_g").orderBy(row)))
    before = inside_group.join(groups, [*keys, "_g"]).select(*keys, row, (F.col("_gb") + F.col("_own")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, row).orderBy(*order)) - 1
    return df.withColumn("_in", inside).join(before, [*keys, row]).withColumn(name, F.col("_before") + F.col("_in")).drop("_before", "_in")
