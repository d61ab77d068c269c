"""Embedding and extraction of messages in pixel tables.

Where a bit goes is arithmetic on r and c, or, where it depends on the data, a number from a two-step rank; bits are joined on that
number. Messages are bit tables (pos, bit); pictures of a table all get the same message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import power2, text_from_bits
from . import transforms
from .geometry import number_in_order, sizes
from .metrics import block_variance, peak

#: Longest message, in bits, that is sent to every task; a longer one is joined by a shuffle.
BROADCAST_BITS = 4_000_000
#: The zig-zag order's first ten places after the mean of an 8 x 8 block.
ZIGZAG = ((0, 1), (1, 0), (2, 0), (1, 1), (0, 2), (0, 3), (1, 2), (2, 1), (3, 0), (4, 0))
HEADER = 32


class CapacityError(ValueError):
    """A picture can't hold the message."""


def _bits(bits: DataFrame) -> tuple[DataFrame, int]:
    n = bits.count()
    return (F.broadcast(bits) if n <= BROADCAST_BITS else bits), n


def _chunks(bits: DataFrame, k: int, msb: bool) -> DataFrame:
    """(slot, chunk): k bits together as a number; a short last one is filled with zeros behind its bits."""
    at = (F.col("pos") % k).cast("int")
    shift = (k - 1) - at if msb else at
    return bits.groupBy(F.expr(f"cast(pos div {k} as long)").alias("slot")).agg(F.sum(F.col("bit") * power2(shift)).cast("int").alias("chunk"))


def _room(px: DataFrame, need: int, per_pixel: int) -> None:
    small = px.groupBy("image_id").agg((F.count("*") * per_pixel).alias("n")).agg(F.min("n")).first()[0]
    if small is not None and small < need:
        raise CapacityError(f"{need} bits don't fit into {small}")


def bits_embedded(room: DataFrame, n: int) -> DataFrame:
    """(image_id, n_bits, n_embedded) of a message of n bits in pictures with ``room`` (image_id, n): what fits is embedded."""
    return room.select("image_id", F.lit(n).cast("long").alias("n_bits"), F.least(F.col("n"), F.lit(n)).cast("long").alias("n_embedded"))


def _fits(room: DataFrame, bits: DataFrame, overflow: str) -> None:
    """With overflow 'error' a picture with too little room is refused; with 'cut' it takes the bits that fit."""
    if overflow not in ("error", "cut"):
        raise ValueError(overflow)
    if overflow == "error" and (short := bits_embedded(room, bits.count()).where("n_embedded < n_bits").first()):
        raise CapacityError(f"{short['n_bits']} bits don't fit into {short['n_embedded']}")


# colour, one bit a value


def embed_color(px: DataFrame, bits: DataFrame, width: int) -> DataFrame:
    """Bit i in the least significant bit of value i of the flattened B, G, R picture."""
    bits, n = _bits(bits)
    _room(px, n, 1)
    slot = (F.col("r").cast("long") * width + F.col("c")) * 3 + F.col("ch")
    got = px.withColumn("pos", slot).join(bits, "pos", "left")
    return got.select("image_id", "r", "c", "ch", F.when(F.col("bit").isNull(), F.col("v")).otherwise(F.col("v").bitwiseAND(0xFE).bitwiseOR(F.col("bit"))).alias("v"))


def color_bits(px: DataFrame, width: int) -> DataFrame:
    """(image_id, pos, bit) of the least significant bits in embedding order."""
    return px.select("image_id", ((F.col("r").cast("long") * width + F.col("c")) * 3 + F.col("ch")).alias("pos"), F.col("v").bitwiseAND(1).alias("bit"))


def extract_color(px: DataFrame, width: int) -> DataFrame:
    """(image_id, message) up to the first NUL byte."""
    return text_from_bits(color_bits(px, width), ["image_id"])


# gray, k bits a pixel


def embed_lsb(px: DataFrame, bits: DataFrame, k: int, width: int) -> DataFrame:
    """k bits, first ones highest, in each pixel's k low bits, in raster order."""
    if not 1 <= k <= 8:
        raise ValueError("k must be 1 to 8")
    _room(px, bits.count(), k)
    chunks, _ = _bits(_chunks(bits, k, True))
    got = px.withColumn("slot", F.col("r").cast("long") * width + F.col("c")).join(chunks, "slot", "left")
    mask = 255 - ((1 << k) - 1)
    return got.select("image_id", "r", "c", F.when(F.col("chunk").isNull(), F.col("v")).otherwise(F.col("v").bitwiseAND(mask).bitwiseOR(F.col("chunk"))).alias("v"))


def extract_lsb(px: DataFrame, k: int, length: int, width: int) -> DataFrame:
    """(image_id, bits): the first ``length`` bits as text of 0 and 1. Pixels beyond them are filtered before anything else."""
    if not 1 <= k <= 8:
        raise ValueError("k must be 1 to 8")
    slot = F.col("r").cast("long") * width + F.col("c")
    got = px.where(slot * k < length).select("image_id", slot.alias("slot"), "v", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    got = got.select("image_id", (F.col("slot") * k + F.col("i")).alias("pos"), F.getbit("v", F.lit(k - 1) - F.col("i")).cast("int").alias("bit")).where(F.col("pos") < length)
    return got.groupBy("image_id").agg(_joined().alias("bits"))


def _joined() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "bit"))), lambda x: x["bit"].cast("string")), "")


# gray, two bits a pixel behind a length header


def _headed(px: DataFrame, slots: DataFrame, bits: DataFrame, width: int) -> DataFrame:
    """Writes the header into the first 32 pixels and two bits into each pixel of ``slots`` (image_id, r, c, slot)."""
    n = bits.count()
    head = sum(F.when(F.col("flat") == i, n >> i & 1).otherwise(0) for i in range(HEADER))
    chunks, _ = _bits(_chunks(bits, 2, False))
    got = px.withColumn("flat", F.col("r").cast("long") * width + F.col("c")).join(slots.join(chunks, "slot"), ["image_id", "r", "c"], "left")
    v = F.col("v")
    return got.select("image_id", "r", "c", F.when(F.col("flat") < HEADER, v.bitwiseAND(0xFE).bitwiseOR(head)).when(F.col("chunk").isNotNull(), v.bitwiseAND(0xFC).bitwiseOR(F.col("chunk"))).otherwise(v).alias("v"))


def _fixed_slots(px: DataFrame, width: int) -> DataFrame:
    flat = F.col("r").cast("long") * width + F.col("c")
    return px.where(flat >= HEADER).select("image_id", "r", "c", (flat - HEADER).alias("slot"))


def _adaptive_slots(cover: DataFrame, width: int, side: int, limit: float) -> DataFrame:
    """Pixels of blocks whose variance reaches the limit, numbered block by block and inside a block row by row; not those of the header."""
    rough = block_variance(cover, side).where(F.col("variance") >= limit).select("image_id", "br", "bc")
    px = cover.select("image_id", "r", "c", F.expr(f"cast(r div {side} as int)").alias("br"), F.expr(f"cast(c div {side} as int)").alias("bc")).join(rough, ["image_id", "br", "bc"])
    px = px.where(F.col("r").cast("long") * width + F.col("c") >= HEADER)
    return number_in_order(px, ["image_id"], "br", ["bc", "r", "c"], "slot").select("image_id", "r", "c", "slot")


def _slot_room(px: DataFrame, slots: DataFrame) -> DataFrame:
    counts = slots.groupBy("image_id").agg((F.count("*") * 2).alias("n"))
    return px.select("image_id").distinct().join(counts, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).alias("n"))


def room_fixed2(px: DataFrame, width: int) -> DataFrame:
    """(image_id, n): bits that embed_fixed2 can take."""
    return _slot_room(px, _fixed_slots(px, width))


def room_adaptive2(px: DataFrame, width: int, side: int = 8, limit: float = 30.0) -> DataFrame:
    return _slot_room(px, _adaptive_slots(px, width, side, limit))


def embed_fixed2(px: DataFrame, bits: DataFrame, width: int, overflow: str = "error") -> DataFrame:
    """The message's length in the first 32 pixels, then two bits a pixel. overflow: 'error' refuses a message that doesn't fit, 'cut' embeds
    what fits behind the whole length; ``bits_embedded`` tells how much that is."""
    _fits(room_fixed2(px, width), bits, overflow)
    return _headed(px, _fixed_slots(px, width), bits, width)


def embed_adaptive2(px: DataFrame, bits: DataFrame, width: int, side: int = 8, limit: float = 30.0, overflow: str = "error") -> DataFrame:
    """As embed_fixed2, in rough blocks only."""
    _fits(room_adaptive2(px, width, side, limit), bits, overflow)
    return _headed(px, _adaptive_slots(px, width, side, limit), bits, width)


def _extract2(px: DataFrame, slots: DataFrame, width: int) -> DataFrame:
    flat = F.col("r").cast("long") * width + F.col("c")
    n = px.where(flat < HEADER).groupBy("image_id").agg(F.sum(F.col("v").bitwiseAND(1) * power2(flat.cast("int"))).alias("n"))
    got = px.join(slots, ["image_id", "r", "c"]).join(n, "image_id").where("slot * 2 < n")
    got = got.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).select("image_id", "n", (F.col("slot") * 2 + F.col("i")).alias("pos"), F.getbit("v", F.col("i")).cast("int").alias("bit"))
    return got.where("pos < n").groupBy("image_id").agg(_joined().alias("bits"))


def extract_fixed2(px: DataFrame, width: int) -> DataFrame:
    """(image_id, bits) of the length in the header."""
    return _extract2(px, _fixed_slots(px, width), width)


def extract_adaptive2(stego: DataFrame, cover: DataFrame, width: int, side: int = 8, limit: float = 30.0) -> DataFrame:
    """As extract_fixed2; which blocks are rough is told by the cover."""
    return _extract2(stego, _adaptive_slots(cover, width, side, limit), width)


# cosine coefficients


def _zigzag() -> Column:
    """The number of a coefficient's place among the ten, else null."""
    out = F.lit(None).cast("int")
    for k, (i, j) in reversed(list(enumerate(ZIGZAG))):
        out = F.when((F.col("r") % 8 == i) & (F.col("c") % 8 == j), k).otherwise(out)
    return out


def _block_number(coef: DataFrame) -> DataFrame:
    """coef with the number of its block in row-major order of whole blocks."""
    return coef.join(sizes(coef).select("image_id", F.expr("w div 8").alias("_bw")), "image_id").withColumn("block", F.expr("(r div 8) * _bw + c div 8")).drop("_bw")


def room_blocks(px: DataFrame, per_block: int) -> DataFrame:
    """(image_id, n): bits that whole 8 x 8 blocks can take."""
    return sizes(px).select("image_id", F.expr(f"cast((h div 8) * (w div 8) * {per_block} as long)").alias("n"))


def embed_dct10(coef: DataFrame, bits: DataFrame, overflow: str = "error") -> DataFrame:
    """Ten bits a block in the low bits of rounded coefficients; works on coefficients and returns them. overflow as in embed_fixed2."""
    _fits(room_blocks(coef, 10), bits, overflow)
    bits, _ = _bits(bits)
    got = _block_number(coef).withColumn("pos", F.col("block") * 10 + _zigzag()).join(bits, "pos", "left")
    whole = transforms.snapped(F.col("v")).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("bit"))
    return got.select("image_id", "r", "c", F.when(F.col("bit").isNull(), F.col("v")).otherwise(whole.cast("double")).alias("v"))


def dct10_bits(coef: DataFrame) -> DataFrame:
    """(image_id, pos, bit) of coefficients in embedding order."""
    got = _block_number(coef).withColumn("z", _zigzag()).where("z is not null")
    return got.select("image_id", (F.col("block") * 10 + F.col("z")).alias("pos"), transforms.snapped(F.col("v")).bitwiseAND(1).alias("bit"))


def extract_dct10(coef: DataFrame) -> DataFrame:
    return text_from_bits(dct10_bits(coef), ["image_id"])


def embed_parity(coef: DataFrame, bits: DataFrame, u: int = 4, v: int = 1, step: float = 4.0, overflow: str = "error") -> DataFrame:
    """One bit a block as the parity of the rounded coefficient (u, v): kept if it fits, else moved by the step up or down if that fits, else
    set to 5 for a one or -6 for a zero. Column ``way`` tells which. overflow as in embed_fixed2."""
    _fits(room_blocks(coef, 1), bits, overflow)
    bits, _ = _bits(bits)
    here = (F.col("r") % 8 == u) & (F.col("c") % 8 == v)
    got = _block_number(coef).withColumn("pos", F.when(here, F.col("block"))).join(bits, "pos", "left")
    parity = lambda x: F.abs(transforms.snapped(x)) % 2
    x, bit = F.col("v"), F.col("bit")
    way = F.when(bit.isNull(), "none").when(parity(x) == bit, "keep").when(parity(x + step) == bit, "add").when(parity(x - step) == bit, "sub").otherwise("set")
    to = F.when(F.col("way").isin("none", "keep"), x).when(F.col("way") == "add", x + step).when(F.col("way") == "sub", x - step).otherwise(F.when(bit == 1, 5.0).otherwise(-6.0))
    return got.withColumn("way", way).select("image_id", "r", "c", to.alias("v"), "way")


def parity_bits(coef: DataFrame, u: int = 4, v: int = 1) -> DataFrame:
    """(image_id, pos, bit), a bit a block."""
    got = _block_number(coef).where((F.col("r") % 8 == u) & (F.col("c") % 8 == v))
    return got.select("image_id", F.col("block").alias("pos"), (F.abs(transforms.snapped(F.col("v"))) % 2).alias("bit"))


# histogram shift


def embed_shift(px: DataFrame, bits: DataFrame, saturation: str = "error", top: int | None = 254) -> DataFrame:
    """(image_id, r, c, v, peak): values above the peak go up by one, and the i-th pixel at the peak takes bit i. A value of 255 has no room
    above: ``saturation`` 'error' refuses it, 'wrap' lets it become 0, 'skip' leaves it. top=None looks for the peak among all ints."""
    if saturation not in ("error", "wrap", "skip"):
        raise ValueError(saturation)
    bits, n = _bits(bits)
    p = peak(px, top)
    about = p.agg(F.min("n")).first()[0]
    if about is not None and about < n:
        raise CapacityError(f"{n} bits don't fit into {about}")
    if saturation == "error" and top is not None and not px.where("v >= 255").isEmpty():
        raise ValueError("a pixel of 255 can't be shifted")
    got = px.join(p.select("image_id", "peak"), "image_id")
    at_peak = number_in_order(got.where("v = peak"), ["image_id"], "r", ["c"], "pos").join(bits, "pos", "left").select("image_id", "r", "c", F.coalesce("bit", F.lit(0)).alias("add"), "peak", "v")
    above = F.when(F.col("v") > F.col("peak"), 1).otherwise(0)
    rest = got.where("v <> peak").select("image_id", "r", "c", above.alias("add"), "peak", "v")
    moved = F.col("v") + F.col("add")
    if top is not None:
        moved = F.when(moved > 255, F.lit(0) if saturation == "wrap" else F.lit(255)).otherwise(moved)
    return rest.unionByName(at_peak).select("image_id", "r", "c", moved.alias("v"), "peak")


def shift_bits(px: DataFrame) -> DataFrame:
    """(image_id, pos, bit) of a table with the peak, in embedding order."""
    carriers = px.where("v = peak or v = peak + 1")
    return number_in_order(carriers, ["image_id"], "r", ["c"], "pos").select("image_id", "pos", (F.col("v") - F.col("peak")).alias("bit"))


def restore_shift(px: DataFrame) -> DataFrame:
    return px.select("image_id", "r", "c", F.when(F.col("v") > F.col("peak"), F.col("v") - 1).otherwise(F.col("v")).alias("v"))


def extract_shift(px: DataFrame) -> DataFrame:
    """(image_id, message)."""
    return text_from_bits(shift_bits(px), ["image_id"])


def _split_hh(coef: DataFrame) -> tuple[DataFrame, DataFrame]:
    got = coef.join(sizes(coef).withColumnsRenamed({"h": "_h", "w": "_w"}), "image_id")
    inside = (F.col("r") >= F.expr("_h div 2")) & (F.col("c") >= F.expr("_w div 2"))
    return got.where(inside).drop("_h", "_w"), got.where(~inside).drop("_h", "_w")


def embed_shift_hh(coef: DataFrame, bits: DataFrame) -> DataFrame:
    """Histogram shift in the high-high quadrant of an integer Haar raster; coefficients in, coefficients out, with the peak of the
    quadrant (null elsewhere)."""
    hh, rest = _split_hh(coef)
    return embed_shift(hh, bits, top=None).unionByName(rest.select("image_id", "r", "c", "v", F.lit(None).cast("int").alias("peak")))


def extract_shift_hh(coef: DataFrame) -> DataFrame:
    return extract_shift(coef.where("peak is not null"))


def restore_shift_hh(coef: DataFrame) -> DataFrame:
    return coef.select("image_id", "r", "c", F.when(F.col("v") > F.col("peak"), F.col("v") - 1).otherwise(F.col("v")).alias("v"))
