"""The registered queries: each operator over its whole fixture, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import morse
from ..operators import compress, crypto, filters, geometry, hiding, metrics, transforms
from ..sources import rasters as R
from ..streaming import files as streams
from . import sql as S

MESSAGE, KEY, WIDTH = "Hello, World!", "key", 64
BITS16, BITS8 = "0010111011110001", "00101110"
CODEWORDS = 16

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(name: str, digits: int = 6):
    """A double rounded for comparison, without negative zero."""
    return (F.round(name, digits) + 0.0).alias(name)


def _message(spark: SparkSession) -> DataFrame:
    return B.message_bits(spark, MESSAGE)


# sources, size and order


@query(S.TALL + "select r, c, v from tall")
def raster_tall(spark, d):
    return R.tall(spark, d).select("r", "c", "v")


@query(S.COLOR + "select r, c, ch, v from color")
def raster_color(spark, d):
    return R.color(spark, d).select("r", "c", "ch", "v")


@query(S.crop("tall", 7))
def crop_multiple(spark, d):
    return geometry.crop_multiple(R.tall(spark, d), 7)


@query(S.crop("tall", 2))
def crop_even(spark, d):
    return geometry.crop_even(R.tall(spark, d))


@query(S.PAD)
def pad_replicate(spark, d):
    return geometry.pad_replicate(R.tall(spark, d), 24)


@query(S.BLOCKS)
def block_vectors(spark, d):
    return geometry.blocks(R.tile(spark, d), 4).select("image_id", "br", "bc", F.array_join("vec", ",").alias("vec"))


@query(S.RESIZE)
def resize_bilinear(spark, d):
    return geometry.resize_bilinear(R.tile(spark, d), 5, 11)


@query(S.RESIZE_LEVELS)
def resize_to_levels(spark, d):
    return geometry.resize_to_levels(R.tall(spark, d), 3)


@query(S.HAAR_PICTURE)
def haar_picture(spark, d):
    return transforms.haar_picture(R.tile(spark, d), 3)


@query(S.CODEBOOK_PICTURE)
def codebook_picture(spark, d):
    book = spark.createDataFrame(list(enumerate(_codebook(spark, d)[:13])), "k int, cw array<double>")
    return compress.codebook_picture(book, 13, 4)


@query(S.MOSAIC)
def bit_plane_mosaic(spark, d):
    planes = transforms.bit_planes(R.tile(spark, d)).withColumn("k", F.col("plane") - 1)
    return geometry.mosaic(planes, "k", 4, 8, 8)


@query("select cast(i // 100 as integer) as r, cast(i % 100 as integer) as c, case when i % 100 between 25 and 74 and i // 100 between 12 and 36 then 0 else 255 end as v from range(5000) t(i)")
def raster_rect(spark, d):
    return R.rect(spark).select("r", "c", "v")


@query(S.TALL + ", b as (select r // 4 as br, c // 4 as bc, string_agg(cast(v as varchar), ',' order by r, c) as vec from tall where r < (select (max(r) + 1) // 4 * 4 from tall) group by r // 4, c // 4) select vec from b")
def training_blocks(spark, d):
    return R.training_blocks(R.tall(spark, d), 4).select(F.array_join(F.transform("vec", lambda x: x.cast("int")), ",").alias("vec"))


@query(f"select i as vec_id, cast(k as integer) as d, ({S.md5_int('1', 'i', 'k')} + 1) / 268435456.0::double as x from range(256) a(i), range(3) b(k)")
def random_vectors(spark, d):
    return R.random_vectors(spark, 256, 3, 1).select("vec_id", F.posexplode("vec").alias("d", "x"))


@query(S.TILE + "select image_id, r, c, cast(0 as integer) as ch, v from tile")
def png_roundtrip(spark, d):
    """Pictures written as PNG and read again."""
    return R.from_png(R.to_png(R.tile(spark, d)))


@query(S.COLOR + "select cast(0 as bigint) as image_id, r, c, ch, v from color")
def png_color_roundtrip(spark, d):
    return R.from_png(R.to_png(R.color(spark, d)))


# spatial filters


@query(S.SHARPEN)
def sharpen(spark, d):
    return filters.sharpen(R.tall(spark, d))


@query(S.GAUSS)
def gaussian5(spark, d):
    return filters.gaussian5(R.tall(spark, d))


@query(S.GAUSS11)
def gaussian11(spark, d):
    return filters.gaussian11(R.tall(spark, d))


@query(S.BLUR_SHARPEN)
def blur_sharpen(spark, d):
    return filters.sharpen(filters.gaussian5(R.tall(spark, d)))


@query(S.NORMALISE)
def minmax_normalize(spark, d):
    return filters.normalise(R.tile(spark, d))


@query(S.TILE + "select image_id, r, c, case when v > 128 then 255 else 0 end as v from tile")
def threshold(spark, d):
    return filters.threshold(R.tile(spark, d))


@query(S.COLOR + "select cast(0 as bigint) as image_id, r, c, cast((sum(v * case ch when 0 then 114 when 1 then 587 else 299 end) + 500) // 1000 as integer) as v from color group by r, c")
def gray(spark, d):
    return filters.to_gray(R.color(spark, d))


@query(S.EDGES)
def edge_map(spark, d):
    return filters.edges(R.tall(spark, d))


@query(S.PLATES)
def plate_boxes(spark, d):
    return filters.plate_boxes(R.plate_scene(spark))


# transforms


@query(S.TILE + "select image_id, r, c, cast(p as integer) as plane, cast(((v >> (p - 1)) & 1) * 255 as integer) as v from tile, range(1, 9) t(p)")
def bit_planes(spark, d):
    return transforms.bit_planes(R.tile(spark, d))


@query(S.HAAR_ORTHO)
def haar_ortho(spark, d):
    return transforms.haar_ortho(R.tile(spark, d)).select("image_id", "r", "c", _r("v"))


@query(S.TILE + "select image_id, r, c, cast(v as double) as v from tile")
def haar_ortho_inverse(spark, d):
    return transforms.haar_ortho_inverse(transforms.haar_ortho(R.tile(spark, d))).select("image_id", "r", "c", _r("v"))


@query(S.haar_average(1))
def haar_avg_l1(spark, d):
    return transforms.haar_average(R.tile(spark, d), 1)


@query(S.haar_average(3))
def haar_avg_l3(spark, d):
    return transforms.haar_average(R.tile(spark, d), 3)


@query(S.IWT)
def iwt(spark, d):
    return transforms.integer_haar(R.tile(spark, d))


@query(S.TILE + "select image_id, r, c, v from tile")
def iwt_inverse(spark, d):
    return transforms.integer_haar_inverse(transforms.integer_haar(R.tile(spark, d)))


@query(S.BASIS)
def dct_basis(spark, d):
    return transforms.dct_basis(spark).select("r", "c", _r("v"))


@query(S.DCT + "select image_id, r, c, round(v, 6) + 0.0 as v from dct")
def dct8(spark, d):
    return transforms.dct8(R.tile(spark, d)).select("image_id", "r", "c", _r("v"))


@query(S.TILE + "select image_id, r, c, cast(v as double) as v from tile")
def idct8_roundtrip(spark, d):
    return transforms.idct8(transforms.dct8(R.tile(spark, d))).select("image_id", "r", "c", _r("v"))


@query(S.DITHER)
def floyd_steinberg(spark, d):
    return transforms.floyd_steinberg(R.tile(spark, d).unionByName(R.rect(spark).withColumn("image_id", F.lit(-1).cast("long"))))


# compression


@query(S.RLE)
def rle_raster(spark, d):
    return compress.raster_runs(R.tall(spark, d), WIDTH)


@query("select cast(0 as bigint) as image_id, cast(65536 as bigint) as n_pixels, cast(256 as bigint) as n_runs, cast(51.2 as double) as ratio")
def rle_stripes_ratio(spark, d):
    return compress.run_length_ratio(R.stripes(spark), 256)


@query(S.RLE_EVENTS)
def rle_events(spark, d):
    return compress.run_lengths(R._table(spark, d, "events"), [], "event_id", "event_type")


def _codebook(spark: SparkSession, d: str) -> list[list[float]]:
    """The blocks of the first tiles: CODEWORDS rows, whatever the input."""
    return [r["vec"] for r in R.vq16(spark, d).where(f"vec_id < {CODEWORDS}").orderBy("vec_id").limit(CODEWORDS).collect()]


@query(S.VQ + "select vec_id, k, d2 from coded")
def vq_encode(spark, d):
    return compress.vq_encode(R.vq16(spark, d), _codebook(spark, d)).select("vec_id", "k", "d2")


@query(S.VQ + "select c.vec_id, c.k, w.cw from coded c join (select vec_id as k, string_agg(cast(cast(x as integer) as varchar), ',' order by i) as cw from vq where vec_id < 16 group by vec_id) w on c.k = w.k")
def vq_decode(spark, d):
    book = _codebook(spark, d)
    got = compress.vq_decode(compress.vq_encode(R.vq16(spark, d), book), book)
    return got.select("vec_id", "k", F.array_join(F.transform("cw", lambda x: x.cast("int")), ",").alias("cw"))


@query(S.VQ + "select round(avg(d2), 6) as distortion, count(*) as n from coded")
def vq_distortion(spark, d):
    return compress.vq_encode(R.vq16(spark, d), _codebook(spark, d)).agg(F.round(F.avg("d2"), 6).alias("distortion"), F.count("*").alias("n"))


@query(S.VQ + "select c.k, cast(v.i as integer) as d, round(avg(v.x), 6) as x from coded c join vq v using (vec_id) group by c.k, v.i")
def lbg_one_iteration(spark, d):
    return compress.centroids(compress.vq_encode(R.vq16(spark, d), _codebook(spark, d))).select("k", "d", _r("x"))


@query()
def lbg_train(spark, d):
    book, _ = compress.lbg_train(R.vq16(spark, d), 128)
    return spark.createDataFrame([(k, i, round(float(x), 6)) for k, w in enumerate(book) for i, x in enumerate(w)], "k int, d int, x double")


@query(S.LBG_STAGES)
def lbg_stages(spark, d):
    """Seven doublings to 128 codewords with one of Lloyd's steps each."""
    book, _ = compress.lbg_train(R.vq16(spark, d), 128, rounds=1)
    return spark.createDataFrame([(k, i, round(float(x), 6)) for k, w in enumerate(book) for i, x in enumerate(w)], "k int, d int, x double")


@query(S.VQ + "select cast(16 as integer) as codebook_size, cast(16 as integer) as dim, cast(4 as integer) as block_size, cast(sum(x) as double) as total from vq where vec_id < 16")
def codebook_file(spark, d):
    """The summary of a codebook as it is written to a file."""
    book = spark.createDataFrame(list(enumerate(_codebook(spark, d))), "k int, cw array<double>")
    return R.codebook_table(book, 4).select("codebook_size", "dim", "block_size", F.aggregate(F.flatten("codewords"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(S.BYTES + "select b, count(*) as n from bytes group by b")
def byte_freq(spark, d):
    return compress.byte_frequencies(R.text_bytes(spark, d), [])


_TEXT = ["conv_id", "turn"]


@query(S.HUFFMAN)
def huffman_bits(spark, d):
    return compress.huffman_size(compress.huffman_table(compress.byte_frequencies(R.text_bytes(spark, d), _TEXT), _TEXT), _TEXT)


@query("select conv_id, turn, octet_length(encode(coalesce(text, ''))) as n_bytes, true as same from conversations")
def huffman_roundtrip(spark, d):
    data = R.text_bytes(spark, d)
    codes = compress.huffman_table(compress.byte_frequencies(data, _TEXT), _TEXT)
    got = compress.huffman_decode(compress.huffman_encode(data, codes, _TEXT), codes, _TEXT)
    texts = R._table(spark, d, "conversations").select(*_TEXT, F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw"))
    content = F.coalesce("content", F.lit("").cast("binary"))  # an empty text has no code
    return texts.join(got, _TEXT, "left").select(*_TEXT, F.octet_length("raw").cast("long").alias("n_bytes"), (F.col("raw") == content).alias("same"))


# bits


@query(S.BYTES + "select c.conv_id, c.turn, coalesce(string_agg(cast((b >> (7 - k)) & 1 as varchar), '' order by pos, k), '') as bits from conversations c left join (select * from bytes, range(8) t(k)) x on x.conv_id = c.conv_id and x.turn = c.turn group by c.conv_id, c.turn")
def bits_msb(spark, d):
    return R._table(spark, d, "conversations").select(*_TEXT, F.array_join(B.bits_msb(F.encode(F.coalesce("text", F.lit("")), "utf-8"), False), "").alias("bits"))


@query(S.BYTES + "select c.conv_id, c.turn, coalesce(string_agg(cast((b >> k) & 1 as varchar), '' order by pos, k), '') as bits from conversations c left join (select * from bytes, range(8) t(k)) x on x.conv_id = c.conv_id and x.turn = c.turn group by c.conv_id, c.turn")
def bits_lsb(spark, d):
    return R._table(spark, d, "conversations").select(*_TEXT, F.array_join(B.bits_lsb(F.encode(F.coalesce("text", F.lit("")), "utf-8")), "").alias("bits"))


@query("select conv_id, turn, coalesce(text, '') as message from conversations")
def bits_to_text(spark, d):
    texts = R._table(spark, d, "conversations")
    bits = texts.select(*_TEXT, F.posexplode(B.bits_msb(F.encode("text", "utf-8"))).alias("pos", "bit"))
    return texts.select(*_TEXT).join(B.text_from_bits(bits, _TEXT), _TEXT, "left").select(*_TEXT, F.coalesce("message", F.lit("")).alias("message"))


# hiding in pixels


@query(S.BGR_EMBED)
def lsb_bgr_embed(spark, d):
    return hiding.embed_color(R.color(spark, d), _message(spark), WIDTH).drop("image_id")


@query(f"select cast(0 as bigint) as image_id, '{MESSAGE}' as message")
def lsb_bgr_extract(spark, d):
    return hiding.extract_color(hiding.embed_color(R.color(spark, d), _message(spark), WIDTH), WIDTH)


def _lsb(k: int):
    def embed(spark, d):
        return hiding.embed_lsb(R.tile(spark, d), B.bit_table(spark, BITS16), k, 8)

    def extract(spark, d):
        return hiding.extract_lsb(embed(spark, d), k, len(BITS16), 8)

    def fidelity(spark, d):
        got = metrics.psnr(R.tile(spark, d), embed(spark, d))
        return got.select("image_id", _r("mse"), _r("psnr"))

    embed.__name__, extract.__name__, fidelity.__name__ = f"lsb_k{k}_embed", f"lsb_k{k}_extract", f"psnr_lsb_k{k}"
    query(S.lsb_k(k, BITS16))(embed)
    query(S.TILE + f"select distinct image_id, '{BITS16}' as bits from tile")(extract)
    query(S.psnr_lsb_k(k, BITS16))(fidelity)


for _k in (1, 2, 3):
    _lsb(_k)


@query(S.FIXED2)
def lsb_fixed2_embed(spark, d):
    return hiding.embed_fixed2(R.tile(spark, d), B.message_bits(spark, "Hi!", "lsb"), 8)


@query(S.TILE + "select distinct image_id, '000100101001011010000100' as bits from tile")
def lsb_fixed2_extract(spark, d):
    return hiding.extract_fixed2(lsb_fixed2_embed(spark, d), 8)


@query(S.ADAPTIVE)
def lsb_adaptive_embed(spark, d):
    return hiding.embed_adaptive2(R.mixed(spark, d), B.message_bits(spark, "Hi!", "lsb"), 8, overflow="cut")


@query(S.TILE + "select distinct image_id, '000100101001011010000100' as bits from tile where image_id % 2 = 1")
def lsb_adaptive_extract(spark, d):
    return hiding.extract_adaptive2(lsb_adaptive_embed(spark, d), R.mixed(spark, d), 8)


# hiding in coefficients


@query(S.DCT10)
def dct_lsb10_embed(spark, d):
    return hiding.embed_dct10(transforms.dct8(R.tile(spark, d)), B.bit_table(spark, BITS8)).select("image_id", "r", "c", _r("v"))


@query(S.DCT + S.ZIGZAG + f"select image_id, cast(k as integer) as pos, case when k < 8 then cast(substr('{BITS8}', cast(k as integer) + 1, 1) as integer) else cast(round(round(v, 6)) as integer) & 1 end as bit from dct join zz using (r, c)")
def dct_lsb10_extract(spark, d):
    stego = hiding.embed_dct10(transforms.dct8(R.tile(spark, d)), B.bit_table(spark, BITS8))
    got = hiding.dct10_bits(transforms.dct8(transforms.idct8(stego)))
    return got.select("image_id", F.col("pos").cast("int").alias("pos"), "bit")


@query(S.PARITY)
def dct_parity_embed(spark, d):
    coef = geometry.mosaic(transforms.dct8(R.tile(spark, d)).withColumn("k", F.col("image_id") % 8).withColumn("image_id", F.expr("image_id div 8")), "k", 4, 8, 8)
    return hiding.embed_parity(coef, B.bit_table(spark, BITS8), overflow="cut").select("image_id", "r", "c", _r("v"), "way")


@query(S.TILE + f"select image_id // 8 as image_id, cast(image_id % 8 as bigint) as pos, cast(substr('{BITS8}', cast(image_id % 8 as integer) + 1, 1) as integer) as bit from tile where r = 4 and c = 1")
def dct_parity_extract(spark, d):
    px = geometry.mosaic(R.tile(spark, d).withColumn("k", F.col("image_id") % 8).withColumn("image_id", F.expr("image_id div 8")), "k", 4, 8, 8)
    stego = transforms.idct8(hiding.embed_parity(transforms.dct8(px), B.bit_table(spark, BITS8), overflow="cut").drop("way"))
    return hiding.parity_bits(transforms.dct8(stego))


# histogram shift


@query(S.SHIFT + "select cast(0 as bigint) as image_id, r, c, v, peak from shifted")
def hs_embed(spark, d):
    return hiding.embed_shift(R.tall(spark, d), _message(spark))


def _report(cover: DataFrame, stego: DataFrame, restored: DataFrame, message: DataFrame) -> DataFrame:
    same = metrics.compare(cover, restored).select("image_id", (F.col("n_different") == 0).alias("restored_ok"))
    held = metrics.peak(cover, 254).select("image_id", "peak", F.col("n").alias("capacity"))
    return held.join(message, "image_id").join(same, "image_id").select("image_id", "peak", "capacity", F.lit(8 * (len(MESSAGE) + 1)).alias("bits_embedded"), (F.col("message") == MESSAGE).alias("message_ok"), "restored_ok")


@query(S.REPORT)
def hs_extract_restore(spark, d):
    cover = R.tall(spark, d)
    stego = hiding.embed_shift(cover, _message(spark))
    return _report(cover, stego, hiding.restore_shift(stego), hiding.extract_shift(stego))


@query(S.REPORT)
def hs_encrypted_pipeline(spark, d):
    """Embed, encrypt, decrypt, extract, restore."""
    cover = R.tall(spark, d)
    stego = hiding.embed_shift(cover, _message(spark))
    opened = crypto.xor_stream(crypto.xor_stream(stego, KEY, WIDTH), KEY, WIDTH)
    return _report(cover, opened, hiding.restore_shift(opened), hiding.extract_shift(opened))


@query(S.SHIFT_HH)
def hs_hh_embed(spark, d):
    return hiding.embed_shift_hh(transforms.integer_haar(R.tall(spark, d)), _message(spark))


@query(f"select cast(0 as bigint) as image_id, '{MESSAGE}' as message, cast(0 as bigint) as n_different")
def hs_hh_extract_restore(spark, d):
    cover = R.tall(spark, d)
    stego = hiding.embed_shift_hh(transforms.integer_haar(cover), _message(spark))
    back = transforms.integer_haar_inverse(hiding.restore_shift_hh(stego))
    return hiding.extract_shift_hh(stego).join(metrics.compare(cover, back).select("image_id", "n_different"), "image_id")


# ciphers and sharing


@query(S.COLOR + "select r, c, ch, xor(v, 127) as v from color")
def xor_cipher(spark, d):
    return crypto.xor_constant(R.color(spark, d)).select("r", "c", "ch", "v")


@query(S.TILE + "select image_id, r, c, v from tile")
def mersenne_cipher_roundtrip(spark, d):
    return crypto.xor_mersenne(crypto.xor_mersenne(R.tile(spark, d), 314159), 314159)


@query(S.TALL + f"select cast(0 as bigint) as image_id, r, c, cast(xor(v, {S.md5_int(KEY, 'r * 64 + c')} % 256) as integer) as v from tall")
def stream_cipher(spark, d):
    return crypto.xor_stream(R.tall(spark, d), KEY, WIDTH)


@query(S.SHAMIR)
def shamir_split(spark, d):
    return crypto.shamir_split(R.secrets(spark, d), KEY)


@query("select o_orderkey as secret_id, o_custkey as secret from orders")
def shamir_recover(spark, d):
    return crypto.shamir_recover(crypto.shamir_split(R.secrets(spark, d), KEY))


@query("select o_orderkey, cast(1 as bigint) as product from orders where o_orderkey % 2147483647 <> 0")
def modular_inverse(spark, d):
    x = F.col("o_orderkey")
    return R._table(spark, d, "orders").where(x % crypto.PRIME != 0).select(x, (crypto.mod_inverse(x) * (x % crypto.PRIME) % crypto.PRIME).alias("product"))


@query("select a.vec_id, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) + 0.0 as distance from (select vec_id, unnest(range(64)) as i, cast(unnest(embedding) as double) as x from embeddings) a join (select vec_id, unnest(range(64)) as i, cast(unnest(embedding) as double) as x from embeddings) b on b.vec_id = a.vec_id + 1 and a.i = b.i group by a.vec_id")
def vector_distance(spark, d):
    v = R._table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    later = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("other"))
    return v.join(later, "vec_id").select("vec_id", F.round(compress.distance(F.col("vec"), F.col("other")), 6).alias("distance"))


@query(S.VC22 + "select cast(0 as bigint) as image_id, share_id, r, c, v from shares")
def vc22_shares(spark, d):
    return crypto.visual_2_of_2(R.rect(spark), KEY)


@query(S.VC22 + "select cast(0 as bigint) as image_id, r, c, min(v) as v from shares group by r, c")
def vc22_overlay(spark, d):
    return crypto.overlay(crypto.visual_2_of_2(R.rect(spark), KEY), 1, 2)


@query(S.VC24 + "select cast(0 as bigint) as image_id, share_id, r, c, v from shares")
def vc24_shares(spark, d):
    return crypto.visual_2_of_4(R.rect(spark), KEY)


@query(S.VC24 + "select cast(0 as bigint) as image_id, r, c, min(v) as v from shares where share_id in (2, 3) group by r, c")
def vc24_overlay(spark, d):
    return crypto.overlay(crypto.visual_2_of_4(R.rect(spark), KEY), 2, 3)


# metrics


@query(S.TILE + "select image_id, v, count(*) as n from tile group by image_id, v")
def histogram_sparse(spark, d):
    return metrics.histogram(R.tile(spark, d))


@query(S.TALL + "select cast(0 as bigint) as image_id, cast(k as integer) as v, count(t.v) as n from range(256) g(k) left join tall t on t.v = g.k group by k")
def histogram_dense(spark, d):
    return metrics.histogram_dense(R.tall(spark, d))


@query(S.TILE + "select image_id, v as peak, n from (select image_id, v, n, row_number() over (partition by image_id order by n desc, v) as k from (select image_id, v, count(*) as n from tile group by image_id, v)) where k = 1")
def peak_bin(spark, d):
    return metrics.peak(R.tile(spark, d))


@query(S.MIXED + "select image_id, cast(r // 8 as integer) as br, cast(c // 8 as integer) as bc, round(var_pop(v), 6) as variance from mixed group by all")
def block_variance(spark, d):
    return metrics.block_variance(R.mixed(spark, d)).select("image_id", "br", "bc", _r("variance"))


@query(S.SSIM)
def ssim_block(spark, d):
    return metrics.ssim_block(R.tall(spark, d), filters.gaussian5(R.tall(spark, d))).select("image_id", _r("ssim"))


@query(S.SSIM_GAUSS)
def ssim_gaussian(spark, d):
    px = R.tile(spark, d)
    return metrics.ssim(px, px.withColumn("v", F.col("v").bitwiseAND(252))).select("image_id", _r("ssim"))


@query(S.COMPARISON)
def adaptive_vs_fixed(spark, d):
    """Both ways of embedding two bits a pixel, side by side."""
    cover, bits = R.mixed(spark, d), B.message_bits(spark, "Hi!", "lsb")
    out = None
    for name, stego in (("fixed", hiding.embed_fixed2(cover, bits, 8)), ("adaptive", hiding.embed_adaptive2(cover, bits, 8, overflow="cut"))):
        got = metrics.psnr(cover, stego).join(metrics.compare(cover, stego), "image_id").select(F.lit(name).alias("method"), "image_id", _r("mse"), F.col("n_different").alias("n_changed"))
        out = got if out is None else out.unionByName(got)
    return out


@query(S.TALL + "select cast(0 as bigint) as image_id, count(*) * 2 as lsb_bits, cast((max(r) + 1) // 8 * ((max(c) + 1) // 8) as bigint) as dct_parity_bits, cast((max(r) + 1) // 8 * ((max(c) + 1) // 8) * 10 as bigint) as dct_lsb_bits, (select max(n) from (select count(*) as n from tall where v <= 254 group by v)) as shift_bits from tall")
def embedding_capacity(spark, d):
    return metrics.capacity(R.tall(spark, d), 2)


@query(S.MIXED + "select image_id, cast(24 as bigint) as n_bits, case when var_pop(v) >= 30 then cast(24 as bigint) else cast(0 as bigint) end as n_embedded from mixed group by image_id")
def adaptive_bits_embedded(spark, d):
    """What of a message of 24 bits fits into the rough blocks of each picture."""
    return hiding.bits_embedded(hiding.room_adaptive2(R.mixed(spark, d), 8), 24)


@query(S.TILE + "select image_id // 8 as image_id, cast(8 as bigint) as n_bits, count(distinct image_id) as n_embedded from tile group by image_id // 8")
def parity_bits_embedded(spark, d):
    px = geometry.mosaic(R.tile(spark, d).withColumn("k", F.col("image_id") % 8).withColumn("image_id", F.expr("image_id div 8")), "k", 8, 8, 8)
    return hiding.bits_embedded(hiding.room_blocks(px, 1), 8)


@query(S.TALL + "select cast(0 as bigint) as image_id, round(112.0 / count(*), 9) as bpp from tall")
def embedding_rate(spark, d):
    return metrics.rate(R.tall(spark, d), 112).select("image_id", F.round("bpp", 9).alias("bpp"))


@query(S.MIXED + "select t.image_id, count(*) filter (where t.v <> m.v) as n_different, max(abs(t.v - m.v)) as max_diff from tile t join mixed m using (image_id, r, c) group by t.image_id")
def image_compare(spark, d):
    return metrics.compare(R.tile(spark, d), R.mixed(spark, d))


# text


@query(S.MORSE)
def morse_encode(spark, d):
    return R._table(spark, d, "conversations").select(*_TEXT, morse.encode(F.col("text")).alias("morse"))


@query(S.MORSE_DECODE)
def morse_decode(spark, d):
    return R._table(spark, d, "conversations").select(*_TEXT, morse.decode(morse.encode(F.col("text"))).alias("text"))


@query(r"""select o_orderkey, regexp_extract(replace(t, ' ', ''), '[A-z]{2}-[0-9]{3}-[A-Z]{2}') as plate from (select o_orderkey, 'no ' || chr(cast(65 + o_custkey % 26 as integer)) || 'b - ' || lpad(cast(o_orderkey % 1000 as varchar), 3, '0') || '- XY;' as t from orders)""")
def plate_regex(spark, d):
    t = F.concat(F.lit("no "), F.char(65 + F.col("o_custkey") % 26), F.lit("b - "), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit("- XY;"))
    return R._table(spark, d, "orders").select("o_orderkey", morse.plate(t).alias("plate"))


# streams


@query(S.MORSE)
def stream_morse_encode(spark, d):
    source = streams.read_stream(spark, f"{d}/conversations.parquet")
    return streams.run_stream(spark, source, lambda df: df.select(*_TEXT, morse.encode(F.col("text")).alias("morse")))


@query(S.TILE + "select image_id, r, c, xor(v, 127) as v from tile")
def stream_xor_cipher(spark, d):
    source = streams.read_stream(spark, f"{d}/embeddings.parquet")
    return streams.run_stream(spark, source, lambda df: crypto.xor_constant(R.tiles_of(df)))
