"""Golden values, round trips and edge cases of the library's operators."""

import math

import numpy as np
import pytest

from rastrum.functions import bits as B
from rastrum.functions import morse
from rastrum.operators import compress, crypto, filters, geometry, hiding, metrics, transforms
from rastrum.sources import rasters as R


def picture(spark, rows, image_id=0):
    return spark.createDataFrame([(image_id, r, c, int(v)) for r, row in enumerate(rows) for c, v in enumerate(row)], "image_id long, r int, c int, v int")


def grid(df):
    rows = df.collect()
    out = np.zeros((max(x["r"] for x in rows) + 1, max(x["c"] for x in rows) + 1))
    for x in rows:
        out[x["r"], x["c"]] = x["v"]
    return out


SENTENCE = "Never gonna give you up, never gonna let you down, never gonna run around and desert you."


def test_huffman_sentence(spark):
    data = spark.createDataFrame([(0, i, b) for i, b in enumerate(SENTENCE.encode())], "id int, pos int, b int")
    table = compress.huffman_table(compress.byte_frequencies(data, ["id"]), ["id"])
    got = compress.huffman_size(table, ["id"]).first()
    assert (got["n_bytes"] * 8, got["n_symbols"], got["encoded_bits"]) == (712, 20, 341)
    assert got["ratio"] == pytest.approx(0.478933, abs=1e-6)
    coded = compress.huffman_encode(data, table, ["id"])
    assert compress.huffman_decode(coded, table, ["id"]).first()["content"] == SENTENCE.encode()


def test_huffman_few_symbols():
    assert compress.huffman_codes({}) == {}
    assert compress.huffman_codes({65: 9}) == {65: "0"}
    assert sorted(map(len, compress.huffman_codes({1: 1, 2: 1, 3: 2}).values())) == [1, 2, 2]


def test_stripe_ratio(spark):
    row = compress.run_length_ratio(R.stripes(spark), 256).first()
    assert (row["n_runs"], row["n_pixels"], row["ratio"]) == (256, 65536, 51.2)


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_runs_cross_chunks(spark, chunk):
    values = "aaabbbbbbbcaaaaaaaaaad" + "d" * 20
    df = spark.createDataFrame(list(enumerate(values)), "p long, x string")
    got = [(r["start_pos"], r["x"], r["run_length"]) for r in compress.run_lengths(df, [], "p", "x", chunk).orderBy("start_pos").collect()]
    assert got == [(0, "a", 3), (3, "b", 7), (10, "c", 1), (11, "a", 10), (21, "d", 21)]


def test_runs_with_nulls(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, "x"), (3, None)], "p long, x string")
    got = [(r["x"], r["run_length"]) for r in compress.run_lengths(df, [], "p", "x", 2).orderBy("start_pos").collect()]
    assert got == [(None, 2), ("x", 1), (None, 1)]


def test_vq_ties_and_degenerate(spark):
    v = spark.createDataFrame([(0, [1.0, 1.0]), (1, [5.0, 5.0])], "vec_id int, vec array<double>")
    assert [r["k"] for r in compress.vq_encode(v, [[0.0, 0.0], [2.0, 2.0], [2.0, 2.0]]).orderBy("vec_id").collect()] == [0, 1]
    none = compress.vq_encode(v, [])
    assert {r["k"] for r in none.collect()} == {-1}
    assert compress.vq_decode(none, [[1.0]]).first()["cw"] == []


def test_lbg_lowers_distortion(spark):
    rng = np.random.default_rng(1)
    centres = np.repeat([[0.0], [20.0], [100.0], [120.0]], 4, axis=1)
    data = [(i, (centres[i % 4] + rng.normal(0, 1, 4)).tolist()) for i in range(200)]
    book, log = compress.lbg_train(spark.createDataFrame(data, "vec_id int, vec array<double>"), 4)
    assert book.shape == (4, 4) and log[-1][2] < 20
    for size in (2, 4):
        d = [x for n, _, x in log if n == size]
        assert all(a >= b - 1e-9 for a, b in zip(d, d[1:], strict=False))


def test_lloyd_keeps_empty_cluster(spark):
    v = spark.createDataFrame([(0, [1.0]), (1, [3.0])], "vec_id int, vec array<double>")
    book, d = compress.lloyd_step(v, np.array([[2.0], [100.0]]))
    assert book.tolist() == [[2.0], [100.0]] and d == 1.0


def test_filters_against_numpy(spark):
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (3, 3), (2, 4), (1, 6)):
        a = rng.integers(0, 256, shape)
        df = picture(spark, a)
        if min(shape) >= 2:
            p = np.pad(a, 1, mode="reflect")
            box = sum(p[i : i + shape[0], j : j + shape[1]] for i in range(3) for j in range(3))
            assert (grid(filters.sharpen(df)) == np.clip(10 * a - box, 0, 255)).all()
        if min(shape) >= 3:
            p = np.pad(a, 2, mode="reflect")
            k = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1])
            want = sum(k[i, j] * p[i : i + shape[0], j : j + shape[1]] for i in range(5) for j in range(5))
            assert (grid(filters.gaussian5(df)) == (want + 128) // 256).all()
        filters.gaussian5(df).count()


def test_plate_boxes_and_regions(spark):
    a = np.zeros((40, 80), int)
    a[10:16, 10:60] = 200
    boxes = filters.regions(picture(spark, a)).collect()
    assert [(b["x"], b["y"], b["w"], b["h"], b["area"]) for b in boxes] == [(10, 10, 50, 6, 300)]
    assert all(b["w"] / b["h"] > 4 for b in filters.plate_boxes(picture(spark, a)).collect())
    assert filters.plate_boxes(picture(spark, a)).count() >= 1


def test_three_haars_invert(spark):
    a = np.random.default_rng(2).integers(0, 256, (8, 12))
    df = picture(spark, a)
    assert np.allclose(grid(transforms.haar_ortho_inverse(transforms.haar_ortho(df))), a)
    assert (grid(transforms.integer_haar_inverse(transforms.integer_haar(df))) == a).all()
    ll = grid(transforms.haar_average(df, 1).where("band = 'LL'"))
    assert np.allclose(ll, a.reshape(4, 2, 6, 2).mean(axis=(1, 3)))


def test_dct_inverts(spark):
    a = np.random.default_rng(3).integers(0, 256, (16, 8))
    df = picture(spark, a)
    assert np.allclose(grid(transforms.idct8(transforms.dct8(df))), a)
    assert grid(transforms.dct8(df))[0, 0] == pytest.approx(a[:8].sum() / 8)


def test_floyd_steinberg_small(spark):
    assert (grid(transforms.floyd_steinberg(picture(spark, [[255, 0], [0, 255]]))) == [[255, 0], [0, 255]]).all()
    out = grid(transforms.floyd_steinberg(picture(spark, np.full((20, 20), 64))))
    assert set(np.unique(out)) <= {0, 255} and abs(out.mean() - 64) < 12


def test_padding_blocks_and_resize(spark):
    a = np.arange(35).reshape(5, 7)
    df = picture(spark, a)
    assert (grid(geometry.pad_replicate(df, 8)) == np.pad(a, ((0, 3), (0, 1)), mode="edge")).all()
    assert grid(geometry.crop_even(df)).shape == (4, 6)
    whole = geometry.crop_multiple(df, 2)
    assert (grid(geometry.unblocks(geometry.blocks(whole, 2), 2)) == a[:4, :6]).all()
    assert (grid(geometry.resize_bilinear(df, 5, 7)) == a).all()


def test_number_in_order_is_raster_order(spark):
    df = picture(spark, np.zeros((6, 5)))
    got = geometry.number_in_order(df.where("(r + c) % 2 = 0"), ["image_id"], "r", ["c"], "n").orderBy("r", "c").collect()
    assert [x["n"] for x in got] == list(range(len(got)))


def test_lsb_limits(spark):
    df = picture(spark, np.full((2, 3), 255))
    for k in (1, 8):
        bits = "101"
        stego = hiding.embed_lsb(df, B.bit_table(spark, bits), k, 3)
        assert hiding.extract_lsb(stego, k, 3, 3).first()["bits"] == bits
    with pytest.raises(ValueError):
        hiding.embed_lsb(df, B.bit_table(spark, "1"), 9, 3)
    with pytest.raises(hiding.CapacityError):
        hiding.embed_lsb(df, B.bit_table(spark, "1" * 7), 1, 3)
    with pytest.raises(ValueError):
        B.message_bits(spark, "a\0b")


def test_shift_saturation_and_ties(spark):
    a = np.array([[3, 3, 7, 7], [255, 4, 9, 8]])
    df = picture(spark, a)
    assert metrics.peak(df, 254).first()["peak"] == 3
    with pytest.raises(ValueError):
        hiding.embed_shift(df, B.bit_table(spark, "10"))
    assert grid(hiding.embed_shift(df, B.bit_table(spark, "10"), "wrap"))[1, 0] == 0
    assert grid(hiding.embed_shift(df, B.bit_table(spark, "10"), "skip"))[1, 0] == 255
    with pytest.raises(hiding.CapacityError):
        hiding.embed_shift(df, B.bit_table(spark, "101"), "wrap")
    clean = picture(spark, np.minimum(a, 250))
    stego = hiding.embed_shift(clean, B.bit_table(spark, "10"))
    assert (grid(hiding.restore_shift(stego)) == np.minimum(a, 250)).all()
    bits = hiding.shift_bits(stego).orderBy("pos").collect()
    assert [x["bit"] for x in bits] == [1, 0]


def test_parity_branches(spark):
    a = np.random.default_rng(5).integers(0, 256, (8, 32))
    coef = transforms.dct8(picture(spark, a))
    got = hiding.embed_parity(coef, B.bit_table(spark, "1010"))
    assert {r["way"] for r in got.where("r = 4 and c % 8 = 1").collect()} <= {"keep", "add", "sub", "set"}
    assert [x["bit"] for x in hiding.parity_bits(got.drop("way")).orderBy("pos").collect()] == [1, 0, 1, 0]


def test_headers(spark):
    rng = np.random.default_rng(6)
    cover = picture(spark, rng.integers(0, 255, (16, 16)))
    bits = B.message_bits(spark, "ok", "lsb")
    assert hiding.extract_fixed2(hiding.embed_fixed2(cover, bits, 16), 16).first()["bits"] == "1111011011010110"
    assert hiding.extract_adaptive2(hiding.embed_adaptive2(cover, bits, 16), cover, 16).first()["bits"] == "1111011011010110"


def test_shamir(spark):
    s = spark.createDataFrame([(1, 31415926), (2, 0), (3, crypto.PRIME - 1)], "secret_id long, secret long")
    shares = crypto.shamir_split(s, "k")
    assert {r["secret_id"]: r["secret"] for r in crypto.shamir_recover(shares).collect()} == {1: 31415926, 2: 0, 3: crypto.PRIME - 1}
    assert crypto.shamir_recover(shares.where("x < 5")).first()["secret"] is None
    three = crypto.shamir_split(s, "k", 7, 3).where("x in (2, 5, 7)")
    assert {r["secret"] for r in crypto.shamir_recover(three, 3).collect()} == {31415926, 0, crypto.PRIME - 1}


def test_visual_sharing(spark):
    px = R.rect(spark)
    two = crypto.overlay(crypto.visual_2_of_2(px, "k"), 1, 2)
    dark = two.groupBy((two.r / 2).cast("int").alias("r"), (two.c / 2).cast("int").alias("c")).agg({"v": "sum"}).collect()
    assert {(x["r"], x["c"]) for x in dark if x["sum(v)"] == 0} == {(r, c) for r in range(12, 37) for c in range(25, 75)}
    shares = crypto.visual_2_of_4(px, "k", "balanced")
    assert shares.groupBy("share_id").count().count() == 4


def test_streams_are_inverses(spark):
    df = picture(spark, np.random.default_rng(7).integers(0, 256, (9, 9)))
    assert (grid(crypto.xor_stream(crypto.xor_stream(df, "k", 9), "k", 9)) == grid(df)).all()
    assert (grid(crypto.xor_constant(crypto.xor_constant(df))) == grid(df)).all()


def test_metrics(spark):
    a, b = picture(spark, [[10, 20], [30, 40]]), picture(spark, [[10, 21], [30, 40]])
    row = metrics.psnr(a, b).first()
    assert row["mse"] == 0.25 and row["psnr"] == pytest.approx(10 * math.log10(255**2 / 0.25))
    assert metrics.psnr(a, a).first()["psnr"] == math.inf
    assert metrics.ssim_block(a, a).first()["ssim"] == pytest.approx(1)
    assert metrics.compare(a, b).first()["n_different"] == 1
    assert metrics.compare(a, b.where("c = 0")).first()["n_different"] == 2


@pytest.mark.parametrize("text, want", [("A #B", ".- /  -..."), ("A # B", ".- /  / -..."), ("ß", ""), ("  hi ", ".... .. / "), ("", ""), ("sos", "... --- ..."), ("#a", ".-")])
def test_morse(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(morse.encode(df.t)).first()[0] == want


def test_morse_decode_and_plate(spark):
    df = spark.createDataFrame([("... --- ... / .- ......",)], "t string")
    assert df.select(morse.decode(df.t)).first()[0] == "SOS A?"
    df = spark.createDataFrame([("xx AB - 123 - CD", "none")], "t string, n string")
    assert df.select(morse.plate(df.t)).first()[0] == "AB-123-CD" and df.select(morse.plate(df.n)).first()[0] is None


def test_png_round_trip(spark, tmp_path):
    a = np.random.default_rng(8).integers(0, 256, (6, 9))
    row = R.to_png(picture(spark, a)).first()
    (tmp_path / "x.png").write_bytes(row["png"])
    assert (grid(R.read_images(spark, str(tmp_path))) == a).all()


def test_text_source_and_codebook(spark, tmp_path):
    (tmp_path / "s.txt").write_bytes(b"secret\x00!")
    assert R.read_text(spark, str(tmp_path)).first()["content"] == b"secret\x00!"
    book = spark.createDataFrame([(0, [1.0, 2.0])], "k int, cw array<double>")
    R.write_codebook(book, str(tmp_path / "cb"))
    assert spark.read.json(str(tmp_path / "cb")).first()["dim"] == 2


def test_random_vectors(spark):
    a = R.random_vectors(spark, 50, 3, 1)
    assert a.collect() == R.random_vectors(spark, 50, 3, 1).repartition(7).orderBy("vec_id").collect()
    assert all(0 < x <= 1 for r in a.collect() for x in r["vec"])
