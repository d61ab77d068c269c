"""Ways that only large pictures or codebooks take, on small ones."""

import numpy as np
import pytest
from conftest import SF

from rastrum.functions import bits as B
from rastrum.operators import compress, crypto, filters, geometry, hiding, transforms
from rastrum.sources import rasters as R


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("stripe", [12, 64])
def test_stripes_change_nothing(spark, monkeypatch, stripe):
    px = R.tall(spark, SF).where("r < 77")
    for f in (filters.sharpen, filters.gaussian5, filters.gaussian11, filters.edges):
        want = rows(f(px))
        monkeypatch.setattr(filters, "STRIPE", stripe)
        assert rows(f(px)) == want
        monkeypatch.undo()


@pytest.mark.parametrize("band", [3, 7])
def test_bands_change_no_region(spark, monkeypatch, band):
    px = filters.edges(filters.gaussian11(R.plate_scene(spark))).unionByName(R.tile(spark, SF).where("image_id between 10 and 30").withColumn("v", (__import__("pyspark").sql.functions.col("v") > 135).cast("int")))
    want = rows(filters.regions(px))
    monkeypatch.setattr(filters, "BAND", band)
    assert rows(filters.regions(px)) == want and len(want) > 40
    # against a flood fill of one picture
    on = {(r["r"], r["c"]) for r in px.where("v > 0 and image_id = 12").collect()}
    areas = []
    while on:
        todo, n = [on.pop()], 0
        while todo:
            r, c = todo.pop()
            n += 1
            for x in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if x in on:
                    on.remove(x)
                    todo.append(x)
        areas.append(n)
    assert sorted(areas) == sorted(w[5] for w in want if w[0] == 12)


def test_groups_of_rows_number_alike(spark, monkeypatch):
    px = R.tall(spark, SF)
    want = rows(geometry.number_in_order(px, ["image_id"], "r", ["c"], "n"))
    monkeypatch.setattr(geometry, "GROUP", 7)
    assert rows(geometry.number_in_order(px, ["image_id"], "r", ["c"], "n")) == want


def test_large_codebooks(spark, monkeypatch):
    book = [r["vec"] for r in R.vq16(spark, SF).where("vec_id < 20").orderBy("vec_id").collect()]
    vectors = R.vq16(spark, SF)
    want = rows(compress.vq_decode(compress.vq_encode(vectors, book), book).select("vec_id", "k", "d2", "cw"))
    monkeypatch.setattr(compress, "MAX_CODEWORDS", 4)
    assert rows(compress.vq_decode(compress.vq_encode(vectors, book), book).select("vec_id", "k", "d2", "cw")) == want


def test_dithering_by_pixel(spark, monkeypatch):
    monkeypatch.setattr(transforms, "DITHER", 200)
    px = R.tile(spark, SF).where("image_id < 20")
    got = {tuple(r)[:3]: r["v"] for r in transforms.floyd_steinberg(px).collect()}
    for i in range(20):
        x = np.zeros((9, 10), np.float32)
        for r in px.where(f"image_id = {i}").collect():
            x[r["r"], r["c"] + 1] = r["v"]
        for r in range(8):
            for c in range(1, 9):
                new = 255 if x[r, c] > 127 else 0
                err = x[r, c] - np.float32(new)
                for dr, dc, k in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                    x[r + dr, c + dc] += err * np.float32(k / 16)
                assert got[(i, r, c - 1)] == new


def test_messages_that_dont_fit_are_refused(spark):
    tiles, long = R.tile(spark, SF).where("image_id < 3"), B.bit_table(spark, "01" * 60)
    coef = transforms.dct8(tiles)
    for embed in (lambda: hiding.embed_fixed2(tiles, long, 8), lambda: hiding.embed_adaptive2(tiles, long, 8), lambda: hiding.embed_dct10(coef, long), lambda: hiding.embed_parity(coef, long)):
        with pytest.raises(hiding.CapacityError):
            embed()
    assert rows(hiding.bits_embedded(hiding.room_fixed2(tiles, 8), 120)) == [(i, 120, 64) for i in range(3)]
    assert hiding.embed_fixed2(tiles, long, 8, overflow="cut").count() == tiles.count()
    with pytest.raises(ValueError, match="maybe"):
        hiding.embed_parity(coef, long, overflow="maybe")


def test_shamir_with_other_places(spark):
    shares = crypto.shamir_split(spark.createDataFrame([(i, 1000 * i + 7) for i in range(40)], "secret_id long, secret long"), "k", 7, 5)
    some = shares.where("(x + secret_id) % 7 > 1")  # other places for each secret, five of seven
    assert rows(crypto.shamir_recover(some)) == [(i, 1000 * i + 7) for i in range(40)]
    assert {r["secret"] for r in crypto.shamir_recover(some.where("x > 2")).collect() if r["secret_id"] % 7 == 0} == {None}


def test_mersenne_stream(spark):
    import random

    px = R.rect(spark)
    twister = random.Random()
    twister.setstate((3, (*map(int, np.random.RandomState(5).get_state()[1]), 624), None))
    want = [twister.getrandbits(32) >> 24 for _ in range(5000)]
    got = {(r["r"], r["c"]): r["v"] for r in crypto.xor_mersenne(px, 5).collect()}
    old = {(r["r"], r["c"]): r["v"] for r in px.collect()}
    assert [got[k] ^ old[k] for k in sorted(old)] == want


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    assert [bytes(r["content"]) for r in R.read_text(spark, str(tmp_path / "a.txt")).collect()] == ["héllo".encode()]
    assert [bytes(r["content"]) for r in R.read_text(spark, str(tmp_path / "none.txt")).collect()] == [b""]


def test_png_files_by_the_image_source(spark, tmp_path):
    tiles, color = R.tile(spark, SF).where("image_id < 3"), R.color(spark, SF).where("r < 40")
    for r in [*R.to_png(tiles).collect(), *R.to_png(color.withColumn("image_id", color.image_id + 100)).collect()]:
        (tmp_path / f"{r['image_id']:03}.png").write_bytes(r["png"])
    by = {}
    for r in R.read_images(spark, str(tmp_path), gray=False).collect():
        by.setdefault(r["origin"][-7:-4], {})[(r["r"], r["c"], r["ch"])] = r["v"]
    assert by["100"] == {(r["r"], r["c"], r["ch"]): r["v"] for r in color.collect()}
    for i in range(3):
        want = {(r["r"], r["c"]): r["v"] for r in tiles.where(f"image_id = {i}").collect()}
        assert {k[:2]: v for k, v in by[f"{i:03}"].items()} == want
    assert R.read_images(spark, str(tmp_path)).select("image_id").distinct().count() == 4


def test_resizing_makes_no_grid(spark):
    """The new grid isn't joined: it counts as small by Spark's estimate, whatever its size, and would be broadcast."""
    px = R.tile(spark, SF)
    for got in (geometry.resize_bilinear(px, 5, 11), geometry.resize_to_levels(R.tall(spark, SF), 3)):
        lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
        below = lines[next(k for k, x in enumerate(lines) if "Join" in x) :]  # each side reads the pixels, and neither multiplies them
        assert sum("Generate" in x for x in below) == 2 and all("posexplode" in x for x in below if "Generate" in x)
    for h, w in ((1, 1), (3, 20), (8, 8), (17, 5)):  # smaller, larger, equal
        small = px.where("image_id < 3")
        want = {}
        old = {(r["image_id"], r["r"], r["c"]): r["v"] for r in small.collect()}
        for i in range(3):
            for y in range(h):
                for x in range(w):
                    at = [min(max((k + 0.5) * 8 / n - 0.5, 0), 7) for k, n in ((y, h), (x, w))]
                    s = 0
                    for dy in (0, 1):
                        for dx in (0, 1):
                            r, c = (int(at[0]) + dy, int(at[1]) + dx)
                            weight = abs(1 - dy - at[0] % 1) * abs(1 - dx - at[1] % 1)
                            s += weight * old[(i, min(r, 7), min(c, 7))]
                    want[(i, y, x)] = int(np.floor(round(s, 6) + 0.5))
        assert {(r["image_id"], r["r"], r["c"]): r["v"] for r in geometry.resize_bilinear(small, h, w).collect()} == want


def test_huffman_joins_texts_not_bytes(spark):
    """Rows of bytes count as small by Spark's estimate, whatever their number; they are summed up by text before a join."""
    data = R.text_bytes(spark, SF)
    codes = compress.huffman_table(compress.byte_frequencies(data, ["conv_id", "turn"]), ["conv_id", "turn"])
    coded = compress.huffman_encode(data, codes, ["conv_id", "turn"])
    for got in (coded, compress.huffman_decode(coded, codes, ["conv_id", "turn"])):
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_huffman_order_and_symbols_without_a_code(spark):
    data = spark.createDataFrame([(1, 2, 65), (1, 0, 66), (1, 1, 67), (1, 300, 65), (2, 0, 67)], "id int, pos int, b int")
    table = spark.createDataFrame([(1, 65, "0"), (1, 66, "10"), (2, 65, "0")], "id int, b int, code string")
    assert rows(compress.huffman_encode(data, table, ["id"])) == [(1, "1000")]


def test_nearest_codewords_are_those_of_all_distances(spark):
    rng = np.random.default_rng(1)
    x, book = rng.integers(0, 256, (3000, 16)).astype(float), rng.integers(0, 256, (128, 16)).astype(float)
    book[5], x[7] = book[90], (book[3] + book[80]) / 2  # equal codewords, a tie
    all_ = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    k, d = compress.nearest(x, book)
    assert (k == all_.argmin(axis=1)).all() and (d == all_.min(axis=1)).all()
    packed = compress._packed(spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>"))
    assert packed.count() < 100  # a round handles batches, not vectors
    means, d2 = compress.lloyd_step(spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>"), book)
    assert np.isclose(d2, all_.min(axis=1).mean()) and np.allclose(means[k[0]], x[k == k[0]].mean(axis=0))
