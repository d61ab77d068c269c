"""Shapes of physical plans that must hold at any size."""

import pytest
from conftest import SF

from rastrum.operators import compress, geometry
from rastrum.plans.queries import QUERIES
from rastrum.sources import rasters as R

NARROW = ["raster_tall", "raster_color", "bit_planes", "xor_cipher", "stream_cipher", "morse_encode", "morse_decode", "plate_regex", "threshold", "shamir_split", "vc22_shares", "vc24_shares", "bits_msb"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NARROW)
def test_row_by_row_operators_dont_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize("name", ["sharpen", "gaussian5", "haar_avg_l3", "dct8", "iwt", "lsb_k2_embed", "lsb_adaptive_embed", "shamir_recover", "psnr_lsb_k1", "ssim_gaussian"])
def test_no_products_of_tables(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_window_over_a_whole_table(spark):
    tiles = R.tile(spark, SF)
    plans = [plan(compress.raster_runs(tiles, 8)), plan(geometry.number_in_order(tiles, ["image_id"], "r", ["c"], "n")), plan(QUERIES["lsb_adaptive_embed"](spark, SF)), plan(QUERIES["rle_events"](spark, SF))]
    for text in plans:
        for line in text.splitlines():
            if "Window [" in line and "windowspecdefinition(" in line:
                first = line.split("windowspecdefinition(")[1].split(",")[0]
                # a definition without a partition key begins with its order; only the summaries of groups of chunks have none
                assert "ASC" not in first or first.startswith("_g"), line[:300]


def test_scans_read_what_is_needed(spark):
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan(QUERIES["shamir_split"](spark, SF))
    assert "ReadSchema: struct<embedding:array<float>>" in plan(QUERIES["raster_tall"](spark, SF).groupBy("v").count())
