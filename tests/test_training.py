"""Codebook training: vectors cut from embeddings, equal ones handled once, all rounds of few vectors in one task."""

import numpy as np
from conftest import SF

from rastrum.operators import compress, geometry
from rastrum.sources import rasters as R


def test_vectors_are_cut_without_a_shuffle(spark):
    """Before, every pixel was shuffled to its block."""
    got = R.vq16(spark, SF)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    blocks = geometry.blocks(R.tile(spark, SF), 4)
    want = {r["image_id"] * 4 + r["br"] * 2 + r["bc"]: [float(x) for x in r["vec"]] for r in blocks.collect()}
    assert {r["vec_id"]: r["vec"] for r in got.collect()} == want


def test_vectors_of_odd_embeddings(spark, tmp_path):
    rows = [(1, [0.1] * 64), (2, None), (3, []), (4, [k / 100 for k in range(10)]), (5, [None, 0.5] * 32), (6, [k / 50 - 0.9 for k in range(90)])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    blocks = geometry.blocks(R.tile(spark, str(tmp_path)), 4).collect()
    want = sorted((r["image_id"] * 4 + r["br"] * 2 + r["bc"], [float(x) for x in r["vec"]]) for r in blocks)
    assert sorted((r["vec_id"], r["vec"]) for r in R.vq16(spark, str(tmp_path)).collect()) == want


def test_rounds_of_few_vectors_are_one_task(spark, monkeypatch):
    """A job for each round took over half a second whatever the table; both ways give the same codewords and rounds."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (300, 4)).astype(float)
    df = spark.createDataFrame([(v.tolist(),) for v in np.repeat(x, rng.integers(1, 4, 300), axis=0)], "vec array<double>")
    step, steps = compress._step, []
    monkeypatch.setattr(compress, "_step", lambda *a: steps.append(1) or step(*a))
    book, log = compress.lbg_train(df, 8, rounds=3)
    assert not steps
    monkeypatch.setattr(compress, "ALONE", 0)
    far, far_log = compress.lbg_train(df, 8, rounds=3)
    assert len(steps) == len(log) + 1 and (book == far).all()
    assert [x[:2] for x in log] == [x[:2] for x in far_log] and np.allclose([x[2] for x in log], [x[2] for x in far_log])
