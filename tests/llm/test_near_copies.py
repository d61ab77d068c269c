"""Near copies against all pairs."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF

from rastrum.llm import simhash


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d for i, (d, _) in enumerate(rows) if least[root(i)] == d}


@pytest.mark.parametrize(("leaders", "big", "block"), [(8, 20_000, 4000), (0, 20_000, 4000), (1, 10, 4000), (0, 20_000, 5)])
def test_near_copies_are_all_pairs(spark, monkeypatch, leaders, big, block):
    monkeypatch.setattr(simhash, "LEADERS", leaders)
    monkeypatch.setattr(simhash, "BIG", big)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    rows = [(1000, "a b"), (1001, "A  b"), (1002, ""), (1003, None)]
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(40, 120))]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(400)}"
            rows.append((len(rows), " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want
    assert 10 < len(want) < len(rows) - 10


def test_large_group_of_near_copies(spark):
    """A few leaders link nearly all of a group, so that no step emits its pairs."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = [(k, " ".join(w if rng.random() > 0.006 else f"y{rng.random()}" for w in base)) for k in range(3000)]
    key = np.arange(len(rows))
    hashes = [np.unique(simhash.hashes_of(t, 5)) for _, t in rows]
    fp = np.array([simhash.folded(h) for h in hashes], np.uint64)
    n = np.array([len(h) for h in hashes])
    assert len(simhash.led(key, n, fp, key)) <= simhash.LEADERS * len(rows) and len(simhash.spanned(key, n, fp, key)) < len(rows)
    want = brute(rows[:400])
    assert {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows[:400], "doc_id long, text string")).collect()} == want and len(want) < 40


def test_forest_spans_all_near_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 9).astype(np.uint64)
    fp = np.repeat(base, 40)
    for _ in range(12):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64))
    key, n, root = np.arange(len(fp)), rng.integers(50, 80, len(fp)), rng.integers(0, 30, len(fp))
    parent = list(range(len(fp)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if root[i] != root[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and int(fp[i] ^ fp[j]).bit_count() <= simhash.WIDE:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    got = np.arange(len(fp))
    for i, j in simhash.spanned(key, n, fp, root).tolist():
        got[i] = j
    assert got.tolist() == [top(i) for i in range(len(fp))]


def test_stage_drops_all_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_copies_with_far_fingerprints_are_found(spark):
    """Texts at a similarity of 0.8 whose fingerprints differ in more than WIDE bits."""
    rng, rows = random.Random(11), []
    while len(rows) < 8:
        words = [f"w{rng.randrange(10**6)}" for _ in range(12)]
        a, b = (" ".join([*words, f"x{rng.randrange(10**6)}"]) for _ in range(2))
        fp = [simhash.folded(np.unique(simhash.hashes_of(t, 5))) for t in (a, b)]
        if (fp[0] ^ fp[1]).bit_count() > simhash.WIDE:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    assert brute(rows) == {0, 2, 4, 6}
    assert {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0, 2, 4, 6}


@pytest.mark.parametrize("at_once", [2, 4000])
def test_search_of_the_rest_is_all_pairs(spark, monkeypatch, at_once):
    """Without any bucket, lists of any length alone find all copies."""
    monkeypatch.setattr(simhash, "LIST", at_once)
    monkeypatch.setattr(simhash, "_members", lambda nodes: nodes.where("false").selectExpr("0L as h", "key", "n", "fp"))
    rng, rows = random.Random(7), []
    for _ in range(5):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 120))]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(400)}"
            rows.append((len(rows), " ".join(t)))
    want = brute(rows)
    assert {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert 5 < len(want) < len(rows) - 10


def test_bitmaps_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (9, 90, 1000, 1024, 1025, 1200, 2040, 2050)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 9).astype(np.uint64)]) for s in sets]
    maps = simhash.Bitmaps([simhash.bitmap(s) for s in sets])
    pairs = [(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets) if 4 * len(s) <= 5 * len(t) and 4 * len(t) <= 5 * len(s)]
    a, b = np.array(pairs).T
    for i, j, k in zip(a, b, maps.apart(a, b).tolist(), strict=True):
        differ = len(np.setxor1d(sets[i], sets[j]))
        assert k <= differ and (2 * differ <= len(sets[i]) + len(sets[j]) or 9 * k > len(sets[i]) + len(sets[j]))
