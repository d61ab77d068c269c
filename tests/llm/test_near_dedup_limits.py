"""What near-dedup holds in a worker's memory and leaves on disk, and that places lose no link."""

import os
import random
import tracemalloc

import numpy as np

from rastrum.llm import common, simhash


def test_search_of_a_large_bucket_holds_few_pairs():
    """2,800 fingerprints that are all near each other: before, one worker held 380 MB of pairs."""
    rng = np.random.default_rng(0)
    fp = np.full(2800, 0x123456789ABCDEF0, np.uint64)
    for _ in range(6):
        fp ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
    fp = np.unique(fp)
    key = np.arange(len(fp))
    tracemalloc.start()
    try:
        got = simhash.spanned(key, np.full(len(fp), 150), fp, key)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == len(fp) - 1 and most < 100 << 20


def test_written_steps_go(spark):
    """Of sketches, sets and lists nothing stays in the shared folder."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    rows = [(k, " ".join(f"y{rng.random()}" if rng.random() < 0.01 else w for w in base)) for k in range(40)]
    at = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    assert simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() < 40
    left = {x.split("-")[0] for x in set(os.listdir(at)) - before}
    assert "copies" in left and not left & {"marks", "sets", "rest", "lists", "units"}


def test_places_lose_no_link():
    """Similar sets are mates in the list of the least hash that they share; most sets that share a passage are in no list's pairs."""
    rng = np.random.default_rng(6)
    pairs = []
    for n in rng.integers(1, 120, 3000).tolist():
        a = np.unique(rng.integers(0, 1 << 62, n))
        b = np.unique(np.r_[rng.permutation(a)[: n - int(rng.integers(0, n // 5 + 2))], rng.integers(0, 1 << 62, int(rng.integers(0, n // 5 + 2)))])
        if len(b):
            pairs.append((a, b))

    def met(a, b):
        for h in np.intersect1d(a[: len(a) // 5 + 1], b[: len(b) // 5 + 1]).tolist():
            two = sorted((len(s), int(np.searchsorted(s, h))) for s in (a, b))
            n, place = (np.array(x) for x in zip(*two, strict=True))
            if any(len(x) for x, _ in simhash.mates(np.zeros(2, int), np.full(2, 2), n, np.arange(2), place)):
                return True
        return False

    alike = [9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)) for a, b in pairs]
    assert sum(alike) > 1000 and all(met(a, b) for (a, b), yes in zip(pairs, alike, strict=True) if yes)
    passage = rng.integers(0, 1 << 62, 20)
    loose = [tuple(np.unique(np.r_[passage, rng.integers(0, 1 << 62, int(rng.integers(60, 160)))]) for _ in range(2)) for _ in range(500)]
    assert sum(met(a, b) for a, b in loose) < 250
