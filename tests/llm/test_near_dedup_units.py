"""Units of comparison: rows grow with texts, and each pair that sizes allow meets."""

import itertools
import random
from collections import defaultdict

import pytest

from rastrum.llm import simhash


def units(spark, n, root, block):
    rows = spark.createDataFrame([(7, k, n[k], root[k]) for k in range(len(n))], "h long, key long, n int, root long")
    return simhash._units(rows, rows, "h", block, ["key", "n", "root"])


@pytest.mark.parametrize("sizes", [(100, 100), (60, 900)])
def test_rows_grow_with_texts(spark, sizes):
    """Four times the texts in one group: before, their blocks met for sixteen times the rows."""
    rng = random.Random(2)
    few, many = (units(spark, [rng.randint(*sizes) for _ in range(m)], list(range(m)), 5).count() for m in (1000, 4000))
    assert many < 6 * few and many <= 2 * 2 * simhash.BLOCKS * 4000


@pytest.mark.parametrize(("m", "sizes", "block"), [(150, (1, 400), 20), (150, (100, 110), 20), (150, (1, 400), 1000)])
def test_every_pair_of_similar_sizes_meets(spark, m, sizes, block):
    rng = random.Random(3)
    n, root = [rng.randint(*sizes) for _ in range(m)], [rng.choice([-1, rng.randint(0, 40)]) for _ in range(m)]
    held = defaultdict(list)
    for r in units(spark, n, root, block).collect():
        held[tuple(r[k] for k in r.asDict() if k not in ("ask", "key", "n", "root"))].append((r["key"], int(r["ask"])))
    met = set()
    for got in held.values():
        met |= {frozenset((a, b)) for (a, x), (b, y) in itertools.product(got, got) if x > 0 and y != 1}
    for a, b in itertools.combinations(range(m), 2):
        if root[a] != root[b] and 5 * min(n[a], n[b]) >= 4 * max(n[a], n[b]):
            assert frozenset((a, b)) in met
