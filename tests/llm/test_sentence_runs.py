"""Sentence dedup against a brute force over all runs of three or more sentences, and against its SQL."""

import random

import pytest
from conftest import SF, same_rows

from rastrum.llm import common, sentence_spans


def brute(rows):
    runs, first = {}, {}
    for i, sentences in rows:
        here = runs[i] = []
        for s in range(len(sentences)):
            for e in range(s + 3, len(sentences) + 1):
                run = tuple(sentences[s:e])
                here.append((s, e, run))
                first[run] = min(first.get(run, (i, s)), (i, s))
    return {i: {k for s, e, run in runs[i] if first[run] < (i, s) for k in range(s, e)} for i, _ in rows}


@pytest.mark.parametrize("hot", [200, 1])
def test_every_repeated_run_goes_whole(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(8)
    pool = [" ".join(f"p{k}w{j}" for j in range(n)) + "." for k, n in enumerate([60, 12, 12, 3, 24, 1, 8, 30, 5, 14, 20, 2])]
    rows = [(0, pool[:3] + ["a tail of its own."]), (1, ["another head."] + pool[:3] + ["and another end."])]
    for i in range(2, 30):
        at = rng.randrange(len(pool) - 3)
        rows.append((i, [f"own {i}."] * rng.randint(0, 1) + pool[at : at + rng.randint(2, 6)] + [f"end {i} " + "z " * rng.randint(0, 30) + "."]))
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sentence_spans.dedup(docs).collect()}
    want = brute(rows)
    assert want[1] == {1, 2, 3}
    for i, s in rows:
        assert got[i]["n_sentences"] == len(s) and got[i]["n_removed"] == len(want[i]), i
        assert got[i]["text"].split() == " ".join(x for k, x in enumerate(s) if k not in want[i]).split()


def test_query_is_its_sql(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same_rows(sentence_spans.digest(docs).toPandas(), duck.execute(sentence_spans.ORACLE_SQL).df())
