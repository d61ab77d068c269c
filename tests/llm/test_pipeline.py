"""The pipeline against a plain version, stage by stage on the whole small table."""

import re

import corpus_pipeline
import sentencepiece
from conftest import SF
from test_corpus_operators import brute_secrets
from test_near_copies import brute as brute_near_copies

from rastrum.llm import secrets, sentencepiece_codec


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain(docs, items):
    kept = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    ids = brute_near_copies(kept)
    kept = [(i, t) for i, t in kept if i in ids]
    sets = [s for s in map(shingles, items) if s]
    kept = [(i, t) for i, t in kept if not any(len(s & shingles(t)) >= 0.8 * len(s) - 1e-9 for s in sets)]
    return [(i, secrets.redact(t, brute_secrets(t) + secrets.confirmed(t, t.encode()))) for i, t in kept]


def test_pipeline_is_its_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.DEFAULT_MODEL)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    want = dict(plain(docs, items))
    assert got.keys() == want.keys() and len(want) < len(docs)
    for i, t in want.items():
        assert got[i]["ids"] == sp.encode(t) and got[i]["n_chars"] == len(t) and got[i]["round_trip"] and got[i]["parity"]


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs.limit(60).union(spark.createDataFrame([(None, None, None, None, None), (10**6, None, "en", None, None), (10**6 + 1, "", None, None, 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "sentencepiece"]


def test_pipeline_on_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = {c: "tag" for c in ("key", "hashes", "fp", "item_id", "spans", "score", "ids", "part", "h")}
    clash = docs.limit(80)
    for c, v in extra.items():
        clash = clash.withColumn(c, __import__("pyspark").sql.functions.lit(v))
    odd = spark.createDataFrame([(None, "The text of a row without an id, in plain words.", "en", None, None), (10**6, None, None, None, None), (10**6 + 1, "", "", "", 0)], docs.schema)
    for c, v in extra.items():
        odd = odd.withColumn(c, __import__("pyspark").sql.functions.lit(v))
    for name, rows, items in (("empty", docs.limit(0), 0), ("clash", clash.unionByName(odd), 40), ("noitems", docs.limit(30), 0)):
        d = tmp_path / name
        rows.write.parquet(str(d / "documents.parquet"))
        spark.read.parquet(f"{SF}/benchmark.parquet").limit(items).write.parquet(str(d / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(d)).collect()
        assert bool(got) == (name != "empty")
        if name == "clash":
            assert {None} <= {r["doc_id"] for r in got} and not {10**6, 10**6 + 1} & {r["doc_id"] for r in got}
