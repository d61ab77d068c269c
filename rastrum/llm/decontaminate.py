"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number n of distinct shingles (powers of two). An item's sketch are its floor((1 - t) n) + 1 least shingle
hashes: an item contained to t or more lacks fewer shingles than that, so a document that holds it holds one of its sketch. No true pair
is missed. A document without any of the longest words of the sketched shingles holds none of these and is passed over. Of the others' hashes only those are sketched that can stand in the sketch of an item of some partition that fits it: a bit
map of the sketches, by partition, is looked up before anything is exploded, so what a document sends grows with the items that it may
hold, not with its length. Candidates are then counted exactly, shingle text by shingle text.

Everything runs in DataFrame functions. Defined cases: words are what white space (blank, tab to carriage return) separates in
the lower-cased text; a text of fewer than five words has one shingle, all its words; a text without words has none and takes
no part. Rows with the same id count as one document or item with all their shingles; rows with a null id or null text take
no part. Repeated shingles count once. Other columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered

WORDS, THRESHOLD = 5, 0.8
#: Frames of at most so many bytes are broadcast; beyond that the joins shuffle. Bits of the map for each hash in a sketch. Longest words up to
#: which documents are looked through for them first.
BROADCAST_BYTES, BITS, LONG_WORDS = 32 << 20, 32, 1 << 13


def words(text: str) -> Column:
    """White-space separated words of the lower-cased text as an array."""
    return F.array_remove(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), "")


#: Of an array ``h`` of word hashes: hashes of its shingles.
_HASHES = f"if(size(h) < {WORDS}, array(xxhash64(h)), transform(sequence(0, size(h) - {WORDS}), i -> xxhash64({', '.join(f'h[i + {k}]' if k else 'h[i]' for k in range(WORDS))})))"
#: Of an array ``w`` of words: texts of its shingles.
_TEXTS = f"transform(sequence(1, greatest(size(w) - {WORDS - 1}, 1)), i -> array_join(slice(w, i, {WORDS}), ' '))"


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _bit_map(sketch: DataFrame, bits: int) -> DataFrame:
    """One row with a map of 2 ** bits bits, as longs: the bits of all hashes are set."""
    words = sketch.select(F.col("h").bitwiseAND((1 << bits) - 1).alias("b")).groupBy(F.shiftright("b", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    every = sketch.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("k")).join(words, "k", "left")
    return every.agg(F.expr("transform(array_sort(collect_list(struct(k, coalesce(v, 0L) as v))), x -> x.v)").alias("map"))


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found, containment: every pair with containment of at least threshold."""
    hashed = F.expr("transform(w, x -> xxhash64(x))")
    of = items.select("item_id", words("text").alias("w")).where("item_id is not null and size(w) > 0")
    # the hash of a shingle's text tells shingles apart; the hash of its words' hashes, which documents can afford, finds candidates
    both = of.withColumn("h", hashed).select("item_id", F.expr(_TEXTS).alias("shingle"), F.expr(_HASHES).alias("h"))
    both = both.select("item_id", F.explode(F.arrays_zip("shingle", "h")).alias("x")).select("item_id", "x.*").distinct()
    shingles = cut(gathered(both), "items")
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    keep = F.floor(F.lit(1 - threshold + 1e-9) * F.col("n_shingles")).cast("int") + 1
    sketch = shingles.groupBy("item_id").agg(F.sort_array(F.collect_list("h")).alias("hs"), F.count("*").alias("n_shingles"))
    part = F.ceil(F.log2("n_shingles")).cast("int")
    sketch = cut(gathered(sketch.select("item_id", part.alias("part"), "n_shingles", F.explode(F.slice("hs", F.lit(1), keep)).alias("h"))), "sketch")
    parts = sketch.groupBy("part").agg(F.count("*").alias("n"), F.min("n_shingles").alias("least"), F.max("h").alias("top")).orderBy("part").collect()
    weight = shingles.agg(F.count("*"), F.sum(F.octet_length("shingle"))).first()
    n_sketch, size = sum(p["n"] for p in parts), 48 * weight[0] + (weight[1] or 0)

    # candidates: documents with a hash of a sketch whose partition's items aren't too large for them
    # texts without words fall out in the joins: a condition on w would be pushed below and split every text twice
    split = docs.where("doc_id is not null and text is not null").select("doc_id", words("text").alias("w"))
    longest = sketch.join(shingles, ["item_id", "h"]).select(F.expr("array_max(transform(split(shingle, ' '), x -> struct(length(x) as n, x as x))).x").alias("x")).distinct()
    longest = longest.agg(F.collect_set("x").alias("long_words"), F.count("*").alias("n"))
    if (longest.first()["n"] or 0) <= LONG_WORDS:
        split = split.crossJoin(F.broadcast(longest.select("long_words"))).where("arrays_overlap(w, long_words)")
    split = split.select("doc_id", hashed.alias("h"))
    single = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()  # else a document's rows count together
    need = [max(1, math.ceil(threshold * p["least"] - 1e-9)) if single else 1 for p in parts]
    all_ = split.select("doc_id", F.expr(_HASHES).alias("hs"))
    fits = " or ".join(f"(x <= {p['top']}L and n >= {k})" for p, k in zip(parts, need, strict=True)) or "false"
    bits = max(12, (BITS * max(n_sketch, 1) - 1).bit_length())
    if 1 << (bits - 3) <= BROADCAST_BYTES:  # else by the partitions' largest hashes alone
        all_ = all_.crossJoin(F.broadcast(_bit_map(sketch, bits)))
        in_map = f"(shiftright(map[cast(shiftright(x, 6) & {(1 << (bits - 6)) - 1} as int)], cast(x & 63 as int)) & 1) = 1"
        all_ = all_.select("doc_id", F.size("hs").alias("n"), F.expr(f"filter(hs, x -> {in_map})").alias("hs"))
    else:
        all_ = all_.select("doc_id", F.size("hs").alias("n"), "hs")
    low = all_.where("size(hs) > 0").select("doc_id", F.explode(F.expr(f"filter(hs, x -> {fits})")).alias("h"))
    found = low.join(_small(sketch.select("h", "item_id").distinct(), 32 * n_sketch), "h").select("doc_id", "item_id").distinct()
    candidates = cut(gathered(found), "candidates")

    # exact containment of the candidates
    again = docs.select("doc_id", "text").join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words("text").alias("w"))
    present = again.select("doc_id", F.explode(F.expr(f"array_distinct({_TEXTS})")).alias("shingle")).join(_small(shingles.select("item_id", "shingle"), size), "shingle")
    counted = present.groupBy("doc_id", "item_id").agg(F.countDistinct("shingle").alias("n_found"))
    pairs = counted.join(candidates, ["doc_id", "item_id"], "left_semi").join(_small(sizes, 32 * weight[0]), "item_id")
    share = F.col("n_found") / F.col("n_shingles")
    return gathered(pairs.where(share >= threshold - 1e-12).select("doc_id", "item_id", "n_shingles", "n_found", share.alias("containment")))


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that contain an item."""
    leaks = cut(gathered(search(docs, items, threshold).select("doc_id").distinct()), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


#: The same pairs by plain counting of all shingles.
ORACLE_SQL = """
with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents where doc_id is not null and text is not null),
i as (select item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from benchmark where item_id is not null and text is not null),
ds as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) as shingle from d where len(w) > 0),
si as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) as shingle from i where len(w) > 0),
n as (select item_id, count(*) as n_shingles from si group by item_id),
f as (select doc_id, item_id, count(*) as n_found from ds join si using (shingle) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_found, n_found / n_shingles as containment from f join n using (item_id) where n_found >= 0.8 * n_shingles - 1e-9
"""
