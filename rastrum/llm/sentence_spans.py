"""Substring dedup by sliding sentence spans.

A span is every run of SPAN consecutive sentences, so the spans inside a longer run cover all of it, and a longer run that stands
elsewhere too is found whole. Each document sends every distinct span's 128-bit hash once; the smallest document of each hash comes from
a partial and final aggregation, never from gathering a group, and rows of very frequent hashes are dealt to many tasks when it is joined
to them. Spans of any other document are repeats: all sentences that they cover are removed, as are those of spans that stand earlier
in the same document. The first place of each span stays.

Defined cases: sentences end at ``.``, ``!`` or ``?`` before white space and at line ends, and stand without the ASCII white space around
them; null texts and texts of fewer sentences than a span have none and stay whole. Rows with the same doc_id count as one document for
comparison with others, each keeping its own text; rows with a null id take part in no comparison with others. Columns besides doc_id and
text aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, hot_keys, spread, texts_of, tidy

#: Sentences of a span.
SPAN = 3
_SPLIT = re.compile(r"(?<=[.!?])[ \t\r\f\v]+|\n")
_BLANK = " \t\r\f\v"


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence that isn't blank, without the white space around it."""
    out, at = [], 0
    for piece_end, next_start in [*((m.start(), m.end()) for m in _SPLIT.finditer(text)), (len(text), len(text))]:
        s = text[at:piece_end]
        t = s.strip(_BLANK)
        if t:
            lead = len(s) - len(s.lstrip(_BLANK))
            out.append((at + lead, at + lead + len(t)))
        at = next_start
    return out


def spans(text: str, found: list[tuple[int, int]]) -> list[bytes]:
    """Hashes of the spans that start at each sentence, as far as there are enough."""
    coded = [text[s:e].encode("utf-8", "surrogatepass") for s, e in found]
    digest = xxhash.xxh3_128_digest
    return [digest(b"\n".join(coded[k : k + SPAN])) for k in range(len(coded) - SPAN + 1)]


def clean(text: str, repeated: set[bytes]) -> tuple[str, int, int, int, str]:
    """(text without sentences of spans whose hash is in ``repeated`` or that stand earlier in the text; sentences; removed sentences;
    removed words; hash of the kept sentences, one a line)."""
    found = sentences(text)
    gone, seen = set(), set()
    for k, h in enumerate(spans(text, found)):
        if h in seen or h in repeated:
            gone.update(range(k, k + SPAN))
        seen.add(h)
    kept, at = [], 0
    for k, (s, _) in enumerate(found):
        stop = found[k + 1][0] if k + 1 < len(found) else len(text)
        if k in gone:
            kept.append(text[at:s])
            at = stop
    kept.append(text[at:])
    stay = "\n".join(text[s:e] for k, (s, e) in enumerate(found) if k not in gone)
    words = sum(len(text[found[k][0] : found[k][1]].encode("utf-8", "surrogatepass").split()) for k in gone)
    return "".join(kept), len(found), len(gone), words, hashlib.sha256(stay.encode("utf-8", "surrogatepass")).hexdigest()


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch)
        ids = batch.column("doc_id")
        for lo in range(0, len(texts), 500):
            got = [set(spans(t, sentences(t))) for t in texts[lo : lo + 500]]
            h = np.frombuffer(b"".join(x for g in got for x in g), np.int64).reshape(-1, 2)
            own = ids.take(pa.array(np.repeat(np.arange(lo, lo + len(got)), list(map(len, got)))))
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), own], names=["h1", "h2", "doc_id"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text (what is left), n_sentences, n_removed, n_removed_words, kept_sha256 (of the kept sentences, one a line); a row for each
    row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    # read twice, for the minimum and for the join: cut, so that texts are split once
    hashes = cut(rows.where("doc_id is not null").mapInArrow(tidy(_emit), f"h1 long, h2 long, doc_id {kind}"), "spans")
    first = hashes.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    first = cut(first.select("h1", "h2", "first", "n"), "first")
    hot = hot_keys(first, "h1", "n")
    joined = dealt(hashes, "h1", hot, "doc_id").join(spread(first, "h1", hot), ["h1", "h2", "part"])
    marks = joined.where("doc_id > first").groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("repeated"))  # a document's own spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("repeated")
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            raw = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1).astype(np.int64).tobytes()
            got, at = [], 0
            for t, k in zip(texts_of(batch), n.tolist(), strict=True):
                got.append(clean(t, {raw[x : x + 16] for x in range(at, at + 16 * k, 16)}))
                at += 16 * k
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True))], names=["doc_id", "text", "n_sentences", "n_removed", "n_removed_words", "kept_sha256"])

    return rows.join(marks, "doc_id", "left").select("doc_id", "text", "repeated").mapInArrow(tidy(run), f"doc_id {kind}, text string, n_sentences long, n_removed long, n_removed_words long, kept_sha256 string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_removed_words, kept_sha256."""
    return dedup(docs).select("doc_id", "n_sentences", "n_removed", "n_removed_words", "kept_sha256")


#: The same rows by numbering all places of every span's text.
ORACLE_SQL = f"""
with d as (select doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\\x20\\t\\r\\f\\v]+', concat('\\1', chr(10)), 'g'), chr(10)), lambda x: trim(x, concat(' ', chr(9), chr(11), chr(12), chr(13)))), lambda x: x <> '') as s from documents),
p as (select doc_id, s, unnest(range(1, len(s) - {SPAN} + 2)) as k from d),
n as (select doc_id, k, row_number() over (partition by array_to_string(s[k:k + {SPAN} - 1], chr(10)) order by doc_id, k) as nth from p),
g as (select distinct doc_id, unnest(range(k, k + {SPAN})) as k from n where nth > 1),
e as (select doc_id, unnest(s) as x, unnest(range(1, len(s) + 1)) as k from d),
m as (select e.doc_id, e.k, x, g.k is not null as gone, len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as words from e left join g on e.doc_id = g.doc_id and e.k = g.k),
t as (select doc_id, count(*) filter (gone) as n_removed, sum(words) filter (gone) as n_removed_words, string_agg(x, chr(10) order by k) filter (not gone) as kept from m group by doc_id)
select d.doc_id, cast(len(s) as bigint) as n_sentences, coalesce(n_removed, 0) as n_removed, cast(coalesce(n_removed_words, 0) as bigint) as n_removed_words, sha256(coalesce(kept, '')) as kept_sha256 from d left join t on d.doc_id = t.doc_id
"""
