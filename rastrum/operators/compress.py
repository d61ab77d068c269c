"""Run-length, vector-quantisation and Huffman coding."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 4096


def _next_head(chunks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, _k, _later): the first run start after chunk _k, looked for inside groups of ``size`` chunks and, where a group has none left,
    among the groups' first starts, so that a window orders one group's chunks or one row per group."""
    x = chunks.withColumn("_g", F.expr(f"_k div {size}"))
    ahead = lambda c, w: F.min(c).over(w.rowsBetween(1, W.unboundedFollowing))
    groups = x.groupBy(*keys, "_g").agg(F.min("_head").alias("_gh"))
    groups = groups.withColumn("_gl", ahead("_gh", W.partitionBy(*keys).orderBy("_g"))).drop("_gh")
    inside = x.withColumn("_own", ahead("_head", W.partitionBy(*keys, "_g").orderBy("_k")))
    return inside.join(groups, [*keys, "_g"]).select(*keys, "_k", F.coalesce("_own", "_gl").alias("_later"))


def run_lengths(df: DataFrame, keys: list[str], pos: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """(keys, start_pos, value, run_length): runs of equal values in order of ``pos``, a whole number without gaps.

    Changes are found inside chunks of positions; a chunk's first row is compared with the last value of the chunk before it, which an
    equi-join on the chunk's number brings. Runs end where the next begins. No task orders more than a chunk, a group of chunks or the
    groups' summaries."""
    x = df.select(*keys, F.col(pos).cast("long").alias("_p"), F.col(value).alias("_v")).withColumn("_k", F.expr(f"_p div {chunk}"))
    ends = x.groupBy(*keys, "_k").agg(F.max_by("_v", "_p").alias("_prev"), F.max("_p").alias("_top"))
    before = ends.select(*keys, (F.col("_k") + 1).alias("_k"), "_prev", F.lit(True).alias("_some"))
    inside = W.partitionBy(*keys, "_k").orderBy("_p")
    x = x.withColumn("_lag", F.lag("_v").over(inside)).withColumn("_first", F.row_number().over(inside) == 1).join(before, [*keys, "_k"], "left")
    change = F.when(F.col("_first"), F.col("_some").isNull() | ~F.col("_prev").eqNullSafe(F.col("_v"))).otherwise(~F.col("_lag").eqNullSafe(F.col("_v")))
    starts = x.where(change).select(*keys, F.col("_p").alias("start_pos"), F.col("_v").alias(value), "_k")
    heads = starts.groupBy(*keys, "_k").agg(F.min("start_pos").alias("_head"))
    later = _next_head(ends.select(*keys, "_k").join(heads, [*keys, "_k"], "left"), keys, chunk)
    top = ends.groupBy(*keys).agg((F.max("_top") + 1).alias("_end"))
    got = starts.withColumn("_next", F.lead("start_pos").over(W.partitionBy(*keys, "_k").orderBy("start_pos"))).join(later, [*keys, "_k"])
    got = got.join(top, keys) if keys else got.crossJoin(F.broadcast(top))  # one row
    return got.select(*keys, "start_pos", value, (F.coalesce("_next", "_later", "_end") - F.col("start_pos")).alias("run_length"))


def raster_runs(px: DataFrame, width: int) -> DataFrame:
    """Runs of a flattened raster; they go on across rows."""
    return run_lengths(px.withColumn("pos", F.col("r").cast("long") * width + F.col("c")), ["image_id"], "pos", "v")


def run_length_ratio(px: DataFrame, width: int) -> DataFrame:
    """(image_id, n_pixels, n_runs, ratio): pixels against five bytes a run."""
    runs = raster_runs(px, width).groupBy("image_id").agg(F.sum("run_length").alias("n_pixels"), F.count("*").alias("n_runs"))
    return runs.withColumn("ratio", F.col("n_pixels") / (F.col("n_runs") * 5))


def distance2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance2(a, b))


#: A codebook becomes a literal of the plan; a larger one is sent to the workers.
MAX_CODEWORDS = 4096


def codebook_column(codewords: list[list[float]]) -> Column:
    return F.array(*[F.array(*map(F.lit, map(float, w))) for w in codewords]) if codewords else F.array().cast("array<array<double>>")


def vq_encode(vectors: DataFrame, codewords: list[list[float]]) -> DataFrame:
    """vectors with k, the nearest codeword (the first on ties, -1 without any), and d2, the squared distance."""
    if len(codewords) > MAX_CODEWORDS:
        return _vq_encode_large(vectors, np.array(codewords, float))
    best = F.array_min(F.transform(codebook_column(codewords), lambda w, k: F.struct(distance2(F.col("vec"), w).alias("d2"), k.alias("k"))))
    return vectors.withColumn("_b", best).withColumn("k", F.coalesce("_b.k", F.lit(-1))).withColumn("d2", F.col("_b.d2")).drop("_b")


def _vq_encode_large(vectors: DataFrame, codebook: np.ndarray) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(codebook)

    @F.pandas_udf("struct<k:int,d2:double>")
    def nearest(vec: pd.Series) -> pd.DataFrame:
        book, ks, ds = sent.value, [], []
        step = max(1, (1 << 22) // book.size)
        x = np.stack(vec.to_list()) if len(vec) else np.zeros((0, book.shape[1]))
        for s in range(0, len(x), step):
            d = ((x[s : s + step, None, :] - book[None]) ** 2).sum(axis=2)
            ks.append(d.argmin(axis=1))
            ds.append(d.min(axis=1))
        return pd.DataFrame({"k": np.concatenate([np.zeros(0, int), *ks]), "d2": np.concatenate([np.zeros(0), *ds])})

    return vectors.withColumn("_b", nearest("vec")).withColumn("k", F.col("_b.k")).withColumn("d2", F.col("_b.d2")).drop("_b")


def codebook_picture(codebook: DataFrame, n: int, side: int) -> DataFrame:
    """(image_id, r, c, v): the n codewords of (k, cw) as blocks in a grid that is nearly square, stretched together to 0 to 255 and rounded half
    up; 128 if all values are equal, 0 where the grid has no codeword."""
    columns = math.isqrt(max(n - 1, 0)) + 1
    rows = -(-n // columns)
    words = codebook.select("k", F.posexplode("cw").alias("i", "x"))
    ends = words.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    stretched = F.when(F.col("hi") > F.col("lo"), F.floor(F.round((F.col("x") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo")), 6) + 0.5)).otherwise(128)
    px = words.crossJoin(F.broadcast(ends)).select(F.expr(f"cast(k div {columns} * {side} + i div {side} as int)").alias("r"), F.expr(f"cast(k % {columns} * {side} + i % {side} as int)").alias("c"), stretched.cast("int").alias("x"))
    grid = codebook.sparkSession.range(rows * columns * side * side).select(F.expr(f"cast(id div {columns * side} as int)").alias("r"), F.expr(f"cast(id % {columns * side} as int)").alias("c"))
    return grid.join(px, ["r", "c"], "left").select(F.lit(0).cast("long").alias("image_id"), "r", "c", F.coalesce("x", F.lit(0)).alias("v"))


def vq_decode(codes: DataFrame, codewords: list[list[float]]) -> DataFrame:
    """codes with cw, the codeword, or an empty vector for a number that the codebook lacks."""
    if len(codewords) > MAX_CODEWORDS:
        book = codes.sparkSession.createDataFrame([(k, list(map(float, w))) for k, w in enumerate(codewords)], "k int, cw array<double>")
        return codes.join(book, "k", "left").withColumn("cw", F.coalesce("cw", F.array().cast("array<double>"))).select(*codes.columns, "cw")
    found = F.when(F.col("k") >= 0, F.try_element_at(codebook_column(codewords), F.col("k") + 1))
    return codes.withColumn("cw", F.coalesce(found, F.array().cast("array<double>")))


def centroids(codes: DataFrame) -> DataFrame:
    """(k, d, x): mean of each cluster's vectors by dimension."""
    return codes.select("k", F.posexplode("vec").alias("d", "x")).groupBy("k", "d").agg(F.avg("x").alias("x"))


def _packed(vectors: DataFrame) -> DataFrame:
    """(dim, x, w): the vectors of each batch as one binary of doubles, and their weights (the column n, or one), so that no later pass handles
    single vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lengths = pc.unique(pc.list_value_length(batch.column(0))).to_pylist()
                if len(lengths) != 1 or not lengths[0]:
                    raise ValueError(f"vectors of one length are needed, not of {lengths}")
                x, w = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in (batch.column(0).flatten(), batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (x, w))], names=["dim", "x", "w"])

    n = F.col("n") if "n" in vectors.columns else F.lit(1)
    return vectors.select(F.col("vec").cast("array<double>").alias("vec"), n.cast("double").alias("n")).mapInArrow(run, "dim int, x binary, w binary")


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest codeword, the first on ties; squared distance) of each vector. Products rank the codewords; where rounding could
    decide between two, distances do."""
    own, to = (x**2).sum(axis=1), (codebook**2).sum(axis=1)
    score = to - 2 * (x @ codebook.T)
    k = score.argmin(axis=1)
    best = score[np.arange(len(k)), k]
    unsure = np.flatnonzero((score <= (best + 1e-11 * (own + to.max()))[:, None]).sum(axis=1) > 1)
    for s in range(0, len(unsure), 4096):
        u = unsure[s : s + 4096]
        k[u] = ((x[u, None, :] - codebook[None]) ** 2).sum(axis=2).argmin(axis=1)
    return k, ((x - codebook[k]) ** 2).sum(axis=1)


def _arrays(parts: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, weights) of packed batches."""
    for part in parts:
        for x, w in zip(part.column("x"), part.column("w"), strict=True):
            yield np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dim), np.frombuffer(w.as_buffer(), np.float64)


def _sums(held: Iterable[tuple[np.ndarray, np.ndarray]], codebook: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(weight of each cluster, sum of squared distances, sums of each cluster)."""
    size, dim = codebook.shape
    n, d2, sums = np.zeros(size), 0.0, np.zeros((size, dim))
    for whole, weights in held:
        for s in range(0, len(whole), 4096):
            x, w = whole[s : s + 4096], weights[s : s + 4096]
            k, d = nearest(x, codebook)
            d2 += float((d * w).sum())
            n += np.bincount(k, weights=w, minlength=size)
            for i in range(dim):
                sums[:, i] += np.bincount(k, weights=x[:, i] * w, minlength=size)
    return n, d2, sums


def _means(codebook: np.ndarray, n: np.ndarray, d2: float, sums: np.ndarray) -> tuple[np.ndarray, float]:
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], codebook), d2 / max(float(n.sum()), 1)


def _assign(codebook: np.ndarray):
    """Sums over a partition, cluster by cluster: one row per cluster and partition leaves the worker."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, d2, sums = _sums(_arrays(parts, codebook.shape[1]), codebook)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(np.r_[d2, np.zeros(len(n) - 1)]), pa.array(list(sums))], names=["k", "n", "d2", "sums"])

    return run


def _step(packed: DataFrame, codebook: np.ndarray) -> tuple[np.ndarray, float]:
    size, dim = codebook.shape
    got = packed.select("x", "w").mapInArrow(_assign(codebook), "k long, n double, d2 double, sums array<double>").groupBy("k").agg(F.sum("n").alias("n"), F.sum("d2").alias("d2"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim))).collect()
    n, sums = np.zeros(size), np.zeros((size, dim))
    for r in got:
        n[r["k"]], sums[r["k"]] = r["n"], [r[f"s{i}"] for i in range(dim)]
    return _means(codebook, n, sum(r["d2"] for r in got), sums)


def lloyd_step(vectors: DataFrame, codebook: np.ndarray) -> tuple[np.ndarray, float]:
    """(means of the clusters, an empty one keeping its codeword; mean squared distance before the update), in one job."""
    return _step(_packed(vectors), codebook)


#: Bytes of distinct vectors up to which one task trains: below, a round takes less time than Spark needs to start one.
ALONE = 8 << 20


def lbg_train(vectors: DataFrame, size: int, tolerance: float = 1e-5, rounds: int = 100) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """(codebook, log of (codewords, round, mean squared distance)). The codebook starts as the mean of all and doubles by adding and
    subtracting (1.1, 1, ..., 1); each stage repeats Lloyd's step until the relative change of the distance is
    below the tolerance. Equal vectors are handled once, with their number as weight. Only size x dimension numbers reach the driver in a
    round; up to ALONE bytes of distinct vectors all rounds are one task's."""
    packed = _packed(vectors.groupBy("vec").agg(F.count("*").alias("n"))).persist(StorageLevel.DISK_ONLY)  # read in every round; whatever its size, it takes no memory
    try:
        dim, held = packed.agg(F.max("dim"), F.sum(F.length("x"))).first()
        if held > ALONE:
            return _rounds(lambda book: _step(packed, book), dim, size, tolerance, rounds)

        def alone(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays = list(_arrays(parts, dim))
            book, log = _rounds(lambda book: _means(book, *_sums(arrays, book)), dim, size, tolerance, rounds)
            yield pa.RecordBatch.from_arrays([pa.array([book.ravel().tolist()]), pa.array([[list(map(float, x)) for x in log]], pa.list_(pa.list_(pa.float64())))], names=["book", "log"])

        got = packed.select("x", "w").coalesce(1).mapInArrow(alone, "book array<double>, log array<array<double>>").first()
        return np.array(got["book"]).reshape(-1, dim), [(int(n), int(k), d) for n, k, d in got["log"]]
    finally:
        packed.unpersist()


def _rounds(step: Callable[[np.ndarray], tuple[np.ndarray, float]], dim: int, size: int, tolerance: float, rounds: int) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    book, log = step(np.zeros((1, dim)))[0], []
    shift = np.ones(dim)
    shift[0] = 1.1
    while len(book) < size:
        book = np.stack([book + shift, book - shift], axis=1).reshape(-1, dim)[:size]
        last = None
        for k in range(rounds):
            book, d = step(book)
            log.append((len(book), k, d))
            if last is not None and (last == 0 or abs(last - d) / last < tolerance):
                break
            last = d
    return book, log


def byte_frequencies(data: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, b, n) of a byte table (keys, pos, b)."""
    return data.groupBy(*keys, "b").agg(F.count("*").alias("n"))


def huffman_codes(freq: dict[int, int]) -> dict[int, str]:
    """Codes by merging the two least frequent nodes, ties by their least symbol; a lone symbol gets '0'."""
    if not freq:
        return {}
    if len(freq) == 1:
        return {next(iter(freq)): "0"}
    heap = [(n, s, s) for s, n in freq.items()]
    heapq.heapify(heap)
    codes = dict.fromkeys(freq, "")
    while len(heap) > 1:
        (n0, s0, left), (n1, s1, right) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (n0 + n1, min(s0, s1), (left, right)))
    stack = [(heap[0][2], "")]
    while stack:
        node, code = stack.pop()
        if isinstance(node, tuple):
            stack += [(node[0], code + "0"), (node[1], code + "1")]
        else:
            codes[node] = code
    return codes


def huffman_table(freq: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, b, n, code): each text's own codes. A text has 256 symbols at most, so its frequencies are one small array; many texts go to
    Python in a batch."""

    @F.pandas_udf("array<struct<b:int,n:bigint,code:string>>")
    def build(texts: pd.Series) -> pd.Series:
        out = []
        for symbols in texts:
            n = {int(x["b"]): int(x["n"]) for x in symbols}
            codes = huffman_codes(n)
            out.append([{"b": b, "n": n[b], "code": codes[b]} for b in n])
        return pd.Series(out)

    texts = freq.groupBy(*keys).agg(F.collect_list(F.struct(F.col("b").cast("int").alias("b"), F.col("n").cast("long").alias("n"))).alias("s"))
    return texts.select(*keys, F.explode(build("s")).alias("x")).select(*keys, "x.*")


def huffman_size(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_bytes, n_symbols, encoded_bits, ratio): ratio is encoded over original bits."""
    got = table.groupBy(*keys).agg(F.sum("n").alias("n_bytes"), F.count("*").alias("n_symbols"), F.sum(F.col("n") * F.length("code")).alias("encoded_bits"))
    return got.withColumn("ratio", F.col("encoded_bits") / (F.col("n_bytes") * 8))


def huffman_encode(data: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bits): codes of (keys, pos, b) in order; symbols without a code are skipped. Both sides are brought to a row a text before they
    are joined: rows of bytes count as small by Spark's estimate, which knows nothing of exploded texts, and would be broadcast."""

    @F.pandas_udf("string")
    def write(places: pd.Series, book: pd.Series) -> pd.Series:
        out = []
        for x, codes in zip(places, book, strict=True):
            codes = dict(codes)
            got = [codes[b] for b in (np.sort(x) & 255).tolist() if b in codes]
            out.append("".join(got) if got else None)
        return pd.Series(out, dtype=object)

    texts = data.groupBy(*keys).agg(F.collect_list(F.col("pos").cast("long") * 256 + F.col("b")).alias("places"))
    books = table.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("b", "code"))).alias("book"))
    return texts.join(books.hint("merge"), keys).select(*keys, write("places", "book").alias("bits")).where("bits is not null")


def huffman_decode(encoded: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): bytes of bits by walking the codes."""
    books = table.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("code", "b"))).alias("book"))

    @F.pandas_udf("binary")
    def walk(bits: pd.Series, book: pd.Series) -> pd.Series:
        out = []
        for text, codes in zip(bits, book, strict=True):
            codes, got, s = dict(codes), bytearray(), 0
            for e in range(1, len(text) + 1):
                if (b := codes.get(text[s:e])) is not None:
                    got.append(b)
                    s = e
            out.append(bytes(got))
        return pd.Series(out)

    return encoded.join(books.hint("merge"), keys).select(*keys, walk("bits", "book").alias("content"))
