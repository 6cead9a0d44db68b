"""Shared helpers: lineage cuts, batched word hashing, connected components."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F

#: A word is a run of bytes outside ASCII white space; the same class bytes.split() uses.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
#: Similarity of a link: SHARE / OF.
SHARE, OF = 75, 100
SLICE_BYTES = 1 << 19
ROWS = 2000
# workers live on from one operator to the next: what Arrow frees goes back to the machine
pa.set_memory_pool(pa.system_memory_pool())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir; a folder of its own only on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    """Takes a table's folder away."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def short_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have ROWS rows, as texts are long; a number that the user has set stays."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return df


#: Rows of a table that a task reads at least, as long as every core has a task.
PER_TASK = 4096


def few(rows: int, spark: SparkSession) -> int:
    """Tasks for so many rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PER_TASK))


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Reliable checkpoint of df in the shared folder, read by as many tasks as its rows need, and the number of these rows.

    Spark takes shuffle files and old checkpoints away when the driver collects what refers to them; a driver with room to
    spare would leave those of all earlier steps, so it is asked to here.
    """
    spark, seen = df.sparkSession, Observation()
    shared_folder(spark)
    spark.sparkContext._jvm.System.gc()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint()
    rows = seen.get["rows"]
    return slim(out, rows), rows


def slim(df: DataFrame, rows: int) -> DataFrame:
    """df in no more tasks than so many rows need."""
    return df.coalesce(few(rows, df.sparkSession))  # more than there are change nothing


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, read by as many tasks as its rows need."""
    return counted(df)[0]


def n_words(text: Column) -> Column:
    """Words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def before_in_order(df: DataFrame, order: str, value: str, name: str, by: tuple[str, ...] = (), span: int = 4096) -> DataFrame:
    """df, one row for each value of the long `order`, with `name`: the sum of `value` over all rows that come before.

    With `by`, sums are of the rows that share these columns, none of which is null. Rows fall into ranges of `span` places;
    a task orders one range, or the table of the ranges' sums.
    """
    earlier = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_range", F.floor(F.col(order) / span))
    sums = df.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*by, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(value).over(earlier.partitionBy(*by, "_range")), F.lit(0))
    df = df.withColumn("_own", own).join(sums, [*by, "_range"]).withColumn(name, F.col("_before") + F.col("_own"))
    return df.drop("_range", "_before", "_own")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int = SLICE_BYTES):
    """Index ranges of about `most` bytes, so that work arrays stay small whatever the batch holds."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


#: A filter of ids has 16 bits for each, between these bounds; beyond the upper one (32 MB) it only lets more rows through.
FILTER_BITS = (1 << 16, 1 << 28)
PIECE = 1 << 14
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = U(0x9E3779B97F4A7C15)
_LANES = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, offsets of each text's words, byte start of every word, byte end), for all texts at once.

    Byte positions are those of the texts joined by single spaces.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum([0] + [len(x) + 1 for x in texts])
    offsets = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), offsets, starts, ends
    size = ends - starts
    power = np.cumprod(np.full(int(size.max()), _STEP, dtype=np.uint64))
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    sums = np.add.reduceat(_BYTE[data[inside]] * power[place], np.cumsum(size) - size)
    return mix(sums + size.astype(np.uint64)), offsets, starts, ends


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word windows of one text; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    if n < SHINGLE:
        return mix((words * _LANES[:n]).sum(keepdims=True, dtype=np.uint64) + U(n))
    total = words[: n - SHINGLE + 1] * _LANES[0]
    for k in range(1, SHINGLE):
        total = total + words[k : n - SHINGLE + 1 + k] * _LANES[k]
    return mix(total)


class IdFilter:
    """A bitmap of bounded size that says no only for ids that aren't in `ids` (one column); what it lets through is joined later."""

    def __init__(self, ids: DataFrame):
        ids, n = counted(ids)
        self.bits = bits = min(max(1 << max(0, 16 * n - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])

        def places(batches):
            for batch in batches:
                p = mix(batch.column(0).to_numpy().view(np.uint64)) % U(bits)
                yield pa.RecordBatch.from_arrays([pa.array((p >> U(5)).view(np.int64)), pa.array((U(1) << (p & U(31))).view(np.int64))], names=["w", "b"])

        def pieces(frame):  # PIECE words of the bitmap as bytes, so that the driver gets the bitmap and no rows of words
            import pandas as pd

            part = np.zeros(PIECE, dtype="<u4")
            part[frame["w"].to_numpy(np.int64) % PIECE] = frame["b"].to_numpy(np.int64)
            return pd.DataFrame({"piece": [int(frame["w"].iloc[0]) // PIECE], "bits": [part.tobytes()]})

        words = slim(ids.mapInArrow(places, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")), n)
        found = slim(words.groupBy(F.floor(F.col("w") / PIECE).alias("p")).applyInPandas(pieces, "piece long, bits binary"), n).toPandas()  # bits / 8 bytes at most
        self.map = np.zeros(max(bits // 32, PIECE), dtype=np.uint32)
        for k, x in zip(found["piece"], found["bits"], strict=True):
            self.map[k * PIECE : (k + 1) * PIECE] = np.frombuffer(x, dtype="<u4")

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        p = mix(ids.view(np.uint64)) % U(self.bits)
        return (self.map[(p >> U(5)).view(np.int64)] >> (p & U(31)).astype(np.uint32)) & 1 == 1


def dense_key(ids: np.ndarray) -> int:
    """A key of a set of ids, whatever their order."""
    return int(mix(np.sort(ids).view(np.uint64)).sum(dtype=np.uint64).astype(np.int64))


#: Shingles of a dense group that one half of a task holds; one set may be larger.
HALF = 1 << 22


def dense_rows(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (key, id): the members of a dense group under the keys of the tasks that confirm it.

    A group whose sets (sizes, in shingles) pass HALF is dealt into parts of HALF, and any two parts meet in a task of their
    own: each pair meets somewhere, and what the tasks link is all that is linked in the group.
    """
    order = np.argsort(ids)
    ids, sizes, key = ids[order], sizes[order].astype(np.int64), dense_key(ids)
    part = (np.cumsum(sizes) - sizes) // HALF
    _, part = np.unique(part, return_inverse=True)
    n = int(part.max(initial=0)) + 1
    if n == 1:
        return np.stack([np.full(len(ids), key), ids], axis=1)
    row, other = np.nonzero(part[:, None] != np.arange(n))
    x, y = np.minimum(part[row], other), np.maximum(part[row], other)
    keys = mix(np.full(len(row), key, dtype=np.int64).view(np.uint64) + mix((x * n + y + 1).astype(np.uint64)))
    return np.stack([keys.view(np.int64), ids[row]], axis=1)


def confirm_groups(batches):
    """Links (a, b) that join all that is linked within each group of members (id, shingles), by their full sets."""
    for batch in batches:
        lists = batch.column("members")
        flat, at = lists.flatten(), np.cumsum([0] + pc.list_value_length(lists).to_pylist())
        ids, inner = flat.field(0).to_numpy(), flat.field(1)
        values, begin = inner.flatten().to_numpy(), np.cumsum([0] + pc.list_value_length(inner).to_pylist())
        links = []
        for k in range(len(at) - 1):
            n, lo = int(at[k + 1] - at[k]), int(at[k])
            sizes = begin[lo + 1 : lo + n + 1] - begin[lo : lo + n]
            owner = np.repeat(np.arange(n), sizes)
            _, column, count = np.unique(values[begin[lo] : begin[lo + n]], return_inverse=True, return_counts=True)
            shared = np.cumsum(count > 1) - 1
            owner, column = owner[count[column] > 1], shared[column[count[column] > 1]]
            common = np.zeros((n, n), dtype=np.float32)
            for c in range(0, len(set(column.tolist())), 4096):
                part = (column >= c) & (column < c + 4096)
                inc = np.zeros((n, 4096), dtype=np.float32)
                inc[owner[part], column[part] - c] = 1
                common += inc @ inc.T
            near = OF * common >= SHARE * (sizes[:, None] + sizes[None, :] - common)
            seen = np.zeros(n, dtype=bool)
            for i in range(n):
                todo = [] if seen[i] else [i]
                seen[i] = True
                while todo:
                    x = todo.pop()
                    for y in np.flatnonzero(near[x] & ~seen):
                        seen[y] = True
                        todo.append(y)
                        links.append((ids[lo + x], ids[lo + y]))
        pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1, initial=2**63 - 1)), pa.array(pairs.max(axis=1, initial=-(2**63)))], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(id, component): smallest id reachable over edges (a, b); ids that have no edge are left out.

    After most_rounds, if given, it may stop with components that are parts of the true ones.

    Alternating large and small stars; minima by partial aggregation, so hubs are never gathered, and
    the joins are plain equi-joins that adaptive execution can split.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    (e, n), rounds = counted(e), 0
    while True:
        rounds += 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, n = counted(slim(slim(small, n).union(slim(low.select("u", "m"), n)).distinct(), n))
        # done when no root is a member elsewhere
        ends = e.select(F.col("u").alias("id"), F.lit(True).alias("member"), F.lit(False).alias("root")).union(e.select("v", F.lit(False), F.lit(True)))
        ends = ends.groupBy("id").agg(F.max("member").alias("member"), F.max("root").alias("root"))
        if rounds == most_rounds or slim(ends.where("member AND root"), n).isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("c")).union(e.select("v", "v")).groupBy("id").agg(F.min("c").alias("component"))
