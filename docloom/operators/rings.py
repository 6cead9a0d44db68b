"""Exact best inner products without meeting all pairs (R5): vectors lie in rings around pivots, and the triangle inequality leaves rings out.

Pivots are fitted on a bounded sample, the SAMPLE vectors of least hash: up to PIVOTS of them, each the farthest from those
before, then moved MOVES times to the middle of what is nearest to them. Every vector of the table lies with its nearest
pivot, in one of RINGS rings by its distance. So there are PIVOTS * RINGS rings at most, whatever the table's size: their
table (rows, least and greatest distance, greatest norm) is bounded and goes to every task. A ring of many rows is dealt into
cells of about CELL rows, by which the vectors are bucketed, so that they meet questions without being dealt anew.

A question q at distance d of a pivot p has with a ring between lo and hi of it products of at most q . p + |q| hi, and of
at most (|q|^2 + norm^2 - g^2) / 2 with g = max(d - hi, lo - d, 0). Round one scores the rings of greatest bound that hold k
rows; what the kth has is the threshold. Round two scores the other rings whose bound reaches it. No ring that could hold one
of the best is left out, so the result is that of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import io
from . import search

PIVOTS, RINGS, SAMPLE, MOVES = 64, 16, 8192, 4
#: Rows of a cell, and of a bucket's file.
CELL, BUCKET = 4096, 1 << 20
#: Scores are rounded to six decimals; a bound may miss by as much.
ROUNDED = 2e-6
_SHIFT = 1 << 32


def fit(sample: np.ndarray) -> tuple[np.ndarray, float]:
    """(pivots, width of a ring) of a sample; equal vectors give one pivot, no vectors a pivot that none lies with."""
    if not len(sample):
        return np.zeros((1, 1)), 1.0
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < PIVOTS and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    pivots = sample[chosen]
    for _ in range(MOVES):
        near = nearest(sample, pivots)
        n = np.bincount(near, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], pivots)
    away = np.sqrt(((sample - pivots[nearest(sample, pivots)]) ** 2).sum(axis=1))
    return pivots, max(float(away.max()) / RINGS, 1e-9)


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot of each vector. Which one it is matters for speed alone."""
    return ((pivots**2).sum(axis=1) - 2 * (x @ pivots.T)).argmin(axis=1)


def _rows(column: pa.Array) -> np.ndarray:
    """A batch's vectors, all of one length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def write(vectors: DataFrame, path: str) -> None:
    """An index of vectors (vec_id, embedding) at path; more columns are ignored.

    Vectors have one length and finite components; those that are null or hold a null take no part. An empty table gives an
    empty index.
    """
    spark = vectors.sparkSession
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    rows = vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    pivots, width = fit(np.stack(sample.to_numpy()).astype(np.float64) if len(sample) else np.zeros((0, 1)))

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column(1))
            pivot = nearest(x, pivots)
            away = np.sqrt(((x - pivots[pivot]) ** 2).sum(axis=1))
            ring = pivot * RINGS + np.minimum(away // width, RINGS - 1).astype(np.int64)
            columns = [batch.column(0), batch.column(1), *map(pa.array, (ring, away, np.sqrt((x**2).sum(axis=1))))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "embedding", "ring", "away", "norm"])

    kind = dict(rows.dtypes)["embedding"]
    placed = io.staged(rows.mapInArrow(place, f"vec_id long, embedding {kind}, ring long, away double, norm double"), "placed")
    rings = placed.groupBy("ring").agg(F.count("*").alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi"), F.max("norm").alias("norm"))
    rings.withColumn("cells", F.ceil(F.col("n") / CELL)).coalesce(1).write.parquet(f"{path}/rings")
    rings = spark.read.parquet(f"{path}/rings")  # PIVOTS * RINGS rows at most
    n = rings.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(4, -(-n // BUCKET))
    spark.createDataFrame([(k, p, buckets) for k, p in enumerate(pivots.tolist())], "pivot int, centre array<double>, buckets int").coalesce(1).write.parquet(f"{path}/pivots")
    cell = F.col("ring") * _SHIFT + F.pmod(F.xxhash64("vec_id"), F.col("cells"))
    celled = placed.join(F.broadcast(rings.select("ring", "cells")), "ring").select("vec_id", "embedding", cell.alias("cell"))
    io.write_bucketed(celled, f"{path}/vectors", "cell", buckets)


class Bounds:
    """The table of rings and the pivots, as it goes to the tasks."""

    def __init__(self, pivots: np.ndarray, rings):
        self.pivots = pivots
        self.ring, self.n, self.lo, self.hi, self.norm = (rings[c].to_numpy() for c in ("ring", "n", "lo", "hi", "norm"))

    def __call__(self, q: np.ndarray) -> np.ndarray:
        """What a product of each question with a vector of each ring is at most."""
        pivots = self.pivots[self.ring // RINGS]
        size = np.sqrt((q**2).sum(axis=1))[:, None]
        by_ball = q @ pivots.T + size * self.hi
        to_pivot = np.stack([np.sqrt(((self.pivots - x) ** 2).sum(axis=1)) for x in q])[:, self.ring // RINGS]
        gap = np.maximum(np.maximum(to_pivot - self.hi, self.lo - to_pivot), 0)
        by_gap = (size**2 + self.norm**2 - gap**2) / 2
        return np.minimum(by_ball, by_gap) + 1e-9 * (1 + size + self.norm + np.sqrt((pivots**2).sum(axis=1))) ** 2


class Rings:
    """The index that write() has made, for questions (query_id, q) of the vectors' length; a vector of a question's id is left out."""

    def __init__(self, spark: SparkSession, path: str):
        pivots = spark.read.parquet(f"{path}/pivots").orderBy("pivot").toPandas()
        self.vectors = io.read_bucketed(spark, f"{path}/vectors", "cell", int(pivots["buckets"].iloc[0]))
        self.rings = spark.read.parquet(f"{path}/rings")
        self.bounds = Bounds(np.stack(pivots["centre"].to_numpy()), self.rings.orderBy("ring").toPandas())

    def asked(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, q, ring, n): the rings that a question is to be compared with, of queries (query_id, q, least).

        Where `least` is null those of round one, else those that round two has to look at beside them.
        """
        table = self.bounds
        if not len(table.ring):
            return queries.select("query_id", "q", F.lit(0).cast("long").alias("ring"), F.lit(0).cast("long").alias("n")).limit(0)

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    bound = table(_rows(part.column(1)))
                    order = np.argsort(-bound, axis=1, kind="stable")
                    n = table.n[order]
                    first = np.zeros(bound.shape, dtype=bool)
                    np.put_along_axis(first, order, np.cumsum(n, axis=1) - n < k + 1, axis=1)  # one row may be the question's own
                    least = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
                    who, ring = np.nonzero(np.where(np.isnan(least), first, ~first & (bound >= least - ROUNDED)))
                    who = pa.array(who)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(who), part.column(1).take(who), pa.array(table.ring[ring]), pa.array(table.n[ring])], names=["query_id", "q", "ring", "n"])

        kind = dict(queries.dtypes)["q"]
        return queries.select("query_id", "q", "least").mapInArrow(run, f"query_id long, q {kind}, ring long, n long")

    def scored(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score) of those vectors of the asked rings that can be among a question's best k of a cell.

        A cell's vectors meet all its questions in one product of matrices.
        """
        cells = asked.join(F.broadcast(self.rings.select("ring", "cells")), "ring")
        cells = cells.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).select("query_id", "q", (F.col("ring") * _SHIFT + F.col("part")).alias("cell"))
        met = self.vectors.groupBy("cell").cogroup(cells.groupBy("cell")).applyInPandas(search.dense_block(k), "query_id long, doc_id long, score double")
        return met.withColumn("score", F.round("score", 6))

    def rounds(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(asked in round one, its best k, asked in round two)."""
        queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "q")
        one = self.asked(queries.withColumn("least", F.lit(None).cast("double")), k)
        best = io.staged(search.top_k(self.scored(one, k), k).drop("rank"), "first")
        kth = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        two = self.asked(queries.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), k)
        return one, best, two

    def best(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank): the best k, ties to the smaller id."""
        _, best, two = self.rounds(queries, k)
        return search.top_k(best.union(self.scored(two, k)), k)

    def compared(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rings, n): how many rings a question is compared with in both rounds, and how many vectors these hold."""
        one, _, two = self.rounds(queries, k)
        return one.union(two).groupBy("query_id").agg(F.count("*").alias("rings"), F.sum("n").alias("n"))
