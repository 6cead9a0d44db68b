"""Hard negatives by blocked products: blocks of anchors are broadcast, every task multiplies them with its own rows.

Anchors are numbered exactly and cut into blocks of BLOCK_BYTES; a block is a broadcast of that size, whatever the table's. A
task reads its rows as Arrow batches and multiplies GEMM anchors with SLICE rows at a time. Products are of whole numbers in
doubles, exact where the norms' product is below 2^53, and in 64-bit integers beyond. First pass: each task keeps each
anchor's best rows of its own label, and these lists merge to the positives. Second pass: blocks go out again with the windows
that their positives' scores set, and each task keeps the best rows of other labels inside each window. Rows are never
shuffled; what is shuffled are short lists.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import before_in_order, cut, short_batches
from .vector_search import scaled

BLOCK_BYTES = 1 << 24
GEMM, SLICE = 256, 2048
#: Products of vectors whose squared norms stay below these are exact in doubles, and in 64-bit integers.
EXACT, MOST = 2.0**53, 9.2e18
NONE = np.iinfo(np.int64).min


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows as 64-bit integers, exact for squared norms below MOST."""
    most = [(x * x).sum(axis=1).max(initial=0) for x in (a, b)]
    if most[0] * most[1] < EXACT * EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


class Best:
    """The best k (score, id) of each of n lists, higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.zeros((n, k), dtype=np.int64)

    def add(self, at: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Scores (lists from `at` on x rows, which are in order of their ids), where allowed."""
        k, own = self.k, slice(at, at + len(scores))
        allowed = allowed & (scores >= self.score[own, -1:])
        row, col = np.nonzero(allowed)
        if len(row) > 4 * k * len(scores):  # ties and first slices: cut each list to k before lists are merged
            n = scores.shape[1]
            if np.abs(scores).max() < 2**62 // n:
                key = np.where(allowed, scores * n + (n - 1 - np.arange(n)), NONE)
                top = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(scores), 1))
            else:
                top = np.argsort(np.where(allowed, scores, NONE)[:, ::-1], axis=1, kind="stable")[:, ::-1][:, :k]
                top = n - 1 - top
            row, col = np.repeat(np.arange(len(scores)), top.shape[1]), top.ravel()
            row, col = row[allowed[row, col]], col[allowed[row, col]]
        if not len(row):
            return
        old = self.score[own] != NONE
        row = np.concatenate([np.nonzero(old)[0], row])
        score = np.concatenate([self.score[own][old], scores[row[old.sum() :], col]])
        vec = np.concatenate([self.id[own][old], ids[col]])
        order = np.lexsort((vec, ~score, row))
        row, score, vec = row[order], score[order], vec[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, score, vec, rank = (x[rank < k] for x in (row, score, vec, rank))
        self.score[at + row, rank], self.id[at + row, rank] = score, vec

    def lists(self):
        """(list, score, id) of all that is held."""
        row, rank = np.nonzero(self.score != NONE)
        return row, self.score[row, rank], self.id[row, rank]


def _rows(batch: pa.RecordBatch):
    """(ids, labels, vectors) of the rows that take part, for each length of vectors, in order of ids, SLICE at a time."""
    lists, ids = batch.column("embedding"), batch.column("vec_id").to_numpy()
    labels = batch.column("label").to_numpy(zero_copy_only=False)
    flat, at = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    begin = np.cumsum(at) - at
    values = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * 256)  # null becomes NaN
    for dim in np.unique(at[at > 0]):
        own = np.flatnonzero(at == dim)
        own = own[np.argsort(ids[own], kind="stable")]
        for i in range(0, len(own), SLICE):
            part = own[i : i + SLICE]
            with np.errstate(all="ignore"):
                x = values[begin[part][:, None] + np.arange(dim)]
                fit = (x * x).sum(axis=1) < MOST  # no for NaN and infinity
            if fit.any():
                yield ids[part][fit], labels[part][fit], x[fit]


def _positives(block, k: int):
    def run(batches):
        who, label, x, _ = block.value
        best = Best(len(who), k)
        for batch in batches:
            for ids, labels, rows in _rows(batch):
                for i in range(0, len(who), GEMM):
                    if rows.shape[1] == x.shape[1]:
                        same = (label[i : i + GEMM, None] == labels) & (who[i : i + GEMM, None] != ids)
                        best.add(i, products(x[i : i + GEMM], rows), same, ids)
        row, score, vec = best.lists()
        yield pa.RecordBatch.from_arrays([pa.array(who[row]), pa.array(vec), pa.array(score)], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(block, k: int, low: int, high: int):
    def run(batches):
        who, label, x, found = block.value
        ids_, scores_ = found  # positives' ids and scores, anchors x ranks; no score is NONE
        given = scores_ != NONE
        least = np.array([[-((-low * int(s)) // 100) for s in r] for r in scores_], dtype=object)
        most = np.array([[high * int(s) // 100 for s in r] for r in scores_], dtype=object)
        clip = lambda v: np.clip(v, NONE + 1, -(NONE + 1)).astype(np.int64).reshape(scores_.shape)
        least, most = clip(least), clip(most)
        best = [Best(len(who), k) for _ in range(scores_.shape[1])]
        for batch in batches:
            for ids, labels, rows in _rows(batch):
                if rows.shape[1] != x.shape[1]:
                    continue
                for i in range(0, len(who), GEMM):
                    own = slice(i, i + GEMM)
                    s = products(x[own], rows)
                    other = (label[own, None] != labels) & (who[own, None] != ids)
                    for j, b in enumerate(best):
                        b.add(i, s, other & given[own, j, None] & (s >= least[own, j, None]) & (s <= most[own, j, None]), ids)
        for j, b in enumerate(best):
            row, score, vec = b.lists()
            columns = [who[row], np.full(len(row), j + 1, dtype=np.int32), ids_[row, j], scores_[row, j], vec, score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where is_anchor holds.

    vectors: (vec_id, embedding, label); more columns are ignored. A component x counts as floor(256 x), a score is the
    inner product, ties go to the smaller vec_id. Positives are an anchor's best rows of its label; negatives of a positive
    the best rows of other labels whose score is from low to high percent of the positive's (none for a negative score).
    Rows with a null id, label or vector, an empty vector, a null or non-finite component take no part, nor do those whose
    squared norm passes 9.2e18, where scores fit no long. Vectors of different lengths don't meet. Rows that share the
    anchor's vec_id are not its partners; other rows that repeat a vec_id count each; of anchors that repeat one, the one
    with the smallest label and vector counts. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    v = short_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")).where("vec_id IS NOT NULL AND label IS NOT NULL")
    form = dict(v.dtypes)["label"]
    x = F.transform(scaled(F.col("embedding")), lambda c: F.floor(c).cast("double"))
    asked = v.where(is_anchor).select("vec_id", F.struct("label", x.alias("x")).alias("a")).where("size(a.x) > 0")
    asked = asked.where(F.aggregate("a.x", F.lit(0.0), lambda s, c: s + c * c) < MOST).groupBy("vec_id").agg(F.min("a").alias("a"))
    asked = asked.select("vec_id", "a.label", "a.x", F.size("a.x").alias("dim"))
    # lengths of vectors are few; the blocks of each length are cut by exact place
    widths = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    blocks = []
    for dim in sorted(widths):
        per = max(1, block_bytes // (8 * dim))
        own = before_in_order(asked.where(F.col("dim") == dim).withColumn("one", F.lit(1).cast("long")), "vec_id", "one", "place")
        own = cut(own.select("vec_id", "label", "x", F.floor(F.col("place") / per).alias("block")))
        blocks += [(own.where(F.col("block") == k)) for k in range(-(-widths[dim] // per))]

    def sent(block, found=None):
        rows = block.orderBy("vec_id").toPandas()  # block_bytes at most
        who = rows["vec_id"].to_numpy(np.int64)
        at = None
        if found is not None:
            ids, scores = np.zeros((len(who), positives), dtype=np.int64), np.full((len(who), positives), NONE)
            own = found.join(block.select(F.col("vec_id").alias("anchor_id")), "anchor_id", "left_semi").toPandas()
            row, rank = np.searchsorted(who, own["anchor_id"]), own["rank"].to_numpy() - 1
            ids[row, rank], scores[row, rank] = own["positive_id"], own["positive_score"]
            at = (ids, scores)
        return spark.sparkContext.broadcast((who, rows["label"].to_numpy(), np.stack(rows["x"].to_numpy()).astype(np.float64), at))

    found_form, out = "anchor_id long, positive_id long, positive_score long", "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not blocks:
        return spark.createDataFrame([], out)
    ranked = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = reduce(DataFrame.union, [v.mapInArrow(_positives(sent(b), positives), found_form) for b in blocks])
    near = cut(near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= positives))
    form = "anchor_id long, nth int, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = reduce(DataFrame.union, [v.mapInArrow(_negatives(sent(b, near), negatives, low, high), form) for b in blocks])
    ranked = W.partitionBy("anchor_id", "nth").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mislabelled(vectors: DataFrame) -> DataFrame:
    """vectors where each seventh label is wrong: (label + 1) % 10 where vec_id is divisible by 7."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


#: DuckDB's statement of the result for every hundredth row.
ORACLE = """
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id != c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
