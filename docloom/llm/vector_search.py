"""Exact top-k by inner product: a ball tree in each shard, branch and bound with a shared kth score.

Vectors are dealt to shards of about SHARD rows by a hash; a shard's tree is one row. Queries travel in blocks of BLOCK
rows. First each block searches one shard, which gives each query a kth score; then block and kth scores go to all
other shards, where nodes are taken by their upper bound q . c + |q| r and left once it is below the kth score, or equal
to it without a smaller id. Every shard returns what can still be among the best k; the last step ranks it. The
work of a stated query set against all rows is theirs by nature; nothing is broadcast and no task holds more than a
shard and a block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

SHARD = 4096
BLOCK = 256
LEAF = 64
#: Up to here sums of products are exact in a double.
EXACT = 2.0**52
#: No float reaches this after scaling; doubles that do would overflow sums and count as not finite.
MOST = 2.0**500


def scaled(embedding, factor: int = 256):
    """factor * x of each component as double; null where a component is null or not finite."""
    e = F.transform(embedding.cast("array<double>"), lambda x: x * factor)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= MOST))
    return F.when(e.isNotNull() & ~F.coalesce(bad, F.lit(True)), e)


def unpack(raw: bytes, n: int, dim: int) -> np.ndarray:
    """n vectors of whole numbers as doubles; _pack gave each component 4 bytes, or 8 where 4 don't hold it."""
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def build_tree(ids: np.ndarray, x: np.ndarray) -> dict:
    """A ball tree: nodes as arrays (centre, radius, smallest id, children or row range)."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    rows = np.arange(len(ids))
    centre, radius, least, left, right, begin, end = [], [], [], [], [], [], []
    place = np.zeros(len(ids), dtype=np.int64)

    def node(part):
        c = x[part].mean(axis=0)
        centre.append(c)
        radius.append(np.sqrt(((x[part] - c) ** 2).sum(axis=1).max()) * (1 + 1e-9) + 1e-6)
        least.append(ids[part].min())
        for a in (left, right, begin, end):
            a.append(-1)
        return len(centre) - 1

    todo, used = [(node(rows), rows)], 0
    while todo:
        k, part = todo.pop()
        if len(part) <= LEAF:
            begin[k], end[k] = used, used + len(part)
            place[used : used + len(part)] = part
            used += len(part)
            continue
        far = part[((x[part] - centre[k]) ** 2).sum(axis=1).argmax()]
        other = part[((x[part] - x[far]) ** 2).sum(axis=1).argmax()]
        side = np.argsort(x[part] @ (x[far] - x[other]), kind="stable")
        half = len(part) // 2
        a, b = part[np.sort(side[:half])], part[np.sort(side[half:])]
        left[k], right[k] = node(a), node(b)
        todo += [(left[k], a), (right[k], b)]
    return {
        "centre": np.array(centre), "radius": np.array(radius), "least": np.array(least), "left": np.array(left), "right": np.array(right),
        "begin": np.array(begin), "end": np.array(end), "ids": ids[place], "x": x[place], "most": float(np.abs(x).max()),
    }


def search(tree: dict, own: int, q: np.ndarray, k: int, kth: float) -> list[tuple[int, int]]:
    """The best (score, id) of a tree for a query, at most k, that are not below kth; own is left out.

    Scores are whole numbers of any size: where products don't fit a double, rounded scores only pick what is summed exactly.
    """
    size, dim = np.sqrt(q @ q), len(q)
    exact = dim * tree["most"] * np.abs(q).max() < EXACT
    reach = np.sqrt((tree["centre"] ** 2).sum(axis=1)) + tree["radius"]
    slack = 1e-6 + 1e-14 * dim * size * reach
    bound = tree["centre"] @ q + tree["radius"] * size + slack
    heap, best = [(-bound[0], 0)], []  # best: heap of (score, -id)
    whole = None if exact else [int(c) for c in q]
    while heap:
        b, n = heapq.heappop(heap)
        least = max(kth, best[0][0]) if len(best) == k else kth
        if -b < least:
            break
        if tree["left"][n] >= 0:
            for c in (tree["left"][n], tree["right"][n]):
                if bound[c] >= least:
                    heapq.heappush(heap, (-bound[c], c))
            continue
        if len(best) == k and -b < best[0][0] + 1 and tree["least"][n] > -best[0][1]:
            continue
        i, j = tree["begin"][n], tree["end"][n]
        scores = tree["x"][i:j] @ q
        for r in np.flatnonzero(scores + (0 if exact else slack[n]) >= float(least)):
            vec = int(tree["ids"][i + r])
            if vec == own:
                continue
            entry = (int(scores[r]) if exact else sum(c * int(x) for c, x in zip(whole, tree["x"][i + r], strict=True)), -vec)
            if entry[0] < kth:
                continue
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return [(s, -v) for s, v in best]


LONG = 2**63 - 1


def _searcher(k: int, width: int):
    """Found rows with the score as a long (the nearest, where it doesn't fit) and as `width` bytes that sort as it does."""

    def run(batches):
        trees: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                key, dim = (row["dim"].as_py(), row["shard"].as_py()), row["dim"].as_py()
                if key not in trees:
                    ids = row["ids"].values.to_numpy(zero_copy_only=False)
                    trees = {key: build_tree(ids, unpack(row["x"].as_py(), len(ids), dim))}
                tree = trees[key]
                who = row["who"].values.to_numpy(zero_copy_only=False)
                q = unpack(row["q"].as_py(), len(who), dim)
                kth = np.frombuffer(row["kth"].as_py(), np.float64) if row["kth"].is_valid else np.full(len(who), -np.inf)
                out = [(int(w), s, v) for w, vec, lim in zip(who, q, kth, strict=True) for s, v in search(tree, int(w), vec, k, lim)]
                query, score, vec = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [])
                order = pa.array([(s + (1 << 8 * width - 1)).to_bytes(width, "big") for s in score], pa.binary())
                score = pa.array([max(-LONG - 1, min(LONG, s)) for s in score], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), score, order], names=["query_id", "vec_id", "score", "place"])

    return run


def _pack(frame):
    """One row for a group of vectors: ids and the whole parts of their components, as 32-bit integers where these fit."""
    import pandas as pd

    frame = frame.sort_values("vec_id")
    x = np.floor(np.stack(frame["v"].to_numpy()))
    x = x.astype(np.int32) if np.abs(x).max() < 2**31 else x
    return pd.DataFrame({"dim": [x.shape[1]], "part": [int(frame["part"].iloc[0])], "ids": [frame["vec_id"].to_numpy()], "x": [x.tobytes()]})


def _block_kth(k: int):
    def run(frame):
        import pandas as pd

        ids = np.asarray(frame["who"].iloc[0])
        kth = {}
        for q, s in zip(frame["query_id"], frame["scores"], strict=True):
            if s is not None and len(s) == k and min(s) > -LONG - 1:
                kth[q] = float(min(s)) if abs(min(s)) < EXACT else np.nextafter(float(min(s)), -np.inf)
        return pd.DataFrame({"dim": [frame["dim"].iloc[0]], "block": [frame["block"].iloc[0]], "kth": [np.array([kth.get(i, -np.inf) for i in ids]).tobytes()]})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where is_query holds against all other rows.

    vectors: (vec_id, embedding); more columns are ignored. Rows with a null id, a null or empty vector, or a null or
    non-finite component (in arrays of doubles, one whose 256-fold reaches 2^500, too) take no part. Vectors of different lengths don't
    meet. Ties go to the smaller vec_id; a repeated vec_id counts once (its smallest vector). Ranks follow the exact
    scores; a score that no long holds is given as the nearest one. An empty table gives an empty result.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("v"))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    v = v.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n, asked = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // BLOCK))
    width = 144 if "double" in dict(vectors.dtypes)["embedding"] else 48  # bytes of a sum of products of such components
    form = "dim int, part long, ids array<long>, x binary"
    tree = v.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards))).groupBy("dim", "part").applyInPandas(_pack, form)
    tree = tree.withColumnRenamed("part", "shard")
    queries = v.where(is_query).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks))).groupBy("dim", "part").applyInPandas(_pack, form)
    queries = queries.toDF("dim", "block", "who", "q")
    first = queries.withColumn("shard", F.pmod(F.col("block"), F.lit(shards))).withColumn("kth", F.lit(None).cast("binary"))
    found = "query_id long, vec_id long, score long, place binary"
    near = first.join(tree, ["dim", "shard"]).mapInArrow(_searcher(k, width), found)
    scores = near.groupBy("query_id").agg(F.collect_list("score").alias("scores"))  # k at most
    of_block = queries.select("dim", "block", "who", F.explode("who").alias("query_id")).join(scores, "query_id", "left")
    kth = of_block.groupBy("dim", "block").applyInPandas(_block_kth(k), "dim int, block long, kth binary")
    rest = queries.join(kth, ["dim", "block"]).withColumn("home", F.pmod(F.col("block"), F.lit(shards)))
    rest = rest.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).where("shard != home").drop("home")
    far = rest.repartition("dim", "shard").join(tree, ["dim", "shard"]).mapInArrow(_searcher(k, width), found) if shards > 1 else None
    all_ = near if far is None else near.union(far)
    by = W.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    return all_.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB's statement of the result for every fiftieth row and k = 5.
ORACLE = """
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
