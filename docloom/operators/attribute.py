"""Where given passages stand in documents, exactly, for passages of any length and at any border.

Both are read as UTF-8. A passage of LONG bytes or more is found by its anchors: of every SPAN neighbouring windows of WINDOW
bytes the one with the least hash is an anchor, in a passage as in a document, so that all anchors of a passage are anchors of
every document that holds it. A shorter passage is found by its windows of SHORT bytes, one shorter than that by itself; a
document gives those windows only where a passage asks for such. A passage goes by the anchor that fewest documents have, and
each document that has it is searched for the whole passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources import io

WINDOW, SPAN = 16, 17
LONG, SHORT = WINDOW + SPAN - 1, 4
#: Bytes of texts that are hashed at once.
PIECE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)


def _windows(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k bytes."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * _STEP + _TURN[data[i : i + n]]
    h ^= h >> np.uint64(29)
    return h * _STEP


def _least(h: np.ndarray) -> np.ndarray:
    """The distinct least hashes of each SPAN neighbours."""
    if len(h) < SPAN:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, SPAN).min(axis=1))


def anchors(text: bytes, k: int) -> np.ndarray:
    """The distinct anchors of a text: least hashes for k = WINDOW, else the hashes of all windows of k bytes."""
    data, found = np.frombuffer(text, dtype=np.uint8), []
    for at in range(0, max(1, len(data)), PIECE):
        h = _windows(data[at : at + PIECE + k + SPAN - 2], k)
        found.append(_least(h) if k == WINDOW else np.unique(h))
    return np.unique(np.concatenate(found))


def _keys(df: DataFrame, id_: str, text: str, kinds: list[int] | None) -> DataFrame:
    """(id, kind, key): the anchors of each text, of these kinds of windows, or of the kind that its own length asks for."""

    def run(batches):
        for batch in batches:
            ids, kind, key = [], [], []
            for i, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                n = len(raw)
                own = kinds if kinds is not None else [WINDOW if n >= LONG else SHORT if n >= SHORT else n]
                for k in own:
                    found = anchors(raw, k) if k else np.zeros(1, dtype=np.uint64)
                    ids.append(np.full(len(found), i)), kind.append(np.full(len(found), k, dtype=np.int32)), key.append(found.view(np.int64))
            at = pa.array(np.concatenate(ids)) if ids else pa.array([], pa.int64())
            columns = [batch.column("id").take(at), pa.array(np.concatenate(kind) if kind else [], pa.int32()), pa.array(np.concatenate(key) if key else [], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "kind", "key"])

    texts = df.select(F.col(id_).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, kind int, key long")


def places(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id, place): each passage (item_id, text) in each document (doc_id, text) that holds it.

    The place is that of the first character, from 1. An empty passage stands at 1 in every document; null ones and null
    documents take no part. Rows that repeat an id are distinct texts of it; a pair of ids comes once for each.
    """
    d = docs.select("doc_id", "text").where("text IS NOT NULL")
    p = passages.select("item_id", "text").where("text IS NOT NULL")
    # what stands for a row is a hash of its text beside its id, so that repeated ids are apart
    p = io.staged(p.withColumn("item", F.struct("item_id", F.xxhash64("text").alias("h"))), "passages")
    asked = io.staged(_keys(p, "item", "text", None), "anchors")
    kinds = sorted(r[0] for r in asked.select("kind").distinct().collect())  # five at most
    has = _keys(d, "doc_id", "text", kinds) if kinds else d.select(F.col("doc_id").alias("id"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key")).limit(0)
    keys = asked.select("kind", "key").distinct()
    has = io.staged(has.join(keys, ["kind", "key"]), "met")
    df = has.groupBy("kind", "key").agg(F.count("*").alias("df"))
    rarest = asked.join(df, ["kind", "key"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = rarest.groupBy("id").agg(F.min(F.struct("df", "kind", "key")).alias("a")).where("a.df > 0").select(F.col("id").alias("item"), "a.kind", "a.key")
    near = has.join(rarest, ["kind", "key"]).select(F.col("id").alias("doc_id"), "item").distinct()
    met = near.join(p.withColumnRenamed("text", "passage").select("item", "passage"), "item").join(d, "doc_id")
    return met.select("doc_id", F.col("item.item_id").alias("item_id"), F.instr("text", F.col("passage")).alias("place")).where("place > 0")
