"""Mixture-controlled packing: deficit round-robin over source queues fills windows of 2048 tokens.

1. Every text becomes token ids once (two bytes each), checkpointed beside its count.
2. A source's queue is its documents in the order of a seeded hash. Where a document starts in its queue, as a share
   of the queue, is its virtual time; sums over hash buckets of a queue come first, so no source is in one task.
3. Bins are equal ranges of virtual time: each holds the target share of every source to within one document. The
   tokens of all earlier bins give the bin's place in the one global token line and what each source is still owed,
   so deficits carry from bin to bin as from window to window.
4. In a bin, round-robin with deficits: a source is credited its share of a window each round and serves pieces of
   up to PIECE tokens while its credit lasts; pieces are cut where a window ends.
5. Windows run on through bins; only the end of the whole line is short, and it is split into powers of two, which
   need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import before_in_order, cut, short_batches

WINDOW = 2048
PIECE = 512
END = 1
BIN_TOKENS = 1_000_000
BUCKETS = 4096
SEED = 20240817
VOCABULARY = "byte_bpe_50k.tiktoken"
# fixed values: the special token of that vocabulary
SPECIAL = {"<|endoftext|>": 50256}


def tokenizer(name: str = VOCABULARY):
    """The public byte-level BPE; its ranks file holds the ids of byte_bpe_50k.json and encodes three times as fast.

    Its one special token is read in texts as that file's tokenizer reads it.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def _encode(batches):
    from itertools import count

    code, number = tokenizer(), count(TaskContext.get().partitionId() << 33)
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            ids = [np.append(code.encode_to_numpy(x or "", allowed_special="all"), END).astype(np.uint16) for x in part.column("text").to_pylist()]
            rows = pa.array([next(number) for _ in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows, part.column("doc_id"), part.column("source"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["row", "doc_id", "source", "n", "ids"],
            )


def round_robin(queues: list[list[tuple[int, int]]], share: np.ndarray, owed: np.ndarray, window: int = WINDOW, piece: int = PIECE):
    """Pieces (row, start, length) in the order in which deficit round-robin serves the queues of (row, tokens)."""
    credit = owed.astype(float)
    at = [0] * len(queues)
    done = [0] * len(queues)
    live = [s for s in range(len(queues)) if queues[s]]
    while live:
        lift = 1
        if all(credit[s] + share[s] * window < 0 for s in live):  # rounds in which nobody could serve
            lift = max(1, int(min(-credit[s] / max(share[s] * window, 1e-9) for s in live)))
        for s in list(live):
            credit[s] += lift * share[s] * window
            while at[s] < len(queues[s]):
                row, n = queues[s][at[s]]
                size = min(piece, n - done[s])
                if credit[s] < size and len(live) > 1:
                    break
                yield row, done[s], size
                credit[s] -= size
                done[s] += size
                if done[s] == n:
                    at[s], done[s] = at[s] + 1, 0
            if at[s] == len(queues[s]):
                live.remove(s)


def tail_lengths(rest: int) -> list[int]:
    """The sequences that hold the last tokens: powers of two, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _layout(total: int, position: int) -> tuple[int, int, int]:
    """(sequence, offset in it, tokens up to its end) of a place in the line of `total` tokens."""
    full = total // WINDOW
    if position < full * WINDOW:
        return position // WINDOW, position % WINDOW, WINDOW - position % WINDOW
    rest, n = position - full * WINDOW, full
    for size in tail_lengths(total % WINDOW):
        if rest < size:
            return n, rest, size - rest
        rest, n = rest - size, n + 1
    raise ValueError(position)


def pack_bin(pdf):
    """Pieces of one bin; its rows carry the bin's start, the line's length, the source's share and what it is owed."""
    import pandas as pd

    pdf = pdf.sort_values(["source_rank", "h", "row"], kind="stable")
    total, position = int(pdf["total"].iloc[0]), int(pdf["bin_start"].iloc[0])
    queues, share, owed = [], [], []
    for _, g in pdf.groupby("source_rank", sort=True):
        queues.append(list(zip(g["row"].tolist(), g["n"].tolist(), strict=True)))
        share.append(float(g["share"].iloc[0]))
        owed.append(float(g["owed"].iloc[0]))
    rows, last = [], None
    for row, start, size in round_robin(queues, np.array(share), np.array(owed)):
        while size:
            sequence, offset, room = _layout(total, position)
            k = min(size, room)
            if last and last[0] == row and last[3] == sequence and last[1] + last[2] == start and last[4] + last[2] == offset:
                last[2] += k
            else:
                last = [row, start, k, sequence, offset]
                rows.append(last)
            start, size, position = start + k, size - k, position + k
    return pd.DataFrame(rows, columns=["row", "start", "length", "sequence_id", "offset"]).astype("int64")


def _explode(batches):
    """One row for each piece, from one row for each document that has the list of its pieces."""
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for doc, n, raw, pieces in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n", "ids", "pieces")), strict=True):
                ids = np.frombuffer(raw, np.uint16)
                for p in sorted(pieces, key=lambda p: p["start"]):
                    s, k = p["start"], p["length"]
                    crc = zlib.crc32(ids[s : s + k].astype("<u4").tobytes())
                    for c, v in zip(cols, (doc, s, k, crc, n, p["sequence_id"], p["offset"]), strict=True):
                        cols[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in cols.values()], names=list(cols))


def plan(counts: DataFrame, bin_tokens: int = BIN_TOKENS) -> DataFrame:
    """(row, start, length, sequence_id, offset): where each piece of the documents (row, source, n) goes."""
    c = counts.select("row", "n", F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("row", "n", F.lit(SEED)).alias("h"))
    c = c.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 8), F.lit(BUCKETS))).withColumn("h", F.struct("bucket", "h"))
    by_bucket = c.groupBy("known", "source", "bucket").agg(F.sum("n").alias("in_bucket"))
    by_source = W.partitionBy("known", "source")
    everything = W.partitionBy(F.lit(0))  # over sums of sources only
    before = F.sum("in_bucket").over(by_source.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    sources = by_bucket.groupBy("known", "source").agg(F.sum("in_bucket").alias("of_source"))
    sources = sources.withColumn("total", F.sum("of_source").over(everything)).withColumn("source_rank", F.row_number().over(everything.orderBy("known", "source")))
    by_bucket = by_bucket.withColumn("bucket_start", F.coalesce(before, F.lit(0))).join(sources, ["known", "source"])
    c = c.join(by_bucket, ["known", "source", "bucket"])
    inside = F.sum("n").over(W.partitionBy("known", "source", "bucket").orderBy("h", "row").rowsBetween(W.unboundedPreceding, -1))
    c = c.withColumn("from", F.col("bucket_start") + F.coalesce(inside, F.lit(0)))
    bins = F.ceil(F.col("total") / bin_tokens)
    c = c.withColumn("bin", F.floor(F.col("from") / F.col("of_source") * bins).cast("long"))
    c = cut(c.select("row", "n", "source_rank", "h", "bin", "of_source", "total"))
    sums = c.groupBy("source_rank", "bin").agg(F.sum("n").alias("in_bin"), F.first("of_source").alias("of_source"), F.first("total").alias("total"))
    # bins that come before, over all sources: sums of a table of (bin, tokens)
    per_bin = sums.groupBy("bin").agg(F.sum("in_bin").alias("all_in_bin"))
    per_bin = before_in_order(per_bin, "bin", "all_in_bin", "bin_start").select("bin", "bin_start")
    sums = before_in_order(sums, "bin", "in_bin", "served", by=("source_rank",))
    sums = sums.join(per_bin, "bin").withColumn("share", F.col("of_source") / F.col("total"))
    sums = sums.withColumn("owed", F.col("share") * F.col("bin_start") - F.col("served"))
    filled = c.join(sums.select("source_rank", "bin", "bin_start", "share", "owed"), ["source_rank", "bin"])
    filled = filled.select("row", "n", "source_rank", F.col("h.h").alias("h"), "bin", "total", "bin_start", "share", "owed")
    return filled.groupBy("bin").applyInPandas(pack_bin, "row long, start long, length long, sequence_id long, offset long")


def pack(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece.

    Each row of docs (doc_id, text, source; more are ignored) is one document: a null or empty text is the end id
    alone; a null source is a source of its own; rows that repeat a doc_id are packed each; the string of
    the vocabulary's special token in a text is that token. An empty table gives an empty result.
    """
    docs = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    tokens = cut(docs.mapInArrow(_encode, "row long, doc_id long, source string, n long, ids binary"))
    pieces = plan(tokens.select("row", "source", "n"))
    pieces = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    out = tokens.select("row", "doc_id", "n", "ids").join(pieces, "row").select("doc_id", "n", "ids", "pieces")
    return out.mapInArrow(_explode, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
