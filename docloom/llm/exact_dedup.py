"""Exact dedup in DataFrame functions: a Bloom filter of possibly repeated hashes, then an exact comparison of what it lets through.

Texts are read once; what is written of each is its digest (doc_id, code points, SHA-256), some 50 bytes. Pass one puts each
digest in one of CELLS_PER_ROW cells a row and counts the cells, partly in each task: a cell hit twice is a bit of the
filter, and a task's share of it travels as its occupied cells alone. The filter has MOST_CELLS bits (32 MB) at most and is
broadcast as bitmaps of 4 KB. Pass two asks it for each digest: where the bit is not set no other row has that digest, and the
row passes straight through; the others are shuffled by digest and grouped exactly. With 64 cells a row 1.6 % of the unrepeated
rows are let through; beyond 4 million rows the filter stays at its size and lets more through, which changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

CELLS_PER_ROW = 64
#: Bits of the filter: least and most.
LEAST_CELLS, MOST_CELLS = 1 << 15, 1 << 28
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 1 << 15
SPACE = " \t\n\x0b\x0c\r"


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, chars, digest) of docs: code points of the text and the SHA-256 of the text without white space."""
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.translate(text, SPACE, ""), 256))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("chars"), digest.alias("digest"))


def cells(n: int, most: int = MOST_CELLS) -> int:
    """Cells of the filter for n rows: a power of two between the bounds."""
    return min(max(1 << max(0, CELLS_PER_ROW * n - 1).bit_length(), LEAST_CELLS), most)


def _cell(digest: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(n))


def repeated_cells(d: DataFrame, n: int) -> DataFrame:
    """(bucket, bitmap): the cells that hold two rows or more, as bitmaps of BITMAP bits; n / BITMAP rows at most."""
    twice = d.groupBy(_cell(F.col("digest"), n).alias("cell")).agg(F.count("*").alias("rows")).where("rows > 1")
    place = F.col("cell") + 1  # Spark's bitmaps begin at 1
    twice = twice.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("position"))
    return twice.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bitmap"))


def marked(d: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """d with `again`: whether another row may have the row's digest."""
    n = cells(d.count(), most_cells)
    cell = _cell(F.col("digest"), n)
    found = d.withColumn("bucket", F.bitmap_bucket_number(cell + 1)).join(F.broadcast(repeated_cells(d, n)), "bucket", "left")
    at = F.pmod(cell, F.lit(BITMAP)).cast("int")
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, at.bitwiseAND(F.lit(7)))
    return found.withColumn("again", F.coalesce(bit == 1, F.lit(False))).drop("bucket", "bitmap")


def exact_groups(docs: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs (doc_id, text); more columns are ignored.

    Texts are equal if they are identical without the characters of [\\x20\\x09-\\x0D]; null counts as empty, so all empty
    texts and those of white space are one group. The longest original text stays (in code points), then the smallest
    doc_id, null last; of rows that repeat both, the one that stands first in the input, and only that one is `kept`. An
    empty table gives an empty result. A group may hold any share of the rows: it is counted in parts, and its rows meet
    one row of the table of groups in a join that adaptive execution splits.
    """
    rows = marked(cut(digests(docs)), most_cells)
    again = rows.where("again")
    order = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = again.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(order).alias("first")).where("group_size > 1")
    groups = cut(groups.select("digest", "group_size", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row")))
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    alone = F.col("group_size").isNull()
    met = again.join(groups, "digest", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("first_row"))).alias("kept"), sha,
    )
    return met.union(rows.where("NOT again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long"), F.lit(True), sha))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, all columns as they are.

    Rows without a doc_id stay, as do rows that repeat the doc_id of one that stays.
    """
    found = exact_groups(docs).where("doc_id IS NOT NULL")
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


#: DuckDB's statement of the result.
ORACLE = r"""
WITH k AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM k WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
