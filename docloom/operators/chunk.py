"""Chunks: sliding word windows and greedy packing of paragraphs, both with overlap."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


def windows(words: Column, most: int, overlap: int) -> Column:
    """Word windows of `most`, each starting most - overlap after the last, until one reaches the end."""
    step = max(1, most - overlap)
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(starts, lambda i: (i == 0) | (i - step + most < n))
    return F.transform(starts, lambda i: F.slice(words, i + 1, F.lit(most)))


def word_windows(docs: DataFrame, most: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_index, chunk_count, tokens, content)."""
    d = docs.select("doc_id", T.let(T.words(F.col("text")), lambda w: windows(w, most, overlap)).alias("w"))
    d = d.select("doc_id", F.size("w").alias("chunk_count"), F.posexplode("w").alias("i", "words"))
    return d.select("doc_id", (F.col("i") + 1).alias("chunk_index"), "chunk_count", F.size("words").alias("tokens"), F.array_join("words", " ").alias("content"))


def chunk_bounds(counts: Sequence[int], most: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """The chunks of paragraphs with these numbers of words (C3), in one pass: (first, last, start, n).

    A chunk is n words from place `start` of all words, which are the end of the chunk before it, and the paragraphs first
    to last. A paragraph beyond `most` makes windows of its own, which are words alone (last < first) and hand nothing on.
    What a chunk hands on are the last words since the beginning or such a paragraph, as it holds the end of the chunk before.
    """
    out, step = [], max(1, most - overlap)
    first, seed, n, at, since = None, (0, 0), 0, 0, 0
    for i, k in enumerate(counts):
        if k > most:
            if first is not None:
                out.append((first, i - 1, *seed))
            out += [(0, -1, at + s, min(most, k - s)) for s in range(0, k, step) if s == 0 or s - step + most < k]
            first, n, since = None, 0, at + k
        elif first is not None and n + k > most:
            out.append((first, i - 1, *seed))
            tail = min(overlap, at - since)
            first, seed, n = i, (at - tail, tail), tail + k
        elif first is None:
            first, seed, n = i, (at, 0), k
        else:
            n += k
        at += k
    return out + [(first, len(counts) - 1, *seed)] if first is not None else out


def bounds(counts: Column, most: int, overlap: int) -> Column:
    """chunk_bounds of an array of numbers."""

    @F.pandas_udf("array<struct<first:int,last:int,start:int,n:int>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("first", "last", "start", "n"), c, strict=True)) for c in chunk_bounds(k.tolist(), most, overlap)] for k in x])

    return run(F.coalesce(counts, F.array().cast("array<int>")))


def pack(docs: DataFrame, most: int, overlap: int) -> DataFrame:
    """Lines as paragraphs, packed greedily up to `most` words; a full chunk's last words begin the next.

    A paragraph beyond `most` is cut into windows of its own and hands no overlap on.
    """
    paras = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), T.words), lambda w: F.size(w) > 0)
    d = docs.select("doc_id", paras.alias("p")).withColumn("b", bounds(F.transform("p", F.size), most, overlap))
    # the words of a chunk stand in a row: its seed is what comes just before its paragraphs
    d = d.withColumn("w", F.flatten("p")).select("doc_id", "p", "w", F.posexplode("b").alias("i", "c"))
    own = F.aggregate(F.slice("p", F.col("c.first") + 1, F.greatest(F.col("c.last") - F.col("c.first") + 1, F.lit(0))), F.lit(0), lambda n, w: n + F.size(w))
    words = F.slice("w", F.col("c.start") + 1, F.col("c.n") + own)
    return d.select("doc_id", (F.col("i") + 1).alias("chunk_index"), F.size(words).alias("tokens"), F.sha2(F.array_join(words, " "), 256).alias("content_sha256"))


_BETWEEN = re.compile("\n[ \t\n\x0b\f\r]*\n")


def text_chunks(text: str, most: int, overlap: int) -> list[str]:
    """Paragraphs between blank lines, trimmed, no empty ones (C1), packed into chunks (chunk_bounds)."""
    p = [x for x in (x.strip(T.BLANKS) for x in _BETWEEN.split(text.strip(T.BLANKS))) if x]
    words = [x.encode().split() for x in p]  # of bytes: at white space of ASCII alone
    own = chunk_bounds(list(map(len, words)), most, overlap)
    if any(n for _, _, _, n in own):
        words = [w for x in words for w in x]
    return ["\n\n".join(([b" ".join(words[start : start + n]).decode()] if n else []) + p[first : last + 1]) for first, last, start, n in own]


def split_text(t: Column, most: int = 850, overlap: int = 100) -> Column:
    """Paragraphs packed greedily up to `most` words, joined by blank lines.

    A full chunk's last words begin the next one as a paragraph; a paragraph beyond `most` is cut into windows of its own,
    which hand nothing on. A text is cut in one pass.
    """

    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda text: text_chunks(text, most, overlap), na_action="ignore")

    return run(t)


NO_TEXT = "Bloque textual de seccion no detectado; se conserva evidencia estructurada extraida de tablas e imagenes."
NO_TITLE = "Evidencia sin seccion textual detectada"
NO_OCR = "OCR sin texto legible."


def section_content(source_file: Column, number: Column, title: Column, text: Column, tables: Column, images: Column) -> Column:
    """A section as one text (C4): its head, its text, a block for each table and image."""
    head = F.array(F.concat(F.lit("Documento: "), source_file), F.concat(F.lit("Seccion "), number, F.lit(": "), title), F.lit(""), T.strip(text))
    of_table = F.transform(tables, lambda x: F.concat(F.lit("\n[Tabla "), x["asset_id"], F.lit("]\n"), x["markdown"], F.lit("\n"), x["trace_note"]))
    ocr = lambda x: F.coalesce(F.nullif(T.strip(x["ocr_text"]), F.lit("")), F.lit(NO_OCR))
    of_image = F.transform(
        images,
        lambda x: F.concat(F.lit("\n[Imagen "), x["asset_id"], F.lit("]\nTipo: "), x["kind"], F.lit(". Archivo: "), x["path"], F.lit(".\n"), x["trace_note"], F.lit("\nTexto OCR:\n"), ocr(x)),
    )
    return T.strip(F.array_join(F.concat(head, of_table, of_image), "\n"))


def with_orphans(blocks: DataFrame, tables: DataFrame, images: DataFrame, titles: DataFrame) -> DataFrame:
    """blocks (doc_id, number, title, page_start, page_end, text) with `tables` and `images` (from assets_by_section), and a
    section for each number that only assets have (C6): it spans their pages and says that it has no text."""
    t = tables.select("doc_id", F.col("section_number").alias("number"), F.col("items").alias("tables"))
    i = images.select("doc_id", F.col("section_number").alias("number"), F.col("items").alias("images"))
    assets = t.join(i, ["doc_id", "number"], "full_outer")
    both = blocks.select("doc_id", "number", "title", "page_start", "page_end", "text", F.lit(True).alias("known")).join(assets, ["doc_id", "number"], "full_outer").join(F.broadcast(titles), "number", "left")
    types = dict(both.dtypes)
    both = both.withColumn("tables", F.coalesce("tables", F.array().cast(types["tables"]))).withColumn("images", F.coalesce("images", F.array().cast(types["images"])))
    pages = F.concat(F.transform("tables", lambda x: x["page"]), F.transform("images", lambda x: x["page"]))
    return both.select(
        "doc_id", "number", F.coalesce("title", "expected", F.lit(NO_TITLE)).alias("title"), F.coalesce("page_start", F.array_min(pages)).alias("page_start"),
        F.coalesce("page_end", F.array_max(pages)).alias("page_end"), F.when(F.col("known"), F.col("text")).otherwise(NO_TEXT).alias("text"), "tables", "images",
    )


def section_chunks(sections: DataFrame, documents: DataFrame, most: int = 850, overlap: int = 100) -> DataFrame:
    """The chunks of sections (with_orphans) of documents (doc_id, document_id, manufacturer, product, source_file).

    Every piece of a section carries the ids of all its tables and images, and a trace.
    """
    s = sections.join(documents, "doc_id")
    content = section_content(F.col("source_file"), F.col("number"), F.col("title"), F.col("text"), F.col("tables"), F.col("images"))
    kinds = F.array(F.lit("text"), F.when(F.size("tables") > 0, F.lit("table")), F.when(F.size("images") > 0, F.lit("image")), F.when(F.size("images") > 0, F.lit("ocr")))
    s = s.withColumn("pieces", split_text(content, most, overlap)).withColumn("content_types", F.array_sort(F.filter(kinds, lambda x: x.isNotNull())))
    s = s.withColumn("table_ids", F.transform("tables", lambda x: x["asset_id"])).withColumn("image_ids", F.transform("images", lambda x: x["asset_id"]))
    s = s.withColumn("asset_paths", F.transform("images", lambda x: x["path"])).withColumn("chunk_count_for_section", F.size("pieces"))
    trace = F.struct(
        "source_file", F.col("number").alias("section"), F.col("title").alias("section_title"), F.array("page_start", "page_end").alias("pages"), F.col("table_ids").alias("tables"), F.col("image_ids").alias("images")
    )
    s = s.withColumn("trace", trace).select("*", F.posexplode("pieces").alias("i", "content")).withColumn("chunk_index", F.col("i") + 1)
    chunk_id = F.format_string("%s__sec%02d__chunk%02d", "document_id", "number", "chunk_index")
    return s.select(
        chunk_id.alias("chunk_id"), "document_id", "manufacturer", "product", "source_file", F.col("number").alias("section_number"), F.col("title").alias("section_title"), "page_start", "page_end",
        "chunk_index", "chunk_count_for_section", "content", "content_types", "table_ids", "image_ids", "asset_paths", "trace",
    )


def report(chunks: DataFrame, *more: Column) -> DataFrame:
    """A flat row for each chunk (C7), with more columns of it."""
    return chunks.select(
        "chunk_id", "document_id", "manufacturer", "product", "source_file", "section_number", "page_start", "page_end", "chunk_index", "chunk_count_for_section", T.token_estimate(F.col("content")).alias("token_estimate"),
        F.array_join("content_types", ",").alias("content_types"), F.size("table_ids").alias("table_count"), F.size("image_ids").alias("image_count"), F.length("content").alias("content_chars"), *more,
    )
