"""Sections: heading hits, the best hit of each number, spans between hits, attribution by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T

# fixed values: the section titles
SECTION_TITLES = {
    1: "Identificacion de la sustancia o la mezcla y de la sociedad o la empresa",
    2: "Identificacion de los peligros",
    3: "Composicion/informacion sobre los componentes",
    4: "Primeros auxilios",
    5: "Medidas de lucha contra incendios",
    6: "Medidas en caso de vertido accidental",
    7: "Manipulacion y almacenamiento",
    8: "Controles de exposicion/proteccion individual",
    9: "Propiedades fisicas y quimicas",
    10: "Estabilidad y reactividad",
    11: "Informacion toxicologica",
    12: "Informacion ecologica",
    13: "Consideraciones relativas a la eliminacion",
    14: "Informacion relativa al transporte",
    15: "Informacion reglamentaria",
    16: "Otra informacion",
}
HEADING = r"(?i)(?:seccion|section)\s*0?(1[0-6]|[1-9])\s*[:.\-]?\s*"
#: The same places in a text whose accents (T3) are still there.
ACCENTED_HEADING = r"(?iu)s[eé](?:cc|ct)[ií][oó][nñ]\s*0?(?:1[0-6]|[1-9])\s*[:.\-]?\s*"


def section_pieces(pages: DataFrame) -> DataFrame:
    """(doc_id, page, piece, start, text, number, title) of pages (doc_id, page, text): each page cut before every heading.

    Piece 0 is what comes before a page's first heading. start counts characters from 0. number and title are those of a
    heading with a title (G1): the rest of its line, accents folded, squeezed, 180 characters at most, 3 letters or more.
    """
    parts = F.split(F.regexp_replace("text", ACCENTED_HEADING, "\x01$0"), "\x01")
    p = pages.select("doc_id", "page", parts.alias("parts")).select("doc_id", "page", F.posexplode("parts").alias("piece", "text"))
    before = W.partitionBy("doc_id", "page").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int")
    folded = T.fold_sections(F.col("text"))
    heading = "^" + HEADING + r"([^\n]*)"
    title = F.substring(T.squeeze(F.regexp_extract(folded, heading, 2)), 1, 180)
    p = p.select("doc_id", "page", "piece", start.alias("start"), "text", F.regexp_extract(folded, heading, 1).alias("n"), title.alias("title"))
    hit = (F.col("piece") > 0) & (F.length(F.regexp_replace("title", "[^A-Za-z]", "")) >= 3)
    return p.select("doc_id", "page", "piece", "start", "text", F.when(hit, F.col("n").cast("int")).alias("number"), F.when(hit, F.col("title")).alias("title"))


def section_hits(pages: DataFrame) -> DataFrame:
    """(doc_id, page, start, number, title): every heading of pages (doc_id, page, text) (G1)."""
    return section_pieces(pages).where("number IS NOT NULL").select("doc_id", "page", "start", "number", "title")


def heading_score(expected: Column, candidate: Column) -> Column:
    """How well a candidate heading fits the expected title."""
    terms = F.filter(F.split(expected, " "), lambda t: (F.length(t) > 3) & F.contains(candidate, t))
    return (
        F.when((expected == "") | (candidate == ""), 0)
        .when(F.startswith(candidate, expected) | F.startswith(expected, candidate), 100)
        .when(F.contains(candidate, expected), 60)
        .otherwise(F.size(terms))
    )


def best_hits(hits: DataFrame, titles: DataFrame) -> DataFrame:
    """One hit for each (doc_id, number): highest score, then earliest (G5). titles: (number, expected)."""
    scored = hits.join(F.broadcast(titles), "number").withColumn("score", heading_score(T.heading(F.col("expected")), T.heading(F.col("title"))))
    order = F.min(F.struct((-F.col("score")).alias("s"), "page", "start", "title")).alias("b")
    best = scored.groupBy("doc_id", "number").agg(order)
    return best.select("doc_id", "number", F.col("b.page").alias("page"), F.col("b.start").alias("start"), F.col("b.title").alias("title"), (-F.col("b.s")).alias("score"))


def section_blocks(pages: DataFrame, titles: DataFrame, product: DataFrame) -> DataFrame:
    """(doc_id, place, number, title, page_start, page_end, text): the sections of documents.

    A section runs from its best heading to the next one by place, or to the document's end; its heading line is left out.
    page_end is the page on which the next begins. place counts a document's sections from 1. product: (doc_id, product).
    """
    # titles are few; by number all pieces without one would meet in one task
    pieces = section_pieces(pages).join(F.broadcast(titles), "number", "left")
    score = heading_score(T.heading(F.col("expected")), T.heading(F.col("title")))
    best = F.row_number().over(W.partitionBy("doc_id", "number").orderBy(F.desc("score"), "page", "start")) == 1
    pieces = pieces.withColumn("score", score).withColumn("begins", F.col("number").isNotNull() & best)
    line = W.partitionBy("doc_id").orderBy("page", "piece")
    pieces = pieces.withColumn("place", F.sum(F.col("begins").cast("int")).over(line)).withColumn("pages", F.max("page").over(W.partitionBy("doc_id")))
    own = F.when(F.col("begins"), F.regexp_replace("text", "^" + ACCENTED_HEADING + r"[^\n]*", "")).otherwise(F.col("text"))
    pieces = pieces.where("place > 0").withColumn("own", own)
    head = F.min(F.when(F.col("begins"), F.struct("number", "expected", "page"))).alias("head")
    parts = F.array_sort(F.collect_list(F.when((F.col("own") != "") | F.col("begins"), F.struct("page", "piece", "own")))).alias("parts")
    blocks = pieces.groupBy("doc_id", "place").agg(head, parts, F.first("pages").alias("pages"))

    def joined(parts: Column) -> Column:
        text = lambda x, i: F.when((i > 0) & (x["page"] != F.get(parts, i - 1)["page"]), F.concat(F.lit("\n"), x["own"])).otherwise(x["own"])
        return F.array_join(F.transform(parts, text), "")

    blocks = blocks.select("doc_id", "place", "head.number", F.col("head.expected").alias("title"), F.col("head.page").alias("page_start"), "pages", T.let(F.col("parts"), joined).alias("raw"))
    end = F.coalesce(F.lead("page_start").over(W.partitionBy("doc_id").orderBy("place")), F.col("pages"))
    blocks = blocks.withColumn("page_end", end).join(product, "doc_id")
    return blocks.select("doc_id", "place", "number", "title", "page_start", "page_end", T.markdown_text(T.strip(F.col("raw")), F.col("product")).alias("text"))


def section_warnings(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, warnings) of every document of pages: missing sections, their order, pages with little text, their number."""
    found = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "number"))).alias("s"))
    low = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.length(T.strip(F.col("text"))) < 80, F.col("page")))).alias("low"))
    both = low.join(found, "doc_id", "left").select("doc_id", "low", F.coalesce(F.transform("s", lambda x: x["number"]), F.array().cast("array<int>")).alias("n"))
    lost = F.array_except(F.sequence(F.lit(1), F.lit(len(SECTION_TITLES))), "n")

    def listed(name: str, items: Column) -> Column:
        return F.concat(F.lit(name + ": "), F.array_join(items.cast("array<string>"), ","))

    warnings = F.array(
        F.when(F.size(lost) > 0, listed("missing_sections", lost)), F.when(F.col("n") != F.array_sort("n"), listed("section_order_not_ascending", F.col("n"))),
        F.when(F.size("low") > 0, listed("low_text_pages", F.col("low"))), F.when(F.size("n") != len(SECTION_TITLES), F.concat(F.lit("section_count: "), F.size("n"))),
    )
    return both.select("doc_id", F.filter(warnings, lambda x: x.isNotNull()).alias("warnings"))


def attribute_assets(assets: DataFrame, anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """assets (doc_id, asset_id, page, y0, ...) with section_number (G10): by the nearest anchor at or above (4 units of slack) on
    the page; without one, the first section by place whose pages hold the page; else 1. anchors: (doc_id, page, y0, number)."""
    # a page's anchors are few numbers: each asset takes the last of them at or above it, and stays in its row
    of_page = anchors.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set(F.struct(F.col("y0").alias("at"), "number"))).alias("_anchors"))
    above = F.filter("_anchors", lambda x: x["at"] <= F.col("y0") + 4)
    at = assets.join(of_page, ["doc_id", "page"], "left").withColumn("attributed", F.try_element_at(above, F.lit(-1))["number"]).drop("_anchors")
    range_ = blocks.select("doc_id", "place", F.col("number").alias("of"), "page_start", "page_end")
    open_ = at.where("attributed IS NULL").select("doc_id", "asset_id", "page").join(range_, "doc_id").where("page BETWEEN page_start AND page_end")
    first = open_.groupBy("doc_id", "asset_id").agg(F.min(F.struct("place", "of"))["of"].alias("by_pages"))
    return at.join(first, ["doc_id", "asset_id"], "left").select(*assets.columns, F.coalesce("attributed", "by_pages", F.lit(1)).alias("section_number"))


def assets_by_section(assets: DataFrame, order: str, *columns: str) -> DataFrame:
    """(doc_id, section_number, items): the assets of each section in order."""
    items = F.array_sort(F.collect_list(F.struct(order, *columns))).alias("items")
    return assets.groupBy("doc_id", "section_number").agg(items)


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    cols = [c for c in rows.columns if c not in key and c not in order]
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, *cols)).alias("f"))
    return first.select(*key, "f.*")


def in_ranges(rows: DataFrame, by: str, at: str, span: float = 1024) -> tuple[DataFrame, DataFrame]:
    """rows with `_range`, the range of `span` places that `at` is in; and (by, _range, _next), the first place of the next range that has rows.

    A key with very many rows is so many ranges; only its ranges are put in order in one task.
    """
    rows = rows.withColumn("_range", F.floor(F.col(at) / span))
    ranges = rows.groupBy(by, "_range").agg(F.min(at).alias("_first"))
    edges = ranges.withColumn("_next", F.lead("_first").over(W.partitionBy(by).orderBy("_range")))
    return rows, edges.drop("_first")


def missing_numbers(rows: DataFrame, by: str, number: str, first: int = 0) -> DataFrame:
    """(by, missing): the numbers from `first` to a key's greatest that it lacks."""
    rows, edges = in_ranges(rows.select(by, number).where(F.col(number) >= first).distinct(), by, number)
    after = F.lead(number).over(W.partitionBy(by, "_range").orderBy(number))
    gaps = rows.withColumn("_after", after).join(edges, [by, "_range"]).select(by, F.col(number).alias("_at"), F.coalesce("_after", "_next").alias("_after"))
    before = rows.groupBy(by).agg(F.min(number).alias("_after")).select(by, F.lit(first - 1).cast("long").alias("_at"), "_after")
    gaps = gaps.union(before)
    hole = F.when(F.col("_after") > F.col("_at") + 1, F.sequence(F.col("_at") + 1, F.col("_after") - 1))
    return gaps.groupBy(by).agg(F.array_sort(F.flatten(F.collect_list(hole))).alias("missing"))


def missing_of(rows: DataFrame, by: str, number: str, expected: int) -> DataFrame:
    """(by, missing): those of 1 .. expected, a few, that a key lacks."""
    return rows.groupBy(by).agg(F.array_except(F.sequence(F.lit(1), F.lit(expected)), F.collect_set(number)).alias("missing"))


def spans(rows: DataFrame, by: str, at: str, *ties: str) -> DataFrame:
    """Every row with span_end, the next row's place or its key's last, and `repeated`: an earlier row has its place."""
    cols = rows.columns
    rows, edges = in_ranges(rows, by, at)
    w = W.partitionBy(by, "_range").orderBy(at, *ties)
    rows = rows.withColumn("_after", F.lead(at).over(w)).withColumn("repeated", F.coalesce(F.lag(at).over(w) == F.col(at), F.lit(False)))
    last = rows.groupBy(by).agg(F.max(at).alias("_last"))
    rows = rows.join(edges, [by, "_range"]).join(last, by)
    return rows.select(*cols, F.coalesce("_after", "_next", "_last").alias("span_end"), "repeated")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, slack: float, value: str, default) -> DataFrame:
    """left with `attributed`, the value of the latest right row at or before its place plus slack, else the default.

    Both sides lie in one line by place; each left row takes the last value before it in its range of the line, or the last
    of an earlier range. No row meets another.
    """
    none = F.lit(None).cast(dict(right.dtypes)[value])
    line = left.select(F.col(by).alias("_by"), (F.col(at) + slack).alias("_at"), F.lit(1).alias("_side"), none.alias("_v"), F.struct(*left.columns).alias("_row"))
    row = F.lit(None).cast(dict(line.dtypes)["_row"]).alias("_row")
    line = line.unionByName(right.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_v"), row))
    line = line.withColumn("_range", F.floor(F.col("_at") / 1024))
    order = W.partitionBy("_by", "_range").orderBy("_at", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    line = line.withColumn("_near", F.last(F.when(F.col("_side") == 0, F.struct("_v")), ignorenulls=True).over(order))
    # the last value of each range, and of all ranges before
    ends = line.groupBy("_by", "_range").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_v"))).alias("_end"))
    before = W.partitionBy("_by").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("_by", "_range", F.last("_end", ignorenulls=True).over(before).alias("_far"))
    found = line.where("_side = 1").join(ends, ["_by", "_range"])
    chosen = F.when(F.col("_near").isNotNull(), F.col("_near._v")).otherwise(F.col("_far._v"))
    return found.select("_row.*", F.coalesce(chosen, F.lit(default)).alias("attributed"))
