"""Inventory, exact duplicates, aliases, coverage and quality of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..sources import io

RANK_BUCKET = 65_536


def rank_by_id(df: DataFrame, id_: str, name: str) -> DataFrame:
    """df with `name`, the rank (from 1) of each distinct long id, without sorting all rows in one task.

    Ids fall into ranges of RANK_BUCKET values; only the table of range counts is summed in order.
    """
    b = F.floor(F.col(id_) / RANK_BUCKET)
    df = df.withColumn("_b", b)
    counts = df.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_b", F.coalesce(before, F.lit(0)).alias("_before"))
    rn = F.row_number().over(W.partitionBy("_b").orderBy(id_))
    return df.withColumn("_rn", rn).join(counts, "_b").withColumn(name, F.col("_before") + F.col("_rn")).drop("_b", "_rn", "_before")


def duplicate_groups(docs: DataFrame, key: Column) -> DataFrame:
    """(doc_id, duplicate_group, group_size): groups of two or more by first occurrence, '' for the rest (A1)."""
    keyed = docs.select("doc_id", key.alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("group_size"), F.min("doc_id").alias("first"))
    labels = rank_by_id(groups.where("group_size > 1"), "first", "rank").select("key", F.format_string("dup-%02d", "rank").alias("duplicate_group"))
    out = keyed.join(groups.select("key", "group_size"), "key").join(labels, "key", "left")
    return out.select("doc_id", F.coalesce("duplicate_group", F.lit("")).alias("duplicate_group"), "group_size")


def canonical_aliases(docs: DataFrame, scope: str, key: Column) -> DataFrame:
    """(doc_id, canonical_id, status): the first document of a scope with a key is converted, later ones are aliases (A4)."""
    keyed = docs.select("doc_id", scope, key.alias("key"))
    first = keyed.groupBy(scope, "key").agg(F.min("doc_id").alias("canonical_id"))
    status = F.when(F.col("doc_id") == F.col("canonical_id"), "converted").otherwise("duplicate_skipped")
    both = keyed.alias("k").join(first.alias("f"), F.col(f"k.{scope}").eqNullSafe(F.col(f"f.{scope}")) & F.col("k.key").eqNullSafe(F.col("f.key")))
    return both.select("doc_id", "canonical_id", status.alias("status"))


def inventory(docs: DataFrame) -> DataFrame:
    """Per source: documents, lines, characters, short ones, duplicate groups and duplicates (A2)."""
    d = docs.select("source", "doc_id", "text", T.fingerprint(F.col("text")).alias("key"))
    per_key = d.groupBy("source", "key").agg(
        F.count("*").alias("n"), F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.sum(F.length("text")).alias("chars"), F.sum((F.length("text") < 1000).cast("int")).alias("low")
    )
    n = F.col("n")
    return per_key.groupBy("source").agg(
        F.sum("n").alias("documents"), F.sum("lines").alias("lines"), F.sum("chars").alias("text_chars"), F.sum("low").alias("low_text"),
        F.sum((n > 1).cast("int")).alias("duplicate_groups"), F.sum(n - 1).alias("duplicates"),
    )


def coverage_gap(expected: DataFrame, covered: DataFrame, key: str, by: str) -> DataFrame:
    """Per `by`: expected, missing keys and the gate's status."""
    gap = expected.join(covered.select(key).distinct().withColumn("_seen", F.lit(1)), key, "left")
    missing = F.sum(F.col("_seen").isNull().cast("int"))
    return gap.groupBy(by).agg(F.count("*").alias("expected"), missing.alias("missing"), F.when(missing == 0, "pass").otherwise("review").alias("status"))


def two_way_diff(actual: DataFrame, referenced: DataFrame) -> DataFrame:
    """Each id with its side: both, orphan (only actual) or missing (only referenced) (A13). Inputs: one column id."""
    a, r = actual.distinct().withColumn("_a", F.lit(1)), referenced.distinct().withColumn("_r", F.lit(1))
    state = F.when(F.col("_r").isNull(), "orphan").when(F.col("_a").isNull(), "missing").otherwise("both")
    return a.join(r, "id", "full_outer").select("id", state.alias("state"))


def quality_gate(docs: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(doc_id, failed, quality_score, status): boolean checks as a share of 100 (A10)."""
    n = len(checks)
    failed = F.filter(F.array(*[F.when(~c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    d = docs.select("doc_id", failed.alias("f"))
    return d.select("doc_id", F.array_join("f", "|").alias("failed"), F.round(100.0 * (n - F.size("f")) / n, 2).alias("quality_score"), F.when(F.size("f") == 0, "pass").otherwise("review").alias("status"))


def quality_summary(gate: DataFrame) -> DataFrame:
    """A11."""
    ok = F.col("status") == "pass"
    return gate.agg(F.count("*").alias("validated"), F.sum(ok.cast("int")).alias("passed"), F.sum((~ok).cast("int")).alias("review"), F.round(F.avg("quality_score"), 2).alias("average_score"))


def integrity(rows: DataFrame, key: list[str], content: str) -> DataFrame:
    """Keys that repeat or have empty content, with both counts."""
    g = rows.groupBy(*key).agg(F.count("*").alias("copies"), F.sum((F.trim(F.coalesce(content, F.lit(""))) == "").cast("int")).alias("empty"))
    return g.where("copies > 1 OR empty > 0")


def alias_errors(aliases: DataFrame, documents: DataFrame) -> DataFrame:
    """(alias_document_id, error): aliases whose canonical document is missing or has another text.

    aliases (alias_document_id, canonical_document_id, text_sha256), documents (document_id, text_sha256).
    """
    d = documents.select(F.col("document_id").alias("canonical_document_id"), F.col("text_sha256").alias("_text"), F.lit(True).alias("_there")).distinct()
    both = aliases.join(d, "canonical_document_id", "left")
    error = F.when(F.col("_there").isNull(), F.concat(F.lit("missing_canonical_metadata:"), "canonical_document_id")).when(
        ~F.col("text_sha256").eqNullSafe(F.col("_text")), F.concat(F.lit("text_hash_mismatch:"), "alias_document_id")
    )
    return both.select("alias_document_id", error.alias("error")).where("error IS NOT NULL")


# fixed values: keys that a Markdown document's head must have, names that say nothing of a product
FRONT_MATTER = ("document_id", "fabricante", "producto", "archivo_fuente", "paginas", "file_sha256", "text_sha256")
GENERIC_PRODUCTS = ("ficha de datos de seguridad", "hoja de datos de seguridad", "msds")


def empty_sections(sections: Column) -> Column:
    """Numbers of the sections with under 40 characters of text."""
    return F.transform(F.filter(sections, lambda s: F.length(T.strip(F.coalesce(s["text"], F.lit("")))) < 40), lambda s: s["number"].cast("string"))


def invalid_sections(sections: Column, page_count: Column) -> Column:
    """Numbers of the sections whose pages are out of order or beyond the document."""
    bad = F.filter(sections, lambda s: (s["page_start"] < 1) | (s["page_end"] < s["page_start"]) | (s["page_end"] > page_count))
    return F.transform(bad, lambda s: s["number"].cast("string"))


def document_checks() -> dict[str, Column]:
    """The 21 checks of a converted document (A10).

    Over the columns of its metadata and: markdown (null if not there), source_file_sha256, source_text_sha256 and
    source_page_count (null if the source is not there), asset_files (the paths that are there).
    """
    md, sections, tables, images = F.coalesce("markdown", F.lit("")), F.col("sections"), F.col("tables"), F.col("images")
    numbers, n = F.transform(sections, lambda s: s["number"]), 16
    every = F.sequence(F.lit(1), F.lit(n))
    keys, headings = io.front_matter_keys(md), io.markdown_sections(md).cast("array<int>")

    def notes(kind: str) -> Column:
        return F.regexp_count(md, F.lit(r"(?m)^> Nota de trazabilidad: " + kind))

    return {
        "markdown_exists": F.col("markdown").isNotNull(),
        "source_exists": F.col("source_file_sha256").isNotNull(),
        "file_hash_matches": F.coalesce(F.col("source_file_sha256") == F.col("file_sha256"), F.lit(False)),
        "text_hash_matches": F.coalesce(F.col("source_text_sha256") == F.col("text_sha256"), F.lit(False)),
        "page_count_matches": F.coalesce(F.col("source_page_count") == F.col("page_count"), F.lit(False)),
        "product_name_is_specific": ~T.casefold(T.strip(F.col("product"))).isin(*GENERIC_PRODUCTS),
        "has_required_front_matter": F.size(F.array_except(F.array(*map(F.lit, FRONT_MATTER)), keys)) == 0,
        "section_count_is_16": (F.col("section_count") == n) & (F.size(sections) == n),
        "sections_are_1_to_16": numbers == every,
        "markdown_has_16_section_headings": headings == every,
        "markdown_has_trace_note_per_section": notes("contenido extraido") == n,
        "tables_have_markdown": F.forall(tables, lambda t: F.contains(t["markdown"], F.lit("|---"))),
        "markdown_has_trace_note_per_table": notes("tabla") == F.size(tables),
        "images_have_files": F.size(F.array_except(F.transform(images, lambda i: i["path"]), F.col("asset_files"))) == 0,
        "images_have_metadata": F.forall(images, lambda i: (F.coalesce(i["sha256"], F.lit("")) != "") & (F.coalesce(i["kind"], F.lit("")) != "") & F.contains(F.coalesce(i["trace_note"], F.lit("")), F.lit("Nota de trazabilidad"))),
        "markdown_has_trace_note_per_image": notes("imagen") == F.size(images),
        "images_have_ocr_field": F.forall(images, lambda i: i["ocr_text"].isNotNull()),
        "no_empty_sections": F.size(empty_sections(sections)) == 0,
        "valid_page_ranges": F.size(invalid_sections(sections, F.col("page_count"))) == 0,
        "no_extraction_errors": F.size("extraction_errors") == 0,
        "no_conversion_warnings": F.size("warnings") == 0,
    }


def markdown() -> Column:
    """A document as Markdown (G14), over the columns of its metadata; tables and images carry their section_number."""

    def lines(*parts) -> Column:
        return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    c = F.col
    yaml = lambda name, value: text(name + ": ", T.yaml_quote(value))
    head = lines(
        "---", yaml("document_id", c("document_id")), yaml("fabricante", c("manufacturer")), yaml("producto", c("product")), yaml("archivo_fuente", c("source_file")), text("paginas: ", c("page_count")),
        yaml("file_sha256", c("file_sha256")), yaml("text_sha256", c("text_sha256")), "---", "", text("# Ficha de Datos de Seguridad - ", c("product")), "", "## Metadatos", "",
        text("- Fabricante: ", c("manufacturer")), text("- Archivo fuente: `", c("source_file"), "`"), text("- Paginas: ", c("page_count")), text("- Secciones detectadas: ", F.size("sections"), " de 16"),
        text("- Tablas extraidas: ", F.size("tables")), text("- Imagenes extraidas: ", F.size("images")), "", "## Tabla de secciones detectadas", "", "| Seccion | Titulo normalizado | Paginas |", "|---:|---|---:|",
    )
    contents = F.transform("sections", lambda s: text("| ", s["number"], " | ", s["title"], " | ", T.page_span(s["page_start"], s["page_end"]), " |"))

    def of_table(t: Column) -> Column:
        return lines(text("#### Tabla `", t["asset_id"], "`"), "", t["markdown"], "", text("> ", t["trace_note"]), "")

    def of_image(i: Column) -> Column:
        ocr = F.coalesce(F.nullif(i["ocr_text"], F.lit("")), F.lit("OCR sin texto legible."))
        return lines(
            text("#### Imagen `", i["asset_id"], "`"), "", text("![", i["kind"], " pagina ", i["page"], "](", i["path"], ")"), "", text("> ", i["trace_note"]), "", "**Texto OCR de la imagen:**", "", "```text", ocr, "```", ""
        )

    def assets(items: str, number: Column, title: str, render) -> Column:
        own = F.filter(items, lambda x: x["section_number"] == number)
        return F.when(F.size(own) > 0, F.concat(F.lit(f"\n\n### {title} extraidas de esta seccion\n\n"), F.array_join(F.transform(own, render), "\n"))).otherwise("")

    def section(s: Column) -> Column:
        pages = F.when(s["page_start"] == s["page_end"], "").otherwise(text(" a la pagina ", s["page_end"]))
        note = text("> Nota de trazabilidad: contenido extraido de la pagina ", s["page_start"], pages, " del PDF fuente `", c("source_file"), "`.")
        body = F.coalesce(F.nullif(s["text"], F.lit("")), F.lit("_Sin texto extraido en esta seccion._"))
        own = lines("", text("## Seccion ", s["number"], ": ", s["title"]), "", note, "", body)
        return F.concat(own, assets("tables", s["number"], "Tablas", of_table), assets("images", s["number"], "Imagenes", of_image))

    alerts = F.transform(F.concat("warnings", "extraction_errors"), lambda w: text("- ", w))
    alerts = F.when(F.size(alerts) > 0, F.concat(F.array(F.lit(""), F.lit("## Alertas de extraccion"), F.lit("")), alerts)).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat(F.array(head), contents, F.transform("sections", section), alerts), "\n")
    return F.concat(F.regexp_replace(whole, r"(?U)\s+$", ""), F.lit("\n"))


def inventory_rows(pages: DataFrame, hits: DataFrame, sections: int = 16) -> DataFrame:
    """A row for each document (A3) of pages (doc_id, page, text) and its hits (doc_id, page, start, number): pages, characters,
    pages with text, hash, the sections found and missing and the page of the first."""
    first = hits.groupBy("doc_id", "number").agg(F.min(F.struct("page", "start"))["page"].alias("page"))
    found = first.groupBy("doc_id").agg(F.array_sort(F.collect_list("number")).alias("found"), F.min("page").alias("first_section_page"))
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))  # a document's pages
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text")
    docs = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"), F.sum((F.length(T.strip(F.col("text"))) >= 80).cast("int")).cast("int").alias("pages_with_text"), text)
    both = docs.join(found, "doc_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<int>")))
    lost = F.array_except(F.sequence(F.lit(1), F.lit(sections)), "found")
    return both.select(
        "doc_id", "page_count", F.length("text").alias("text_chars"), "pages_with_text", T.fingerprint(F.col("text")).alias("text_sha256"), F.size("found").alias("sections_found"),
        F.array_join(lost.cast("array<string>"), ",").alias("missing_sections"), "first_section_page",
    )


def chunk_totals(chunks: DataFrame, expected: DataFrame, sections: int = 16) -> DataFrame:
    """One row (A6): documents, chunks, sections expected (document_id, section_number) and covered, and sections times documents."""
    e = expected.agg(F.count_distinct("document_id", "section_number").alias("sections_expected"), F.count_distinct("document_id").alias("documents"))
    c = chunks.groupBy("document_id", "section_number").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("sections_covered"))
    return e.withColumn("_1", F.lit(1)).join(c.withColumn("_1", F.lit(1)), "_1").select("documents", "chunks", "sections_expected", (F.col("documents") * sections).alias("full_sections_expected"), "sections_covered")


def uncovered(expected: DataFrame, chunks: DataFrame, ids: str) -> DataFrame:
    """The asset ids (document_id, asset_id) that no chunk names in its array column `ids`."""
    named = chunks.select("document_id", F.explode(ids).alias("asset_id")).distinct()
    return expected.join(named, ["document_id", "asset_id"], "left_anti")


def untraced(chunks: DataFrame) -> DataFrame:
    """(chunk_id, empty, missing_trace, copies) of chunks with no content, no source or section in their trace (section 0 counts as
    none), or an id that others have too (A8)."""
    t = F.col("trace")
    lost = F.coalesce(t["source_file"], F.lit("")).eqNullSafe("") | (F.coalesce(t["section"], F.lit(0)) == 0)
    g = chunks.groupBy("chunk_id").agg(F.max(T.strip(F.coalesce("content", F.lit(""))) == "").alias("empty"), F.max(lost).alias("missing_trace"), F.count("*").alias("copies"))
    return g.where("empty OR missing_trace OR copies > 1")
