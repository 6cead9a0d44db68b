"""Questions put to texts without an index: the rows of an index, for common and rare terms, and what the queries write."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import inverted, scan, search
from docloom.plans import catalogue, sheets  # noqa: F401  (sheets adds its queries)
from docloom.sources import io
from docloom.streaming import ingest

from .test_index import ASKED, DOCS, plain, topics


@pytest.mark.parametrize("common", [1 << 21, 140, 0])
def test_texts_answer_as_their_index_does(spark, monkeypatch, common):
    """With all weights sent to the tasks, with some, with none."""
    monkeypatch.setattr(scan, "COMMON", common)
    rows = topics(300)[0] + [(1000, "Ünïcode ÁRBOL guante_guantes2 ĳ ŉ", 8), (1001, None, 2), (1002, "", 3), (1003, "x", None)]
    docs = spark.createDataFrame(rows, DOCS)
    asked = spark.createDataFrame([*topics()[1], (200, "arbol unicode nadie"), (201, None)], ASKED)
    index = inverted.tables(docs)
    texts = scan.Texts(docs, io.staged(scan.frequencies(docs), "terms"))
    for kwargs in ({"coverage": 0.0}, {"sections": docs.select("doc_id", "section_number")}):
        a, b = (plain(search.Bounded(x, asked, 4, **kwargs).best(), "query_id", "rank", "doc_id", "score") for x in (index, texts))
        assert a == b and a
    assert (200, 1, 1000) in plain(search.Bounded(texts, asked, 1).best(), "query_id", "rank", "doc_id")


def test_what_stands_before_a_text_is_counted_and_not_covered(spark):
    docs = spark.createDataFrame([(1, "Producto: alfa\n", "guantes"), (2, "Producto: beta\n", "guantes alfa"), (3, "beta\n", "nada")], "doc_id long, head string, text string")
    asked = spark.createDataFrame([(1, "alfa guantes"), (2, "producto beta")], ASKED)
    texts = scan.Texts(docs, io.staged(scan.frequencies(docs), "terms"))
    a, b = (plain(search.Bounded(x, asked, 3).best(), "query_id", "rank", "doc_id", "score") for x in (inverted.tables(scan.whole(docs), "content"), texts))
    assert a == b and len(a) == 5


def test_terms_that_tasks_count_apart_come_together(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"uno dos tres{k}") for k in range(60)], "doc_id long, text string").repartition(4)
    got = {r["hash"]: r["df"] for r in scan.frequencies(docs).collect()}
    terms = spark.createDataFrame([("uno",), ("uno dos",), ("tres7",), ("dos tres7",)], "term string").select("term", scan.term_hash(F.col("term")).alias("h")).collect()
    assert {r["term"]: got[r["h"]] for r in terms} == {"uno": 60, "uno dos": 60, "tres7": 1, "dos tres7": 1} and len(got) == 3 + 120


def test_more_questions_than_a_block_meet_in_blocks(spark, monkeypatch):
    docs, asked = spark.createDataFrame(topics(200)[0], DOCS), spark.createDataFrame(topics()[1], ASKED)
    texts = scan.Texts(docs, io.staged(scan.frequencies(docs), "terms"))
    whole = plain(search.Bounded(texts, asked, 3).best(), "query_id", "rank", "doc_id", "score")
    monkeypatch.setattr(search, "BLOCK", 5)
    assert plain(search.Bounded(texts, asked, 3).best(), "query_id", "rank", "doc_id", "score") == whole


@pytest.mark.parametrize("name", ["lexical_fallback", "tfidf_search", "hybrid_search", "chunk_search", "smoke_five_rows"])
def test_a_search_writes_no_index(spark, tmp_path, monkeypatch, name):
    """No postings of all terms; questions too many to be sent to the tasks are put to an index, with the same rows."""
    rows = [(k, f"guantes{k} gafas numero{k % 3}\nproteccion personal {k}", "en", "s", 6) for k in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "los guantes y la gafa"), (2, "numero2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(20 * k, [float(k), 1.0], 0) for k in range(4)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    ask = lambda: sorted(map(str, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
    got = ask()
    assert got and not [k for k in catalogue.Tables.written if k[1] == str(tmp_path) and k[2].startswith("index")]
    monkeypatch.setattr(catalogue, "ASKED", 0)
    catalogue.Tables.clear(spark)
    assert ask() == got and [k for k in catalogue.Tables.written if k[1] == str(tmp_path) and k[2].startswith("index")]


def test_batches_of_an_upload_add_their_terms(spark, tmp_path):
    """A chunk that comes again counts once; the rows are those of the chunks in one go, and no index is written."""
    schema = "doc_id long, text string"
    chunks = lambda d: d.select(F.concat_ws("-", "doc_id", F.lit("c")).alias("doc_id"), F.concat(F.lit("Documento "), "doc_id", F.lit("\n")).alias("head"), "text", F.lit(3).alias("section_number"))
    up = ingest.Upload(spark, f"{tmp_path}/c", "c", chunks)
    parts = [[(1, "guantes y gafas"), (2, "gafas"), (3, "tres")], [(2, "otros guantes"), (4, "cuatro gafas"), (5, "GUANTES y gafas")], [(6, "guantes")]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        up.receive(f"{tmp_path}/in/*", schema)
    up.convert(), up.count(), up.count()
    kept = spark.createDataFrame([*parts[0], (4, "cuatro gafas"), (6, "guantes")], schema)  # 2 came before with another text, 5 is the text of 1
    asked = spark.createDataFrame([(1, "gafas y guantes"), (2, "documento 4")], ASKED)
    rows = [plain(search.Bounded(x, asked, 4).best(), "query_id", "rank", "doc_id", "score") for x in (up.texts(), inverted.tables(scan.whole(chunks(kept)), "content"))]
    assert rows[0] == rows[1] and len(rows[0]) == 8 and not up.index.versions()


def test_sheet_files_exchange_no_texts(spark, tmp_path):
    """What is read of a sheet's files meets by its id as hashes; what sheets come from isn't made, their Markdown isn't stored twice."""
    rows = [(k, f"Línea {k}\n" + "x" * (4 * k) + "\notra\n" * (k % 5), "en", "s", 6) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.QUERIES["sheet_files"](spark, str(tmp_path))
    read = df.collect()
    assert len(read) == 40 and {r["same"] for r in read} == {True, False}
    plan = df._jdf.queryExecution().optimizedPlan()
    while "Join" not in plan.nodeName():
        plan = plan.children().head()
    assert {a.split("#")[0] for a in plan.output().mkString(" ").split()} <= {"document_id", "doc_id", "read", "was", "front_matter", "headings", "sha"}
    steps = {k[2]: v[0] for k, v in catalogue.Tables.written.items() if k[1] == str(tmp_path)}
    assert "origins" not in steps and "markdown" not in spark.read.parquet(steps["sheets"]).columns
    assert {f.rsplit(".", 1)[1] for f in io.there(spark, f"{steps['delivered']}/m*/part-*")} == {"gz"}
