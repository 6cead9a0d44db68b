"""What the larger tables need: texts folded and cut once, by few passes."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunk, corpus
from docloom.plans import catalogue, sheets  # noqa: F401  (sheets adds its queries)


def test_aliases_of_documents_without_scope(spark):
    d = spark.createDataFrame([(1, None, "A b"), (2, None, "a  B"), (3, "x", "a b"), (4, None, None), (5, None, None)], "doc_id long, lang string, text string")
    got = {r["doc_id"]: r["canonical_id"] for r in corpus.canonical_aliases(d, "lang", T.fingerprint(F.col("text"))).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_casefold_of_texts_with_and_without_rare_letters(spark):
    texts = ["Straße ÉÑÜ", "ΑΣ Σας", "ŉ ǰ ﬀ ẞ", "µ ſ K Å", "plain ASCII", "Ꭰ ꭰ ᾳ", "ЖДУ"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.whole_casefold(F.col("t")).alias("f"))
    assert {r["id"]: r["f"] for r in d.collect()} == {i: x.casefold() for i, x in enumerate(texts)}


def test_alias_check_folds_each_text_once(spark, tmp_path):
    rows = [(k, f"Text {k // 3}", "en", "s", 6) for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalogue.QUERIES["alias_check"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" not in plan


def test_blanks_of_python_are_those_of_columns(spark):
    d = spark.range(1, 0x3100).select("id", T.strip(F.expr("decode(encode(concat('', decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')), 'UTF-8'), 'UTF-8')")).alias("s"))
    assert {r["id"] for r in d.where("s = ''").collect()} == set(map(ord, T.BLANKS))


def test_chunks_of_blanks_that_only_some_functions_know(spark):
    long = " ".join(f"w{k}" for k in range(12))
    text = f"\u00a0uno\u00a0dos tres \n \x0b\n\u2003cuatro\u2003\n\n\x85\n\n{long}\n\n cinco seis\u00a0\n\n1 2 3 4 5 6 7 8 9"
    d = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(chunk.split_text(F.col("t"), 10, 3).alias("c"))
    windows = [" ".join(f"w{k}" for k in r) for r in (range(10), range(7, 12))]
    assert [r["c"] for r in d.collect()] == [["uno\u00a0dos tres\n\ncuatro", *windows, "cinco seis", "cinco seis\n\n1 2 3 4 5 6 7 8 9"], None, []]


@pytest.mark.parametrize("name", ["asset_sections", "section_chunks"])
def test_lines_of_assets_are_read_once(spark, tmp_path, name):
    rows = [(k, "\n".join("x" * (k % 9 + 5 * i) for i in range(12)), "en", "s", 6) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    steps = {k[2] for k in catalogue.Tables.written if k[1] == str(tmp_path)}
    assert "assets" in steps and not steps & {"tables", "images"}


def test_coverage_needs_no_postings(spark, tmp_path):
    rows = [(k, f"guantes{k} gafas numero{k % 3}", "en", "s", 6) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "los guantes y la gafa"), (2, "nada")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["query_id"], r["doc_id"], r["coverage"]) for r in catalogue.QUERIES["term_coverage"](spark, str(tmp_path)).collect()}
    assert got == {(1, k, 1.0) for k in range(20)}
    assert {k[2] for k in catalogue.Tables.written if k[1] == str(tmp_path)} == {"words", "lexicon"}
    spark.createDataFrame([(99, "xguantesx", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert (1, 99, 0.5) in {(r["query_id"], r["doc_id"], r["coverage"]) for r in catalogue.QUERIES["term_coverage"](spark, str(tmp_path)).collect()}
