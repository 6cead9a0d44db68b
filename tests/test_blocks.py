"""Best k in blocks: no row stands for a pair, and the rows are those of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import inverted, search


def rows(df, *cols):
    return sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(2)
    x = [[r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)] for _ in range(150)]
    return spark.createDataFrame([(k, v, k % 3 or None) for k, v in enumerate(x)] + [(200, None, 1), (240, [float("nan")] * 6, 2)], "vec_id long, embedding array<float>, label int").cache()


@pytest.mark.parametrize("k", [1, 5, 400])
def test_dense_best_are_those_of_all_pairs(spark, vectors, monkeypatch, k):
    monkeypatch.setattr(search, "VECTORS", 40)
    monkeypatch.setattr(search, "QUESTIONS", 3)
    q = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    whole = search.top_k(search.dense_scores(vectors, q).withColumn("score", F.round("score", 6)), k)
    got = search.dense_best(vectors, q, k)
    assert rows(got, "query_id", "rank", "doc_id", "label", "score") == rows(whole, "query_id", "rank", "doc_id", "label", "score")


def test_dense_best_has_no_row_for_a_pair(spark, vectors):
    plain = vectors.where("vec_id < 200")
    q = plain.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plan = search.dense_best(plain, q, 5)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "NestedLoop" not in plan and "Join" not in plan


@pytest.mark.parametrize("products", [1 << 22, 16])
def test_fused_best_are_those_of_all_pairs(spark, vectors, monkeypatch, products):
    monkeypatch.setattr(search, "PRODUCTS", products)
    monkeypatch.setattr(search, "HITS", 300)
    r = random.Random(4)
    words = [f"palabra{k}" for k in range(30)] + ["uno", "dos"]
    docs = spark.createDataFrame([(k, " ".join(r.choices(words, k=r.randint(0, 20)))) for k in range(180)], "doc_id long, text string")
    asked = spark.createDataFrame([(k, " ".join(r.choices(words, k=5))) for k in range(5)] + [(5, "")], "query_id long, text string")
    index = {n: x.cache() for n, x in inverted.tables(docs).items()}
    own = asked.select("query_id", (F.col("query_id") * 20).alias("own")).join(vectors.select(F.col("vec_id").alias("own"), F.col("embedding").alias("q")), "own")
    dense = search.dense_scores(vectors, own.select(F.col("own").alias("query_id"), "q")).select((F.col("query_id") / 20).cast("long").alias("query_id"), "doc_id", F.round("score", 6).alias("dense"))
    whole = search.top_k(search.hybrid(index, asked, dense), 5)
    got = search.Fused(index, asked, 5, vectors, own).best()
    assert rows(got, "query_id", "rank", "doc_id", "score") == rows(whole, "query_id", "rank", "doc_id", "score")


def test_folding_reads_other_letters_where_the_ranges_end(spark):
    d = spark.createDataFrame([("Señor ŉ x",), ("plano",), ("\U0001d538b ł",), (None,)], "t string")
    from docloom.functions import text as T

    assert [r[0] for r in d.select(T.needs_python(F.col("t")).isNotNull()).collect()] == [True, False, True, False]


def test_pieces_without_a_number_do_not_meet_in_one_task(spark):
    from docloom.operators import chunk, segment

    pages = spark.createDataFrame([(1, 1, "SECCIÓN 1: Identificacion\nx")], "doc_id long, page int, text string")
    titles = spark.createDataFrame([(1, "Identificacion")], "number int, expected string")
    blocks = segment.section_blocks(pages, titles, spark.createDataFrame([(1, "p")], "doc_id long, product string"))
    none = spark.createDataFrame([], "doc_id long, section_number int, items array<struct<page:int>>")
    for df in (blocks, chunk.with_orphans(blocks, none, none, titles), segment.best_hits(segment.section_hits(pages), titles)):
        assert "hashpartitioning(number" not in df._jdf.queryExecution().executedPlan().toString()


def test_an_asset_takes_the_last_anchor_above_without_a_line_of_all(spark):
    from docloom.operators import segment

    assets = spark.createDataFrame([(1, "a", 1, 10), (1, "b", 1, 1), (1, "c", 2, 5), (2, "d", 9, 0)], "doc_id long, asset_id string, page int, y0 int")
    anchors = spark.createDataFrame([(1, 1, 14, 7), (1, 1, 14, 3), (1, 1, 15, 9), (1, 1, 6, 2)], "doc_id long, page int, y0 int, number int")
    blocks = spark.createDataFrame([(1, 1, 4, 1, 2), (1, 2, 5, 2, 3)], "doc_id long, place int, number int, page_start int, page_end int")
    got = segment.attribute_assets(assets, anchors, blocks)
    assert sorted((r["asset_id"], r["section_number"]) for r in got.collect()) == [("a", 7), ("b", 4), ("c", 4), ("d", 1)]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_buckets_follow_the_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "CHARS", 100)
    docs = spark.createDataFrame([(k, "palabra " * 20) for k in range(20)], "doc_id long, text string")
    assert inverted.Index(spark, f"{tmp_path}/index")._buckets(docs) == 32
