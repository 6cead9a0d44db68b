"""Rings around pivots against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import rings, search


@pytest.mark.parametrize("cell", [4096, 10])
def test_best_are_those_of_all_pairs(spark, tmp_path, monkeypatch, cell):
    """Groups of vectors of unequal norms, repeats, ties, a zero vector, nulls and a clashing column; hot rings in cells."""
    monkeypatch.setattr(rings, "CELL", cell)
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 8))
    x = [(centres[k % 12] * (1 + k % 3) + 0.05 * r.normal(size=8)).astype(np.float32).tolist() for k in range(600)]
    x += [[1.0] + [0.0] * 7] * 90 + [[0.0] * 8]
    rows = [(k, v, k % 5) for k, v in enumerate(x)] + [(9001, None, 1), (9002, [1.0] * 7 + [None], 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ring long")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rings.write(e, f"{tmp_path}/index")
    index = rings.Rings(spark, f"{tmp_path}/index")
    whole = e.where("vec_id < 9000").withColumn("label", F.lit(0))
    dense = search.dense_scores(whole, q).withColumn("score", F.round("score", 6))
    for k in (1, 5, 800):
        theirs = search.top_k(dense, k).select("query_id", "rank", "doc_id", "score").collect()
        got = index.best(q, k).select("query_id", "rank", "doc_id", "score").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, theirs))
    compared = [c["n"] for c in index.compared(q, 5).collect()]
    assert len(compared) == q.count() and sum(compared) < 0.5 * len(compared) * len(x)


def test_an_empty_table_has_an_empty_index(spark, tmp_path):
    e = spark.createDataFrame([], "vec_id long, embedding array<float>")
    rings.write(e, f"{tmp_path}/index")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, q array<float>")
    assert rings.Rings(spark, f"{tmp_path}/index").best(q, 5).count() == 0
