"""Passages in documents against Python's own search."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import attribute


def texts(seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß漢🙂") for _ in range(r.randint(1, 9))) for _ in range(300)]
    docs = ["".join(r.choice(words) + r.choice([" ", ", ", "\n", "“", "."]) for _ in range(r.randint(0, 200))) for _ in range(60)]
    docs += ["", None, "aaaa" * 40, "x" * 200_000 + "fin del texto, muy lejos del comienzo de todo" + "y" * 10, docs[0], "a"]
    passages = []
    for _ in range(120):
        d = docs[r.randrange(60)]
        n = r.choice([1, 2, 3, 4, 5, 9, 31, 32, 33, 40, 100, 400])
        at = r.randrange(max(1, len(d) - n))
        passages.append(d[at : at + n])
    passages += ["", None, "no está en ninguna parte de estos textos", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "fin del texto, muy lejos del comienzo de todo", "yyyyyyyyyyy", "comienzo de todo y"]
    return docs, passages


def test_places_are_those_of_find(spark):
    docs, passages = texts()
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("item_id", F.lit(1))
    p = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted(map(tuple, attribute.places(d, p).collect()))
    want = sorted((i, j, x.find(y) + 1) for i, x in enumerate(docs) for j, y in enumerate(passages) if x is not None and y is not None and y in x)
    assert got == want and len(got) > 1000


def test_what_lost_rows_before(spark):
    docs = spark.createDataFrame([(1, 'Er sagte: "eins zwei drei vier fünf sechs" und ging.'), (2, "eins zwei drei vier fünf, sechs"), (3, "eins zwei")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "eins zwei drei vier fünf sechs"), (2, "eins zwei drei vier fünf"), (3, "eins zwei"), (4, "zwe")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in attribute.places(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (1, 3), (2, 3), (3, 3), (1, 4), (2, 4), (3, 4)}


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, item_id long, text string"), spark.createDataFrame([(1, 1, "x")], "doc_id long, item_id long, text string")
    assert attribute.places(none, one).count() == attribute.places(one, none).count() == attribute.places(none, none).count() == 0


def test_repeated_ids_are_texts_of_their_own(spark):
    d = spark.createDataFrame([(1, "uno dos"), (1, "dos tres"), (None, "dos")], "doc_id long, text string")
    p = spark.createDataFrame([(1, "dos"), (1, "tres")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["place"]) for r in attribute.places(d, p).collect()), key=str)
    assert got == [(1, 1, 1), (1, 1, 5), (1, 1, 5)]


@pytest.mark.parametrize("k", [attribute.WINDOW, attribute.SHORT])
def test_anchors_of_a_part_are_anchors_of_the_whole(monkeypatch, k):
    monkeypatch.setattr(attribute, "PIECE", 64)
    r = random.Random(1)
    whole = bytes(r.randrange(97, 101) for _ in range(3000))
    for _ in range(200):
        at, n = r.randrange(2900), r.randint(attribute.LONG, 300)
        part = whole[at : at + n]
        if len(part) >= attribute.LONG:
            assert len(attribute.anchors(part, k)) and set(attribute.anchors(part, k)) <= set(attribute.anchors(whole, k))
