"""The growing index, its bounded search, its layout, and steps that follow their tables."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import inverted, search
from docloom.plans import catalogue
from docloom.sources import io
from docloom.streaming import ingest

DOCS, ASKED = "doc_id long, text string, section_number int", "query_id long, text string"


def topics(n=900, seed=3):
    """Documents of words that all have and words of one of 30 topics, and a question on each topic."""
    r = random.Random(seed)
    common = [f"comun{k}" for k in range(60)]
    own = [[f"tema{t:02d}x{k}" for k in range(12)] for t in range(30)]
    docs = [(k, " ".join([r.choice(common) for _ in range(r.randint(10, 60))] + [r.choice(own[k % 30]) for _ in range(8)]), k % 16 + 1) for k in range(n)]
    asked = [(t, " ".join([*r.sample(own[t], 6), *r.sample(common, 3)])) for t in range(30)]
    return docs, [*asked, (100, "guantes comun1 comun2"), (101, "nada de nada"), (102, ""), (103, "tema05x1")]


@pytest.fixture(scope="module")
def index(spark):
    return {k: v.cache() for k, v in inverted.tables(spark.createDataFrame(topics()[0], DOCS)).items()}


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(topics()[1], ASKED).cache()


def plain(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bounded_search_gives_the_rows_of_the_whole(spark, index, asked):
    whole = search.lexical(index, asked)
    got = search.Bounded(index, asked, 5)
    assert plain(got.best(), "query_id", "rank", "doc_id", "score") == plain(search.top_k(whole, 5), "query_id", "rank", "doc_id", "score")
    pairs = got.candidates().where("query_id < 100")  # all that are scored in full
    assert pairs.count() < whole.where("query_id < 100").count() / 10


def test_bounded_search_with_boost(spark, index, asked):
    sections = index["docs"].select("doc_id", "section_number")
    whole = search.boosted(search.lexical(index, asked), sections, asked)
    got = search.Bounded(index, asked, 4, sections=sections).best()
    assert plain(got, "query_id", "rank", "doc_id", "score") == plain(search.top_k(whole.select("query_id", "doc_id", "score"), 4), "query_id", "rank", "doc_id", "score")
    # only the boost brings these up: they share a common word with the question and nothing else
    docs = spark.createDataFrame([(k, f"raro{k % 3} uno " + " ".join(f"r{k}x{j}" for j in range(60)), 1) for k in range(60)] + [(k, "uno " * 9 + "cuatro cinco", 8) for k in range(60, 64)], DOCS)
    few, q = inverted.tables(docs), spark.createDataFrame([(1, "guantes raro1 uno")], ASKED)
    sections = docs.select("doc_id", "section_number")
    got = plain(search.Bounded(few, q, 4, sections=sections).best(), "doc_id", "score")
    assert [d for d, _ in got] == [60, 61, 62, 63]
    assert got == plain(search.top_k(search.boosted(search.lexical(few, q), sections, q).select("query_id", "doc_id", "score"), 4), "doc_id", "score")


def test_bounded_search_without_coverage(spark, index, asked):
    whole = search.tfidf_scores(index, asked).select("query_id", "doc_id", F.round("tfidf", 6).alias("score"))
    got = search.Bounded(index, asked, 7, coverage=0.0).best()
    assert plain(got, "query_id", "rank", "doc_id", "score") == plain(search.top_k(whole, 7), "query_id", "rank", "doc_id", "score")


def test_bounded_search_keeps_ties_by_id(spark):
    docs = spark.createDataFrame([(k, "igual texto aqui", 1) for k in range(40)] + [(99, None, None), (98, "", 2)], DOCS)
    index = inverted.tables(docs)
    asked = spark.createDataFrame([(1, "igual texto"), (2, None)], ASKED)
    assert [r["doc_id"] for r in search.Bounded(index, asked, 3).best().orderBy("rank").collect()] == [0, 1, 2]


def test_batches_give_the_index_of_one_go(spark, asked, tmp_path):
    docs = topics(120)[0]
    grown, once = inverted.Index(spark, f"{tmp_path}/grown"), inverted.Index(spark, f"{tmp_path}/once")
    parts = [docs[:50], docs[30:90], docs[60:], docs[:10]]  # rows of earlier batches come again
    seen = []
    for part in parts:
        grown.add(spark.createDataFrame(part, DOCS))
        seen.append(grown.tables())
    once.add(spark.createDataFrame(docs + docs[:20], DOCS))
    assert grown.versions() == [1, 2, 3] and once.versions() == [1]  # the last batch brought nothing
    a, b = grown.tables(), once.tables()
    assert plain(a["vocab"].select("term", "df", F.round("idf", 9).alias("idf")), "term", "df", "idf") == plain(b["vocab"].select("term", "df", F.round("idf", 9).alias("idf")), "term", "df", "idf")
    assert plain(a["norms"].select("doc_id", F.round("norm", 9).alias("n")), "doc_id", "n") == plain(b["norms"].select("doc_id", F.round("norm", 9).alias("n")), "doc_id", "n")
    rows = [plain(search.Bounded(x, asked, 4, sections=x["docs"].select("doc_id", "section_number")).best(), "query_id", "rank", "doc_id", "score") for x in (a, b)]
    assert rows[0] == rows[1] and rows[0]
    # a reader keeps its version
    assert seen[0]["docs"].count() == seen[0]["norms"].count() == 50 and seen[1]["docs"].count() == 90
    # a version without its list isn't there
    b["vocab"].write.parquet(f"{tmp_path}/grown/versions/9/vocab")
    assert max(grown.versions()) == 3
    assert grown.merge() == 4 and len(grown.segments()) == 1
    merged = grown.tables()
    assert plain(search.Bounded(merged, asked, 4).best(), "query_id", "doc_id", "score") == plain(search.Bounded(b, asked, 4).best(), "query_id", "doc_id", "score")
    grown.drop_before(4)
    assert grown.versions() == [4] and len(io.there(spark, f"{tmp_path}/grown/segments/*")) == 1
    assert grown.tables()["docs"].count() == 120


def test_an_index_keeps_no_texts(spark, tmp_path):
    """A text is not written into the index, whether ids come again or not, and words are read once for all their tables."""
    docs = spark.createDataFrame([(1, "uno dos", "grande casa"), (2, "dos", "casa")], "doc_id long, text string, content string").withColumn("section_number", F.lit(3))
    index = inverted.Index(spark, f"{tmp_path}/i")
    index.add(docs, "content")
    index.add(docs.union(docs).union(docs.withColumn("doc_id", F.lit(5).cast("long"))), "content")  # 1 and 2 again, 5 twice: its smallest row stays
    t = index.tables()
    assert t["docs"].columns == ["doc_id", "section_number"] and plain(t["docs"], "doc_id", "section_number") == [(1, 3), (2, 3), (5, 3)]
    assert plain(t["words"].where("doc_id != 5"), "doc_id", "word") == [(1, "casa"), (1, "grande"), (2, "casa")]
    assert plain(t["words"].where("doc_id = 5"), "word") == [("casa",)] and set(plain(t["lexicon"], "word")) == {("casa",), ("grande",)}


def test_an_empty_index_answers_nothing(spark, asked, tmp_path):
    empty = inverted.Index(spark, f"{tmp_path}/e")
    assert empty.versions() == [] and empty.add(spark.createDataFrame([], DOCS)) == 1
    assert search.Bounded(empty.tables(), asked, 3).best().count() == 0


def test_tables_of_one_key_meet_without_an_exchange(spark, tmp_path):
    """Postings and vocabulary, norms and documents, words and lexicon: no exchange above their scans."""
    docs = spark.createDataFrame(topics(60)[0], DOCS)
    index = inverted.Index(spark, f"{tmp_path}/i")
    index.add(docs.where("doc_id < 30"))
    index.add(docs)
    index.merge()
    t = index.tables()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for a, b in (("postings", "vocab"), ("norms", "docs"), ("words", "lexicon")):
            met = t[a].join(t[b], inverted.KEYS[a])
            plan = met._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    met = t["postings"].join(F.broadcast(spark.createDataFrame([("comun1", 1.0)], "term string, q double")), "term")
    assert not re.search(r"^\W*Exchange", met._jdf.queryExecution().executedPlan().toString(), re.M)


def test_terms_are_counted_inside_each_row(spark):
    texts = ["uno dos dos tres dos uno", "a b", "", None, "ÁRBOL árbol " * 50]
    got = {}
    for r in search.counts(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect():
        got.setdefault(r["id"], {})[r["term"]] = r["tf"]
    for k, text in enumerate(texts):
        w = re.findall(r"\w{2,}", (text or "").lower().replace("á", "a"))
        assert got.get(k, {}) == dict(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))


def test_weights_are_those_of_the_formula(spark):
    docs = [(1, "uno dos dos"), (2, "dos tres"), (3, "cuatro")]
    t = inverted.tables(spark.createDataFrame(docs, "doc_id long, text string"))
    idf = {r["term"]: r["idf"] for r in t["vocab"].collect()}
    assert idf["dos"] == pytest.approx(math.log(4 / 3) + 1) and idf["uno dos"] == pytest.approx(math.log(4 / 2) + 1)
    (row,) = search.tfidf_scores(t, spark.createDataFrame([(7, "tres cuatro")], ASKED)).where("doc_id = 3").collect()
    q = [idf["tres"], idf["cuatro"]]
    assert row["tfidf"] == pytest.approx(q[1] / math.hypot(*q))


def test_a_stored_step_follows_its_tables(spark, tmp_path):
    rows = lambda text: spark.createDataFrame([(len(text), text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    rows("alfa beta").write.parquet(f"{tmp_path}/documents.parquet")
    ask = lambda: {r["term"] for r in catalogue.QUERIES["tfidf_vocab"](spark, str(tmp_path)).collect()}
    assert ask() == {"alfa", "beta", "alfa beta"}
    paths = dict(catalogue.Tables.written)
    assert ask() == {"alfa", "beta", "alfa beta"} and catalogue.Tables.written == paths  # read, not made again
    rows("gama").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert ask() == {"gama"}
    rows("delta").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert ask() == {"gama", "delta"}
    catalogue.Tables.clear(spark)
    assert not any(k[0] == spark.sparkContext.applicationId for k in catalogue.Tables.written) and ask() == {"gama", "delta"}


def test_an_upload_that_fails_halfway_adds_nothing_twice(spark, tmp_path, monkeypatch):
    schema = "doc_id long, text string"
    chunks = lambda d: d.select(F.concat_ws("-", "doc_id", F.lit("c")).alias("doc_id"), "text", F.col("text").alias("content"))
    up = ingest.Upload(spark, f"{tmp_path}/c", "Mi colección 1", chunks)
    rows = [(1, "uno dos"), (2, "UNO  dos"), (3, "tres"), (4, None), (5, "")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    whole = ingest.Upload._batch

    def halfway(self, batch, number):
        self.index.add(self.chunks_of(batch.where("doc_id = 1")), self.content)
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest.Upload, "_batch", halfway)
    with pytest.raises(Exception, match="lost"):
        up.take(f"{tmp_path}/in/*", schema)
    monkeypatch.setattr(ingest.Upload, "_batch", whole)
    up.take(f"{tmp_path}/in/*", schema)
    assert plain(up.report(), "doc_id", "status") == [(1, "converted"), (2, "duplicate"), (3, "converted"), (5, "converted")]
    spark.createDataFrame([(9, "tres"), (10, "diez")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    up.take(f"{tmp_path}/in/*", schema)
    assert plain(up.index.tables()["docs"], "doc_id") == [("1-c",), ("10-c",), ("3-c",), ("5-c",)]
    assert up.summary().first().asDict() == {"collection_name": "Mi colección 1", "collection_slug": "mi-coleccion-1", "manufacturer_runtime": "UPLOAD_mi-coleccion-1", "documents": 4, "chunks": 4}
    assert spark.read.json(f"{tmp_path}/c/summary").count() == 1


def test_keys_of_several_segments_meet(spark, asked, tmp_path):
    """Of three segments a word comes once, and each document has its norm, where no table is sent to every task."""
    rows = [(k, f"comun uno{k % 5} dos{k % 7} tres{k}", 1) for k in range(60)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = inverted.Index(spark, f"{tmp_path}/i")
        for k in range(3):
            index.add(spark.createDataFrame([r for r in rows if r[0] % 3 == k], DOCS))
        t = index.tables()
        words = [r["word"] for r in t["lexicon"].distinct().collect()]
        assert sorted(words) == sorted({w for _, text, _ in rows for w in text.split() if len(w) >= 4})
        whole = inverted.Index(spark, f"{tmp_path}/w")
        whole.add(spark.createDataFrame(rows, DOCS))
        assert plain(t["norms"], "doc_id") == plain(whole.tables()["norms"], "doc_id") == [(k,) for k in range(60)]
        assert {r["doc_id"]: round(r["norm"], 9) for r in t["norms"].collect()} == {r["doc_id"]: round(r["norm"], 9) for r in whole.tables()["norms"].collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_an_upload_reports_and_counts_without_its_index(spark, tmp_path):
    """Each stage takes up what the one before has left; a batch that comes again says what it said; fingerprints lie in a file a folder."""
    schema = "doc_id long, text string"
    chunks = lambda d: d.select(F.concat_ws("-", "doc_id", F.lit("c")).alias("doc_id"), "text", F.col("text").alias("content"))
    up = ingest.Upload(spark, f"{tmp_path}/c", "c", chunks)
    rows = [(k, f"texto {k % 300}") for k in range(400)] + [(1, "TEXTO 1"), (1, "texto 1")]
    spark.createDataFrame(rows, schema).repartition(8).write.parquet(f"{tmp_path}/in/0")
    up.receive(f"{tmp_path}/in/*", schema)
    told = plain(up.report(), "doc_id", "status")
    assert told == sorted((k, "converted" if k < 300 else "duplicate") for k, _ in rows)
    assert not io.there(spark, f"{tmp_path}/c/chunks") and not up.index.versions()
    up._batch(spark.createDataFrame(rows, schema), 0)
    assert plain(up.report(), "doc_id", "status") == told
    files = io.there(spark, f"{tmp_path}/c/documents/batch=0/folder=*/*.parquet")
    assert len(files) == len({f.rsplit("/", 2)[1] for f in files})
    up.convert()
    assert not up.index.versions() and (up.summary().first()["documents"], up.summary().first()["chunks"]) == (300, 300)
    up.build()
    assert up.index.tables()["docs"].count() == 300
