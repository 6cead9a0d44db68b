"""An inverted index that grows by batches.

An index is a folder. A batch of documents is a segment: postings (term, doc_id, tf), words (doc_id, word_id, word) with each
word once (word_id, word) and their pieces (gram, word_id), and the documents (doc_id and what else the batch has but its texts). Segments
are never changed. A version lists its segments and holds what depends on all of them: vocab (term, df, idf) and norms
(doc_id, norm). Document frequencies are merged from the last version and the new segment; norms follow the idf and are made
anew from the postings. A version's list is written last and it is there once that list is, so readers go from one version
to the next at once and keep the one that they began with.

Tables that meet by a key are bucketed and sorted by it: postings and vocab by term, norms and documents by doc_id, words,
lexicon by word_id, grams by gram. The number of buckets stands in the folder's name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import io
from . import search

#: The key that each table of a segment or a version is bucketed by.
KEYS = {"postings": "term", "words": "word_id", "lexicon": "word_id", "grams": "gram", "docs": "doc_id", "vocab": "term", "norms": "doc_id"}
#: Characters of text whose postings are put in order by one task.
CHARS = 1 << 24
SEGMENT, VERSION = ("postings", "words", "lexicon", "grams", "docs"), ("vocab", "norms")


def segment_tables(docs: DataFrame, content: str = "text") -> dict[str, DataFrame]:
    """The tables of a segment of docs (doc_id, text; coverage asks the column `content`; more columns are kept in docs, texts are not).

    Terms are counted inside each row. Words are the runs of four or more letters and digits, which hold every term that
    coverage can ask for; a word's pieces are its runs of GRAM characters, each once.
    """
    postings = search.counts(docs, "doc_id", "text").select("term", F.col("id").alias("doc_id"), "tf")
    of_doc = search.long_words(docs, "doc_id", content).withColumnRenamed("id", "doc_id")
    words = of_doc.select("doc_id", search.word_id(F.col("word")).alias("word_id"), "word")
    lexicon = lexicon_of(words)
    return {"postings": postings, "words": words, "lexicon": lexicon, "grams": grams_of(lexicon), "docs": docs.drop("text", content)}


def lexicon_of(words: DataFrame) -> DataFrame:
    """(word_id, word): each word of words (doc_id, word_id, word) once."""
    return words.select("word_id", "word").distinct()


def grams_of(lexicon: DataFrame) -> DataFrame:
    """(gram, word_id): the pieces of each word."""
    return lexicon.select(F.explode(search.grams(F.col("word"))).alias("gram"), "word_id")


def coverage_tables(words: DataFrame, lexicon: DataFrame) -> dict[str, DataFrame]:
    """What coverage alone asks of an index: of words (doc_id, word) and the lexicon (word_id, word), which have been written down."""
    return {"words": words.select("doc_id", search.word_id(F.col("word")).alias("word_id")), "lexicon": lexicon, "grams": grams_of(lexicon)}


def frequencies(postings: DataFrame) -> DataFrame:
    """(term, df) of postings, which hold a pair once."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def norms(docs: DataFrame, postings: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, norm) of every document; 0 without terms."""
    w = F.col("tf") * F.col("idf")
    sums = postings.join(vocab, "term").groupBy("doc_id").agg(F.sqrt(F.sum(w * w)).alias("norm"))
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("norm", F.lit(0.0)).alias("norm"))


def tables(docs: DataFrame, content: str = "text") -> dict[str, DataFrame]:
    """All tables of an index of docs as plain DataFrames, nothing written: for small inputs."""
    t = segment_tables(docs, content)
    vocab = search.vocabulary(frequencies(t["postings"]), docs.count())
    return t | {"vocab": vocab, "norms": norms(docs, t["postings"], vocab)}


class Index:
    """The index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, in order."""
        return sorted(int(p.rstrip("/").split("/")[-2]) for p in io.there(self.spark, f"{self.path}/versions/*/segments", "_SUCCESS"))

    def segments(self, version: int | None = None) -> dict[str, tuple[int, int]]:
        """{segment: (documents, buckets)} of a version, the last one if none is named; empty before the first batch."""
        number = version if version is not None else max(self.versions(), default=None)
        if number is None:
            return {}
        listed = self.spark.read.parquet(f"{self.path}/versions/{number}/segments").collect()  # a row for each batch
        return {r["segment"]: (r["documents"], r["buckets"]) for r in listed}

    def _read(self, name: str, places: dict[str, int]) -> DataFrame:
        """One table of several places (folder: buckets) as one.

        Keys are never null. Asking so keeps a union in rows: Spark 4.1 takes a union of tables bucketed alike as bucketed, too,
        but where it reads columns it puts their buckets one behind the other, so that keys don't meet.
        """
        parts = [io.read_bucketed(self.spark, f"{self.path}/{place}/{name}", KEYS[name], n) for place, n in places.items()]
        if len(parts) > 1:
            parts = [p.where(F.col(KEYS[name]).isNotNull()) for p in parts]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version (the last one if none is named) over all its segments."""
        number = version if version is not None else max(self.versions())
        segments = self.segments(number)
        places = {f"segments/{s}": n for s, (_, n) in segments.items()}
        buckets = max(n for _, n in segments.values())
        return {name: self._read(name, places) for name in SEGMENT} | {name: self._read(name, {f"versions/{number}": buckets}) for name in VERSION}

    def _buckets(self, docs: DataFrame) -> int:
        """No more files than a few for each core, but as many as keep a bucket of postings at some CHARS characters of text."""
        few = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism)
        chars = docs.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
        return max(few, -(-chars // CHARS))

    def add(self, docs: DataFrame, content: str = "text") -> int:
        """Adds a batch of docs (doc_id, text, ...) as a segment and returns the new version's number.

        doc_ids that the index has already, and those that repeat within the batch, are left out (of these the smallest
        row stays); an empty batch makes no version unless it is the first. docs are read several times where they lie: their
        ids alone are exchanged as long as none comes again.
        """
        old, buckets = self.segments(), self._buckets(docs)
        again = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
        if again:
            others = [c for c in docs.columns if c != "doc_id"]
            docs = docs.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("d")).select("doc_id", "d.*")
        known = self.tables()["docs"].select("doc_id") if old else None
        if old and not docs.select("doc_id").join(known, "doc_id", "left_semi").isEmpty():
            docs, again = docs.join(known, "doc_id", "left_anti"), True
        if again:
            docs = io.staged(docs, "batch")
        segment = uuid.uuid4().hex
        place = f"{self.path}/segments/{segment}"
        made = segment_tables(docs, content)

        def write(name: str, table: DataFrame) -> DataFrame:
            io.write_bucketed(table, f"{place}/{name}", KEYS[name], buckets)
            return io.read_bucketed(self.spark, f"{place}/{name}", KEYS[name], buckets)

        new = write("docs", made["docs"]).count()
        if old and not new:
            return max(self.versions())
        write("postings", made["postings"])
        lexicon = write("lexicon", lexicon_of(write("words", made["words"])))
        write("grams", grams_of(lexicon))
        segments = {**old, segment: (new, buckets)}
        number = max(self.versions(), default=0) + 1
        self._commit(number, segments, frequencies(self._read("postings", {f"segments/{segment}": buckets})))
        return number

    def _commit(self, number: int, segments: dict[str, tuple[int, int]], df: DataFrame) -> None:
        """Writes version `number` of these segments; df: frequencies of what the version before doesn't hold."""
        place, buckets = f"{self.path}/versions/{number}", max(n for _, n in segments.values())
        if number - 1 in self.versions():
            df = df.union(self.tables(number - 1)["vocab"].select("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))
        n = sum(d for d, _ in segments.values())
        io.write_bucketed(search.vocabulary(df, n), f"{place}/vocab", KEYS["vocab"], buckets)
        vocab = io.read_bucketed(self.spark, f"{place}/vocab", KEYS["vocab"], buckets)
        postings, docs = (self._read(name, {f"segments/{s}": b for s, (_, b) in segments.items()}) for name in ("postings", "docs"))
        io.write_bucketed(norms(docs, postings, vocab), f"{place}/norms", KEYS["norms"], buckets)
        listed = [(s, d, b) for s, (d, b) in segments.items()]
        self.spark.createDataFrame(listed, "segment string, documents long, buckets int").coalesce(1).write.parquet(f"{place}/segments")

    def merge(self) -> int:
        """Makes one segment of all, as a new version, so that reads stay few after many batches; returns its number."""
        old, t = self.segments(), self.tables()
        buckets, segment = max(n for _, n in old.values()), uuid.uuid4().hex
        place = f"{self.path}/segments/{segment}"
        for name in SEGMENT:
            whole = t[name].distinct() if name in ("lexicon", "grams") else t[name]
            io.write_bucketed(whole, f"{place}/{name}", KEYS[name], buckets)
        number = max(self.versions()) + 1
        listed = {segment: (sum(d for d, _ in old.values()), buckets)}
        for name in VERSION:
            io.write_bucketed(t[name], f"{self.path}/versions/{number}/{name}", KEYS[name], buckets)
        self.spark.createDataFrame([(s, d, b) for s, (d, b) in listed.items()], "segment string, documents long, buckets int").coalesce(1).write.parquet(f"{self.path}/versions/{number}/segments")
        return number

    def drop_before(self, version: int) -> None:
        """Takes away the versions before this one, and the segments that neither it nor a later one lists."""
        stay = {s for v in self.versions() if v >= version for s in self.segments(v)}
        for v in [v for v in self.versions() if v < version]:
            io.delete(self.spark, f"{self.path}/versions/{v}")
        for place in io.there(self.spark, f"{self.path}/segments/*"):
            if place.rstrip("/").split("/")[-1] not in stay:
                io.delete(self.spark, place)
