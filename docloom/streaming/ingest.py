"""Micro-batch ingestion: new files are fingerprinted, folded, chunked and indexed as they come."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import inverted, scan, search
from ..sources import io

FOLDERS = 256


def ingest(spark: SparkSession, source: str, target: str, schema: str, state: str) -> DataFrame:
    """Runs all new Parquet files below source through foreachBatch and returns what the target holds.

    target: (doc_id, text_sha256, tokens) in FOLDERS folders by the beginning of the fingerprint; a batch reads, of the
    folders its own fingerprints fall into, the fingerprint column alone. A text that an earlier batch or row has brought
    is not written again; state is the checkpoint folder of the stream.
    """
    made = "doc_id long, text_sha256 string, tokens int, folder string"
    spark.createDataFrame([], made).write.mode("append").partitionBy("folder").parquet(target)

    def write(batch: DataFrame, _: int) -> None:
        new = batch.select("doc_id", T.fingerprint(F.col("text")).alias("text_sha256"), T.token_estimate(F.col("text")).alias("tokens"))
        new = new.groupBy("text_sha256").agg(F.min(F.struct("doc_id", "tokens")).alias("f"))
        new = new.select("f.doc_id", "text_sha256", "f.tokens", F.substring("text_sha256", 1, 2).alias("folder")).persist()
        try:
            folders = [r[0] for r in new.select("folder").distinct().collect()]  # FOLDERS at most
            seen = batch.sparkSession.read.schema(made).parquet(target).where(F.col("folder").isin(folders)).select("folder", "text_sha256")
            new.join(seen, ["folder", "text_sha256"], "left_anti").select("doc_id", "text_sha256", "tokens", "folder").write.mode("append").partitionBy("folder").parquet(target)
        finally:
            new.unpersist()

    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(source)
    query = stream.writeStream.queryName("ingest_" + uuid.uuid4().hex).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(made).parquet(target).drop("folder")


class Upload:
    """A collection of uploaded documents in a folder: what has come (`documents`, `texts`), what became of each row (`report`),
    the chunks, their index, and the stream's state (S12).

    It has three stages, each of which takes up what the one before has left: `receive` the files, `convert` new texts to
    chunks, `build` the index of them; `take` runs all. A stated set of questions needs no index: `count` keeps the frequencies of
    each batch's terms, and `texts` are the chunks with the frequencies of all batches. A batch's texts that an earlier batch or row has brought are reported
    as duplicates and go no further. What a stage makes of a batch lies in a folder of the batch's number, which is made anew
    if the stage failed halfway; the index leaves out chunks that it has already.
    """

    SEEN = "doc_id long, text_sha256 string, batch int, folder string"

    def __init__(self, spark: SparkSession, folder: str, name: str, chunks_of: Callable[[DataFrame], DataFrame], content: str = "content"):
        """chunks_of: from documents (doc_id, text, ...) to what the index takes (doc_id, text, `content`, ...), or to what scan.Texts does (doc_id, head, text, ...)."""
        self.spark, self.folder, self.name, self.chunks_of, self.content = spark, folder, name, chunks_of, content
        self.index = inverted.Index(spark, f"{folder}/index")

    def _seen(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.SEEN).parquet(f"{self.folder}/documents")

    def _batch(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = io.staged(batch.where("text IS NOT NULL").withColumn("text_sha256", T.fingerprint(F.col("text"))), "upload")
        ids = keyed.select("doc_id", "text_sha256", F.substring("text_sha256", 1, 1).alias("folder"))
        folders = [r[0] for r in ids.select("folder").distinct().collect()]  # 16 at most
        seen = self._seen(spark).where(F.col("folder").isin(folders) & (F.col("batch") != number)).select("folder", "text_sha256")
        first = ids.groupBy("text_sha256", "folder").agg(F.min("doc_id").alias("doc_id"))
        first = io.staged(first.join(seen, ["folder", "text_sha256"], "left_anti").select("doc_id", "text_sha256", "folder"), "new")
        # texts meet the ids of those that stay; rows that repeat an id and a text but for case and white space are rare
        new, others = keyed.join(first.drop("folder"), ["doc_id", "text_sha256"]), [c for c in batch.columns if c != "doc_id"]
        if not ids.groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
            new = new.groupBy("doc_id", "text_sha256").agg(F.min(F.struct(*others)).alias("d")).select("doc_id", "d.*")
        new.select("doc_id", *others).write.mode("overwrite").parquet(f"{self.folder}/texts/batch={number}")
        # a file for each folder, not one for each folder and task
        first.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{self.folder}/documents/batch={number}")
        told = ids.join(first.select("text_sha256", F.col("doc_id").alias("first")), "text_sha256", "left")
        status = F.when(F.col("doc_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), "converted").otherwise("duplicate")
        told.select("doc_id", status.alias("status")).write.mode("overwrite").parquet(f"{self.folder}/report/batch={number}")

    def _batches(self, stage: str) -> list[int]:
        """Numbers of the batches that a stage has done, in order."""
        return sorted(int(p.rstrip("/").split("=")[-1]) for p in io.there(self.spark, f"{self.folder}/{stage}/batch=*", "_SUCCESS"))

    def receive(self, source: str, schema: str) -> None:
        """Takes all Parquet files below source that no earlier call has taken, and reports what becomes of their rows."""
        if not io.there(self.spark, f"{self.folder}/documents"):
            none = self.spark.range(0).select(F.col("id").alias("doc_id"), F.lit("").alias("text_sha256"), F.lit(0).alias("batch"), F.lit("").alias("folder"))
            none.write.mode("append").partitionBy("batch", "folder").parquet(f"{self.folder}/documents")
        stream = self.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(source)
        name = "upload_" + uuid.uuid4().hex
        query = stream.writeStream.queryName(name).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).foreachBatch(self._batch).start()
        query.awaitTermination()

    def convert(self) -> None:
        """Makes chunks of the texts of all batches that have none yet."""
        done = self._batches("chunks")
        for k in [k for k in self._batches("report") if k not in done]:
            self.chunks_of(self.spark.read.parquet(f"{self.folder}/texts/batch={k}")).write.mode("overwrite").parquet(f"{self.folder}/chunks/batch={k}")

    def build(self) -> None:
        """Adds the chunks of all batches to the index that it has not taken yet, a segment for each batch."""
        done = self._batches("indexed")
        for k in [k for k in self._batches("chunks") if k not in done]:
            chunks = self.spark.read.parquet(f"{self.folder}/chunks/batch={k}")
            self.index.add(scan.whole(chunks) if "head" in chunks.columns else chunks, self.content)
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/indexed/batch={k}")

    def _new(self, number: int) -> DataFrame:
        """The chunks that a batch is the first to bring, each once."""
        read = lambda k: self.spark.read.parquet(f"{self.folder}/chunks/batch={k}")
        docs, ids = search.once(read(number)), read(number).select("doc_id")
        for k in [k for k in self._batches("chunks") if k < number]:
            if not ids.join(read(k), "doc_id", "left_semi").isEmpty():
                docs = docs.join(read(k).select("doc_id"), "doc_id", "left_anti")
        return docs

    def count(self) -> None:
        """Counts the terms of the chunks of all batches whose terms are not counted yet, each batch apart."""
        done = self._batches("terms")
        for k in [k for k in self._batches("chunks") if k not in done]:
            scan.frequencies(scan.spread(self._new(k))).write.mode("overwrite").parquet(f"{self.folder}/terms/batch={k}")

    def texts(self) -> scan.Texts:
        """The chunks of all batches that `count` has seen, with the frequencies of their terms."""
        batches = self._batches("terms")
        df = self.spark.read.parquet(*[f"{self.folder}/terms/batch={k}" for k in batches])
        if len(batches) > 1:
            df = io.staged(df.groupBy("hash").agg(F.sum("df").alias("df")), "terms")
        docs = self._new(batches[0])
        for k in batches[1:]:
            docs = docs.unionByName(self._new(k))
        return scan.Texts(scan.spread(docs), df)

    def take(self, source: str, schema: str) -> None:
        """Takes all Parquet files below source that no earlier call has taken, through all stages."""
        self.receive(source, schema)
        self.convert()
        self.build()
        io.write_json(self.summary(), f"{self.folder}/summary")

    def report(self) -> DataFrame:
        """(doc_id, status, batch): `converted` or `duplicate` for each row that came with a text; a row that repeats both
        id and text within a batch says what its first does."""
        return self.spark.read.parquet(f"{self.folder}/report")

    def summary(self) -> DataFrame:
        """One row (K8): the collection, its documents and chunks, which the index holds or will hold by their ids."""
        name = self.spark.createDataFrame([(self.name,)], "collection_name string").withColumn("collection_slug", T.slug(F.col("collection_name")))
        chunks = self.spark.read.parquet(f"{self.folder}/chunks").agg(F.countDistinct("doc_id").alias("chunks"))
        documents = self._seen(self.spark).agg(F.count("*").alias("documents"))
        return documents.join(name, F.lit(True)).join(chunks, F.lit(True)).select("collection_name", "collection_slug", F.concat(F.lit("UPLOAD_"), "collection_slug").alias("manufacturer_runtime"), "documents", "chunks")
