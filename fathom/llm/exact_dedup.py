"""Exact deduplication with streaming state on disk.

Digests of arriving documents go to an inbox in the shared folder. A Structured Streaming aggregation keyed by the
digest reads them in micro-batches; its state lives in RocksDB, is checkpointed to the shared folder and never
expires. For each digest it keeps the largest id (the stable identifier), where that document is (the content
locator) and how many rows have come. The state is read back with Spark's state data source. Digests that came more
than once are hits: their rows' full texts are compared with the text of the row that stays, and only equal bytes
count as copies. Everything runs in DataFrame operators; no Python code touches a row.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.storage import Workspace

from .members import may_match

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a store's memory is given back as soon as its batch is in
}


@contextlib.contextmanager
def _store(spark: SparkSession) -> Iterator[None]:
    """The session's settings for the state store while it is written or read."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    try:
        for k, v in _STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class ExactDedup:
    """Deduplicates by equal text, across as many arrivals as wanted.

    ingest() may be called again and again with further documents; resolve() then tells about any documents that have
    been ingested, in one call or in several; the texts of rows that stay are read again from the arrivals they came in.
    Null texts count as empty and all empty texts are copies of each other. Of equal texts the row with the largest id stays; a null id is smaller than any other. Rows that repeat an id with the same text stay or
    go together. Columns other than id and text are ignored.
    """

    def __init__(self, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000):
        self.spark, self.id_col, self.text_col, self.digest = spark, id_col, text_col, digest
        self.work, self.files_per_batch = Workspace(spark, "exact-dedup"), files_per_batch
        self._arrived: list[DataFrame] = []

    def _texts(self, docs: DataFrame) -> DataFrame:
        text, place = F.coalesce(F.col(self.text_col), F.lit("")), F.input_file_name()
        try:
            docs.select(place)
        except AnalysisException:  # not read from files of one source: the id alone locates a document
            place = F.lit("")
        return docs.select(self.digest(text).alias("digest"), F.col(self.id_col).alias("id"), text.alias("text"), place.alias("locator"))

    def ingest(self, docs: DataFrame) -> None:
        """Add documents to the state."""
        self._arrived.append(docs)
        inbox = self.work.path("inbox")
        arrivals = self._texts(docs).drop("text")
        arrivals.write.mode("append").parquet(inbox)
        with _store(self.spark):
            stream = self.spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(inbox)
            kept = stream.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("top"), F.count(F.lit(1)).alias("rows"))
            run = kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", self.work.path("state")).trigger(availableNow=True).start()
            run.awaitTermination()

    def state(self) -> DataFrame:
        """(digest, keep_id, locator, rows) as the state has them now."""
        stored = self.spark.read.format("statestore").load(self.work.path("state"))
        top, count = (F.col("value").getField(f) for f in stored.schema["value"].dataType.names)
        return stored.select(F.col("key.digest").alias("digest"), top["id"].alias("keep_id"), top["locator"].alias("locator"), count.alias("rows"))

    def resolve(self, docs: DataFrame) -> DataFrame:
        """(id, keep_id, group_size, kept, digest) for each row of docs, all of which have been ingested; the groups are
        those of all arrivals."""
        whole = len(self._arrived) == 1 and self._arrived[0] is docs
        with _store(self.spark):
            state = self.work.table(self.state(), "kept")
        single = state.where("rows = 1").select(F.col("keep_id").alias("id"), "keep_id", F.col("rows").alias("group_size"), F.lit(True).alias("kept"), "digest")
        hits = state.where("rows > 1")
        asked = self._texts(docs)
        if not whole:
            digests = self.work.table(asked.select("digest").distinct(), "asked")
            single = asked.select("id", "digest").join(single.drop("id"), "digest").select(*single.columns)
            hits = self.work.table(hits.join(digests, "digest", "left_semi"), "asked-hits")
        asked = may_match(asked, "digest", hits, "digest")
        texts = asked if whole else may_match(functools.reduce(DataFrame.unionByName, map(self._texts, self._arrived)), "digest", hits, "digest")
        # The row that stays, with its text; then every row of its digest beside it.
        tops = texts.join(hits.select("digest", "keep_id", "rows"), "digest").where(F.col("id").eqNullSafe(F.col("keep_id"))).withColumnRenamed("text", "keep_text")
        tops = tops.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("rows").alias("rows"), F.max("keep_text").alias("keep_text"))
        tops = self.work.table(tops, "tops")  # a table of its own, so that the join below can split a hot digest

        def compared(rows: DataFrame) -> DataFrame:
            beside = rows.join(tops, "digest").select("id", "keep_id", F.col("rows").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", (F.col("text") == F.col("keep_text")).alias("same"))
            return self.work.table(beside, "hits")

        beside = compared(asked)
        found = single.unionByName(beside.where("same").drop("same"))
        clash = (beside if whole else compared(texts)).where("not same").select("digest").distinct()
        if clash.isEmpty():
            return found
        # Different texts under one digest: group those by their full bytes.
        clash = self.work.table(clash, "clash")
        rows = self.work.table(texts.join(clash, "digest", "left_semi").select("id", "digest", "text"), "clash-texts")
        groups = rows.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        rows = rows if whole else asked.join(clash, "digest", "left_semi").select("id", "digest", "text")
        parted = rows.join(groups, ["digest", "text"]).select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
        return found.join(clash, "digest", "left_anti").select(*parted.columns).unionByName(parted)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One table's (id, keep_id, group_size, kept, digest), see ExactDedup. An empty table gives an empty result."""
    run = ExactDedup(docs.sparkSession, id_col, text_col, digest)
    run.ingest(docs)
    return run.work.finish(run.resolve(docs))
