"""Incremental indexing as a stream: new and changed notes go into the store, unchanged ones are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathom.operators.ann import AnnIndex
from fathom.operators.chunking import chunk_notes
from fathom.operators.segments import SegmentedIndex
from fathom.operators.store import UnitStore, changed
from fathom.providers import Embedder, embed_column, hashing_embedder
from fathom.sources.vault import parse_notes
from fathom.storage import Workspace

KEPT = ("date", "project", "type", "public", "content_sha")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def units_of(notes: DataFrame, embedder: Embedder, chunk_size: int = 1000, chunk_overlap: int = 100) -> DataFrame:
    """The store's units of parsed notes: chunks with their note's fields and content hash, and a vector."""
    return embed_column(chunk_notes(notes, chunk_size, chunk_overlap, KEPT), embedder)


def index_stream(arrivals: DataFrame, store: UnitStore, checkpoint: str, embedder: Embedder | None = None, chunk_size: int = 1000, chunk_overlap: int = 100, words: SegmentedIndex | None = None, vectors: AnnIndex | None = None) -> StreamingQuery:
    """Parse, chunk, embed and upsert every micro-batch of arrivals (source, raw, version) into the store, and into the
    lexical index `words`, where each batch becomes a segment of its own, and the vector index `vectors`. Of several
    versions of a note in a batch the last counts; notes whose body the store has already are skipped; a note is public
    only if its frontmatter says so. Each batch counts once even if it runs again, as its sources are replaced. Runs until
    all that is there has been read."""
    embedder = embedder or hashing_embedder()

    def put(batch: DataFrame, _: int) -> None:
        work = Workspace(batch.sparkSession, "arrivals")
        notes = work.table(parse_notes(latest(batch, "source", "version").select("source", "raw")), "notes")
        sources = notes.select("source")
        known = store.read("").join(sources, "source", "left_semi").select("source", "content_sha", "public").distinct()
        new = work.table(changed(known, notes, digest=("content_sha", "public")), "changed")
        fresh = work.table(units_of(new, embedder, chunk_size, chunk_overlap), "units")
        if not new.isEmpty():
            store.upsert(fresh, sources=new)
        if words is not None:  # also notes that the store had before: a batch may have ended between the two
            words.upsert(store.read("").join(sources, "source", "left_semi"), sources)
        if vectors is not None:
            vectors.add(fresh)
        work.remove()

    return arrivals.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame, time_col: str, late: str) -> DataFrame:
    """events with `_at`; times without a zone are taken as UTC session time, which watermarks need."""
    timed = events.withColumn("_at", F.col(time_col).cast("timestamp"))
    return timed.withWatermark("_at", late) if events.isStreaming else timed


def windowed_counts(events: DataFrame, time_col: str, window: str, late: str, *by: str, slide: str | None = None) -> DataFrame:
    """Events per window and group, with a watermark; for streams and tables alike. Windows tumble, or begin every `slide`."""
    span = F.window("_at", window, slide) if slide else F.window("_at", window)
    counted = _timed(events, time_col, late).groupBy(span.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), *by, "n")


def session_counts(events: DataFrame, time_col: str, gap: str, late: str, *by: str) -> DataFrame:
    """(start, finish, by..., n): runs of a group's events with no pause longer than gap; a session ends a gap after its last
    event. A stream tells of a session once the watermark has passed its end; rows that come later than that are left out."""
    counted = _timed(events, time_col, late).groupBy(F.session_window("_at", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("finish"), *by, "n")
