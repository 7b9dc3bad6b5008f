"""The corpus pipeline: language ID, exact dedup, near-duplicate join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as Parquet in the
shared folder and reads it again as the next one's docs. All stages but the last return the columns of documents, and
no stage changes a text. Rows are kept or dropped one by one by their text, so rows that repeat a doc_id or have none lose
nothing. Columns beside doc_id and text may have any names. A stage over an empty table returns no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import language_id
from fathom.llm.decontamination import clean_documents
from fathom.llm.exact_dedup import exact_duplicates
from fathom.llm.members import without
from fathom.llm.ngram_join import similarity_components
from fathom.llm.packing import pack_documents
from fathom.llm.queries import END_ID, tokenizer_path
from fathom.storage import Workspace, sweep, temporary


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be determined: those without a letter. Where no document is labelled there
    is no language to learn, and still only those go."""
    return language_id.determined(docs, language_id.fit(docs))


def _row(doc_id: Column, digest: Column) -> Column:
    """What tells a row from all others but those with the same id and text."""
    return F.sha2(F.concat_ws(":", doc_id.cast("string"), digest), 256)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays (a missing one is the smallest). Rows that
    repeat an id with another text are documents of their own."""
    kept = Workspace(spark, "exact-dropped")
    with temporary():
        found = exact_duplicates(docs).where("not kept")
        gone = kept.table(found.select(_row(F.col("id"), F.lower(F.hex("digest"))).alias("row")), "rows")
    sweep(spark)
    return without(docs, _row(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)), gone, "row")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (5-word Jaccard of 0.8 or more) the document with the smallest doc_id stays.
    Where ids are missing or repeat, rows get numbers that take their place; a row without an id is the last to stay."""
    kept = Workspace(spark, "near-dropped")
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        with temporary():
            found = similarity_components(docs, width=5, percent=80)
            gone = kept.table(found.where("component_id <> doc_id").select("doc_id"), "ids")
        sweep(spark)
        return without(docs, "doc_id", gone, "doc_id")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows = kept.table(docs.select(F.monotonically_increasing_id().alias("number"), whole), "numbered")
    with temporary():
        found = similarity_components(rows.select("number", F.col("whole.text").alias("text")), id_col="number", width=5, percent=80)
        ranked = found.join(rows.select("number", F.col("whole.doc_id").alias("doc_id")), "number")
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "number")
        stays = ranked.groupBy("component_id").agg(F.min(order).alias("least"))
        gone = kept.table(ranked.join(stays, "component_id").where("number <> least.number").select("number"), "numbers")
    sweep(spark)
    return without(rows, "number", gone, "number").select("whole.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated with benchmark passages; the others keep their whole text."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return pack_documents(docs, tokenizer_path(), END_ID, capacity=1024)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The first stage is a trained classifier, which SQL cannot express; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        work = Workspace(spark, f"pipeline-{name.replace(' ', '-')}")
        docs = work.table(stage(spark, docs, sf_dir), "docs")
        if before is not None:
            before.remove()
        before = work
    return docs
