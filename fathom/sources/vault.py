"""Sources: a folder of markdown notes, gold questions, question-answer benchmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.config import EXCLUDED_DIRS, GENERATED_FILES, GENERATED_PREFIX
from fathom.functions.text import is_public, strip

#: Fixed value: frontmatter lies between a first line that begins with --- and the next line of ---.
_FENCED = re.compile(r"\A---[^\n]*\n(.*?)\n---\s*\n(.*)\Z", re.S)
_PARSED = pa.schema([("fields", pa.map_(pa.string(), pa.string())), ("related", pa.list_(pa.string())), ("tags", pa.list_(pa.string())), ("body", pa.string())])


def is_generated(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.lower(F.element_at(parts, -1)).isin(*GENERATED_FILES) | F.exists(parts, lambda p: p.startswith(GENERATED_PREFIX))


def is_excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(d) for d in EXCLUDED_DIRS)))


def scan(spark: SparkSession, vault: str) -> DataFrame:
    """(source, raw) of every note below the folder; source is the path relative to it. Bytes that are no UTF-8 become
    replacement characters; unreadable files are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(vault)
    root = vault.rstrip("/").rpartition(":")[2].lstrip("/")
    inside = F.substring_index(F.col("path"), root + "/", -1)
    return files.select(inside.alias("source"), F.call_function("make_valid_utf8", F.col("content").cast("string")).alias("raw")).where(~is_excluded(F.col("source")) & ~is_generated(F.col("source")))


def split_frontmatter(raw: str | None) -> tuple[dict[str, str], list[str], list[str], str]:
    """(fields, related, tags, body). Only text that begins with --- has frontmatter, up to the next line of ---; without
    that line all is body. What YAML cannot read, or reads as no mapping, counts as empty. Lists are as they stand."""
    raw = raw or ""
    match = _FENCED.match(raw.replace("\r\n", "\n")) if raw.startswith("---") else None
    if not match:
        return {}, [], [], raw
    try:
        found = yaml.safe_load(match[1])
    except (yaml.YAMLError, ValueError):
        found = None
    found = found if isinstance(found, dict) else {}
    flat = {str(k): "" if v is None else str(v) for k, v in found.items() if not isinstance(v, (list, dict))}
    many = [[str(v) for v in (found[k] if isinstance(found[k], list) else [found[k]]) if v is not None] if k in found else [] for k in ("related", "tags")]
    return flat, *many, match[2]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [split_frontmatter(raw) for raw in batch.column("raw").to_pylist()]
        columns = [pa.array([list(r[i].items()) if i == 0 else r[i] for r in rows], f.type) for i, f in enumerate(_PARSED)]
        yield pa.RecordBatch.from_arrays([batch.column("source"), *columns], ["source", *_PARSED.names])


def _stripped(c: Column) -> Column:
    return F.filter(F.transform(c, strip), lambda x: x != "")


def parse_notes(files: DataFrame) -> DataFrame:
    """(source, stem, title, node, date, project, type, public, related, tags, body, content_sha) of rows (source, raw).
    YAML is read in Arrow batches; all else is expressions."""
    parsed = files.select("source", "raw").mapInArrow(_parse, "source string, fields map<string,string>, related array<string>, tags array<string>, body string")

    def text(key: str) -> Column:
        return F.coalesce(F.try_element_at("fields", F.lit(key)), F.lit(""))

    stem = F.regexp_replace(F.element_at(F.split("source", "/"), -1), "(?i)\\.md$", "")
    return parsed.select(
        "source", stem.alias("stem"), F.coalesce(F.nullif(text("node"), F.lit("")), stem).alias("title"), text("node").alias("node"), text("date").alias("date"), text("project").alias("project"), text("type").alias("type"),
        is_public(text("public")).alias("public"), _stripped(F.col("related")).alias("related"), _stripped(F.col("tags")).alias("tags"), "body", F.sha2("body", 256).alias("content_sha"),
    )


def gold_set(spark: SparkSession, text: str) -> DataFrame:
    """(qid, question, expected, category) of YAML with a list `questions`."""
    rows = [(i, q["question"], [str(s).strip() for s in q.get("expected_sources") or [] if str(s).strip()], q.get("category", "")) for i, q in enumerate(yaml.safe_load(text)["questions"])]
    return spark.createDataFrame(rows, "qid int, question string, expected array<string>, category string")


def qa_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(place, question, context) of nested question-answering JSON: data[].paragraphs[].qas[]; place is the order."""
    top = spark.read.json(path, multiLine=True).select(F.posexplode("data").alias("i", "d")).select("i", F.posexplode("d.paragraphs").alias("j", "p"))
    asked = top.select("i", "j", F.posexplode("p.qas.question").alias("n", "question"), F.col("p.context").alias("context"))
    return asked.select(F.struct("i", "j", "n").alias("place"), "question", "context")


def benchmark_subset(records: DataFrame, n_contexts: int, n_queries: int, distractors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(corpus (doc_id, text), queries (question, gold_id)) of rows (place, question, context).

    Contexts are numbered by their first place, and the corpus is the first n_contexts of them. If records have fewer,
    it is filled up with texts of `distractors` (place, context) that are not among them, by their first place. The
    queries are the first n_queries distinct questions that ask for a context of the corpus.
    """
    first = records.groupBy("context").agg(F.min("place").alias("place")).select("context", F.struct(F.lit(0).alias("o"), F.col("place").cast("string").alias("p")).alias("_o"), "place")
    own = first.orderBy("place").limit(n_contexts).select("context", F.row_number().over(Window.orderBy("place")).alias("number"))
    if distractors is not None:
        missing = n_contexts - own.count()
        if missing > 0:
            more = distractors.join(records.select("context").distinct(), "context", "left_anti").groupBy("context").agg(F.min("place").alias("place"))
            more = more.orderBy("place").limit(missing).select("context", (F.row_number().over(Window.orderBy("place")) + (n_contexts - missing)).alias("number"))
            own = own.unionByName(more)
    corpus = own.select(F.format_string("c%05d", F.col("number") - 1).alias("doc_id"), F.col("context").alias("text"))
    asked = records.join(corpus, records.context == corpus.text).groupBy("question").agg(F.min("place").alias("place"), F.min_by("doc_id", "place").alias("doc_id"))
    return corpus, asked.orderBy("place").limit(n_queries).select("question", F.col("doc_id").alias("gold_id"))
