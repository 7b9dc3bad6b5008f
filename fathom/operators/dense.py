"""Exact cosine search for a table of queries against all vectors.

The queries are a stated set. They go to every task as blocks of a matrix of bounded size; a task multiplies its
vectors with a block, SCORES products at a time, and passes on what can still be among a query's k best only, so no
pair of all pairs is ever held or moved. More queries than a block takes are searched block by block, so neither the
driver nor a task ever holds more than one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathom.storage import Workspace

from .bm25 import TIE_DIGITS, top_k

#: Numbers in a block of queries that goes to the tasks; vectors that a task reads at once, and scores that it holds.
BLOCK_NUMBERS, BATCH_ROWS, SCORES = 4_000_000, 4096, 2_000_000


def cosine(a: F.Column, b: F.Column) -> F.Column:
    """Cosine similarity of two arrays as an expression, in double precision."""
    double = [F.transform(x, lambda v: v.cast("double")) for x in (a, b)]

    def dot(x: F.Column, y: F.Column) -> F.Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return dot(*double) / (F.sqrt(dot(double[0], double[0])) * F.sqrt(dot(double[1], double[1])))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if len(m) else m


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles; all lists have dim numbers."""
    flat = column.flatten()
    if len(flat) != dim * len(column) or flat.null_count:
        raise ValueError(f"every vector must have {dim} numbers")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _searched(base: DataFrame, block: list, k: int, types: list[pa.DataType], schema: str, exclude_self: bool) -> DataFrame:
    ids = [r["q"] for r in block]
    rows_of: dict = {}
    for i, q in enumerate(ids):
        rows_of.setdefault(q, []).append(i)
    shared = base.sparkSession.sparkContext.broadcast((ids, rows_of, _unit(np.array([r["v"] for r in block], dtype=np.float64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows_of, matrix = shared.value
        asked = pa.array(ids, types[0])
        floors = np.full(len(ids), -np.inf)  # the k-th best of a batch so far: what stays below it cannot be among k
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                units, vectors = part.column("unit"), _unit(_matrix(part.column("v"), matrix.shape[1])).T
                own = [(row, i) for i, unit in enumerate(units.to_pylist()) for row in rows_of.get(unit, ())] if exclude_self else []
                step = max(1, SCORES // part.num_rows)
                for first in range(0, len(ids), step):
                    scores = matrix[first : first + step] @ vectors
                    for row, i in own:
                        if first <= row < first + step:
                            scores[row - first, i] = -np.inf
                    floor = floors[first : first + step]
                    if scores.shape[1] > k:  # what ties with the k-th after rounding stays, too
                        np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k], out=floor)
                    query, unit = np.nonzero((scores > -np.inf) & (scores >= floor[:, None] - 10.0**-TIE_DIGITS))
                    if len(query):
                        yield pa.RecordBatch.from_arrays([asked.take(pa.array(query + first)), units.take(pa.array(unit)), pa.array(scores[query, unit])], ["query", "unit", "score"])

    return top_k(base.mapInArrow(run, schema), k)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "unit_id", vector_col: str = "embedding", query_id_col: str = "query_id", query_vector_col: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(query, unit, score, rank): the k nearest vectors of each query, ties by unit. Null vectors match nothing."""
    spark = vectors.sparkSession
    asked = queries.where(F.col(query_vector_col).isNotNull()).select(F.col(query_id_col).alias("q"), F.col(query_vector_col).alias("v"))
    base = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("unit"), F.col(vector_col).alias("v"))
    unit_type, query_type = base.schema["unit"].dataType.simpleString(), queries.schema[query_id_col].dataType.simpleString()
    types = [to_arrow_type(queries.schema[query_id_col].dataType)]
    schema = f"query {query_type}, unit {unit_type}, score double"
    dim = asked.select(F.size("v")).first()
    if dim is None:
        return top_k(spark.createDataFrame([], schema), k)
    step, rows = max(1, BLOCK_NUMBERS // max(1, dim[0])), asked.toLocalIterator()
    block = list(islice(rows, step))
    found, work = [_searched(base, block, k, types, schema, exclude_self)], None
    while len(block) == step and (block := list(islice(rows, step))):
        work = work or Workspace(spark, "dense-search")
        found[-1] = work.table(found[-1], "block")
        found.append(_searched(base, block, k, types, schema, exclude_self))
    return reduce(DataFrame.unionAll, found)


def top_similarity(found: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(query, top_similarity): best score per query, community summaries left out."""
    if kinds is not None:
        found = found.join(kinds.where("kind <> 'community_summary'").select("unit"), "unit", "left_semi")
    return found.groupBy("query").agg(F.max("score").alias("top_similarity"))
