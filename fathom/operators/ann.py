"""Approximate nearest neighbours: an inverted file of coarse cells with product-quantised residuals.

Cells and codebooks are fitted on a bounded sample; every vector is then indexed: its cell, and one byte for each slice of
what its centroid leaves over. The codes lie in a folder for each cell. A search looks at the nearest cells of a query
only (their folders are all that is read), scores codes by table look-ups, and takes the best REFINE x k to an exact
cosine, so scores are exact and only which units are found is approximate. How many cells are looked at is fitted, too: as
many as hold TARGET of the true neighbours within the sample. `dense` keeps the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathom.storage import Workspace, table_if_there

from .bm25 import top_k
from .dense import _matrix, _unit, cosine

#: Rows that a fit looks at; the most cells; numbers of a slice; codes of a slice; rounds of a fit.
SAMPLE, MAX_CELLS, SLICE, CODES, ROUNDS = 16_384, 1024, 4, 256, 8
#: Share of the true neighbours whose cells are looked at; candidates for each asked unit; queries that go to the tasks at once.
TARGET, REFINE, QUERY_BLOCK = 0.98, 20, 512
_PROBED, _ASKED = 10, 256


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _means(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n centres by Lloyd's rounds from rows of x; centres without rows stay."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:n]].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """centres: cells x numbers; books: slices x codes x SLICE (numbers are filled up with zeros); probes: cells of a query."""

    centres: np.ndarray
    books: np.ndarray
    probes: int

    @classmethod
    def fit(cls, x: np.ndarray) -> Quantiser:
        x = _unit(x)
        centres = _means(x, min(MAX_CELLS, max(1, int(2 * len(x) ** 0.5) // 2)), 1)
        own = _nearest(x, centres)
        parts = cls._slices(x - centres[own])
        books = np.stack([_means(parts[:, i], min(CODES, len(x)), i) for i in range(parts.shape[1])])
        asked = x[:: max(1, len(x) // _ASKED)][:_ASKED]
        near = np.argsort(-(asked @ x.T), axis=1)[:, 1 : _PROBED + 1]
        place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
        places = np.sort(np.take_along_axis(place, own[near], axis=1).ravel()) if near.size else np.zeros(1, dtype=int)
        return cls(centres, books, int(places[min(len(places) - 1, int(np.ceil(TARGET * len(places))) - 1)]) + 1)

    @staticmethod
    def _slices(x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, -x.shape[1] % SLICE)))
        return x.reshape(len(x), -1, SLICE)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, codes: rows x slices)."""
        x = _unit(x)
        cell = _nearest(x, self.centres)
        parts = self._slices(x - self.centres[cell])
        return cell, np.stack([_nearest(parts[:, i], self.books[i]) for i in range(parts.shape[1])], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of normed queries: scores of the centres, and of each slice's codes."""
        return q @ self.centres.T, np.einsum("qsd,scd->qsc", self._slices(q), self.books).astype(np.float32)


class AnnIndex:
    """The index of a folder: the quantiser, and codes of (id, vector) rows. Null vectors are left out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self) -> bool:
        return table_if_there(self.spark, f"{self.path}/quantiser") is not None

    def build(self, vectors: DataFrame, id_col: str = "unit_id", vector_col: str = "embedding") -> Quantiser:
        """Fit on SAMPLE rows (those with the least hash of their id) and index all."""
        base = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("unit"), F.col(vector_col).alias("v"))
        rows = base.orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE).select("v").collect()
        x = np.array([r["v"] for r in rows], dtype=np.float64) if rows else np.zeros((1, 1))
        fitted = Quantiser.fit(x)
        parts = [(n, list(a.shape), a.astype(np.float64).tobytes()) for n, a in (("centres", fitted.centres), ("books", fitted.books), ("probes", np.array([fitted.probes])))]
        self._encoded(base, fitted, "overwrite")
        self.spark.createDataFrame(parts, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/quantiser")
        return fitted

    def add(self, vectors: DataFrame, id_col: str = "unit_id", vector_col: str = "embedding") -> None:
        """Index further rows with the quantiser there is."""
        base = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("unit"), F.col(vector_col).alias("v"))
        self._encoded(base, self.quantiser(), "append")

    def quantiser(self) -> Quantiser:
        a = {r["name"]: np.frombuffer(r["data"]).reshape(r["shape"]) for r in self.spark.read.parquet(f"{self.path}/quantiser").collect()}
        return Quantiser(a["centres"], a["books"], int(a["probes"][0]))

    def _encoded(self, base: DataFrame, fitted: Quantiser, mode: str) -> None:
        dim = fitted.centres.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, codes = fitted.encode(_matrix(batch.column("v"), dim))
                    yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["unit", "cell", "code"])

        coded = base.mapInArrow(run, f"unit {base.schema['unit'].dataType.simpleString()}, cell int, code binary")
        coded.repartition("cell").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/codes")

    def search(self, queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "unit_id", vector_col: str = "embedding", query_id_col: str = "query_id", query_vector_col: str = "embedding", exclude_self: bool = False, probes: int | None = None) -> DataFrame:
        """(query, unit, score, rank): about the k nearest of each query, with exact scores; ties by unit. `vectors` has the
        vectors of the units that count now: others that the index knows are not found. A query's probes are those fitted
        if none are given."""
        fitted = self.quantiser()
        asked = queries.where(F.col(query_vector_col).isNotNull()).select(F.col(query_id_col).alias("query"), F.col(query_vector_col).alias("q"))
        rows, found, work = asked.toLocalIterator(), [], Workspace(self.spark, "ann")
        base = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("unit"), F.col(vector_col).alias("v"))
        kind = base.schema["unit"].dataType.simpleString()
        while block := list(islice(rows, QUERY_BLOCK)):
            found.append(work.table(self._candidates(block, fitted, asked, REFINE * k, probes or fitted.probes, exclude_self, kind), "candidates"))
        if not found:
            return top_k(asked.join(base.select("unit").limit(0), F.lit(True), "left").select("query", "unit", F.lit(0.0).alias("score")).limit(0), k)
        near = reduce(DataFrame.unionAll, found).select("query", "unit").distinct().join(base, "unit").join(asked, "query")
        return top_k(near.select("query", "unit", cosine(F.col("v"), F.col("q")).alias("score")), k)

    def _candidates(self, block: list, fitted: Quantiser, asked: DataFrame, n: int, probes: int, exclude_self: bool, unit_type: str) -> DataFrame:
        ids = [r["query"] for r in block]
        cell_scores, tables = fitted.tables(_unit(np.array([r["q"] for r in block], dtype=np.float64)))
        probed = np.argsort(-cell_scores, axis=1)[:, :probes]
        of_cell: dict[int, np.ndarray] = {int(c): np.nonzero((probed == c).any(axis=1))[0] for c in np.unique(probed)}
        codes = self.spark.read.schema(f"unit {unit_type}, code binary, cell int").parquet(f"{self.path}/codes").where(F.col("cell").isin(list(of_cell)))
        query_type = asked.schema["query"].dataType
        kind = to_arrow_type(query_type)
        shared = self.spark.sparkContext.broadcast((ids, cell_scores, tables, of_cell))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, cell_scores, tables, of_cell = shared.value
            names = pa.array(ids, kind)
            for batch in batches:
                cells, units = batch.column("cell").to_numpy(), batch.column("unit")
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                for c in np.unique(cells):
                    rows, q = np.nonzero(cells == c)[0], of_cell[int(c)]
                    scores = np.repeat(cell_scores[q, c][:, None], len(rows), axis=1)
                    for s in range(code.shape[1]):
                        scores += tables[q, s][:, code[rows, s]]
                    top = np.argpartition(-scores, n - 1, axis=1)[:, :n] if len(rows) > n else np.broadcast_to(np.arange(len(rows)), scores.shape)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(q, top.shape[1]))), units.take(pa.array(rows[top.ravel()])), pa.array(np.take_along_axis(scores, top, axis=1).ravel())], ["query", "unit", "score"])

        near = codes.select("cell", "unit", "code").mapInArrow(run, f"query {query_type.simpleString()}, unit {unit_type}, score double")
        return top_k(near.where("query <> unit") if exclude_self else near, n)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n, recall): the share of the exact (query, unit) pairs that were found, over n queries."""
    hits = exact.join(found.select("query", "unit", F.lit(1).alias("_hit")), ["query", "unit"], "left")
    return hits.agg(F.countDistinct("query").alias("n"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
