"""Hard negatives by a Voronoi-partitioned exact nearest-neighbour join.

Vectors become whole numbers, and each gets one coordinate more, so that all have the norm of the longest: the largest
inner products with an anchor (whose own extra coordinate is 0) are then the smallest distances. Every vector goes to the
cell of its nearest pivot. A cell is known by the range of its members' distances to the pivot, their number and the least
of the distances; from these follow, for an anchor and a cell, a least and a largest score that a member can have, and
scores that so many members surely reach. Anchors form groups of neighbouring cells. The members of a cell are replicated
to those groups only that they might serve, dealt out in chunks of bounded size, and each (group, chunk) is joined exactly
in one task; the best of each anchor's chunks are the result.

The join runs twice: for the nearest rows of an anchor's own label, then for the rows of other labels within the score
windows that those give. Vectors without any structure leave no cell out, and then every row meets every anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.storage import Workspace

from .hashing import mix64
from .members import _column

#: Steps of a component to one; the most pivots; anchors of a group, rows of a chunk and anchors multiplied at a time.
QUANTUM, MAX_PIVOTS, GROUP_ANCHORS, CHUNK_ROWS, BLOCK = 256, 256, 1024, 8192, 64
#: Squared norms from here on have scores that doubles do not hold exactly.
MOST_NORM2 = 2.0**48
_LEAST = np.iinfo(np.int64).min


class Share(NamedTuple):
    """Bounds of a negative's score, in hundredths of the positive's."""

    low: int = 30
    high: int = 90


def usable(vector: Column) -> Column:
    """The vector has no null and no component that is not finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles; missing components are 0."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(lists), dim)
    out = np.zeros((len(lists), dim))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass(frozen=True)
class Pivots:
    """Pivots in an order in which neighbours are close; `most` is the largest squared norm of all vectors."""

    vectors: np.ndarray
    most: float

    @classmethod
    def of(cls, vectors: np.ndarray, most: float) -> Pivots:
        rest, chain = list(range(1, len(vectors))), [0] if len(vectors) else []
        while rest:
            gaps = ((vectors[rest] - vectors[chain[-1]]) ** 2).sum(axis=1)
            chain.append(rest.pop(int(gaps.argmin())))
        return cls(vectors[chain], most)

    @property
    def extra(self) -> np.ndarray:
        return self._extra(self.vectors)

    def _extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.most - (x * x).sum(axis=1)))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its distance to the pivot."""
        near = x @ self.vectors.T + np.outer(self._extra(x), self.extra)
        cell = near.argmax(axis=1)
        return cell, np.sqrt(np.maximum(0.0, 2 * (self.most - near[np.arange(len(x)), cell])))

    def from_anchors(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(inner products, distances) of anchors, whose extra coordinate is 0, and pivots."""
        dot = a @ self.vectors.T
        return dot, np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + self.most - 2 * dot))


class Bounds:
    """What scores the members of cells can have with anchors: least and largest, with room for rounding."""

    def __init__(self, pivots: Pivots, a: np.ndarray, cells: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        dot, d = pivots.from_anchors(a)
        home = d.argmin(axis=1)
        between = pivots.vectors @ pivots.vectors.T + np.outer(pivots.extra, pivots.extra)
        gap = np.sqrt(np.maximum(0.0, 2 * (pivots.most - between)))[home][:, cells]
        own = d[np.arange(len(a)), home][:, None]
        self.dot, self.d = dot[:, cells], d[:, cells]
        self.norm2 = (a * a).sum(axis=1)[:, None]
        self.most, self.room = pivots.most, 1 + 1e-7 * (self.norm2 + pivots.most)
        with np.errstate(divide="ignore", invalid="ignore"):  # members are on their own pivot's side of the plane between
            plane = np.where(gap > 0, (self.d**2 - own**2) / (2 * gap), 0.0)
        nearest = np.maximum.reduce([np.zeros_like(self.d), self.d - hi, lo - self.d, plane])
        length = np.sqrt(self.norm2)
        self.largest = np.minimum((self.norm2 + self.most - nearest**2) / 2, self.dot + length * hi) + self.room
        self.least = self.surely(hi)

    def surely(self, distance: np.ndarray) -> np.ndarray:
        """A score that a member as far from its pivot as this has at least."""
        length = np.sqrt(self.norm2)
        return np.maximum((self.norm2 + self.most - (self.d + distance) ** 2) / 2, self.dot - length * distance) - self.room


def serves_nearest(bounds: Bounds, near: np.ndarray, k: int) -> np.ndarray:
    """By anchor and cell: whether a member might be among the k best. near: the least distances in each cell to its
    pivot, infinite where there are fewer; the anchor itself may be one of the rows."""
    sure = np.concatenate([bounds.surely(near[:, j]) for j in range(near.shape[1])], axis=1)
    floor = np.full(len(sure), -np.inf)
    if sure.shape[1] > k:
        floor = np.partition(sure, sure.shape[1] - k - 1, axis=1)[:, sure.shape[1] - k - 1]
    return bounds.largest >= floor[:, None]


def serves_windows(bounds: Bounds, others: np.ndarray, low: np.ndarray, high: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """By anchor and cell: whether a member might be among the k best within one of the anchor's windows (low, high;
    anchors x windows, with `held` where there is one). others: rows of a cell that surely have another label."""
    order = np.argsort(-bounds.least, axis=1)
    out = np.zeros(bounds.least.shape, dtype=bool)
    for w in range(low.shape[1]):
        inside = np.where(bounds.largest <= high[:, w : w + 1], others, 0)
        reached = np.cumsum(np.take_along_axis(inside, order, axis=1), axis=1) >= k
        at = reached.argmax(axis=1)
        floor = np.where(reached.any(axis=1), np.take_along_axis(bounds.least, order, axis=1)[np.arange(len(at)), at], -np.inf)
        floor = np.maximum(floor, low[:, w])
        out |= held[:, w : w + 1] & (bounds.largest >= floor[:, None]) & (bounds.least <= high[:, w : w + 1])
    return out


def _best(scores: np.ndarray, may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row that may; of equal ones the first columns."""
    n = scores.shape[1]
    keys = np.where(may, scores * n + (n - 1 - np.arange(n)), _LEAST)
    top = np.argpartition(keys, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), keys.shape)
    row, at = np.nonzero(np.take_along_axis(keys, top, axis=1) > _LEAST)
    return row, top[row, at]


class _Join:
    """The local joins; tables have few enough rows for a task. A group of no rows on either side gives none."""

    def __init__(self, dim: int, k: int, share: Share):
        self.dim, self.k, self.share = dim, k, share

    def _blocks(self, anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
        if not anchors.num_rows or not rows.num_rows:
            return
        rows = rows.sort_by("id")
        matrix, label, ids = _matrix(rows["q"], self.dim).T, rows["label"].to_numpy(), rows["id"].to_numpy()
        for begin in range(0, anchors.num_rows, BLOCK):
            part = anchors.slice(begin, BLOCK)
            scores = np.rint(_matrix(part["q"], self.dim) @ matrix).astype(np.int64)
            same = part["label"].to_numpy()[:, None] == label[None, :]
            yield part, rows, scores, same, part["id"].to_numpy()[:, None] != ids[None, :]

    def positives(self, _, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [pa.table({"anchor": pa.array([], anchors["id"].type), "positive": pa.array([], rows["id"].type), "score": pa.array([], pa.int64())})]
        for part, all_rows, scores, same, other in self._blocks(anchors, rows):
            row, at = _best(scores, same & other, self.k)
            out.append(pa.table({"anchor": part["id"].take(pa.array(row)), "positive": all_rows["id"].take(pa.array(at)), "score": scores[row, at]}))
        return pa.concat_tables(out)

    def windows(self, anchors: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, held): anchors x positives."""
        scores = anchors["scores"].to_pylist()
        held = np.array([[j < len(s) for j in range(max(map(len, scores)))] for s in scores])
        p = np.zeros(held.shape, dtype=np.int64)
        p[held] = np.concatenate(scores)
        return -((-self.share.low * p) // 100), (self.share.high * p) // 100, held

    def negatives(self, _, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [pa.table({"anchor": pa.array([], anchors["id"].type), "place": pa.array([], pa.int32()), "negative": pa.array([], rows["id"].type), "score": pa.array([], pa.int64())})]
        for part, all_rows, scores, same, _other in self._blocks(anchors, rows):
            low, high, held = self.windows(part)
            for w in range(held.shape[1]):
                may = ~same & held[:, w : w + 1] & (scores >= low[:, w : w + 1]) & (scores <= high[:, w : w + 1])
                row, at = _best(scores, may, self.k)
                out.append(pa.table({"anchor": part["id"].take(pa.array(row)), "place": pa.array(np.full(len(row), w), pa.int32()), "negative": all_rows["id"].take(pa.array(at)), "score": scores[row, at]}))
        return pa.concat_tables(out)


class VoronoiJoin:
    """Rows (id, label, vector) with their cells. Rows with a null id or label, or with a vector that is not `usable`, take
    no part; vectors shorter than the longest are filled up with zeros; a norm of 65,536 or more is an error, as scores
    would not be exact. Rows that repeat an id are rows of their own, none of which is a partner of an anchor of that id;
    of anchors that repeat an id the one with the least label and vector counts. Other columns are ignored."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", label: str | Column = "label", vector_col: str = "embedding", max_pivots: int = MAX_PIVOTS, chunk_rows: int = CHUNK_ROWS, group_anchors: int = GROUP_ANCHORS):
        self.spark, self.chunk_rows, self.group_anchors = vectors.sparkSession, chunk_rows, group_anchors
        self.work = Workspace(self.spark, "hard-negatives")
        label = _column(label) if isinstance(label, str) else label
        base = vectors.select(_column(id_col).alias("id"), label.alias("label"), _column(vector_col).alias("v"))
        base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
        q = F.transform("v", lambda x: F.floor(QUANTUM * x.cast("double")).cast("double"))
        norm2 = F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)
        rows = self.work.table(base.select("id", "label", q.alias("q")).withColumn("norm2", norm2), "rows")
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("most"), F.max(F.size("q")).alias("dim")).first()
        self.n, self.dim = stats["n"], max(1, stats["dim"] or 1)
        if (stats["most"] or 0.0) >= MOST_NORM2:
            raise ValueError("a vector's norm is 65,536 or more: its scores would not be exact")
        n_pivots = min(max_pivots, max(1, math.isqrt(self.n)))  # at most max_pivots rows
        chosen = rows.orderBy(F.xxhash64("id"), "id", "q").limit(n_pivots).select("q").collect()
        self.pivots = Pivots.of(np.array([r["q"] + [0.0] * (self.dim - len(r["q"])) for r in chosen]).reshape(len(chosen), self.dim), stats["most"] or 0.0)
        self.rows = self.work.table(self._placed(rows), "placed")
        self.cells = self.work.table(self._summary(), "cells")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """(id, label, q, cell, dist, lot): lot is a number that deals the rows out evenly, whatever their ids are."""
        pivots, dim = self.pivots, self.dim
        kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
        schema = "id {}, label {}, q array<int>, cell int, dist double, lot long".format(*kinds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = TaskContext.get().partitionId() << 40
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell, dist = pivots.assign(_matrix(batch.column("q"), dim))
                lot = (mix64(np.arange(seen, seen + batch.num_rows)) >> np.uint64(2)).astype(np.int64)
                seen += batch.num_rows
                q = batch.column("q").cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), q, pa.array(cell, pa.int32()), pa.array(dist), pa.array(lot)], ["id", "label", "q", "cell", "dist", "lot"])

        return rows.mapInArrow(run, schema)

    def _summary(self) -> DataFrame:
        """(label, cell, rows, lo, hi, near): near are the NEAR least distances to the pivot."""
        first = Window.partitionBy("label", "cell").orderBy("dist")
        near = self.rows.select("label", "cell", "dist").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= self.NEAR)
        near = near.groupBy("label", "cell").agg(F.collect_list("dist").alias("near"))  # NEAR at most
        whole = self.rows.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("rows"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
        return whole.join(near, ["label", "cell"])

    NEAR = 8

    def anchors(self, where: Column) -> DataFrame:
        """(id, label, q, cell, lot) of the rows whose id fulfils the condition (on `id`)."""
        found = self.rows.where(where).groupBy("id").agg(F.min(F.struct("label", "q", "cell", "lot")).alias("_row")).select("id", "_row.*")
        return self.work.table(found, "anchors")

    def _grouped(self, anchors: DataFrame, space: str) -> DataFrame:
        """anchors with `grp`: of one space and of neighbouring cells, about group_anchors of them."""
        counts = anchors.groupBy(space, "cell").agg(F.count(F.lit(1)).alias("_n"))  # max_pivots rows for each space
        before = F.sum("_n").over(Window.partitionBy(space).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        runs = counts.withColumn("_run", F.floor(F.coalesce(before, F.lit(0)) / self.group_anchors)).withColumn("_shares", F.ceil(F.col("_n") / self.group_anchors))
        own = F.when(F.col("_shares") > 1, F.concat_ws("/", "cell", F.pmod("lot", "_shares"))).otherwise("")
        return anchors.join(runs, [space, "cell"]).withColumn("grp", F.concat_ws(":", "_run", own, F.col(space).cast("string"))).drop("_n", "_run", "_shares")

    def _joined(self, anchors: DataFrame, space: str, cells: DataFrame, serves, local, schema: str) -> DataFrame:
        """The local joins' rows. cells: (space, cell, rows, lo, hi, ...); serves(bounds, cells table, anchors table) tells
        which cells might serve which anchors."""
        pivots, dim = self.pivots, self.dim
        grouped = self.work.table(self._grouped(anchors, space), "grouped")

        def served(_, few: pa.Table, known: pa.Table) -> pa.Table:
            at = known["cell"].to_numpy()
            found = np.zeros(len(at), dtype=bool)
            for begin in range(0, few.num_rows if len(at) else 0, BLOCK):
                part = few.slice(begin, BLOCK)
                bounds = Bounds(pivots, _matrix(part["q"], dim), at, known["lo"].to_numpy(), known["hi"].to_numpy())
                found |= serves(bounds, known, part).any(axis=0)
            name = few["grp"][0].as_py() if few.num_rows else ""
            return pa.table({"grp": pa.array([name] * int(found.sum()), pa.string()), "cell": pa.array(at[found], pa.int32())})

        groups = grouped.select("grp", space).distinct()
        known = self.work.table(cells.join(groups, space), "known")  # max_pivots rows for each group
        served_cells = grouped.groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(served, "grp string, cell int")
        served_cells = self.work.table(served_cells.join(known.select("grp", "cell", space, "rows"), ["grp", "cell"]), "served")
        chunks = served_cells.groupBy("grp").agg(F.ceil(F.sum("rows") / self.chunk_rows).alias("chunks"))
        given = self.rows if space == "label" else self.rows.withColumn(space, F.lit(0))
        given = given.join(served_cells.join(chunks, "grp").drop("rows"), [space, "cell"])
        given = given.select("grp", F.pmod("lot", "chunks").alias("chunk"), "id", "label", "q")
        asked = grouped.join(chunks, "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        asked = asked.select("grp", "chunk", "id", "label", "q", *(c for c in ("scores",) if c in anchors.columns))
        return asked.groupBy("grp", "chunk").cogroup(given.groupBy("grp", "chunk")).applyInArrow(local, schema)

    def nearest_of_label(self, anchors: DataFrame, k: int) -> DataFrame:
        """(anchor, place, positive, score): the k best other rows of the anchor's label, place from 0."""
        if k >= self.NEAR:
            raise ValueError(f"k must be less than {self.NEAR}")
        kind = self.rows.schema["id"].dataType.simpleString()

        def serves(bounds: Bounds, known: pa.Table, _: pa.Table) -> np.ndarray:
            near = np.full((known.num_rows, k + 1), np.inf)
            for i, d in enumerate(known["near"].to_pylist()):
                d = sorted(d)[: k + 1]
                near[i, : len(d)] = d
            return serves_nearest(bounds, near, k)

        local = _Join(self.dim, k, Share())
        found = self._joined(anchors, "label", self.cells, serves, lambda key, a, r: local.positives(key, a, r), f"anchor {kind}, positive {kind}, score long")
        best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "positive")
        found = found.withColumn("place", (F.row_number().over(best) - 1).cast("int")).where(F.col("place") < k)
        return self.work.table(found.select("anchor", "place", "positive", "score"), "positives")

    def mined(self, anchors: DataFrame, positives: DataFrame, k: int, share: Share = Share()) -> DataFrame:
        """(anchor, place, positive, positive_score, rank, negative, negative_score): for each anchor and positive the k
        best rows of other labels within the share of the positive's score, rank from 1."""
        kind = self.rows.schema["id"].dataType.simpleString()
        scores = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("_s"))  # few
        scores = scores.select(F.col("anchor").alias("id"), F.transform("_s", lambda s: s["score"]).alias("scores"))
        asked = self.work.table(anchors.join(scores, "id").withColumn("space", F.lit(0)), "asked")
        cells = self.cells.groupBy("cell").agg(F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("rows") - F.max("rows")).alias("others"))
        cells = self.work.table(cells.withColumn("space", F.lit(0)), "all-cells")
        local = _Join(self.dim, k, share)

        def serves(bounds: Bounds, known: pa.Table, part: pa.Table) -> np.ndarray:
            return serves_windows(bounds, known["others"].to_numpy(), *local.windows(part), k)

        found = self._joined(asked, "space", cells, serves, lambda key, a, r: local.negatives(key, a, r), f"anchor {kind}, place int, negative {kind}, score long")
        best = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "negative")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        both = found.withColumnRenamed("score", "negative_score").join(positives.withColumnRenamed("score", "positive_score"), ["anchor", "place"])
        return both.select("anchor", "place", "positive", "positive_score", "rank", "negative", "negative_score")


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label: str | Column = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, share: Share = Share(), **sizes: int) -> DataFrame:
    """mined() for the rows whose id fulfils the condition `anchor` (on a column `id`); see VoronoiJoin for the rest. An
    empty table gives an empty result."""
    join = VoronoiJoin(vectors, id_col, label, vector_col, **sizes)
    anchors = join.anchors(anchor)
    return join.work.finish(join.mined(anchors, join.nearest_of_label(anchors, positives), negatives, share))
