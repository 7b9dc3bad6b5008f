"""Packing into sequences by minimum bin slack.

Only longer documents are cut, into pieces of the capacity; the first piece holds the remainder. How to pack depends on
nothing but how many pieces there are of each length, a table of at most `capacity` rows. For each bin the longest
piece left is taken, and a subset-sum over the lengths left (one bitset, repeated lengths included) finds the fullest
way to fill the rest. That combination is applied as often as the counts allow and so removed. Each application uses
up a length, so there are at most `capacity` combinations, whatever the number of documents.

Pieces then find their place by their rank among the pieces of their length. Ranks are counted per hash bucket and
summed over buckets, so a length that very many pieces share is not gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.storage import Workspace

from .batches import slices
from .bpe import encoder

RANK_BUCKETS = 64


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (from counts, each at most as often as counted) with the largest sum <= room; longest first."""
    reach, limit = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # length, pieces, sums reachable before
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:  # groups of 1, 2, 4, ... pieces cover every number up to the count
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return sorted(chosen, reverse=True)


@dataclass(frozen=True)
class Plan:
    """Combinations with their multiplicity: (lengths in order, how many bins)."""

    capacity: int
    bins: list[tuple[list[int], int]]

    @property
    def n_sequences(self) -> int:
        return sum(n for _, n in self.bins)


def plan_bins(counts: dict[int, int], capacity: int) -> Plan:
    """Combinations that use up all pieces of the counted lengths (each from 1 to capacity)."""
    left = {x: n for x, n in counts.items() if n > 0}
    bins = []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest({x: n for x, n in left.items() if n > 0}, capacity - longest)
        left[longest] += 1
        bin_ = [longest, *rest]
        need = {x: bin_.count(x) for x in set(bin_)}
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
        bins.append((bin_, times))
    return Plan(capacity, bins)


def _lookup(plan: Plan) -> dict[int, list]:
    """length -> (first rank, first sequence, offsets in a bin) of each combination that uses it, by first rank."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan.bins:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in lengths:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, places in offsets.items():
            rows.setdefault(x, []).append((taken.get(x, 0), sequence, places))
            taken[x] = taken.get(x, 0) + times * len(places)
        sequence += times
    return rows


def _place(lookup: dict[int, list]):
    """Adds sequence_id and offset to rows with (length, rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {x: np.array([r[0] for r in rows]) for x, rows in lookup.items()}
        for batch in batches:
            sequences, offsets = [], []
            for x, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                first, sequence, places = lookup[x][int(np.searchsorted(firsts[x], rank, side="right")) - 1]
                j = rank - first
                sequences.append(sequence + j // len(places))
                offsets.append(places[j % len(places)])
            kept = [c for c in batch.schema.names if c not in ("rank", "_bucket")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], [*kept, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """pieces with sequence_id and offset. pieces has a column length (1..capacity); the columns in order identify a
    piece and must be hashable. Pieces that agree in all of order are interchangeable. No pieces: no rows."""
    spark = pieces.sparkSession
    work = Workspace(spark, "packing")
    pieces = work.table(pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(RANK_BUCKETS)).cast("int")), "pieces")
    counted = pieces.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity x RANK_BUCKETS rows
    counts: dict[int, int] = {}
    bases = []
    for r in sorted(counted, key=lambda r: (r["length"], r["_bucket"])):
        bases.append((r["length"], r["_bucket"], counts.get(r["length"], 0)))
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    lookup = _lookup(plan_bins(counts, capacity))
    base = spark.createDataFrame(bases, "length long, _bucket int, _base long")
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order))
    ranked = pieces.withColumn("_own", own).join(F.broadcast(base), ["length", "_bucket"])
    ranked = ranked.withColumn("rank", F.col("_base") + F.col("_own") - 1).drop("_base", "_own")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name not in ("rank", "_bucket")]
    return ranked.mapInArrow(_place(lookup), ", ".join([*fields, "sequence_id long", "offset long"]))


def _cut(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in slices(batches, "text"):
            ids_of, rows = batch.column("id").to_pylist(), []
            for at, ids in own.encode([t or "" for t in batch.column("text").to_pylist()]):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append((ids_of[at], piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Texts are encoded whole (null: empty) and end_id is appended, so every document has a piece. Rows with a null or
    repeated id are packed like others. Columns other than id and text are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = base.mapInArrow(_cut(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return pack(pieces, capacity, ["doc_id", "piece", "ids_crc32"])
