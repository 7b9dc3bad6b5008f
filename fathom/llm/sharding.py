"""Sharding over fixed virtual slots.

A record's slot is a hash of its id over thousands of slots and never changes. Bytes are summed per slot, and a map
from slots to shards balances the bytes. The map is a small table of N_SLOTS rows with a version; rebalancing edits
the map (a new version), not the slots. Only the map is broadcast, and its size is fixed.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.storage import Workspace

N_SLOTS = 8192
SLOT_MAP = "version int, vslot int, shard int, bytes long, rows long"


def virtual_slot(record_id: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    """The slot of a record; records with a null id are spread by their text."""
    return F.pmod(F.when(record_id.isNotNull(), F.xxhash64(record_id)).otherwise(F.xxhash64(text)), F.lit(n_slots)).cast("int")


def slot_sizes(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(vslot, bytes, rows) of the slots in use, at most as many as there are slots."""
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return sorted((r["vslot"], r["bytes"], r["rows"]) for r in sums.collect())


def balance(sizes: list[tuple[int, int, int]], n_shards: int) -> dict[int, int]:
    """vslot to shard, near equal in bytes: from the largest slot on, each goes to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(n_shards)]
    placed: dict[int, int] = {}
    for vslot, size, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[vslot] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def grow(sizes: list[tuple[int, int, int]], placed: dict[int, int], new_shard: int) -> dict[int, int]:
    """The map with one more shard: slots move only into it, from the fullest shards, until it has its share."""
    size_of = {v: b for v, b, _ in sizes}
    placed = dict(placed)
    loads: dict[int, int] = {}
    for v, s in placed.items():
        loads[s] = loads.get(s, 0) + size_of[v]
    share, got = sum(loads.values()) / (len(loads) + 1), 0
    for v in sorted(placed, key=lambda v: (-size_of[v], v)):
        if loads[placed[v]] - size_of[v] >= share - max(size_of.values()) and got + size_of[v] <= share:
            loads[placed[v]] -= size_of[v]
            got += size_of[v]
            placed[v] = new_shard
    return placed


def write_map(rows: list[tuple[int, int, int, int, int]], spark: SparkSession, root: str) -> DataFrame:
    """Keep one version of a map below root, in a folder of its own; a version that is there is never replaced."""
    path = f"{root}/version={rows[0][0] if rows else 1}"
    spark.createDataFrame([r[1:] for r in rows], "vslot int, shard int, bytes long, rows long").coalesce(1).write.parquet(path)
    return read_map(spark, root, rows[0][0] if rows else 1)


def read_map(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of the map that is kept below root; without one the latest."""
    found = spark.read.schema(SLOT_MAP).parquet(root)
    version = found.agg(F.max("version")).first()[0] if version is None else version
    return found.where(F.col("version") == version).select("version", "vslot", "shard", "bytes", "rows")


def grow_map(spark: SparkSession, root: str) -> DataFrame:
    """Read the latest map below root, add a shard to it, and write it as the next version."""
    stored = read_map(spark, root).collect()
    if not stored:
        raise ValueError(f"no slots in the map below {root}")
    placed = grow([(r["vslot"], r["bytes"], r["rows"]) for r in stored], {r["vslot"]: r["shard"] for r in stored}, max(r["shard"] for r in stored) + 1)
    return write_map([(r["version"] + 1, r["vslot"], placed[r["vslot"]], r["bytes"], r["rows"]) for r in stored], spark, root)


def _by_map(sizes: list[tuple[int, int, int]], slot_map: DataFrame) -> dict[int, int]:
    """vslot to shard as a map says; slots that it does not know go, the largest first, to the shard with the fewest bytes."""
    known = {r["vslot"]: r["shard"] for r in slot_map.select("vslot", "shard").collect()}
    if not known:
        raise ValueError("the given map has no slots")
    loads = dict.fromkeys(known.values(), 0)
    for v, size, _ in sizes:
        if v in known:
            loads[known[v]] += size
    for v, size, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        if v not in known:
            known[v] = min(loads, key=lambda s: (loads[s], s))
            loads[known[v]] += size
    return known


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24, n_slots: int = N_SLOTS, overhead: int = 8, slot_map: DataFrame | None = None, map_root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(assignment, slot map). Assignment: id, size, text_crc32, shard, vslot and slot, the record's place in its shard
    (gapless from 0). Size is the text's UTF-8 bytes (null: none) plus overhead; shards are near equal in bytes.

    Records are placed one by one, so neither a hot group of equal texts nor a hot source loads a shard. Rows that
    repeat an id share its slot. Places in a shard are numbered by slot, then by id. An empty table gives no rows.

    With slot_map, one version of a map of as many slots (see read_map, grow_map), records go where it says and n_shards
    is not used; the map that is returned keeps its version. Without, a new map is made; with map_root it is kept there
    as version 1, to be grown later, else it goes when the driver ends.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "sharding")
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + overhead).alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"), virtual_slot(F.col(id_col), F.col(text_col), n_slots).alias("vslot"))
    rows = work.table(rows, "rows")
    sizes = slot_sizes(rows)
    placed = balance(sizes, n_shards) if slot_map is None else _by_map(sizes, slot_map)
    version = 1 if slot_map is None else slot_map.agg(F.max("version")).first()[0]
    entries = [(version, v, placed[v], b, n) for v, b, n in sizes]
    if slot_map is None and map_root is not None:
        slot_map = write_map(entries, spark, map_root)
    else:
        slot_map = work.table(spark.createDataFrame(entries, SLOT_MAP).coalesce(1), f"slot-map-{version}")
    # Rows before a slot in its shard: the map alone decides, so no shard has to be gathered in one task.
    before, taken = [], dict.fromkeys(placed.values(), 0)
    for v, _, n in sizes:
        before.append((v, placed[v], taken[placed[v]]))
        taken[placed[v]] += n
    base = spark.createDataFrame(before, "vslot int, shard int, base long")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "text_crc32", "size"))
    out = rows.withColumn("place", place).join(F.broadcast(base), "vslot")
    return out.select("id", "size", "text_crc32", "shard", "vslot", (F.col("base") + F.col("place") - 1).alias("slot")), slot_map
