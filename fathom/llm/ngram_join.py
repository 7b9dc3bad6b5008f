"""Near-duplicate components: an exact Jaccard join on word shingles by PartEnum signatures.

1. Texts become sets of hashed shingles. Equal sets form a class, represented by its smallest id.
2. Every set emits its signatures. Sets that share one are candidates. Signatures travel in packed rows, one for each
   chunk of texts and bucket of signatures. Within a chunk the holders of a signature are settled at once, and one
   delegate for them goes to the signature's bucket, so that a signature that a third of all texts share does not send
   all of them to one task.
3. Each set is checked against its likeliest partner (of the first holder of a signature and its neighbour there, the
   one with the most common signatures). That is linear and joins most of what belongs together. An eighth of the
   signatures of larger sets serve to find it; what is missed here is found below.
4. What is left are signatures whose holders are still of several components. Where there are FEW holders, the pairs
   across components are listed, each once for all its signatures, ruled out by sketches if they are surely too
   different, and else checked by their shingles. The list grows with the signatures and not with any square.
5. Signatures of more holders: there all pairs across components are compared in tiles of bounded size by sketches.
   Components with a pair that passes become one family (of a tile's pairs only those are passed on that connect it).
6. In a family all texts of different components are compared, in tiles again, by sketches and then by their shingles,
   until its links are known up to connection. Components of all verified links are the result.

Sketches and signatures never lose a link; what is verified in steps 3, 4 and 6 never adds one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.components import connected_components
from fathom.storage import Workspace, sweep

from .batches import release, slices
from .hashing import mix64
from .members import may_match
from .partenum import ENUMERATED, PartEnum
from .shingles import shingle_sets

#: Rows of a signature, and texts of a family, that are compared with each other at a time.
TILE, TILE_OF_TEXTS = 2048, 256
#: Holders of a signature whose pairs are listed.
FEW = 32
#: Signatures that a task packs at a time, and about how many a bucket should have.
CHUNK, BUCKET = 100_000, 100_000
_PACKED = "bucket int, base long, width int, sigs binary, ids binary, prevs binary, firsts binary"
_SHARED = "sig long, id long, prev long, first long"
#: A signature is its bucket and 40 bits more, whatever the number of buckets: chance meetings in a bucket are as rare at
#: any size, and are sorted out by what follows. The last bits tell whether its instance is odd, and is enumerated.
SIG_BITS, MOST_BUCKETS = 40, 1 << 23


def _describe(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = PartEnum(percent)
        for batch in slices(batches, "text"):
            sizes, first, second, sketches = [], [], [], []
            for _, features in shingle_sets(batch.column("text").to_pylist(), width):
                sizes.append(len(features))
                first.append(np.bitwise_xor.reduce(features).view(np.int64) if len(features) else 0)
                second.append(np.add.reduce(features).view(np.int64) if len(features) else 0)
                sketches.append(scheme.sketch(features))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sketches, pa.binary())], ["id", "n", "h1", "h2", "sketch"])

    return run


def _sign(width: int, percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = PartEnum(percent)
        seen, held, total = set(), [], 0
        for batch in slices(batches, "text"):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for at, features in shingle_sets(batch.column("text").to_pylist(), width):
                key = features.tobytes() if len(features) < 4 else (len(features), features[0], np.add.reduce(features), np.bitwise_xor.reduce(features))
                if len(features) and key not in seen:
                    seen.add(key)
                    codes, of = scheme.signatures(features)
                    small = np.array([scheme.differences(i) <= ENUMERATED for i in range(int(of.max()) + 1)])[of]
                    low = (codes & np.uint64((1 << SIG_BITS) - 4)) | (small << 1 | of & 1).astype(np.uint64)
                    held.append((ids[at], ((codes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) << np.uint64(SIG_BITS)) | low))
                    total += len(codes)
                if total > CHUNK:
                    yield _chunk(held, buckets)
                    seen, held, total = set(), [], 0
        if held:
            yield _chunk(held, buckets)

    return run


def _chunk(held: list[tuple[int, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Packed rows: one for each bucket, with a holder of each signature, and one with all holders of the signatures
    that several texts of the chunk have, each with the one before it and the first. Ids are kept as differences from
    the smallest, in as many bytes as the largest needs; of signatures all but the bucket."""
    codes = np.concatenate([x[1] for x in held])
    ids = np.repeat(np.array([x[0] for x in held], dtype=np.int64), [len(x[1]) for x in held])
    order = np.argsort(codes, kind="stable")
    codes, ids = codes[order], ids[order]
    opens = np.concatenate(([True], codes[1:] != codes[:-1]))
    settled = ~opens | np.concatenate((~opens[1:], [False]))
    own = (codes[settled], ids[settled], *_before(opens, ids, settled))
    codes, ids = codes[opens], ids[opens]
    of = (codes >> np.uint64(SIG_BITS)).astype(np.int32)
    cuts = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]))
    n, base = len(cuts) - 1, int(ids.min())
    gaps = (ids - base).view(np.uint64)  # wraps, and so holds for ids of any two signs
    width = next(w for w in (2, 4, 8) if w == 8 or int(gaps.max()) < 1 << 8 * w)

    def packed(values: np.ndarray, width: int, last: bytes) -> pa.Array:
        data = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
        return pa.Array.from_buffers(pa.binary(), n + 1, [None, pa.py_buffer(np.append(cuts * width, len(data) + len(last)).astype(np.int32)), pa.py_buffer(data + last)])

    own = [x.tobytes() for x in own]
    spread = int(mix64(np.array([held[0][0]]))[0]) % buckets
    columns = [pa.array(np.append(of[cuts[:-1]], np.int32(spread))), pa.array([base] * (n + 1), pa.int64()), pa.array([width] * (n + 1), pa.int32()), packed(codes, SIG_BITS // 8, own[0]), packed(gaps, width, own[1])]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([None] * n + [x], pa.binary()) for x in own[2:])], ["bucket", "base", "width", "sigs", "ids", "prevs", "firsts"])


def _before(opens: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the wanted rows of sorted groups: the id before each in its group (its own, if it is the first), and the
    group's first id."""
    first = np.maximum.accumulate(np.where(opens, np.arange(len(ids)), 0))
    prev = np.where(opens, ids, np.concatenate((ids[:1], ids[:-1])))
    return prev[wanted], ids[first][wanted]


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows, sorted by bucket: the holders of signatures that more than one text has."""

    def told(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["sig", "id", "prev", "first"])

    def shared() -> Iterator[pa.RecordBatch]:
        sigs = np.concatenate([_unpacked(p[3], SIG_BITS // 8) for p in parts]) | np.uint64(of << SIG_BITS)
        ids = np.concatenate([_unpacked(p[4], p[2]).view(np.int64) + p[1] for p in parts])
        order = np.lexsort((ids, sigs))
        sigs, ids = sigs[order], ids[order]
        opens = np.concatenate(([True], sigs[1:] != sigs[:-1]))
        again = ~opens | np.concatenate((~opens[1:], [False]))
        if again.any():
            yield told(sigs[again], ids[again], *_before(opens, ids, again))

    parts, of = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[5] is not None:
                if row[3]:
                    yield told(*(np.frombuffer(x, dtype=np.int64) for x in row[3:]))
                continue
            if row[0] != of and parts:
                yield from shared()
                parts = []
            of = row[0]
            parts.append(row)
    if parts:
        yield from shared()
    release()


def _plausible(percent: int):
    """Of rows with the sketches of two sets, the pairs that the sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = PartEnum(percent)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True)
            keep = [_close(scheme, na, nb, sa, sb) for na, nb, sa, sb in rows]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _close(scheme: PartEnum, na: int, nb: int, sa: bytes, sb: bytes) -> bool:
    if 100 * min(na, nb) < scheme.percent * max(na, nb):
        return False
    for i in set(scheme.instances(na)) & set(scheme.instances(nb)):
        x = np.frombuffer(sa, dtype=np.uint8)[scheme.part_of_sketch(na, i)]
        y = np.frombuffer(sb, dtype=np.uint8)[scheme.part_of_sketch(nb, i)]
        return scheme.differing(x, y) <= scheme.allowed(na, nb)
    return False


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """The groups of rows that agree in keys, of rows sorted by them, as arrays by column."""
    parts: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    for batch in batches:
        rows = {}
        for c, column in zip(batch.schema.names, batch.columns, strict=True):
            rows[c] = np.empty(len(column), dtype=object) if pa.types.is_binary(column.type) or pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)
            if rows[c].dtype == object:
                rows[c][:] = column.to_pylist()
        if not batch.num_rows:
            continue
        key = np.stack([rows[c].astype(np.int64) for c in keys])
        starts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [batch.num_rows]))
        if parts and any(parts[-1][c][-1] != rows[c][0] for c in keys):
            yield joined()
            parts = []
        for begin, end in zip(starts[:-1], starts[1:], strict=True):
            parts.append({c: v[begin:end] for c, v in rows.items()})
            if end < batch.num_rows:
                yield joined()
                parts = []
    if parts:
        yield joined()


def _join_roots(roots: np.ndarray, i: int, others: np.ndarray) -> list[int]:
    """Merge the groups of rows `others` with row i's; the first of others in each group that was merged."""
    _, first = np.unique(roots[others], return_index=True)
    chosen = others[first]
    roots[np.isin(roots, roots[chosen])] = roots[i]
    return chosen.tolist()


def _may_link(rows: dict[str, np.ndarray], roots: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Rows after i, of another group and (in a pair of tiles) of the other tile, with a size that fits."""
    rest = slice(i + 1, None)
    fits = (roots[rest] != roots[i]) & (100 * np.minimum(rows["n"][rest], rows["n"][i]) >= percent * np.maximum(rows["n"][rest], rows["n"][i]))
    if rows["x"][0] != rows["y"][0]:
        fits &= rows["tile"][rest] != rows["tile"][i]
    return np.flatnonzero(fits) + i + 1


def _across(percent: int):
    """Of sorted rows (sig, x, y, tile, comp, n, sketch): pairs of components that close members connect. Per
    tile at most one pair less than it has components, enough to connect all that close pairs connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, seen = PartEnum(percent), set()

        def instance(size: int, odd: int) -> int:
            """The instance of the signature; none (-1) for another set of a repeated id, that did not sign it."""
            return next((i for i in scheme.instances(size) if i & 1 == odd), -1)

        for group in _groups(batches, ("sig", "x", "y")):
            insts = np.array([instance(int(n), int(group["sig"][0]) & 1) for n in group["n"]])
            found = set()
            for inst in np.unique(insts[insts >= 0]):  # more than one only by a chance meeting of signatures
                rows = {c: v[insts == inst] for c, v in group.items()}
                sizes, comps = rows["n"], rows["comp"]
                sketches = np.vstack([np.frombuffer(s, dtype=np.uint8)[scheme.part_of_sketch(int(n), inst)] for s, n in zip(rows["sketch"], sizes, strict=True)])
                roots = comps.copy()
                for i in range(len(comps) - 1):
                    others = _may_link(rows, roots, i, percent)
                    if len(others):
                        differing = scheme.differing(sketches[others], sketches[i])
                        close = others[differing <= (sizes[others] + sizes[i]) * (100 - percent) // (100 + percent)]
                        found |= {(min(comps[i], comps[j]), max(comps[i], comps[j])) for j in _join_roots(roots, i, close)} if len(close) else set()
            found -= seen
            if len(seen) > 50_000:
                seen.clear()
            seen |= found
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    return run


def _within(width: int, percent: int):
    """Of sorted rows (family, x, y, tile, id, comp, text): verified links that connect all components that links
    connect; at most one less than there are components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("family", "x", "y")):
            sets = [f for _, f in shingle_sets(list(rows["text"]), width)]
            rows["n"] = np.array([len(f) for f in sets])
            # A sketch as in PartEnum, over twice as many equal ranges as a middle-sized set has features.
            bits = max(6, min(14, int(np.median(rows["n"])).bit_length() + 1))
            inner = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
            sketches = np.empty((len(sets), 1 << bits), dtype=np.uint8)
            for i, features in enumerate(sets):
                sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(features)))
                cuts = np.concatenate(([0], np.searchsorted(features, inner), [len(features)]))
                sketches[i] = (mix64(sums[cuts[1:]] - sums[cuts[:-1]]) >> np.uint64(56)).astype(np.uint8)
            roots, found = rows["comp"].copy(), []
            for i in range(len(sets) - 1):
                others = _may_link(rows, roots, i, percent)
                if not len(others):
                    continue
                differing = np.count_nonzero(sketches[others] != sketches[i], axis=1)
                for j in others[differing <= (rows["n"][others] + rows["n"][i]) * (100 - percent) // (100 + percent)]:
                    if roots[j] != roots[i]:
                        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                            found.append((rows["id"][i], rows["id"][j]))
                            roots[roots == roots[j]] = roots[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

    return run


def _linked(width: int, percent: int):
    """Of rows (a, b, ta, tb) the pairs whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                sets = [f for _, f in shingle_sets(part.column("ta").to_pylist() + part.column("tb").to_pylist(), width)]
                for i in range(part.num_rows):
                    one, two = sets[i], sets[i + part.num_rows]
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    keep[begin + i] = common > 0 and 100 * common >= percent * (len(one) + len(two) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets of `width`-word shingles. A row's
    component is the smallest id reachable by links, its own included. Ids are whole numbers. Null and blank texts
    have the empty set and link with nothing. Rows that repeat an id are one node. Rows with a null id link with
    nothing and have a null component. Other columns of docs are ignored. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "ngram-join")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = work.table(base.mapInArrow(_describe(width, percent), "id long, n long, h1 long, h2 long, sketch binary"), "sets")
    real = sets.where("id is not null and n > 0")
    # A table of its own, so that the join can split a class with very many members.
    smallest = work.table(real.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")), "smallest")
    classes = work.table(real.join(smallest, ["n", "h1", "h2"]).select("id", "rep", "n"), "classes")
    sketches = real.select(F.col("id").alias("rep"), "n", "sketch")

    features = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, int(features * 2 * (100 - percent) / (100 + percent) * 1.75) // BUCKET)
    buckets = min(buckets, MOST_BUCKETS)
    signed = base.where("id is not null").mapInArrow(_sign(width, percent, buckets), _PACKED)
    shared = work.table(signed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _SHARED), "shared")
    sweep(spark)

    def of_class(pairs: DataFrame) -> DataFrame:
        one, two = (classes.select(F.col("id").alias(c), F.col("rep").alias(f"r{c}")) for c in "ab")
        pairs = pairs.join(one, "a").join(two, "b").where("ra <> rb")
        return pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = work.table(pairs, f"{name}-pairs")
        ends = pairs.select(F.col("a").alias("end")).unionAll(pairs.select("b"))
        texts = may_match(base, "id", ends, "end")
        rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return work.table(rows.select("a", "b", "ta", "tb").mapInArrow(_linked(width, percent), "a long, b long"), f"{name}-links")

    def sketched(rows: DataFrame, of: str, *names: str) -> DataFrame:
        """rows with the size and sketch of the set that column `of` names; a row for each, if an id has several sets."""
        found = may_match(sketches, "rep", rows, of).distinct()
        return rows.join(found.select(F.col("rep").alias(of), F.col("n").alias(names[0]), F.col("sketch").alias(names[1])), of)

    probe = shared.where((F.col("sig").bitwiseAND(F.lit(2)) != 0) | (F.shiftright("sig", 2).bitwiseAND(F.lit(7)) == 0))
    likely = probe.select("id", F.explode(F.array("prev", "first")).alias("other")).where("other <> id")
    likely = likely.groupBy("id", "other").count().groupBy("id").agg(F.max(F.struct("count", (-F.col("other")).alias("other"))).alias("best"))
    likely = work.table(of_class(likely.select(F.col("id").alias("a"), (-F.col("best.other")).alias("b"))), "likely")
    likely = sketched(sketched(likely, "a", "na", "sa"), "b", "nb", "sb")
    links = verified(likely.mapInArrow(_plausible(percent), "a long, b long"), "likely")
    sweep(spark)

    near = connected_components(links, work)
    node = classes.join(near.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep", "left").select("id", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
    held = work.table(shared.select("sig", "id").join(node, "id").select("sig", F.col("rep").alias("id"), "n", "comp"), "held")
    mixed = held.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low <> high")
    mixed = work.table(mixed.select("sig", "size"), "mixed-signatures")
    rows = work.table(may_match(held, "sig", mixed, "sig").distinct().join(mixed, "sig"), "mixed")

    fits = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"  # sets of other sizes are surely too different
    both = f"flatten(transform(held, x -> transform(filter(held, y -> y.comp > x.comp AND {fits}), y -> struct(least(x.id, y.id) AS a, greatest(x.id, y.id) AS b))))"
    listed = rows.where(F.col("size") <= FEW).groupBy("sig").agg(F.collect_list(F.struct("comp", "id", "n")).alias("held"))
    listed = work.table(listed.select(F.explode(F.expr(both)).alias("p")).select("p.a", "p.b").distinct(), "listed")
    listed = sketched(sketched(listed, "a", "na", "sa"), "b", "nb", "sb")
    links = links.unionAll(verified(listed.mapInArrow(_plausible(percent), "a long, b long").distinct(), "listed"))
    rows = rows.where(F.col("size") > FEW).drop("n").distinct()
    sweep(spark)

    def tiled(rows: DataFrame, size: str, tile: int) -> DataFrame:
        """Each row once for every pair (x, y) of tiles that its own is part of."""
        tiles = F.ceil(F.col(size) / tile).cast("int")
        rows = rows.withColumn("tile", F.pmod(F.xxhash64("id"), tiles).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), tiles - 1)))
        return rows.withColumn("x", F.least("tile", "with")).withColumn("y", F.greatest("tile", "with")).drop("with", size)

    across = tiled(sketched(rows, "id", "n", "sketch"), "size", TILE).select("sig", "x", "y", "tile", "comp", "n", "sketch")
    close = across.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y").mapInArrow(_across(percent), "a long, b long").distinct()
    family = connected_components(close, work).select(F.col("node").alias("comp"), F.col("component").alias("family"))
    members = work.table(rows.select("id", "comp").distinct().join(family, "comp"), "members")
    sizes = members.groupBy("family").agg(F.count("*").alias("size"))
    members = members.join(sizes, "family")
    members = tiled(members.join(may_match(base, "id", members, "id"), "id"), "size", TILE_OF_TEXTS).select("family", "x", "y", "tile", "id", "comp", "text")
    more = members.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(_within(width, percent), "a long, b long")
    links = links.unionAll(work.table(more, "more-links"))

    whole = connected_components(links, work).select(F.col("node").alias("rep"), "component")
    final = classes.select("id", "rep").distinct().join(whole, "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id"))
    # A node that stands for several sets (a repeated id) is reached through any of them.
    final = final.groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = sets.join(final, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return work.finish(out)
