"""A Merkle manifest of a table: a tree over the rows of each group, and one over the groups.

The trees are built from the bottom up, a level at a time, for all groups at once: the nodes of a level go to their
parents by (group, place // arity), so a hash is worked out from `arity` nodes whatever the size of a group. Every level is
a table of its own. Proofs are pushed from the top down: each level joins its nodes to their parents, and a child prepends
its siblings to the proof that its parent has inherited. Places come from a sort by ranges, so no group is ever in one task.

Digests are kept as bytes and hashed as lower-case hex text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.storage import Workspace

from .members import _column

ARITY = 3
#: Rows that a task ranks.
RANK_ROWS = 250_000
_STEP = "array<struct<left:binary,right:binary>>"


def hash_hex(hexes: Column) -> Column:
    """H of an array of digests as bytes."""
    return F.unhex(F.sha2(F.array_join(F.transform(hexes, lambda d: F.lower(F.hex(d))), ""), 256))


def field(value: Column) -> Column:
    """A value in a leaf: '-' for null, else its UTF-8 bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column | str) -> Column:
    """H of the values, each as `field` has it; a string names a column."""
    return F.unhex(F.sha2(F.concat(*(field(_column(v) if isinstance(v, str) else v) for v in values)), 256))


def group_key(value: Column) -> Column:
    """A key that is never null and is ordered as groups are: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _ranked(rows: DataFrame, order: list[str], work: Workspace, name: str, total: int) -> DataFrame:
    """rows (a table, with `group`) with `pos`, from 0 within the group in this order, and the group's size `n`."""
    parts = max(1, -(-total // RANK_ROWS))
    at = F.monotonically_increasing_id()  # partition and place in it, of sorted partitions that follow each other
    dealt = rows.repartitionByRange(parts, "group", *order).sortWithinPartitions("group", *order).withColumn("_at", at)
    dealt = work.table(dealt.withColumn("_part", F.shiftright("_at", 33)), f"{name}-sorted")
    runs = work.table(dealt.groupBy("group", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")), f"{name}-runs")
    # a group has as many runs as parts at most
    sizes = runs.groupBy("group").agg(F.sum("_rows").alias("n"), F.array_sort(F.collect_list(F.struct("_part", "_rows"))).alias("_all"))
    before = F.aggregate(F.filter("_all", lambda r: r["_part"] < F.col("_part")), F.lit(0).cast("long"), lambda a, r: a + r["_rows"])
    starts = runs.join(sizes, "group").select("group", "_part", "n", (F.col("_first") - before).alias("_start"))
    return dealt.join(starts, ["group", "_part"]).withColumn("pos", F.col("_at") - F.col("_start")).drop("_at", "_part", "_start")


@dataclass(frozen=True)
class Forest:
    """The levels of all groups' trees: (group, pos, n, digest, kids), `n` nodes of the group on the level; kids are the
    digests below, null on level 0. A group's last level is where it has one node."""

    levels: list[DataFrame]
    arity: int = ARITY

    @classmethod
    def build(cls, leaves: DataFrame, work: Workspace, name: str, arity: int = ARITY) -> Forest:
        """leaves: a table with group, pos, n, digest."""
        most = leaves.agg(F.max("n")).first()[0] or 0
        levels = [leaves]
        while most > 1:
            below = levels[-1].where("n > 1").groupBy("group", F.floor(F.col("pos") / arity).alias("pos"))
            kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda k: k["digest"])  # arity at most
            up = below.agg(F.max("n").alias("n"), kids.alias("kids"))
            up = up.select("group", "pos", F.ceil(F.col("n") / arity).alias("n"), hash_hex(F.col("kids")).alias("digest"), "kids")
            levels.append(work.table(up, f"{name}-{len(levels)}"))
            most = -(-most // arity)
        return cls(levels, arity)

    def roots(self) -> DataFrame:
        """(group, digest) of each group."""
        out = self.levels[0].where("n = 1").select("group", "digest")
        for level in self.levels[1:]:
            out = out.unionByName(level.where("n = 1").select("group", "digest"))
        return out

    def proofs(self, inherited: DataFrame, work: Workspace, name: str) -> DataFrame:
        """Level 0 with `proof`: steps (left, right) of concatenated digests beside a node, up to its group's root and
        then as `inherited` (group, proof) has it."""
        parents = None
        for i in range(len(self.levels) - 1, -1, -1):
            level = self.levels[i]
            top = level.where("n = 1").join(inherited, "group")
            if parents is not None:
                nodes = level.where("n > 1").withColumn("_up", F.floor(F.col("pos") / self.arity))
                above = parents.select("group", F.col("pos").alias("_up"), F.col("kids").alias("_kids"), F.col("proof").alias("_proof"))
                place = (F.col("pos") % self.arity).cast("int")

                def beside(keep) -> Column:
                    run = F.transform(F.filter("_kids", keep), lambda d: F.hex(d))
                    return F.unhex(F.array_join(run, ""))

                step = F.struct(beside(lambda d, k: k < place).alias("left"), beside(lambda d, k: k > place).alias("right"))
                pushed = nodes.join(above, ["group", "_up"]).withColumn("proof", F.concat(F.array(step).cast(_STEP), F.col("_proof")))
                top = top.unionByName(pushed.drop("_up", "_kids", "_proof"))
            parents = work.table(top, f"{name}-proofs-{i}") if i else top
        return parents


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def up(acc: Column, step: Column) -> Column:
        return F.sha2(F.concat(F.lower(F.hex(step["left"])), acc, F.lower(F.hex(step["right"]))), 256)

    return F.aggregate(proof, F.lower(F.hex(digest)), up)


def proof_digest(proof: Column) -> Column:
    """H of a proof's siblings, level by level, left to right, as hex text."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(F.lower(F.hex(s["left"])), F.lower(F.hex(s["right"])))), ""), 256)


class MerkleManifest:
    """The manifest of a table; `leaves` (id, group, digest and the kept columns) are committed to.

    Leaves of a group ascend by id (null first), then by digest, so that rows that repeat an id have places, too; equal rows
    are leaves of their own and which of them has which place makes no difference. Groups ascend with null first, then by
    UTF-8 bytes. An empty table has no root.
    """

    def __init__(self, spark: SparkSession, work: Workspace, rows: Forest, groups: Forest, root: bytes | None):
        self.spark, self.work, self.rows, self.groups, self._root = spark, work, rows, groups, root

    @classmethod
    def build(cls, docs: DataFrame, columns: list[str], id_col: str, group_col: str, keep: dict[str, Column] | None = None, arity: int = ARITY) -> MerkleManifest:
        """columns: those that a leaf hashes, in order. keep: further expressions over docs to be carried with a leaf."""
        spark, work = docs.sparkSession, Workspace(docs.sparkSession, "merkle")
        kept = {f"keep_{n}": c for n, c in (keep or {}).items()}
        leaves = docs.select(_column(id_col).alias("id"), group_key(_column(group_col)).alias("group"), leaf(*columns).alias("digest"), *(c.alias(n) for n, c in kept.items()))
        leaves = work.table(leaves, "leaves")
        ranked = work.table(_ranked(leaves, ["id", "digest"], work, "leaves", leaves.count()), "rows-0")
        rows = Forest.build(ranked, work, "rows", arity)
        subroots = work.table(rows.roots().select(F.lit("").alias("group"), F.col("group").alias("key"), "digest"), "subroots")
        groups = Forest.build(work.table(_ranked(subroots, ["key"], work, "subroots", subroots.count()), "groups-0"), work, "groups", arity)
        root = groups.roots().first()
        return cls(spark, work, rows, groups, None if root is None else bytes(root["digest"]))

    def save(self, path: str) -> None:
        """Write all levels below path, and last of all the table `manifest`, without which there is none to load."""
        for name, forest in (("rows", self.rows), ("groups", self.groups)):
            for i, level in enumerate(forest.levels):
                level.write.parquet(f"{path}/{name}-{i}")
        row = (self._root, self.rows.arity, len(self.rows.levels), len(self.groups.levels))
        self.spark.createDataFrame([row], "root binary, arity int, rows int, groups int").coalesce(1).write.parquet(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MerkleManifest:
        """A manifest that save() wrote."""
        row = spark.read.parquet(f"{path}/manifest").first()
        forests = (Forest([spark.read.parquet(f"{path}/{name}-{i}") for i in range(row[name])], row["arity"]) for name in ("rows", "groups"))
        return cls(spark, Workspace(spark, "merkle"), *forests, None if row["root"] is None else bytes(row["root"]))

    @property
    def root(self) -> str | None:
        """As lower-case hex text; None for an empty table."""
        return None if self._root is None else self._root.hex()

    def subroots(self) -> DataFrame:
        """(group key, digest)."""
        return self.groups.levels[0].select(F.col("key").alias("group"), "digest")

    def proofs(self) -> DataFrame:
        """Each leaf (id, group, pos, n, digest, kept columns) with its group's subroot and the proof up to the root."""
        none = self.spark.createDataFrame([("",)], "group string").withColumn("proof", F.array().cast(_STEP))
        tops = self.groups.proofs(none, self.work, "groups")
        tops = self.work.table(tops.select(F.col("key").alias("group"), F.col("digest").alias("subroot"), "proof"), "tops")
        found = self.rows.proofs(tops.select("group", "proof"), self.work, "rows")
        return found.join(tops.select("group", "subroot"), "group").drop("kids")


def verified(proofs: DataFrame, root: str | None, digest: Column) -> DataFrame:
    """proofs with folded_root, from `digest` in place of the leaf, and verified: whether that is the root."""
    out = proofs.withColumn("folded_root", fold(digest, F.col("proof")))
    return out.withColumn("verified", F.col("folded_root") == F.lit(root))
