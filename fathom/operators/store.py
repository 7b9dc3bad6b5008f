"""The unit store: Parquet by kind, in layers, with replacement by kind and by source.

A kind's units lie in layers, the oldest first; a manifest names them. An upsert writes one layer, which holds the units it
brings and a delete vector: the sources that it replaces. It costs what it brings, whatever the store holds. A reader takes
the units of all layers but those whose source a later layer replaces. When FAN layers at the end are of about the same
size they become one, so there are fewer than FAN layers of each size and a unit is rewritten once for each size.

The manifest is replaced in one rename after all data are written, so readers see the old units or the new ones and a crash
loses nothing; what it leaves behind no manifest names, and `vacuum` removes it. Layers that a manifest no longer names stay
until the next one is published, so that plans made before a merge can still run. One writer at a time.
"""

from __future__ import annotations

import contextlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.storage import read_text, remove, replace_text, table_if_there

UNITS = "unit_id string, source string, header_path string, date string, project string, type string, public boolean, text string, chunk_index int, community_id int, note_count int, content_sha string, embedding array<float>, kind string"
FAN = 4
#: Bytes of a layer up to which it is of the smallest size; each further size holds FAN times as much.
SMALL = 1 << 20


def _size(layer: dict) -> int:
    """The number of the layer's size."""
    size = 0
    while layer["bytes"] > SMALL * FAN**size:
        size += 1
    return size


class UnitStore:
    """Units of kinds '' (chunks) and community_summary below one folder. Writing a kind replaces that kind only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _folder(self, kind: str) -> str:
        return f"{self.path}/kind-{kind or 'chunks'}"

    def _manifest(self, kind: str) -> dict[str, list]:
        found = read_text(self.spark, f"{self._folder(kind)}/MANIFEST")
        return json.loads(found) if found else {"layers": [], "retired": []}

    def layers(self, kind: str = "") -> list[dict]:
        """(name, bytes, gone: whether it has a delete vector) of each layer, the oldest first."""
        return self._manifest(kind)["layers"]

    def _publish(self, kind: str, layers: list[dict]) -> None:
        before, named = self._manifest(kind), {layer["name"] for layer in layers}
        retired = [layer["name"] for layer in before["layers"] if layer["name"] not in named]
        replace_text(self.spark, f"{self._folder(kind)}/MANIFEST", json.dumps({"layers": layers, "retired": retired}))
        self._remove(kind, before["retired"])

    def _remove(self, kind: str, names: list[str]) -> None:
        for name in names:
            for part in ("units", "gone"):
                remove(self.spark, f"{self._folder(kind)}/{part}/layer={name}")

    def kinds(self) -> list[str]:
        fs, path = self._hadoop(self.path)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        found = ["" if n == "kind-chunks" else n[5:] for n in names if n.startswith("kind-")]
        return sorted(k for k in found if self.layers(k))

    def exists(self) -> bool:
        return bool(self.kinds())

    def _part(self, kind: str, part: str, schema: str, layers: list[dict]) -> DataFrame:
        """Rows of a part of some layers, with `_at`, the layer's place among them."""
        root = f"{self._folder(kind)}/{part}"
        rows = self.spark.read.schema(f"{schema}, layer string").option("basePath", root).parquet(*(f"{root}/layer={layer['name']}" for layer in layers))
        places = F.create_map(*(F.lit(x) for i, layer in enumerate(layers) for x in (layer["name"], i)))
        return rows.withColumn("_at", places[F.col("layer")]).drop("layer")

    def _live(self, kind: str, layers: list[dict]) -> DataFrame:
        """Units of these layers that no later one of them replaces."""
        units = self._part(kind, "units", UNITS, layers).withColumn("kind", F.lit(kind))
        if any(layer["gone"] for layer in layers[1:]):
            holders = {layer["name"]: i for i, layer in enumerate(layers) if layer["gone"]}
            gone = self._part(kind, "gone", "source string", [layer for layer in layers if layer["gone"]])
            places = F.array(*(F.lit(i) for i in holders.values()))
            last = gone.groupBy("source").agg(F.max(places[F.col("_at")]).alias("_gone"))
            units = units.join(last, (units["source"] == last["source"]) & (units["_at"] < last["_gone"]), "left_anti")
        return units.drop("_at")

    def read(self, kind: str | None = None) -> DataFrame:
        """All units, or those of a kind."""
        out = self.spark.createDataFrame([], UNITS)
        for k in self.kinds() if kind is None else [kind]:
            if layers := self.layers(k):
                out = out.unionByName(self._live(k, layers).select(*out.columns))
        return out

    def _write(self, kind: str, units: DataFrame, gone: DataFrame | None, own: bool = False, unique: bool = True) -> dict:
        """Write a layer; the sources of its units are its delete vector if `own`. Units are written where they are, without
        a shuffle. Unless they are `unique`, repeated ids are looked for in what was written, and only if there are any it
        is written once more without them."""
        name, root = uuid.uuid4().hex[:12], self._folder(kind)
        where = {part: f"{root}/{part}/layer={name}" for part in ("units", "gone")}
        units.drop("kind").write.parquet(where["units"])
        if not unique:
            written = self.spark.read.schema(units.drop("kind").schema).parquet(where["units"])
            if not written.groupBy("unit_id").count().where("count > 1").isEmpty():
                layer = self._write(kind, _one_each(written), gone, own)
                self._remove(kind, [name])
                return layer
        if own:
            gone = self.spark.read.schema(UNITS).parquet(where["units"])
        if gone is not None:
            gone.select("source").where("source is not null").distinct().write.parquet(where["gone"])
        total = 0
        for part in where.values():
            fs, path = self._hadoop(part)
            total += fs.getContentSummary(path).getLength() if fs.exists(path) else 0
        return {"name": name, "bytes": total, "gone": gone is not None}

    def replace(self, units: DataFrame, kind: str = "") -> None:
        """The kind's units become these."""
        self._publish(kind, [self._write(kind, units, None)])

    def delete(self, kind: str) -> None:
        fs, path = self._hadoop(self._folder(kind))
        fs.delete(path, True)

    def reset(self) -> None:
        fs, path = self._hadoop(self.path)
        fs.delete(path, True)

    def upsert(self, units: DataFrame, kind: str = "", sources: DataFrame | None = None) -> None:
        """Replace all units of the sources (of those that occur in units, if none are given), then add units; others
        stay. Sources without units lose theirs. Of units that repeat a unit_id the first in the order of all their values
        stays. Units are computed once, so they may be costly."""
        self._publish(kind, [*self.layers(kind), self._write(kind, units, sources, own=sources is None, unique=False)])
        self.compact(kind)

    def compact(self, kind: str = "") -> None:
        """Merge layers at the end, while FAN or more of them are of about the same size. The units stay what they are."""
        layers = self.layers(kind)
        while (first := _first_to_merge(layers)) is not None:
            rest, tail = layers[:first], layers[first:]
            holders = [layer for layer in tail if layer["gone"]]
            gone = self._part(kind, "gone", "source string", holders) if rest and holders else None
            layers = [*rest, self._write(kind, self._live(kind, tail), gone)]
            self._publish(kind, layers)

    def vacuum(self, kind: str = "") -> int:
        """Remove what crashed writers left and what has been replaced; the number of folders. Nothing may be written, and
        no plan made before the last change may run, meanwhile."""
        manifest, removed = self._manifest(kind), 0
        named = {layer["name"] for layer in manifest["layers"]}
        for part in ("units", "gone"):
            fs, path = self._hadoop(f"{self._folder(kind)}/{part}")
            for status in fs.listStatus(path) if fs.exists(path) else ():
                if status.getPath().getName().removeprefix("layer=") not in named:
                    removed += bool(fs.delete(status.getPath(), True))
        return removed


def _first_to_merge(layers: list[dict]) -> int | None:
    """Where the layers begin that become one: the shortest run at the end that has FAN layers of one size and none of a
    larger size. So a large layer is not rewritten for the sake of small ones."""
    for size in range(max(map(_size, layers), default=0) + 1):
        first = len(layers)
        while first and _size(layers[first - 1]) <= size:
            first -= 1
        if sum(_size(layer) == size for layer in layers[first:]) >= FAN:
            return first
    return None


def _one_each(units: DataFrame) -> DataFrame:
    """Of rows that repeat a unit_id the first in the order of all their values."""
    rest = [c for c in units.columns if c != "unit_id"]
    return units.groupBy("unit_id").agg(F.min(F.struct(*rest)).alias("_row")).select("unit_id", "_row.*")


def upserted(old: DataFrame, new: DataFrame, by: str = "source", sources: DataFrame | None = None) -> DataFrame:
    """old without the sources of new (or the given ones), and new. Of rows of new that repeat a unit_id the first in the
    order of all their values stays."""
    gone = (new if sources is None else sources).select(by).distinct()
    return old.join(gone, by, "left_anti").unionByName(_one_each(new), allowMissingColumns=True).select(*old.columns)


def changed(old: DataFrame, new: DataFrame, key: str = "source", digest: str | tuple[str, ...] = "content_sha") -> DataFrame:
    """Rows of new whose content is not that of old."""
    digests = [digest] if isinstance(digest, str) else list(digest)
    return new.join(old.select(key, *digests), [key, *digests], "left_anti")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges), or None if there is no graph that can be read as Parquet: search then goes on without it."""
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    with contextlib.suppress(PySparkException, Py4JError):
        nodes, edges = (table_if_there(spark, f"{path}/{part}") for part in ("nodes", "edges"))
        return None if nodes is None or edges is None else (nodes, edges)
    return None
