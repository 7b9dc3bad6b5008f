"""WARC archives with revisit records, and a capture index built by external merging.

Writing: each task writes its records to one archive (one gzip member per record) and its index entries, sorted by URL
key and timestamp, to one run file; both lie in the shared folder under names of their own per attempt, and a manifest
table names those that count. Merging: key ranges are merged in parallel; a task opens every run at its range, found
by the run's sparse index, and streams them through a loser tree, so it holds one block of each run. With more runs
than `fan_in` groups of runs are merged first. The merged parts, in order, are the capture histories of all URLs.
Reading: records are fetched through the merged index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.storage import Workspace

from .members import maybe_members
from .token_store import filesystem, put

#: Captures are dated by their page's id, one second each from EPOCH on, and again from EPOCH after SPAN seconds.
EPOCH, SPAN = datetime(2024, 1, 1, tzinfo=UTC), 100 * 366 * 86400
#: The id that stands for a missing one in index entries.
NO_ID = -(1 << 63)
SPARSE, CUTS = 128, 64  # entries between two marks of a run's sparse index; keys that a run offers as range bounds
_RUNS = "part int, run string, entries long, marks string"
_RANGES = "part int, low string, high string, runs array<string>"
_HEAD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; scheme, user and fragment are dropped."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or "").partition("#")[0]
    host, slash, path = rest.partition("/")
    if not slash:
        host, mark, query = host.partition("?")
        path = mark + query
    name, _, port = host.rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")/" + path.lower()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, stamp: datetime, payload: bytes, digest: str, original: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has no payload but tells its digest, length and the record it refers to."""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")), ("WARC-Date", stamp.strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{'null' if original is None else original}>")] if revisit else []),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes | None]:
    """Header fields and payload (None for a revisit) of a record; raises ValueError if its digest does not fit."""
    data = gzip.decompress(member)
    split = data.index(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not a WARC record")
    fields = {k.decode(): v.decode() for k, v in _HEAD.findall(data[10 : split + 2])}
    block = data[split + 4 : split + 4 + int(fields["Content-Length"])]
    if fields["WARC-Type"] == "revisit":
        return fields, None
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if f"sha1:{payload_digest(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not fit its digest")
    return fields, payload


class LoserTree:
    """Merges sorted iterators. Inner nodes keep the loser of their match, so a pop replays one path to the root."""

    def __init__(self, sources: list[Iterator]):
        self.sources, self.n = sources, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.losers = [-1] * max(1, self.n)
        for source in range(self.n):
            self._replay(source, building=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _replay(self, source: int, building: bool = False) -> None:
        node = (source + self.n) // 2
        while node > 0:
            if self.losers[node] < 0 and building:
                self.losers[node] = source
                return
            if self._beats(self.losers[node], source):
                self.losers[node], source = source, self.losers[node]
            node //= 2
        self.losers[0] = source

    def __iter__(self) -> Iterator:
        while self.n and self.heads[self.losers[0]] is not None:
            source = self.losers[0]
            yield self.heads[source]
            self.heads[source] = next(self.sources[source], None)
            self._replay(source)


class RunWriter:
    """Writes sorted index entries as JSON lines, and marks every SPARSE-th entry's key and offset."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri, self.out, self.marks, self.at, self.count = uri, fs.open_output_stream(path, compression=None), [], 0, 0

    def add(self, entry: list) -> None:
        if self.count % SPARSE == 0:
            self.marks.append([entry[:3], self.at])
        line = json.dumps(entry, ensure_ascii=True).encode() + b"\n"
        self.out.write(line)
        self.at += len(line)
        self.count += 1

    def close(self) -> str:
        self.out.close()
        put(self.uri + ".marks", json.dumps(self.marks).encode())
        return self.uri


    def manifest(self, part: int) -> pa.RecordBatch:
        """Closes the run; its row for the manifest, with CUTS evenly spread keys at most."""
        keys = [k for k, _ in self.marks]
        some = keys[:: -(-len(keys) // CUTS) or 1]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([self.close()]), pa.array([self.count]), pa.array([json.dumps(some)])], ["part", "run", "entries", "marks"])


def read_run(uri: str, low: list | None, high: list | None) -> Iterator[list]:
    """The entries of a run with low <= key < high, read from the last mark before low on."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path + ".marks") as source:
        marks = json.loads(source.read())
    start = 0
    if low is not None:
        first, last = 0, len(marks)
        while first < last:
            middle = (first + last) // 2
            first, last = (middle + 1, last) if marks[middle][0] < low else (first, middle)
        start = marks[first - 1][1] if first else 0
    with fs.open_input_file(path) as source:
        source.seek(start)
        rest = b""
        while block := source.read(1 << 14):
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                entry = json.loads(line)
                if high is not None and entry[:3] >= high:
                    return
                if low is None or entry[:3] >= low:
                    yield entry


def _write(root: str):
    """Rows (id, url, html, keep_id, revisit): an archive and an index run per task; its manifest row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, entries, at, name = None, [], 0, uuid.uuid4().hex[:12]
        for whole in batches:
            for begin in range(0, whole.num_rows, 200):
                batch = whole.slice(begin, 200)
                for page_id, url, html, keep, revisit in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "keep_id", "revisit")), strict=True):
                    if out is None:
                        fs, path = filesystem(f"{root}/archive-{name}.warc.gz")
                        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = fs.open_output_stream(path, compression=None)
                    stamp = EPOCH + timedelta(seconds=(page_id or 0) % SPAN)
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    member = record(page_id, url, stamp, payload, payload_digest(payload), keep, revisit)
                    out.write(member)
                    entries.append([url_key(url), stamp.strftime("%Y%m%d%H%M%S"), NO_ID if page_id is None else page_id, name, at, len(member)])
                    at += len(member)
        if out is not None:
            out.close()
            entries.sort()
            writer = RunWriter(f"{root}/run-{name}.jsonl")
            for entry in entries:
                writer.add(entry)
            yield writer.manifest(0)

    return run


def _merge(root: str):
    """Rows (part, low, high, runs): merges that key range of the runs into one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, low, high, runs in zip(*(batch.column(c).to_pylist() for c in ("part", "low", "high", "runs")), strict=True):
                bounds = [json.loads(x) if x else None for x in (low, high)]
                writer = RunWriter(f"{root}/part-{part:05d}-{uuid.uuid4().hex[:8]}.jsonl")
                for entry in LoserTree([read_run(r, *bounds) for r in runs]):
                    writer.add(entry)
                yield writer.manifest(part)

    return run


class Archive:
    """Written archives and their merged index: parts (part, run, entries), in key order."""

    def __init__(self, spark: SparkSession, root: str, parts: DataFrame):
        self.spark, self.root, self.parts = spark, root, parts

    def history(self) -> DataFrame:
        """(part, place, url_key, timestamp, page_id, archive, offset, length), globally ordered by (part, place)."""
        return self._through(lambda entry, _: [], "", ())

    def read(self) -> DataFrame:
        """history() with each record's type, payload_bytes, payload_digest and refers_to, read from the archives.
        Every payload is checked against its digest."""

        def fields(entry: list, member: bytes) -> list:
            head, payload = parse(member)
            refers = head.get("WARC-Refers-To", "<urn:page:null>")[10:-1]
            size = int(head["X-Payload-Length"]) if payload is None else len(payload)
            return [head["WARC-Type"], size, head["WARC-Payload-Digest"][5:], None if refers == "null" else int(refers)]

        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return self._through(fields, ", record_type string, payload_bytes long, payload_digest string, refers_to long", kinds)

    def _through(self, fields: Callable[[list, bytes], list], schema: str, kinds: tuple) -> DataFrame:
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["part", "place", "url_key", "timestamp", "page_id", "archive", "offset", "length", *re.findall(r", (\w+) ", schema)]
            types = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *kinds)
            for batch in batches:
                for part, uri in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist(), strict=True):
                    block, place = [], 0
                    for entry in read_run(uri, None, None):
                        block.append(entry)
                        if len(block) == 2000:
                            yield packed(part, place, block, names, types)
                            place, block = place + len(block), []
                    if block:
                        yield packed(part, place, block, names, types)

        def packed(part: int, place: int, block: list[list], names: list[str], types: tuple) -> pa.RecordBatch:
            more: list[list] = [[]] * len(block)
            if kinds:  # one archive after the other, each in file order
                source, of = None, None
                for i in sorted(range(len(block)), key=lambda i: (block[i][3], block[i][4])):
                    _, _, _, name, offset, length = block[i]
                    if name != of:
                        source = source.close() if source else None
                        fs, path = filesystem(f"{root}/archive-{name}.warc.gz")
                        source, of = fs.open_input_file(path), name
                    more[i] = fields(block[i], source.read_at(length, offset))
                source.close()
            rows = [[part, place + i, e[0], e[1], None if e[2] == NO_ID else e[2], *e[3:], *m] for i, (e, m) in enumerate(zip(block, more, strict=True))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        parts = self.parts.repartition(max(1, self.parts.count()))
        return parts.mapInArrow(run, "part int, place long, url_key string, timestamp string, page_id long, archive string, offset long, length long" + schema)


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, part_entries: int = 8192, fan_in: int = 256) -> Archive:
    """Write a record per row (null html: empty payload) and index them all.

    Of records with equal payloads of at least least_bytes bytes the one with the largest id is a
    response and the others revisit it; smaller ones are all responses. Rows that repeat the largest id are responses;
    a null id is smaller than any. Null URLs have the key ")/". Captures are dated by id (see SPAN). Columns other than the three are ignored. An empty table gives an archive without records.

    Pages whose payload occurs once stay where they were read; only the others are moved, to meet the page they revisit.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "warc")
    root = work.path("files")
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    long_enough = F.coalesce(F.octet_length("html"), F.lit(0)) >= least_bytes
    base = base.withColumn("digest", F.when(long_enough, F.sha1(F.coalesce("html", F.lit("")))))
    groups = base.where("digest is not null").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = work.table(groups.where("n > 1").drop("n").withColumn("grouped", F.lit(True)), "groups")
    flagged = maybe_members(base, "digest", groups, "digest")
    alone = flagged.where("not _maybe").select("id", "url", "html", F.lit(None).cast("long").alias("keep_id"), F.lit(False).alias("revisit"))
    met = flagged.where("_maybe").join(groups, "digest", "left")
    met = met.select("id", "url", "html", "keep_id", (F.coalesce("grouped", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("keep_id"))).alias("revisit"))
    runs = work.table(alone.unionAll(met).mapInArrow(_write(root), _RUNS), "runs", arrow_rows=500)
    while (listed := runs.collect()) and len(listed) > fan_in:
        groups_of = [[r["run"] for r in listed[i : i + fan_in]] for i in range(0, len(listed), fan_in)]
        rows = spark.createDataFrame([(i, None, None, g) for i, g in enumerate(groups_of)], _RANGES)
        runs = work.table(rows.repartition(len(groups_of)).mapInArrow(_merge(root), _RUNS), "runs")
    total = sum(r["entries"] for r in listed)
    keys = sorted(k for r in listed for k in json.loads(r["marks"]))
    n_parts = max(1, min(-(-total // part_entries), len(keys)))
    cuts = sorted({json.dumps(keys[i * len(keys) // n_parts]) for i in range(1, n_parts)}, key=json.loads)
    names = [r["run"] for r in listed]
    ranges = [(i, low, high, names) for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))] if names else []
    rows = spark.createDataFrame(ranges, _RANGES)
    return Archive(spark, root, work.table(rows.repartition(max(1, len(ranges))).mapInArrow(_merge(root), _RUNS), "parts"))
