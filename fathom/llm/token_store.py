"""Token-id files with a shared zstandard dictionary and random access.

A file holds the documents of one id range, in id order:

    header   b"TKZ1", then a length and a JSON object: width of an id in bytes, SHA-256 of the dictionary
    frames   one zstandard frame per document: its ids, little-endian, the end id included
    index    per document: id, offset of its frame, length of its frame, number of ids (4 x little-endian int64);
             a null id is the smallest int64
    tail     offset of the index and number of documents (2 x int64), b"TKZ1"

The dictionary lies beside the files. It makes short documents small, and any document can be read alone: the index,
one frame, the dictionary. Files are written under names of their own per attempt; a manifest table names those that
count, so a task that is run again leaves nothing wrong behind.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.storage import Workspace

from .batches import slices
from .bpe import encoder

MAGIC, NO_ID = b"TKZ1", -(1 << 63)
#: Documents whose ids the dictionary is trained on, and its size in bytes.
DICTIONARY_SAMPLE, DICTIONARY_BYTES = 400, 64 << 10
_INDEX = np.dtype([("id", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("count", "<i8")])


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(data)


def get(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as source:
        return source.read()


class TokenFile:
    """Reads one file: all documents, or any one of them."""

    def __init__(self, uri: str, dictionary: bytes):
        fs, path = filesystem(uri)
        self.source = fs.open_input_file(path)
        size = self.source.size()
        at, self.count, magic = struct.unpack("<qq4s", self.source.read_at(20, size - 20))
        head = self.source.read_at(8, 0)
        self.header = json.loads(self.source.read_at(struct.unpack("<i", head[4:])[0], 8))
        if head[:4] != MAGIC or magic != MAGIC or self.header["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{uri}: not a token file of this dictionary")
        self.index = np.frombuffer(self.source.read_at(size - 20 - at, at), dtype=_INDEX)
        self._open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def document(self, position: int) -> np.ndarray:
        entry = self.index[position]
        raw = self._open.decompress(self.source.read_at(int(entry["length"]), int(entry["offset"])))
        return np.frombuffer(raw, dtype=f"<u{self.header['width']}").astype("<u4")

    def close(self) -> None:
        self.source.close()


def _write(root: str, width: int, dictionary: bytes):
    """Rows (bucket, id, frame, count) in order: a file per bucket; rows for the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, bucket, out = [], None, None
        for batch in batches:
            for b, i, frame, count in zip(*(batch.column(c).to_pylist() for c in ("bucket", "id", "frame", "count")), strict=True):
                if b != bucket:
                    if out is not None:
                        done.append((bucket, *out.close()))
                    bucket, out = b, _Writer(f"{root}/ids-{b:05d}-{uuid.uuid4().hex[:8]}.tkz", width, dictionary)
                out.add(i, frame, count)
        if out is not None:
            done.append((bucket, *out.close()))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["bucket", "path", "documents", "tokens"])

    return run


class _Writer:
    def __init__(self, uri: str, width: int, dictionary: bytes):
        self.uri, (fs, path) = uri, filesystem(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.index, self.at, self.tokens = fs.open_output_stream(path, compression=None), [], 0, 0
        head = json.dumps({"width": width, "dictionary": hashlib.sha256(dictionary).hexdigest()}).encode()
        self._put(MAGIC + struct.pack("<i", len(head)) + head)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, frame: bytes, count: int) -> None:
        self.index.append((NO_ID if doc_id is None else doc_id, self.at, len(frame), count))
        self.tokens += count
        self._put(frame)

    def close(self) -> tuple[str, int, int]:
        at = self.at
        self._put(np.array(self.index, dtype=_INDEX).tobytes() + struct.pack("<qq4s", at, len(self.index), MAGIC))
        self.out.close()
        return self.uri, len(self.index), self.tokens


def _frames(tokenizer: str, end_id: int, width: int, dictionary: bytes, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text"):
            frames, counts = [], []
            for _, ids in own.encode([t or "" for t in batch.column("text").to_pylist()]):
                frames.append(squeeze.compress(np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()))
                counts.append(len(ids) + 1)
            ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            buckets = np.searchsorted(bounds, ids, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), batch.column("id"), pa.array(frames, pa.binary()), pa.array(counts, pa.int64())], ["bucket", "id", "frame", "count"])

    return run


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """A dictionary from the ids of DICTIONARY_SAMPLE documents, chosen by a hash of their ids; empty if zstandard
    finds too little to train on. It only decides how small the files are."""
    chosen = docs.where("id is not null").select("id").orderBy(F.xxhash64("id"), "id").limit(DICTIONARY_SAMPLE)
    texts = [r["text"] or "" for r in docs.join(F.broadcast(chosen.distinct()), "id").select("text").limit(2 * DICTIONARY_SAMPLE).collect()]
    samples = [np.append(ids, np.uint32(end_id)).astype(f"<u{width}").tobytes()[: 1 << 16] for _, ids in encoder(tokenizer).encode(texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class TokenStore:
    """A written set of token files: root folder, dictionary and manifest (bucket, path, documents, tokens)."""

    def __init__(self, spark: SparkSession, root: str, manifest: DataFrame):
        self.spark, self.root, self.manifest = spark, root, manifest

    def read(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32, path, position) of every document, from the files. start counts the
        ids of all documents before it; ids_crc32 is over all its ids as little-endian unsigned 32-bit integers."""
        files = sorted((tuple(r) for r in self.manifest.collect()), key=lambda r: r[0])
        rows, before = [], 0
        for _, path, _, tokens in files:
            rows.append((path, before))
            before += tokens
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dictionary = get(f"{root}/dictionary")
            for batch in batches:
                for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                    file = TokenFile(path, dictionary)
                    n = file.count
                    crcs = np.fromiter((zlib.crc32(file.document(i).tobytes()) for i in range(n)), dtype=np.int64, count=n)
                    counts = file.index["count"]
                    ids = pa.array(file.index["id"], mask=file.index["id"] == NO_ID)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array(crcs), pa.array([path] * n, pa.string()), pa.array(np.arange(n))], ["doc_id", "start", "n_tokens", "ids_crc32", "path", "position"])
                    file.close()

        listed = self.spark.createDataFrame(rows, "path string, base long")
        return listed.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, position long")

    def document(self, path: str, position: int) -> np.ndarray:
        """The ids of one document, without reading others."""
        file = TokenFile(path, get(f"{self.root}/dictionary"))
        try:
            return file.document(position)
        finally:
            file.close()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", bytes_per_file: int = 32 << 20) -> TokenStore:
    """Encode every text (null: empty), append end_id, and write all ids in ascending id order.

    Only compressed ids are moved. Files are cut at quantiles of the ids, so that each has about bytes_per_file of
    text. Rows with a null id come first; rows that repeat an id follow each other; other columns are ignored. An
    empty table gives a store without files.
    """
    spark = docs.sparkSession
    root = Workspace(spark, "token-store").path("files")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = base.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    n_files = max(1, -(-size // bytes_per_file))
    shares = [i / n_files for i in range(1, n_files)]
    bounds = np.array(sorted(set(base.approxQuantile("id", shares, 0.2 / n_files))) if shares else [], dtype=np.int64)
    width = 2 if max(encoder(tokenizer).library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(base, tokenizer, end_id, width)
    put(f"{root}/dictionary", dictionary)
    frames = base.mapInArrow(_frames(tokenizer, end_id, width, dictionary, bounds), "bucket int, id long, frame binary, count long")
    order = frames.repartition(n_files, "bucket").sortWithinPartitions("bucket", "id", "count")
    manifest = Workspace(spark, "token-store").table(order.mapInArrow(_write(root, width, dictionary), "bucket int, path string, documents long, tokens long"), "manifest")
    return TokenStore(spark, root, manifest)
