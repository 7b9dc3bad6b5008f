"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds all substrings of the normalised items, over words. A document's words are streamed through it
while the length of the longest match that ends at each word is tracked. A word window of an item occurs where that
length reaches the window's. Words that no item has reset the match, and stretches of known words that are shorter than
the shortest window cannot hold one and are skipped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from fathom.storage import Workspace

from .batches import kept_rows, slices

#: Bytes of item texts that one index takes; what is sent to the tasks is a small multiple of it. More items are read in
#: blocks, one pass over the documents for each.
MOST_ITEM_BYTES = 64 << 20

Items = list[tuple[object, str | None]]

#: A-Z to a-z; every ASCII character but letters and digits to a blank. Others are parts of words.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class SuffixAutomaton:
    """Generalised: one root, all items. next[s]: word to state; length, link as usual."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])

    def _state(self, length: int, of: int | None = None) -> int:
        self.next.append({} if of is None else dict(self.next[of]))
        self.length.append(length)
        self.link.append(0 if of is None else self.link[of])
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The state for the longest match of `state` + word when the existing one also stands for longer ones."""
        q = self.next[state][word]
        if self.length[q] == self.length[state] + 1:
            return q
        copy = self._state(self.length[state] + 1, q)
        self.link[q] = copy
        while state >= 0 and self.next[state].get(word) == q:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, state = self._state(self.length[last] + 1), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        self.link[new] = 0 if state < 0 else self._split(state, word)
        return new

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)


class WindowIndex:
    """Finds the windows of items in documents: `width` consecutive words of an item, or a shorter item as a whole.

    Items without words have no window. Its size is a small multiple of the number of item words.
    """

    def __init__(self, items: Items, width: int = 13):
        self.width, self.vocabulary, by_words = width, {}, {}
        for item, text in items:
            words = words_of(text)
            if words:
                key = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words)
                by_words.setdefault(key, set()).add(str(item))
        self.items = [sorted(names) for names in by_words.values()]
        self.automaton = automaton = SuffixAutomaton()
        for sequence in by_words:
            automaton.add(list(sequence))
        n = len(automaton.length)
        self.shortest = min((min(width, len(s)) for s in by_words), default=width)
        self._of: list[set[int]] = [set() for _ in range(n)]  # items with a window-long substring in the state
        short: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for number, sequence in enumerate(by_words):
            state = 0
            for word in sequence:
                state = automaton.next[state][word]
                up = state
                while up > 0 and automaton.length[up] >= width and number not in self._of[up]:
                    self._of[up].add(number)
                    up = automaton.link[up]
            if len(sequence) < width:
                short[state].append((len(sequence), number))
        self._short: list[list[tuple[int, int]]] = short  # with those of shorter suffixes, longest first
        for state in sorted(range(1, n), key=automaton.length.__getitem__):
            self._short[state] = sorted(short[state] + self._short[automaton.link[state]], reverse=True)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurring window, and the numbers of the items with one."""
        n, width = len(words), self.width
        hit, found = np.zeros(n, dtype=bool), set()
        get, step, length, link = self.vocabulary.get, self.automaton.next, self.automaton.length, self.automaton.link
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        for begin, end in zip(edges[::2], edges[1::2], strict=True):
            if end - begin < self.shortest:
                continue
            state, matched = 0, 0
            for at, word in enumerate(ids[begin:end].tolist(), int(begin)):
                while state and word not in step[state]:
                    state = link[state]
                    matched = length[state]
                if word in step[state]:
                    state, matched = step[state][word], matched + 1
                if matched >= width:
                    hit[at - width + 1 : at + 1] = True
                    top = state
                    while length[link[top]] >= width:
                        top = link[top]
                    found |= self._of[top]
                for size, number in self._short[state]:
                    if size <= matched:
                        hit[at - size + 1 : at + 1] = True
                        found.add(number)
        return hit, found


def remove_spans(text: str, hit: np.ndarray) -> str:
    """The text without the words that are hit; what stands between two removed words goes with them."""
    data = text.encode("utf-8", "surrogatepass")
    chars = np.frombuffer(data.translate(_FOLD), dtype=np.uint8)
    inside = np.concatenate(([False], chars != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    kept, at = [], 0
    runs = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    for first, last in zip(runs[::2], runs[1::2], strict=True):
        kept.append(data[at : edges[2 * first]])
        at = edges[2 * last - 1]
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, percent: int = 5, cleaned: bool = False) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every document, and with cleaned=True its text
    without the hit spans if it is contaminated, else unchanged.

    Words are lower-cased runs of ASCII letters, digits and other than ASCII characters. A document is contaminated
    if it has a hit and 100 * n_hit >= percent * n_words. items_sha256: of the found items' ids, as text, sorted and
    comma-joined (of the empty string if none). Null and blank texts have no words. Items with equal words all count;
    rows that repeat an item id count once. An empty benchmark hits nothing. Null item ids count as the text "None".
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _judged(rows, _blocks(benchmark, item_col, item_text_col), width, percent, cleaned)
    return found.toDF(id_col, *found.columns[1:])


def _judged(rows: DataFrame, blocks: Iterator[Items], width: int, percent: int, cleaned: bool = False) -> DataFrame:
    """decontaminate for rows (id, text). Of several blocks of items each marks the words that it hits in a pass of its
    own, and the last pass judges what all have marked; so a word that two blocks hit counts once."""
    spark, work = rows.sparkSession, None
    kind, block = rows.schema["id"].dataType, next(blocks, [])
    while True:
        later = next(blocks, None)
        index = spark.sparkContext.broadcast(WindowIndex(block, width))
        if later is None:
            schema = StructType().add("id", kind).add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")
            return rows.mapInArrow(_judge(index, percent, cleaned), schema.add("cleaned", "string") if cleaned else schema)
        schema = StructType().add("id", kind).add("text", "string").add("hits", "binary").add("names", ArrayType(StringType()))
        before, work = work, Workspace(spark, "decontaminate")
        rows = work.table(rows.mapInArrow(_mark(index), schema), "marked")
        if before is not None:
            before.remove()
        index.unpersist()
        block = later


def _scanned(index: Broadcast, batch: pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray, list[str]]]:
    """Of each text: itself, which of its words are hit, and the ids of the items found, with what earlier blocks marked."""
    found_by, texts = index.value, batch.column("text").to_pylist()
    again = "hits" in batch.schema.names
    before = zip(batch.column("hits").to_pylist(), batch.column("names").to_pylist(), strict=True) if again else ((b"", ()) for _ in texts)
    for text, (hits, names) in zip(texts, before, strict=True):
        words = words_of(text)
        hit, numbers = found_by.scan(words)
        if again:
            hit |= np.unpackbits(np.frombuffer(hits, dtype=np.uint8), count=len(words)).astype(bool)
        yield text, hit, sorted({name for i in numbers for name in found_by.items[i]}.union(names))


def _mark(index: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(np.packbits(hit).tobytes(), names) for _, hit, names in _scanned(index, batch)]
            marks = pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), *marks], ["id", "text", "hits", "names"])

    return run


def _judge(index: Broadcast, percent: int, cleaned: bool):
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "cleaned": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = list(kinds)[: 5 + cleaned]
        for batch in slices(batches, "text"):
            rows = []
            for text, hit, names in _scanned(index, batch):
                n_hit = int(hit.sum())
                dirty = _is_contaminated(n_hit, len(hit), percent)
                row = [len(hit), n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), dirty]
                rows.append([*row, remove_spans(text, hit) if dirty else text] if cleaned else row)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[i] for r in rows], kinds[k]) for i, k in enumerate(wanted))], ["id", *wanted])

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, percent: int = 5) -> DataFrame:
    """The rows of docs, whole and unchanged, that are not contaminated (see decontaminate)."""
    blocks = _blocks(benchmark, item_col, item_text_col)
    first, second = next(blocks, []), next(blocks, None)
    if second is not None:
        named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
        rows = named.select(F.struct(*named.columns).alias("id"), F.col(f"c{docs.columns.index(text_col)}").cast("string").alias("text"))
        return _judged(rows, chain([first, second], blocks), width, percent).where("not contaminated").select("id.*").toDF(*docs.columns)
    index = docs.sparkSession.sparkContext.broadcast(WindowIndex(first, width))

    def wanted():
        found_by = index.value

        def ask(texts: list[str | None]) -> list[bool]:
            out = []
            for text in texts:
                words = words_of(text)
                out.append(not _is_contaminated(int(found_by.scan(words)[0].sum()), len(words), percent))
            return out

        return ask

    return kept_rows(docs, text_col, wanted)


def _is_contaminated(n_hit: int, n_words: int, percent: int) -> bool:
    return n_hit > 0 and 100 * n_hit >= percent * n_words


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[Items]:
    """The items in blocks of MOST_ITEM_BYTES of text at most (or of one item that is longer): mostly a single block.
    Their size is known before any is collected, and the driver holds two blocks at a time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= MOST_ITEM_BYTES:
        yield [(r["item"], r["text"]) for r in items.collect()]
        return
    block, held = [], 0
    for row in items.toLocalIterator():
        size = len((row["text"] or "").encode("utf-8", "surrogatepass"))
        if block and held + size > MOST_ITEM_BYTES:
            yield block
            block, held = [], 0
        block.append((row["item"], row["text"]))
        held += size
    yield block
