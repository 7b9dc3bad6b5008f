"""Arrow batches for Python workers in pieces of bounded size, and long texts in pieces at white space.

A batch that arrives may hold thousands of texts, and one text may be as long as all of them. Operators look at
`slices` of a batch, and take a text that is longer than a piece through `pieces`, so that what a worker holds beside
the texts themselves has a bound. When a task ends, memory that the allocators keep for later goes back to the system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_ROWS, SLICE_BYTES = 1000, 2 << 20
_BLANKS = "\t\n\x0b\x0c\r "


def slices(batches: Iterator[pa.RecordBatch], *columns: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most `rows` rows and about `size` bytes in the columns (or one row)."""
    for batch in batches:
        total = np.zeros(batch.num_rows, dtype=np.int64)
        for c in columns:
            total += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(total), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = min(begin + rows, max(begin + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(begin, end - begin)
            begin = end
        del batch
    release()


def release() -> None:
    """Give free memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces(text: str, size: int) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut before white space; without any within twice the size, after
    exactly that many characters. A text that is not longer is its only piece."""
    begin = 0
    while len(text) - begin > size:
        end = max(text.rfind(c, begin + 1, begin + size) for c in _BLANKS)
        if end < 0:
            end = min((at for at in (text.find(c, begin + size, begin + 2 * size) for c in _BLANKS) if at >= 0), default=min(begin + 2 * size, len(text)))
        yield text[begin:end]
        begin = end
    if begin < len(text) or not text:
        yield text[begin:]


def kept_rows(docs: DataFrame, text_col: str, wanted: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows of docs, whole and unchanged, whose text is wanted. `wanted` is called once in each task; what it
    returns is asked about the texts of a slice. Columns may have any names."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = wanted()
        for batch in batches:
            keep = [k for part in slices([pa.RecordBatch.from_arrays([batch.column(at)], ["text"])], "text") for k in ask(part.column("text").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return named.mapInArrow(run, named.schema).toDF(*docs.columns)
