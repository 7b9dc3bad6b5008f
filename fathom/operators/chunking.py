"""Markdown notes to chunks: header sections, then pieces of bounded size with overlap.

Headers are lines of one to three # and a blank, outside code fences. A section keeps its header line; one that is only
a header joins the next section. Sections longer than the size are split at paragraphs, else at lines, else at blanks,
else anywhere; consecutive pieces share up to `overlap` characters. Pieces are spans of the section, so no text is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import unit_id

_HEADER, _FENCE = re.compile(r"(#{1,3}) +(.*?)\s*#*\s*$"), re.compile(r"\s*(```|~~~)")
#: Where a section is split, from the most to the least wanted.
SEPARATORS = ("\n\n", "\n", " ")


def sections(body: str) -> list[tuple[str, str]]:
    """(header path, text) of the sections of a note; blank sections are left out."""
    levels, fenced, lines, out = ["", "", ""], False, [], []
    bare = True  # nothing but headers so far

    def close() -> None:
        text = "\n".join(lines).strip()
        if text:
            out.append((" > ".join(x for x in levels if x), text))

    for line in body.replace("\r\n", "\n").split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        header = None if fenced else _HEADER.match(line)
        if header:
            if not bare:
                close()
                lines.clear()
            depth = len(header[1])
            levels[depth - 1 :] = [header[2], *[""] * (3 - depth)]
            bare = True
        elif line.strip():
            bare = False
        lines.append(line)
    close()
    return out


def _atoms(text: str, begin: int, end: int, size: int, overlap: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Consecutive spans of text[begin:end], each at most size long, cut after the most wanted separators. Where there are
    none, spans are as long as the overlap, so that a piece can begin with the last of the one before."""
    if end - begin <= size:
        yield begin, end
        return
    if level == len(SEPARATORS):
        step = overlap or size
        yield from ((at, min(at + step, end)) for at in range(begin, end, step))
        return
    mark = SEPARATORS[level]
    while begin < end:
        cut = text.find(mark, begin, end)
        stop = end if cut < 0 else cut + len(mark)
        yield from _atoms(text, begin, stop, size, overlap, level + 1)
        begin = stop


def split_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of a text, at most size long, in order. Each begins where the one before ends or up to
    `overlap` characters earlier, so together they cover the text."""
    out: list[tuple[int, int]] = []
    window: list[tuple[int, int]] = []
    for atom in _atoms(text, 0, len(text), size, overlap) if text else ():
        if window and atom[1] - window[0][0] > size:
            out.append((window[0][0], window[-1][1]))
            while window and (window[-1][1] - window[0][0] > overlap or atom[1] - window[0][0] > size):
                window.pop(0)
        window.append(atom)
    if window:
        out.append((window[0][0], window[-1][1]))
    return out


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """The pieces of a text without white space at their ends; blank ones are left out."""
    return [piece for a, b in split_spans(text, size, overlap) if (piece := text[a:b].strip())]


def chunk_notes(notes: DataFrame, size: int = 1000, overlap: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """(unit_id, source, header_path, chunk_index, text, keep...) of notes (source, body, keep...). The index runs over
    the whole note, so ids are unique. Notes without text give no rows."""
    wanted = ("source", "body", *keep)
    base = notes.select(*wanted)
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, places, texts = [], [], [], []
            for i, body in enumerate(batch.column("body").to_pylist()):
                place = 0
                for path, section in sections(body or ""):
                    for piece in split_text(section, size, overlap):
                        at.append(i)
                        paths.append(path)
                        places.append(place)
                        texts.append(piece)
                        place += 1
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("source", *keep)), pa.array(paths, pa.string()), pa.array(places, pa.int32()), pa.array(texts, pa.string())], ["source", *keep, "header_path", "chunk_index", "text"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("source", *keep)) + ", header_path string, chunk_index int, text string"
    return base.mapInArrow(run, schema).withColumn("unit_id", unit_id(F.col("source"), F.col("header_path"), F.col("chunk_index")))
