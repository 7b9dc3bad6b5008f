"""Character tables over Unicode, for whole chunks of text."""

from __future__ import annotations

import unicodedata

import numpy as np

#: First and last code point of the main blocks of each script.
SCRIPT_RANGES = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x530, 0x58F),),
    "Hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "Devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "Bengali": ((0x980, 0x9FF),),
    "Gurmukhi": ((0xA00, 0xA7F),),
    "Gujarati": ((0xA80, 0xAFF),),
    "Tamil": ((0xB80, 0xBFF),),
    "Telugu": ((0xC00, 0xC7F),),
    "Kannada": ((0xC80, 0xCFF),),
    "Malayalam": ((0xD00, 0xD7F),),
    "Sinhala": ((0xD80, 0xDFF),),
    "Thai": ((0xE00, 0xE7F),),
    "Lao": ((0xE80, 0xEFF),),
    "Tibetan": ((0xF00, 0xFFF),),
    "Burmese": ((0x1000, 0x109F),),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "Ethiopic": ((0x1200, 0x139F),),
    "Khmer": ((0x1780, 0x17FF),),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "Han": ((0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
SCRIPTS = ("Other", *SCRIPT_RANGES)
LETTER, MARK = 1, 2
_TABLES: dict[str, np.ndarray] = {}


def _kind(code: int) -> int:
    category = unicodedata.category(chr(code))[0]
    return LETTER if category == "L" else MARK if category == "M" else 0


def letters(codes: np.ndarray) -> np.ndarray:
    """LETTER, MARK or 0 for each code point."""
    if "kinds" not in _TABLES:
        _TABLES["kinds"] = np.fromiter(map(_kind, range(0x10000)), dtype=np.uint8, count=0x10000)
    out = _TABLES["kinds"][np.minimum(codes, 0xFFFF)]
    for code in np.unique(codes[codes > 0xFFFF]) if codes.max(initial=0) > 0xFFFF else ():
        out[codes == code] = _kind(int(code))
    return out


def scripts(codes: np.ndarray) -> np.ndarray:
    """The number of each code point's script in SCRIPTS."""
    if "starts" not in _TABLES:
        ranges = sorted((a, b, SCRIPTS.index(name)) for name, parts in SCRIPT_RANGES.items() for a, b in parts)
        _TABLES["starts"], _TABLES["ends"], _TABLES["of"] = (np.array(x) for x in zip(*ranges, strict=True))
    at = np.maximum(np.searchsorted(_TABLES["starts"], codes, side="right") - 1, 0)
    inside = (codes >= _TABLES["starts"][at]) & (codes <= _TABLES["ends"][at])
    return np.where(inside, _TABLES["of"][at], 0)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a line feed before and after each, and each text's first position, plus the end."""
    chars = np.frombuffer(("\n" + "".join(t + "\n" for t in texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    return chars, np.concatenate(([1], 1 + np.cumsum(sizes)))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]
