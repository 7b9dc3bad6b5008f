"""Token ids of many texts, by the tokenizers library and a cache of words.

A byte-level BPE tokenizer splits a text into pieces (words, numbers, punctuation, white space) and encodes each piece
on its own. The split is done here for a whole chunk of texts at once, in numpy; each distinct piece is encoded by the
library once and kept. A kept piece is found by its hash and then compared character by character, so a text whose piece
meets another's hash goes to the library whole. So do texts with characters whose class changed
between Unicode versions, and texts that contain an added token (such as <|endoftext|>). Long texts are encoded part by
part; they are cut before a blank between two other characters, where a piece begins in any case.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np

from .hashing import chunks_of, slice_hashes

CHUNK_CHARS = 1 << 17
#: The characters that the split takes as white space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: The endings after an apostrophe that are pieces of their own.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")
_OTHER, _SPACE, _LETTER, _NUMBER, _UNSURE = range(5)
#: Slots of the cache, and the pieces and characters that it holds at most before it drops what was met only once.
_CACHE_SLOTS, _CACHE_FULL, _CACHE_CHARS = 1 << 20, 500_000, 4 << 20
#: Pieces longer than this are not kept.
_LONGEST = 256


#: A blank between two characters that are no white space.
_CUT = re.compile(r"[^\s\x1c-\x1f\x85] (?![\s\x1c-\x1f\x85])(?=.)", re.S)


def _class_of(code: int) -> int:
    if code in WHITE:
        return _SPACE
    now, old = unicodedata.category(chr(code)), unicodedata.ucd_3_2_0.category(chr(code))
    return _UNSURE if now[0] != old[0] or now == "Cn" else {"L": _LETTER, "N": _NUMBER}.get(now[0], _OTHER)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] numbers), then those of starts[1], and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class WordCacheEncoder:
    """Encodes texts with a tokenizer file as its library does; added tokens in a text are their own ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # A piece that contains one of these is in the cache too, but only texts that go to the library whole have it.
        self._added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._classes = np.full(0x10000, 255, dtype=np.uint8)
        self._reset()

    def _reset(self) -> None:
        self._keys = np.zeros(_CACHE_SLOTS, dtype=np.uint64)
        self._entry = np.zeros(_CACHE_SLOTS, dtype=np.int32)
        self._begin, self._count = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self._ids, self._entries, self._used = np.zeros(1 << 18, dtype=np.uint32), 0, 0
        self._chars, self._place, self._size, self._held = np.zeros(1 << 18, dtype=np.uint32), np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64), 0
        self._again = np.zeros(1 << 16, dtype=bool)

    def _trim(self) -> None:
        """Keep the pieces that a later chunk met again, or none if these fill more than half of the cache."""
        used = np.flatnonzero(self._keys)
        used = used[self._again[self._entry[used]]]
        keys, entry = self._keys[used], self._entry[used]
        counts, sizes = self._count[entry], self._size[entry]
        if len(keys) > _CACHE_FULL // 2 or sizes.sum() > _CACHE_CHARS // 2:
            return self._reset()
        flat, chars = self._ids[_runs(self._begin[entry], counts)], self._chars[_runs(self._place[entry], sizes)]
        self._reset()
        self._keep(keys, flat, counts, chars, sizes)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The cache entry of each key, or -1."""
        found = np.full(len(keys), -1, dtype=np.int64)
        open_at, slot = np.arange(len(keys)), (keys >> np.uint64(44)).astype(np.int64)
        while len(open_at):
            held = self._keys[slot]
            hit = held == keys[open_at]
            found[open_at[hit]] = self._entry[slot[hit]]
            going = ~hit & (held != 0)
            open_at, slot = open_at[going], (slot[going] + 1) % _CACHE_SLOTS
        return found

    @staticmethod
    def _grown(array: np.ndarray, size: int) -> np.ndarray:
        while size > len(array):
            array = np.concatenate((array, np.zeros_like(array)))
        return array

    def _same(self, chars: np.ndarray, starts: np.ndarray, stops: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether each piece is the one that its cache entry was made from."""
        sizes = stops - starts
        same = self._size[entry] == sizes
        at = np.flatnonzero(same)
        if len(at):
            n = sizes[at]
            same[at] = np.logical_and.reduceat(chars[_runs(starts[at], n)] == self._chars[_runs(self._place[entry[at]], n)], np.cumsum(n) - n)
        return same

    def _add(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces, at most a chunk's worth of them, and keep them and their ids."""
        encoded = self.library.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        counts = np.bincount(np.array(encoded.word_ids, dtype=np.int64), minlength=len(pieces))
        sizes, chars = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)), np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self._keep(keys, np.array(encoded.ids, dtype=np.uint32), counts, chars, sizes)

    def _keep(self, keys: np.ndarray, flat: np.ndarray, counts: np.ndarray, chars: np.ndarray, sizes: np.ndarray) -> None:
        """Keep pieces of counts ids and sizes characters each, all of them in flat and chars one after the other."""
        first, self._entries = self._entries, self._entries + len(keys)
        self._begin, self._count, self._place, self._size, self._again = (self._grown(x, self._entries) for x in (self._begin, self._count, self._place, self._size, self._again))
        self._ids, self._chars = self._grown(self._ids, self._used + len(flat)), self._grown(self._chars, self._held + len(chars))
        self._ids[self._used : self._used + len(flat)] = flat
        self._chars[self._held : self._held + len(chars)] = chars
        self._begin[first : self._entries] = self._used + np.cumsum(counts) - counts
        self._place[first : self._entries] = self._held + np.cumsum(sizes) - sizes
        self._count[first : self._entries], self._size[first : self._entries] = counts, sizes
        self._used += len(flat)
        self._held += len(chars)
        todo, slot = np.arange(len(keys)), (keys >> np.uint64(44)).astype(np.int64)
        while len(todo):
            free = self._keys[slot] == 0
            self._keys[slot[free]] = keys[todo[free]]
            mine = free & (self._keys[slot] == keys[todo])
            self._entry[slot[mine]] = first + todo[mine]
            todo, slot = todo[~mine], (slot[~mine] + 1) % _CACHE_SLOTS

    def _classify(self, chars: np.ndarray) -> np.ndarray:
        low = np.minimum(chars, 0xFFFF).astype(np.uint16)
        kinds = self._classes[low]
        if (kinds == 255).any():
            for code in np.unique(low[kinds == 255]):
                self._classes[code] = _class_of(int(code))
            kinds = self._classes[low]
        for code in np.unique(chars[chars > 0xFFFF]) if chars.max(initial=0) > 0xFFFF else ():
            kinds[chars == code] = _class_of(int(code))
        return kinds

    def _pieces(self, chars: np.ndarray, kinds: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """First character of each piece."""
        n = len(chars)
        space = kinds == _SPACE
        opens = np.zeros(n + 1, dtype=bool)
        opens[text_starts] = True
        begins = opens[:n].copy()
        changes = np.ones(n, dtype=bool)
        changes[1:] = kinds[1:] != kinds[:-1]
        after_blank = np.zeros(n, dtype=bool)
        after_blank[1:] = (chars[:-1] == 32) & ~space[1:] & ~begins[1:]
        starts = (changes & ~after_blank) | begins
        starts[:-1] |= space[:-1] & ~space[1:] & ~opens[1:n]  # the last white space before something else
        quotes = np.flatnonzero((chars == 39) & starts)
        quotes = quotes[quotes + 1 < n]
        if len(quotes):
            tail = np.concatenate((chars, [0, 0, 0]))
            same = np.cumsum(np.concatenate((begins, [True, True, True])))
            for endings in (SHORT_ENDINGS, LONG_ENDINGS):
                for ending in endings:
                    at = quotes[np.all([(tail[quotes + 1 + i] == ord(c)) & (same[quotes + 1 + i] == same[quotes]) for i, c in enumerate(ending)], axis=0)]
                    starts[at + 1] = False
                    end = at + 1 + len(ending)
                    starts[end[end < n]] = True
        return np.flatnonzero(starts)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(position of the text, its ids as uint32) for every text, in order."""
        for begin, end in chunks_of([len(t) for t in texts], CHUNK_CHARS):
            if len(texts[begin]) > 2 * CHUNK_CHARS:
                yield begin, self._long(texts[begin])
            else:
                yield from ((begin + i, ids) for i, ids in enumerate(self._chunk(texts[begin:end])))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _long(self, text: str) -> np.ndarray:
        """The ids of a text that is cut where a piece begins for certain."""
        if any(t in text for t in self._added):
            return self._whole(text)
        out, begin = [], 0
        while begin < len(text):
            cut = _CUT.search(text, min(begin + CHUNK_CHARS, len(text)))
            end = cut.start() + 1 if cut else len(text)
            if (ids := next(self._chunk([text[begin:end]], None))) is None:
                return self._whole(text)
            out.append(ids)
            begin = end
        return np.concatenate(out)

    def _chunk(self, texts: list[str], otherwise=True) -> Iterator[np.ndarray | None]:
        """The ids of each text. One that has to go to the library whole does so, or gives None with otherwise=None."""
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        begins = np.concatenate(([0], ends[:-1]))
        kinds = self._classify(chars)
        starts = self._pieces(chars, kinds, begins[begins < len(chars)])
        stops = np.concatenate((starts[1:], [len(chars)])) if len(starts) else starts
        first, last = np.searchsorted(starts, begins), np.searchsorted(starts, ends)
        keys = slice_hashes(chars, starts, stops) if len(starts) else np.zeros(0, dtype=np.uint64)
        keys[keys == 0] = 1
        if self._entries > _CACHE_FULL or self._held > _CACHE_CHARS:
            self._trim()
        short = stops - starts <= _LONGEST
        entry = self._find(keys)
        self._again[entry[entry >= 0]] = True
        missing = np.flatnonzero((entry < 0) & short)
        if len(missing):
            new, at = np.unique(keys[missing], return_index=True)
            at = missing[at]
            self._add(new, [joined[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)])
            entry[missing] = self._find(keys[missing])
        sure = np.zeros(len(starts), dtype=bool)
        known = np.flatnonzero(entry >= 0)
        sure[known] = self._same(chars, starts[known], stops[known], entry[known])
        doubtful = np.concatenate(([0], np.cumsum(~sure)))
        unsure = np.concatenate(([0], np.cumsum(kinds == _UNSURE)))
        doubtful = (doubtful[last] > doubtful[first]) | (unsure[ends] > unsure[begins])
        counts = np.where(sure, self._count[entry], 0)
        total = np.concatenate(([0], np.cumsum(counts)))
        flat = self._ids[np.repeat(self._begin[entry] - total[:-1], counts) + np.arange(total[-1])]
        first, last = total[first], total[last]
        for i, text in enumerate(texts):
            if doubtful[i] or otherwise and any(t in text for t in self._added):
                yield self._whole(text) if otherwise else None
            else:
                yield flat[first[i] : last[i]]


_ENCODERS: dict[str, WordCacheEncoder] = {}


def encoder(path: str) -> WordCacheEncoder:
    """This process's encoder for a tokenizer file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads would wait for each other
    if path not in _ENCODERS:
        _ENCODERS[path] = WordCacheEncoder(path)
    return _ENCODERS[path]
