"""Language identification of texts that may mix languages.

Each word gets a score per language: the log likelihood of its letter trigrams (the word's edges count as letters),
under hashed trigram counts learned from labelled text. Script ranges narrow the candidates first: a language whose
training text hardly uses the word's script is out. A Viterbi pass over the words with a penalty for switching labels
spans; the language with most letters in its spans is the document's.

The pass is exact but not word by word: where one language leads by twice the penalty or more, every best path goes
through it, so such words are fixed and only the stretches between them are solved, many side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chars as ch
from .batches import kept_rows, pieces, slices
from .hashing import chunks_of

BUCKETS = 1 << 14
CHUNK_CHARS = 1 << 17
#: Labelled rows that a model is fitted on, at most about as many (a hash of the id chooses them).
TRAIN_ROWS = 20_000
SWITCH, UNDETERMINED = 8.0, "und"
#: A language may use a script that at least this share of its training words has.
SCRIPT_SHARE = 0.005


@dataclass(frozen=True)
class Words:
    """The words of a chunk of texts: starts and ends in chars, first word of each text, trigram bucket of each char."""

    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    buckets: np.ndarray
    scripts: np.ndarray


def words_in(texts: list[str]) -> Words:
    codes, begins = ch.joined([t.lower() for t in texts])
    kinds = ch.letters(codes)
    inside = kinds > 0
    starts, ends = ch.runs(inside)
    plain = np.where(inside, codes, 0).astype(np.uint32)
    mixed = plain * np.uint32(0x85EBCA6B)
    mixed[1:] += plain[:-1] * np.uint32(0x9E3779B1)
    mixed[:-1] += plain[1:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    buckets = (mixed >> np.uint32(18)).astype(np.int32)
    has_letter = np.add.reduceat((kinds == ch.LETTER).astype(np.int64), starts) > 0 if len(starts) else np.zeros(0, dtype=bool)
    starts, ends = starts[has_letter], ends[has_letter]
    return Words(starts, ends, np.searchsorted(starts, begins), buckets, ch.scripts(codes[starts]))


class LanguageModel:
    def __init__(self, languages: list[str], counts: np.ndarray, script_words: np.ndarray, switch: float = SWITCH):
        """counts: languages x BUCKETS; script_words: languages x scripts."""
        self.languages, self.switch = languages, switch
        self.scores = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
        share = script_words / np.maximum(script_words.sum(axis=1, keepdims=True), 1)
        self.allowed = share >= SCRIPT_SHARE

    def word_scores(self, words: Words) -> np.ndarray:
        out = np.zeros((len(words.starts), len(self.languages)), dtype=np.float32)
        if not len(words.starts):
            return out
        cuts = np.stack((words.starts, words.ends), axis=1).ravel()
        padded = np.append(words.buckets, np.int32(0))
        for i, table in enumerate(self.scores):
            out[:, i] = np.add.reduceat(table[padded], cuts)[::2]
        out -= out.max(axis=1, keepdims=True)
        fits = self.allowed[:, words.scripts].T
        out[~fits] = -1e4
        out[~fits.any(axis=1)] = 0  # a script that nobody knows says nothing
        return out - out.max(axis=1, keepdims=True)

    def labels(self, scores: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Best language of each word on the best path of its text."""
        n, width = scores.shape
        best = scores.argmax(axis=1).astype(np.int32)
        if width == 1 or not n:
            return best
        second = np.partition(scores, width - 2, axis=1)[:, width - 2]
        fixed = scores.max(axis=1) - second >= 2 * self.switch
        opens = np.zeros(n + 1, dtype=bool)
        opens[firsts] = True
        free = ~fixed
        begins = np.flatnonzero(free & (opens[:n] | np.concatenate(([True], fixed[:-1]))))
        ends = np.flatnonzero(free & (opens[1:] | np.concatenate((fixed[1:], [True])))) + 1
        left = np.where(opens[begins], -1, best[begins - 1])
        right = np.where(opens[ends], -1, best[np.minimum(ends, n - 1)])
        order = np.argsort(begins - ends, kind="stable")
        begins, left, right, sizes = begins[order], left[order], right[order], (ends - begins)[order]
        value = np.where(left[:, None] < 0, 0.0, np.where(np.arange(width) == left[:, None], 0.0, -self.switch)).astype(np.float64)
        back: list[np.ndarray] = []
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
        for t, m in enumerate(active):
            if t:
                top = value[:m].argmax(axis=1)
                jump = value[:m][np.arange(m), top][:, None] - self.switch
                back.append(np.where(jump > value[:m], top[:, None], np.arange(width)).astype(np.int16))
                value[:m] = np.maximum(value[:m], jump)
            value[:m] += scores[begins[:m] + t]
        last = np.where((right[:, None] < 0) | (np.arange(width) == right[:, None]), value, value - self.switch).argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            best[begins[:m] + t] = last[:m]
            if t:
                last[:m] = back[t - 1][np.arange(m), last[:m]]
        return best

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first word, end word, language) of the spans of a text."""
        words = words_in([text])
        label = self.labels(self.word_scores(words), words.firsts)
        cuts = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist(), len(label)] if len(label) else [0]
        return [(a, b, self.languages[label[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and sizes of the words of a chunk of texts, and each text's first word, plus the end. A text longer
        than a chunk is read in pieces, cut at white space; its words are labelled together all the same."""
        if len(texts) == 1 and len(texts[0]) > 2 * CHUNK_CHARS:
            parts = [(self.word_scores(w), w.ends - w.starts) for w in (words_in([p]) for p in pieces(texts[0], CHUNK_CHARS))]
            sizes = np.concatenate([p[1] for p in parts])
            return np.concatenate([p[0] for p in parts]), sizes, np.array([0, len(sizes)])
        words = words_in(texts)
        return self.word_scores(words), words.ends - words.starts, words.firsts

    def predict(self, texts: list[str]) -> Iterator[tuple[str, float, int]]:
        """(language, share of the letters in its spans, number of spans) of each text."""
        for begin, end in chunks_of([len(t) for t in texts], CHUNK_CHARS):
            scores, sizes, firsts = self._read(texts[begin:end])
            label, k = self.labels(scores, firsts), len(self.languages)
            owner = np.repeat(np.arange(end - begin), np.diff(firsts))
            weight = np.bincount(owner * k + label, weights=sizes, minlength=(end - begin) * k).reshape(-1, k)
            changes = np.bincount(owner[1:], weights=(label[1:] != label[:-1]) & (owner[1:] == owner[:-1]), minlength=end - begin)
            for i in range(end - begin):
                total = weight[i].sum()
                if total:
                    top = int(weight[i].argmax())
                    yield self.languages[top], float(weight[i, top] / total), int(changes[i]) + 1
                else:
                    yield UNDETERMINED, 0.0, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n): trigrams by bucket (kind 0) and words by script (kind 1)."""
    counts: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text"):
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).extend(pieces(text, CHUNK_CHARS))
        for lang, texts in by_lang.items():
            own = counts.setdefault(lang, np.zeros(BUCKETS + len(ch.SCRIPTS), dtype=np.int64))
            for begin, end in chunks_of([len(t) for t in texts], CHUNK_CHARS):
                words = words_in(texts[begin:end])
                inside = np.repeat(words.starts, words.ends - words.starts) if len(words.starts) else np.zeros(0, dtype=np.int64)
                sizes = words.ends - words.starts
                at = inside + np.arange(len(inside)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                own[:BUCKETS] += np.bincount(words.buckets[at], minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(words.scripts, minlength=len(ch.SCRIPTS))
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "key", "n"])


def fit(docs: DataFrame, train: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on about max_rows rows (all, if there are fewer) of those that `train` selects and that have text and
    language. Counts are summed in the cluster; the driver gets languages x BUCKETS of them. No rows: a model without
    languages, which calls everything undetermined."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.lit(True) if train is None else train))
    share = min(1.0, max_rows / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sums = rows.mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    table = np.zeros((len(languages), BUCKETS + len(ch.SCRIPTS)))
    table[[languages.index(x) for x in sums["lang"]], sums["key"]] = sums["n"]
    return LanguageModel(languages, table[:, :BUCKETS], table[:, BUCKETS:])


def determined(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, whole and unchanged, whose language the model tells. Null texts and texts without a letter go.
    A model without languages (nothing was labelled) cannot tell any, and then only those go, too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def wanted():
        model = shared.value
        if model.languages:
            return lambda texts: [lang != UNDETERMINED for lang, _, _ in model.predict([t or "" for t in texts])]
        return lambda texts: [any(len(words_in([p]).starts) for p in pieces(t or "", CHUNK_CHARS)) for t in texts]

    return kept_rows(docs, text_col, wanted)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_spans) for every row. Null texts and texts without a letter: und, 0, 0. score is the
    share of the letters that lie in spans of the predicted language. Ties: the first language in sorted order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = list(shared.value.predict(texts)) if shared.value.languages else [(UNDETERMINED, 0.0, 0)] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64()), pa.array([r[2] for r in out], pa.int32())], [id_col, "lang_pred", "score", "n_spans"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"`{id_col}` {base.schema['id'].dataType.simpleString()}, lang_pred string, score double, n_spans int")
