"""Toxicity scores from averaged subword embeddings and a linear softmax, trained jointly in numpy.

A text's features are its distinct words and their character n-grams (word edges included), hashed into buckets. Every
bucket has an embedding; a text's vector is the average over its features and PADDING zero vectors (which keep a text of
few words from an extreme score); a linear softmax over two classes scores it. Repeats count by their logarithm, so that
a text that repeats itself is not judged by one word.
Misspelt words that were never seen share n-grams with those that were. Only text goes into a score.

Applying a trained model needs one number per bucket: the difference of the two class scores of its embedding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chars as ch
from .batches import pieces, slices
from .hashing import chunks_of, slice_hashes

BUCKET_BITS, DIM, GRAMS = 17, 4, (4, 5)
CHUNK_CHARS = 1 << 17
#: Labelled rows of each class that a model is fitted on, at most (those with the smallest hashes of their ids).
TRAIN_ROWS = 1500
EPOCHS, GAIN, MIN_TEXTS = 100, 100.0, 5
#: Zero vectors that each average has besides.
PADDING = 100
#: Steps for the embeddings, the softmax weights and its bias.
RATES = (6.0, 0.03, 0.3)


def _found(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each feature in lower-cased texts, as often as it occurs, and the text that it is in."""
    codes, begins = ch.joined(texts)
    inside = (ch.letters(codes) > 0) | ((codes >= 48) & (codes <= 57))
    starts, ends = ch.runs(inside)
    with np.errstate(over="ignore"):
        found, where = [(slice_hashes(codes, starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)], [starts]
        plain = np.where(inside, codes, 0).astype(np.uint32)
        mixed = plain * np.uint32(0x9E3779B1)
        valid = np.ones(len(plain), dtype=bool)
        for n in range(2, max(GRAMS) + 1):
            # The gram at p covers p .. p + n - 1; only its ends may lie outside a word.
            mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + plain[n - 1 :] * np.uint32(0xC2B2AE35)
            valid = valid[:-1] & (inside[n - 2 : len(inside) - 1] if n > 2 else True)
            if n in GRAMS:
                at = np.flatnonzero(valid)
                code = mixed[at] + np.uint32(n)
                code = (code ^ (code >> np.uint32(13))) * np.uint32(0x2C1B3C6D)
                found.append((code >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
                where.append(at + 1)
    return np.concatenate(found), np.searchsorted(begins, np.concatenate(where), side="right") - 1


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct features of each text of a chunk, the text that each belongs to (in order), and its
    weight there: 1 + ln of how often it occurs. A text longer than a chunk is read in pieces, cut at white space."""
    if len(texts) == 1 and len(texts[0]) > 2 * CHUNK_CHARS:
        often = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for piece in pieces(texts[0].lower(), CHUNK_CHARS):
            often += np.bincount(_found([piece])[0], minlength=1 << BUCKET_BITS)
        buckets = np.flatnonzero(often)
        return buckets.astype(np.int32), np.zeros(len(buckets), dtype=np.int64), 1 + np.log(often[buckets])
    buckets, owner = _found([t.lower() for t in texts])
    keys = np.sort(owner << BUCKET_BITS | buckets)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    weights = 1 + np.log(np.diff(np.append(first, len(keys))))
    keys = keys[first]
    return (keys & ((1 << BUCKET_BITS) - 1)).astype(np.int32), keys >> BUCKET_BITS, weights


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # one number per bucket
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text; a text without features gets the bias alone."""
        out = np.zeros(len(texts))
        for begin, end in chunks_of([len(t) for t in texts], CHUNK_CHARS):
            buckets, owner, often = features(texts[begin:end])
            sums = np.bincount(owner, weights=self.weights[buckets] * often, minlength=end - begin)
            out[begin:end] = sums / (np.bincount(owner, weights=often, minlength=end - begin) + PADDING)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -500, 500)))


def train(buckets: np.ndarray, shares: np.ndarray, sizes: np.ndarray, labels: np.ndarray, seed: int = 7) -> ToxicityModel:
    """Embeddings and softmax together, by gradient descent with momentum on the cross entropy of all rows; classes
    weigh alike. buckets and shares: those of all texts, one text after the other; sizes: how many each has. Steps are not scaled per parameter: what many
    texts of a class share must move faster than what one text alone has, or rare features would be learned by heart.
    Buckets of fewer than MIN_TEXTS texts are left out and weigh nothing."""
    if not len(labels) or labels.min() == labels.max():
        base = float(labels[0]) if len(labels) else 0.0
        return ToxicityModel(np.zeros(1 << BUCKET_BITS), 4.0 * base - 2.0)
    n = len(labels)
    often = np.bincount(buckets, minlength=1 << BUCKET_BITS) >= min(MIN_TEXTS, n)
    keep = often[buckets]
    used = np.flatnonzero(often)
    index = (np.cumsum(often) - 1)[buckets[keep]]
    share = shares[keep] * np.float32(GAIN)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)[keep]
    cuts = np.searchsorted(owner, np.arange(n + 1))
    full = np.flatnonzero(np.diff(cuts))
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / DIM, 1 / DIM, (DIM, len(used))).astype(np.float32)
    linear, bias = random.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    target = np.eye(2)[labels]
    weight = (1 / np.bincount(labels, minlength=2) / 2)[labels][:, None]
    params = [table, linear, bias]
    pace = [np.zeros_like(p) for p in params]
    for _ in range(EPOCHS):
        mean = np.zeros((n, DIM))
        for d in range(DIM):
            if len(full):
                mean[full, d] = np.add.reduceat(table[d][index] * share, cuts[full])
        logits = mean @ linear + bias
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        delta = (prob - target) * weight
        back = (delta @ linear.T).astype(np.float32)
        grad = np.stack([np.bincount(index, weights=back[owner, d] * share, minlength=len(used)) for d in range(DIM)]).astype(np.float32)
        for p, v, g, rate in zip(params, pace, (grad, mean.T @ delta, delta.sum(axis=0)), RATES, strict=True):
            v *= 0.9
            v += g
            p -= rate * v
    weights = np.zeros(1 << BUCKET_BITS)
    weights[used] = GAIN * (table.T @ (linear[:, 1] - linear[:, 0]))
    return ToxicityModel(weights, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, train_rows: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on at most max_rows labelled texts of each class, of those whose id `train_rows` selects. Rows without
    label or id are no training rows. No usable rows or one class only: a model that gives every text that class."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    if train_rows is not None:
        known = known.where(train_rows)
    known = known.dropDuplicates(["id"])
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(max_rows)
        chosen = part if chosen is None else chosen.unionAll(part)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = base.join(F.broadcast(chosen), "id")  # at most 2 * max_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, found, shares, sizes = [t or "" for t in batch.column("text").to_pylist()], [], [], []
            for text in texts:
                buckets, _, often = features([text])
                sizes.append(len(buckets))
                found.append(buckets.tobytes())
                shares.append((often / (often.sum() + PADDING)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(shares, pa.binary())], ["id", "label", "sizes", "buckets", "shares"])

    got = rows.select("id", "label", "text").mapInArrow(run, "id long, label int, sizes long, buckets binary, shares binary").toPandas().sort_values("id", kind="stable")
    buckets = np.frombuffer(b"".join(got.pop("buckets")), dtype=np.int32)
    shares = np.frombuffer(b"".join(got.pop("shares")), dtype=np.float32)
    return train(buckets, shares, got["sizes"].to_numpy(), got["label"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = shared.value.score([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], [id_col, "score"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"`{id_col}` {base.schema['id'].dataType.simpleString()}, score double")
