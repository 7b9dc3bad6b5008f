"""Model providers. Each is a plain callable, so any model can be put in; the defaults are deterministic and local.

Tokenizer: Column -> Column. Embedder: list of texts -> matrix. Generator: prompt -> text. The defaults make every path
runnable and testable; their retrieval and answer quality says nothing about real models. `local_embedder` and
`local_generator` call a model server on this machine over HTTP.
"""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
Generator = Callable[[str], str]
NO_EVIDENCE, IRRELEVANT = "NO_EVIDENCE", "IRRELEVANT"
#: The least similarity of evidence, by embedder: how near a question is to a text that answers it differs much.
HASHING_THRESHOLD = 0.2


def hashing_embedder(dim: int = 256) -> Embedder:
    """Signed feature hashing of lower-cased words, scaled to length one."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    embed.threshold = HASHING_THRESHOLD
    return embed


def extractive_generator(sentences: int = 2) -> Generator:
    """Answers with the context sentences that share most words with the question; with the no-evidence or irrelevant
    marker, if the prompt names one, when none shares a word. Grades with yes or no; lists entities as JSON."""

    def generate(prompt: str) -> str:
        task, _, rest = prompt.partition("\n")
        question, _, context = rest.partition("\n\n")
        asked = set(re.findall(r"\w{3,}", question.lower()))
        if task == "ENTITIES":
            names = sorted(set(re.findall(r"\b[A-Z][a-z]{2,}\b", context)))[:8]
            return json.dumps({"entities": names, "relations": [[a, "near", b] for a, b in zip(names[:-1], names[1:], strict=True)]})
        if task == "REWRITE":
            return " ".join(sorted(asked))
        scored = [(len(asked & set(re.findall(r"\w{3,}", s.lower()))), -i, s) for i, s in enumerate(re.split(r"(?<=[.!?])\s+|\n+", context))]
        best = sorted((x for x in scored if x[0]), reverse=True)[:sentences]
        if task == "GRADE":
            return "yes" if best else "no"
        if task == "SUMMARY":
            return context[:400]
        return " ".join(s for _, _, s in sorted(best, key=lambda x: -x[1])) if best else IRRELEVANT if task == "MAP" else NO_EVIDENCE

    return generate


def _posted(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def local_embedder(base_url: str, model: str, timeout: float = 120.0, threshold: float = 0.48) -> Embedder:
    """Vectors from a model server's /api/embed."""

    def embed(texts: list[str]) -> np.ndarray:
        return np.asarray(_posted(f"{base_url.rstrip('/')}/api/embed", {"model": model, "input": texts}, timeout)["embeddings"], dtype=np.float32) if texts else np.zeros((0, 0), dtype=np.float32)

    embed.threshold = threshold
    return embed


#: What a model is told before a prompt, by the prompt's first line.
INSTRUCTIONS = {
    "ANSWER": f"Answer the question from the context alone and name its sources in brackets. If the context holds no answer, say {NO_EVIDENCE}.",
    "MAP": f"Tell what the summary says about the question. If it says nothing, say {IRRELEVANT}.",
    "REDUCE": "Combine the partial answers into one answer to the question.",
    "GRADE": "Say yes if the context can answer the question, else no.",
    "REWRITE": "Rewrite the question as a better search query. Give the query alone.",
    "SUMMARY": "Summarise what these notes have in common in three sentences.",
    "ENTITIES": 'List the text\'s main entities and how they relate, as JSON: {"entities": [name, ...], "relations": [[name, label, name], ...]}.',
}


def local_generator(base_url: str, model: str, timeout: float = 300.0) -> Generator:
    """Answers from a model server's /api/generate, at temperature 0; entities are asked for in JSON mode."""

    def generate(prompt: str) -> str:
        task, _, rest = prompt.partition("\n")
        body = {"model": model, "system": INSTRUCTIONS.get(task, ""), "prompt": rest, "stream": False, "options": {"temperature": 0}}
        return _posted(f"{base_url.rstrip('/')}/api/generate", body | ({"format": "json"} if task == "ENTITIES" else {}), timeout)["response"]

    return generate


def word_tokenizer(split: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A tokenizer from a function on one text, such as a morphological analyser's. Blank words are left out; a text that
    the function fails on is split at white space and lower-cased."""

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str] | None:
            if text is None:
                return None
            try:
                return [w for w in split(text) if w.strip()]
            except Exception:  # an analyser's failure must not end the batch
                return text.lower().split()

        return texts.map(one)

    return lambda c: words(c)


def letter_run_tokenizer() -> Callable[[Column], Column]:
    """Runs of letters, marks and digits, lower-cased: no punctuation sticks to a word. Stays in the JVM."""
    return lambda c: F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{M}\\p{N}]+"), F.lit(0))


@cache
def tokenizers() -> dict[str, Callable[[Column], Column]]:
    """Tokenizers by name, for the configuration."""
    from fathom.functions.text import tokenize

    return {"whitespace": tokenize, "letters": letter_run_tokenizer()}


def embed_column(units: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """units with a vector column; batches go through the embedder whole."""
    columns = units.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = np.asarray(embedder([t or "" for t in batch.column(text_col).to_pylist()]), dtype=np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(matrix), pa.list_(pa.float32()))], [*columns, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema)
    return units.mapInArrow(run, f"{fields}, {out} array<float>")


def generate_column(prompts: DataFrame, generator: Generator, prompt_col: str = "prompt") -> DataFrame:
    """prompts with `answer` and `error`: a call that fails leaves its message in error and no answer. Null prompts
    reach no generator."""
    columns = prompts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for prompt in batch.column(prompt_col).to_pylist():
                try:
                    answer, error = None if prompt is None else generator(prompt), None
                except Exception as e:  # one row's failure must not end the batch
                    answer, error = None, f"{type(e).__name__}: {e}"
                answers.append(answer)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], [*columns, "answer", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInArrow(run, f"{fields}, answer string, error string")


def cached(work: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, answer): from the cache (key, answer), and computed for the distinct keys of work that it lacks. Failed
    computations are left out, so they are tried again next time. Keys that work does not have are left out, too."""
    missing = work.join(cache, key, "left_anti").dropDuplicates([key])
    return cache.join(work.select(key).distinct(), key, "left_semi").select(key, "answer").unionByName(compute(missing).where(F.col("error").isNull()).select(key, "answer"))
