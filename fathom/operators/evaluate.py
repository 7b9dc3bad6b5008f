"""Retrieval evaluation: first hits, Hit@k, MRR, segments, sweeps, the substring baseline."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.config import EngineConfig
from fathom.functions.text import tokenize
from fathom.providers import Embedder, embed_column
from fathom.storage import Workspace

from .dense import dense_search

#: Characters of the patterns that one automaton takes.
PATTERN_CHARS = 8 << 20


def distinct_sources(ranked: DataFrame, source_col: str = "source") -> DataFrame:
    """(query, source, rank): each source once at its best place, ranked anew."""
    best = ranked.groupBy("query", F.col(source_col).alias("source")).agg(F.min("rank").alias("best"))
    return best.select("query", "source", F.row_number().over(Window.partitionBy("query").orderBy("best", "source")).alias("rank"))


def first_hits(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """gold (query, expected, ...) with rank: the first place of an expected source in ranked (query, source, rank)."""
    hits = gold.select("query", F.explode("expected").alias("source")).join(ranked, ["query", "source"]).groupBy("query").agg(F.min("rank").alias("rank"))
    return gold.join(hits, "query", "left")


def first_hits_by_setting(gold: DataFrame, ranked: DataFrame, settings: list[str]) -> DataFrame:
    """first_hits for each setting, as `method`, of ranked (setting, query, source, rank): one job for all of them. A
    setting that found nothing has its rows, too."""
    names = F.broadcast(gold.sparkSession.createDataFrame([(s,) for s in settings], "method string"))
    both = gold.join(names).withColumn("query", F.struct("method", "query"))  # a stated set of questions, a few settings
    found = distinct_sources(ranked.withColumn("query", F.struct(F.col("setting").alias("method"), "query")))
    return first_hits(both, found).withColumn("query", F.col("query.query"))


def metrics(results: DataFrame, *by: str, k: int = 5) -> DataFrame:
    """(by..., n, hit_at_k, mrr) of results with a nullable rank; a missing rank counts 0."""
    hit = F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))
    none = F.lit(0.0)
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(hit), none).alias("hit_at_k"), F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), none)), none).alias("mrr"))


def truncated_metrics(results: DataFrame, *by: str) -> DataFrame:
    """(by..., n, hit_at_5, hit_at_10, mrr_at_10): ranks after the tenth count as missing."""
    rank = F.when(F.col("rank") <= 10, F.col("rank"))
    none = F.lit(0.0)
    at = {f"hit_at_{k}": F.coalesce(F.avg(F.coalesce((rank <= k).cast("double"), none)), none) for k in (5, 10)}
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(c.alias(n) for n, c in at.items()), F.coalesce(F.avg(F.coalesce(1 / rank, none)), none).alias("mrr_at_10"))


def agent_metrics(runs: DataFrame, *by: str) -> DataFrame:
    """(by..., n, failures, hit_at_5, mrr, latency_mean, latency_max, tokens_mean, tokens_total) of runs (rank, failed,
    latency, tokens): latency and tokens over runs that did not fail, hits and ranks over all, a failed run being a miss."""
    ok = ~F.col("failed")
    rank = F.when(ok, F.col("rank"))
    none = F.lit(0.0)
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures"), F.coalesce(F.avg(F.coalesce((rank <= 5).cast("double"), none)), none).alias("hit_at_5"), F.coalesce(F.avg(F.coalesce(1 / rank, none)), none).alias("mrr"),
        F.avg(F.when(ok, F.col("latency"))).alias("latency_mean"), F.max(F.when(ok, F.col("latency"))).alias("latency_max"), F.avg(F.when(ok, F.col("tokens"))).alias("tokens_mean"), F.sum(F.when(ok, F.col("tokens"))).alias("tokens_total"),
    )


def last_result(lines: DataFrame, run_col: str = "run", place_col: str = "place", line_col: str = "line") -> DataFrame:
    """(run, result): of each run's JSON lines the last object whose type is "result"; what is no JSON is skipped."""
    kind = F.get_json_object(line_col, "$.type")
    return lines.where(kind == "result").groupBy(F.col(run_col).alias("run")).agg(F.max_by(line_col, place_col).alias("result"))


def escalated(sizes: list[int], measure: Callable[[int], float], most: float = 1.0) -> list[tuple[int, float]]:
    """(size, hit rate) of rising corpus sizes, up to the first at which the rate is under `most`: a rate that cannot
    rise tells nothing."""
    out = []
    for size in sizes:
        out.append((size, measure(size)))
        if out[-1][1] < most:
            break
    return out


def whole_files(files: DataFrame, queries: DataFrame, embedder: Embedder, k: int = 20) -> DataFrame:
    """(query, source, rank): dense search with one vector for each file (source, text); queries (query, text)."""
    vectors = embed_column(files.select("source", "text"), embedder)
    asked = embed_column(queries.select("query", "text"), embedder)
    return dense_search(vectors, asked, k, "source", query_id_col="query").select("query", F.col("unit").alias("source"), "rank")


def sweep_settings(config: EngineConfig, weights: tuple[float, ...] = (0.0, 0.3, 0.5, 0.7, 1.0)) -> list[tuple[str, EngineConfig]]:
    """Configurations of two sweeps, one weight at a time: the graph's without summaries, the summaries' without graph."""
    return [(f"graph {w}", replace(config, graph_weight=w, summary_weight=0.0)) for w in weights] + [(f"summary {w}", replace(config, graph_weight=0.0, summary_weight=w)) for w in weights]


def segments(results: DataFrame, k: int = 5) -> DataFrame:
    """metrics per method, over all questions and per segment: graph questions and the others."""
    segment = F.when(F.col("category") == "graph", "graph").otherwise("base")
    rows = results.withColumn("segment", F.explode(F.array(F.lit("all"), segment)))
    return metrics(rows, "method", "segment", k=k)


def rank_changes(flat: DataFrame, whole: DataFrame) -> DataFrame:
    """(query, flat_rank, whole_rank, change): change is null unless both found something."""
    both = flat.select("query", F.col("rank").alias("flat_rank")).join(whole.select("query", F.col("rank").alias("whole_rank")), "query", "full")
    return both.withColumn("change", F.col("whole_rank") - F.col("flat_rank"))


def regressed(flat: DataFrame, whole: DataFrame, k: int = 5) -> bool:
    """Whether fewer base questions hit with all signals than without the graph's."""
    one, two = (metrics(r.where("category <> 'graph'"), k=k).first()["hit_at_k"] or 0.0 for r in (flat, whole))
    return two < one


def containing(files: DataFrame, patterns: DataFrame, id_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, pattern): which of the patterns (pattern) each text contains anywhere, each once.

    The patterns are a stated set. They become an automaton, which reads each text once, so only matches are moved and
    the work does not grow with texts times patterns. Null texts and empty patterns match nothing.
    """
    base = files.select(F.col(id_col).alias("source"), F.col(text_col).alias("text"))
    schema = f"source {base.schema['source'].dataType.simpleString()}, pattern string"
    rows = patterns.where("pattern <> ''").select("pattern").distinct().toLocalIterator()
    found, work = None, None
    while block := _block(rows):
        part = _matched(base, block, schema)
        if found is not None:  # more patterns than one automaton takes: block by block
            work = work or Workspace(files.sparkSession, "containing")
            part = found.unionAll(work.table(part, "block"))
        found = part
    return files.sparkSession.createDataFrame([], schema) if found is None else found


def _block(rows: Iterator) -> list[str]:
    """The next patterns, of about PATTERN_CHARS characters."""
    out, total = [], 0
    while total < PATTERN_CHARS and (row := next(rows, None)) is not None:
        out.append(row["pattern"])
        total += len(row["pattern"])
    return out


def _matched(base: DataFrame, patterns: list[str], schema: str) -> DataFrame:
    automaton = ahocorasick.Automaton()
    for pattern in patterns:
        automaton.add_word(pattern, pattern)
    automaton.make_automaton()
    shared = base.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = {p for _, p in shared.value.iter(text)} if text else set()
                at += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column("source").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["source", "pattern"])

    return base.mapInArrow(run, schema)


def grep(files: DataFrame, queries: DataFrame, k: int | None = None, id_col: str = "source", text_col: str = "text") -> DataFrame:
    """(query, source, matched, rank): files by how many of a query's distinct words they contain anywhere."""
    words = queries.select("query", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("pattern"))
    found = containing(files.select(id_col, F.lower(text_col).alias("text")), words, id_col)
    scored = found.join(words, "pattern").groupBy("query", "source").agg(F.count(F.lit(1)).alias("matched"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("matched").desc(), "source")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def report(rows: DataFrame) -> str:
    """A fixed-width table of a small result."""
    names = rows.columns
    cells = [[f"{v:.3f}" if isinstance(v, float) else "-" if v is None else str(v) for v in r] for r in rows.collect()]
    widths = [max(len(n), *(len(c[i]) for c in cells)) if cells else len(n) for i, n in enumerate(names)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in [names, *cells])
