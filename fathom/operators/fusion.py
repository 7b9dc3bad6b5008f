"""Weighted reciprocal rank fusion over any number of signals.

A signal is a table (query, unit, signal, rank). Weights are a table too, so many settings are one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.storage import Workspace

from .bm25 import top_k


def signals(**ranked: DataFrame) -> DataFrame:
    """One table from ranked lists by name, dealt by what fusion groups by."""
    parts = [df.select("query", "unit", F.lit(name).alias("signal"), "rank") for name, df in ranked.items()]
    return reduce(DataFrame.unionByName, parts).repartition("query", "unit")


def fuse(ranks: DataFrame, weights: dict[str, float], k: int, rrf_k: int = 60, summaries: DataFrame | None = None, summary_weight: float = 0.3) -> DataFrame:
    """(query, unit, score, rank, <signal>_rank...): the k best of each query; ties by unit.

    A unit in `summaries` (unit) has summary_weight in place of the dense weight; with a summary_weight of 0 summaries
    are left out. A signal of weight 0 keeps its units, with nothing added.
    """
    weight = reduce(lambda c, kv: c.when(F.col("signal") == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    if summaries is not None:
        marked = summaries.select("unit").distinct().withColumn("_summary", F.lit(True))
        ranks = ranks.join(marked, "unit", "left")
        if summary_weight == 0:
            ranks = ranks.where("_summary is null")
        weight = F.when(F.col("_summary") & (F.col("signal") == "dense"), summary_weight).otherwise(weight)
    terms = [F.sum(weight / (rrf_k + F.col("rank"))).alias("score")]
    terms += [F.max(F.when(F.col("signal") == s, F.col("rank"))).alias(f"{s}_rank") for s in weights]
    return top_k(ranks.groupBy("query", "unit").agg(*terms), k)


def setting(name: str, weights: dict[str, float], summary_weight: float) -> list[tuple[str, str, float]]:
    """Rows (setting, signal, weight) for `sweep` over `marked` ranks that stand for `fuse` with these weights."""
    rows = [(name, s, w) for s, w in weights.items()]
    return rows + [(name, f"summary/{s}", summary_weight if s == "dense" else w) for s, w in weights.items() if summary_weight != 0]


def marked(ranks: DataFrame, summaries: DataFrame) -> DataFrame:
    """ranks with the signals of summaries (unit) under names of their own."""
    known = summaries.select("unit").distinct().withColumn("_summary", F.lit(True))
    return ranks.join(known, "unit", "left").withColumn("signal", F.when(F.col("_summary"), F.concat(F.lit("summary/"), "signal")).otherwise(F.col("signal"))).drop("_summary")


def sweep(ranks: DataFrame, settings: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """(setting, query, unit, score, rank) for every row (setting, signal, weight) of a small settings table."""
    scored = ranks.join(F.broadcast(settings), "signal").groupBy("setting", "query", "unit").agg(F.sum(F.col("weight") / (rrf_k + F.col("rank"))).alias("score"))
    scored = scored.withColumn("run", F.struct("setting", "query"))
    return top_k(scored, k, "run").drop("run")


def hydrate(ranked: DataFrame, units: DataFrame, *columns: str) -> DataFrame:
    """Adds columns of units (unit, ...) to the few rows that were found; of the units only those found move."""
    ranked = Workspace(ranked.sparkSession, "hydrate").table(ranked, "ranked")
    found = units.select("unit", *columns).join(F.broadcast(ranked.select("unit").distinct()), "unit", "left_semi")
    return ranked.join(found, "unit", "left")
