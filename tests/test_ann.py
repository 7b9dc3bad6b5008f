"""The approximate index against the exact search."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fathom.operators import ann, dense


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "unit_id int, embedding array<double>")


def clusters(n, seed, dim=10):
    r = np.random.default_rng(seed)
    return np.random.default_rng(0).normal(size=(20, dim))[r.integers(0, 20, n)] + 0.3 * r.normal(size=(n, dim))


def pairs(df):
    return {(r["query"], r["unit"]): (round(r["score"], 9), r["rank"]) for r in df.collect()}


def test_recall_scores_and_additions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    index, x, more = ann.AnnIndex(spark, f"file://{tmp_path}/ann"), clusters(1500, 1), clusters(300, 2)
    assert not index.exists()
    first = frame(spark, x).unionByName(spark.createDataFrame([(5000, None)], "unit_id int, embedding array<double>"))
    fitted = index.build(first)
    assert fitted.probes < len(fitted.centres) and index.exists()
    both = first.unionByName(frame(spark, more, 2000))
    index.add(frame(spark, more, 2000))
    asked = both.where("unit_id % 50 = 0").withColumnRenamed("unit_id", "query_id")
    got, want = index.search(asked, both, 10, exclude_self=True), dense.dense_search(both, asked, 10, exclude_self=True)
    assert ann.recall(got, want).first()["recall"] >= 0.9
    exact = pairs(want)
    assert all(q != u and abs(s - exact[q, u][0]) < 1e-9 for (q, u), (s, _) in pairs(got).items() if (q, u) in exact)
    assert pairs(index.search(asked, both, 10, exclude_self=True, probes=len(fitted.centres))).keys() >= set(list(exact)[:5]) & exact.keys()


def test_gone_units_repeats_and_nothing(spark, tmp_path):
    index, x = ann.AnnIndex(spark, f"file://{tmp_path}/ann"), clusters(60, 3)
    rows = frame(spark, x)
    index.build(rows)
    index.add(rows)  # codes that repeat give no unit twice
    asked = rows.limit(3).withColumnRenamed("unit_id", "query_id")
    left = rows.where("unit_id % 2 = 0")
    found = index.search(asked, left, 5)
    assert pairs(found) == pairs(dense.dense_search(left, asked, 5)) and found.groupBy("query", "unit").count().where("count > 1").count() == 0
    assert index.search(asked.limit(0), rows, 5).count() == 0
    empty = ann.AnnIndex(spark, f"file://{tmp_path}/none")
    empty.build(rows.limit(0))
    assert empty.search(asked.withColumn("embedding", F.array(F.lit(1.0))), rows.limit(0), 5).count() == 0


def test_only_probed_cells_are_read(spark, tmp_path):
    index, rows = ann.AnnIndex(spark, f"file://{tmp_path}/ann"), frame(spark, clusters(400, 4))
    fitted = index.build(rows)
    block = [{"query": 0, "q": clusters(1, 5)[0].tolist()}]
    asked = spark.createDataFrame([(0,)], "query int")
    plan = index._candidates(block, fitted, asked, 20, 2, False, "int")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan


def test_exact_search_holds_a_bounded_number_of_scores(monkeypatch):
    monkeypatch.setattr(dense, "top_k", lambda df, k: df)
    r = np.random.default_rng(6)
    x, q = r.normal(size=(10_000, 4)), r.normal(size=(3000, 4))
    base = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v))), mapInArrow=lambda f, schema: f)
    run = dense._searched(base, [{"q": i, "v": v} for i, v in enumerate(q)], 5, [pa.int64()], "", True)
    batch = pa.RecordBatch.from_pydict({"unit": list(range(10_000)), "v": x.tolist()})
    tracemalloc.start()
    found = {}
    for part in run(iter([batch])):
        for query, unit, score in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
            if query in (0, 1500, 2999):
                found.setdefault(query, []).append((-score, unit))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # all scores at once are 240 MB
    scores = dense._unit(q) @ dense._unit(x).T
    for query in found:
        scores[query, query] = -np.inf
        assert [u for _, u in sorted(found[query])[:5]] == np.argsort(-scores[query])[:5].tolist()
    assert len(found) == 3
