"""Hard negatives against all pairs, and what the bounds leave out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import hard_negatives as hn
from fathom.llm.queries import ORACLES, QUERIES
from tests.oracles import same_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<double>, id string, q int, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0, "x") for r in rows], SCHEMA)


def brute(rows, positives=5, negatives=10, low=30, high=90):
    kept = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {}
    for r in kept:
        if r[0] % 10 == 0:
            anchors[r[0]] = min(anchors.get(r[0], r), r, key=lambda x: (x[1], x[2]))
    out = []
    for a in anchors.values():
        near = lambda same: sorted((-dot(a[2], r[2]), r[0]) for r in kept if r[0] != a[0] and (r[1] == a[1]) is same)
        others = near(False)
        for p, positive in near(True)[:positives]:
            fit = [(s, i) for s, i in others if low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(a[0], positive, n + 1, i, -p, -s) for n, (s, i) in enumerate(fit)]
    return sorted(out)


def mined(df, **sizes):
    found = hn.hard_negatives(df, F.col("id") % 10 == 0, **sizes)
    return sorted(tuple(r) for r in found.select("anchor", "positive", "rank", "negative", "positive_score", "negative_score").collect())


def test_query_equals_sql(spark):
    same_rows(spark, QUERIES["op11_hard_negatives"], ORACLES["op11_hard_negatives"], SF)


def clustered(n, dim=6, seed=1, spread=0.05, clusters=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    at = r.integers(0, clusters, n)
    return [(i, int(at[i] % 3 if r.random() < 0.8 else r.integers(0, 3)), (centres[at[i]] + spread * r.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"max_pivots": 5, "chunk_rows": 40, "group_anchors": 3}])
def test_all_pairs_and_edges(spark, sizes):
    rows = clustered(230)
    rows += [(1000 + i, 1, rows[0][2]) for i in range(60)]  # a third of copies of one vector: ties
    rows += [(300, None, [1.0] * 6), (310, 1, None), (320, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (330, 1, [math.nan] * 6), (340, 1, [math.inf] * 6), (None, 1, [1.0] * 6), (350, 2, [0.0] * 6), (360, 2, []), (370, 0, [0.5, 0.5])]
    rows += [rows[0], rows[10], (20, 2, [0.1] * 6)]  # repeated rows, and an anchor that comes with two vectors
    assert mined(frame(spark, rows), **sizes) == brute([(i, y, v if v is None else v + [0.0] * (6 - len(v))) for i, y, v in rows]) != []


def test_few_rows_and_none(spark):
    assert mined(frame(spark, [])) == [] and mined(frame(spark, [(0, 1, [1.0])])) == []
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5]), (3, 2, [0.95])]
    assert mined(frame(spark, rows)) == brute(rows) == [(0, 1, 1, 2, 65536, 32768)]
    with pytest.raises(ValueError):
        mined(frame(spark, [(0, 1, [1e6]), (1, 1, [1.0])]))


def test_cells_that_cannot_serve_are_left_out(spark):
    rows = clustered(3000, spread=0.02, clusters=12)
    join = hn.VoronoiJoin(frame(spark, rows), max_pivots=40, group_anchors=1)
    anchors = join.anchors(F.col("id") % 100 == 0)
    found = join.nearest_of_label(anchors, 5)
    served = spark.read.parquet(f"{join.work.root}/served-*")
    met = served.join(join._grouped(anchors, "label").groupBy("grp").count(), "grp").agg(F.sum(F.col("rows") * F.col("count"))).first()[0]
    all_pairs = join.rows.groupBy("label").count().join(anchors.groupBy("label").agg(F.count(F.lit(1)).alias("a")), "label").agg(F.sum(F.col("count") * F.col("a"))).first()[0]
    assert found.count() == 5 * anchors.count() and met < 0.5 * all_pairs


def test_bounds_hold_for_all_members():
    r = np.random.default_rng(3)
    x, a = r.integers(-200, 200, (500, 5)).astype(float), r.integers(-200, 200, (40, 5)).astype(float)
    pivots = hn.Pivots.of(x[:12], float((x * x).sum(axis=1).max()))
    cell, dist = pivots.assign(x)
    cells = np.unique(cell)
    lo, hi = (np.array([f(dist[cell == c]) for c in cells]) for f in (np.min, np.max))
    bounds, scores = hn.Bounds(pivots, a, cells, lo, hi), a @ x.T
    for j, c in enumerate(cells):
        own = scores[:, cell == c]
        assert (own.max(axis=1) <= bounds.largest[:, j]).all() and (own.min(axis=1) >= bounds.least[:, j]).all()
