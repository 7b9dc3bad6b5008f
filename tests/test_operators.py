import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.cli import _parser
from fathom.config import EngineConfig
from fathom.operators import answer, bm25, chunking, community, dense, evaluate, fusion, graph, store
from fathom.operators.components import connected_components
from fathom.providers import cached, extractive_generator, generate_column, hashing_embedder, word_tokenizer
from fathom.sources import vault
from fathom.storage import Workspace


def test_config_rejects_remote_endpoints(monkeypatch):
    monkeypatch.setenv("OLLAMA_BASE_URL", "http://example.org:1")
    with pytest.raises(ValueError):
        EngineConfig()
    assert EngineConfig.candidate_k(5) == 20 and EngineConfig.candidate_k(20) == 60 and EngineConfig.clamp_k(99) == 50


def test_agentic_rounds_are_held_to_five():
    parse = lambda *more: _parser().parse_args(["agentic", "q", *more]).max_iter
    assert parse() == 2 and parse("--max-iter", "5") == 5
    for wrong in ("0", "6"):
        with pytest.raises(SystemExit):
            parse("--max-iter", wrong)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the bird sings"), (4, ""), (5, None)], "unit_id int, text string")
    index = bm25.Bm25Index.build(docs)
    assert (index.n_units, index.mean_length) == (5, 7 / 5)
    found = index.search(spark.createDataFrame([(0, "cat cat unknown")], "query_id int, query string"), 5).collect()
    assert [(r["unit"], r["rank"]) for r in found] == [(1, 1)]
    from math import log

    idf = log(5 - 1 + 0.5) - log(1.5)
    assert found[0]["score"] == pytest.approx(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1.4)))
    weights = {r["token"]: r["idf"] for r in index.weights().collect()}
    raw = [log(5 - d + 0.5) - log(d + 0.5) for d in (3, 1, 1, 1, 1)]
    assert weights["the"] == pytest.approx(0.25 * sum(raw) / 5)  # negative, so floored


def _ranks(spark):
    rows = [(0, "a", "dense", 1), (0, "b", "dense", 2), (0, "s", "dense", 3), (0, "a", "bm25", 2), (0, "c", "bm25", 1), (0, "s", "bm25", 3)]
    return spark.createDataFrame(rows, "query int, unit string, signal string, rank int")


def test_fusion_weights_and_summaries(spark):
    ranks, summaries = _ranks(spark), spark.createDataFrame([("s",)], "unit string")
    score = {r["unit"]: r["score"] for r in fusion.fuse(ranks, {"dense": 1.0, "bm25": 0.7}, 10, summaries=summaries).collect()}
    assert score["a"] == pytest.approx(1 / 61 + 0.7 / 62) and score["c"] == pytest.approx(0.7 / 61) and score["s"] == pytest.approx(0.3 / 63 + 0.7 / 63)
    assert {r["unit"] for r in fusion.fuse(ranks, {"dense": 1.0, "bm25": 0.7}, 10, summaries=summaries, summary_weight=0).collect()} == {"a", "b", "c"}
    assert {r["unit"]: r["score"] for r in fusion.fuse(ranks, {"dense": 1.0, "bm25": 0.0}, 10).collect()}["c"] == 0


def test_gate(spark):
    asked = spark.createDataFrame([(0,), (1,), (2,), (3,)], "query int")
    found = spark.createDataFrame([(0, "u"), (1, "u"), (2, "u")], "query int, unit string")
    top = spark.createDataFrame([(0, 0.47), (1, 0.48)], "query int, top_similarity double")
    assert {r["query"]: r["no_evidence"] for r in answer.gate(asked, found, top, 0.48).collect()} == {0: True, 1: False, 2: False, 3: True}


def test_metrics(spark):
    rows = spark.createDataFrame([("m", 1, "keyword"), ("m", 6, "graph"), ("m", None, "mixed"), ("m", 2, "keyword")], "method string, rank int, category string")
    out = {r["segment"]: (r["n"], r["hit_at_k"], r["mrr"]) for r in evaluate.segments(rows).collect()}
    assert out["all"] == (4, 0.5, pytest.approx((1 + 1 / 6 + 0.5) / 4)) and out["graph"] == (1, 0.0, pytest.approx(1 / 6))
    assert "method" in evaluate.report(rows)


def _proximity_by_walks(edges, seeds, hops):
    steps = {}
    for a, b, kind, w in edges:
        f = {"links_to": 1.0, "related": 1.0, "relates_to": 0.6}.get(kind, 0.4)
        for x, y in ((a, b), (b, a)):
            e = y.startswith("entity::")
            steps.setdefault(x, []).append((y, 0.5 * f * w - 1 - e, 1 if e else 2))
    best = {}

    def walk(node, left, score):
        if not node.startswith("entity::") and node not in seeds:
            best[node] = max(best.get(node, 0), score)
        if left > 0:
            for y, gain, cost in steps.get(node, ()):
                if score + gain > -1:
                    walk(y, left - cost, score + gain)

    for s in seeds:
        walk(s, 2 * hops, hops + 1.0)
    return {n: s for n, s in best.items() if s > 0}


def test_proximity_equals_all_walks(spark):
    r = random.Random(3)
    names = [f"n{i}" for i in range(9)] + ["entity::a", "entity::b"]
    edges = [(*sorted(r.sample(names, 2)), r.choice(graph.KINDS), r.choice((1.0, 2.0, 3.0))) for _ in range(16)]
    edges = list({e[:2]: e for e in edges}.values())
    table = spark.createDataFrame(edges, "src string, dst string, kind string, weight double")
    seeds = spark.createDataFrame([(0, "n0"), (0, "n3")], "query int, node string")
    for hops in (1, 2):
        got = {x["node"]: x["score"] for x in graph.proximity(seeds, table, hops).collect()}
        assert got == pytest.approx(_proximity_by_walks(edges, {"n0", "n3"}, hops))


def test_tags_as_nodes_equal_their_pairs(spark):
    r = random.Random(8)
    notes = [(f"n{i}", r.sample(["a", "b", "c", "d", None], r.randint(0, 3))) for i in range(14)]
    table = spark.createDataFrame(notes, "source string, tags array<string>")
    pairs = [(a, b) for a, t in notes for b, u in notes if a < b and set(t) & set(u) - {None}]
    links = [tuple(sorted(r.sample([n for n, _ in notes], 2))) for _ in range(5)] + [("entity::x", "n1"), ("entity::x", "n2")]
    kinds = lambda e: "mentions" if e[0].startswith("entity::") else "links_to"
    linked = [(*e, kinds(e), 1.0) for e in dict.fromkeys(links)]
    both = linked + [(*p, "tagged", 1.0) for p in pairs if p not in links]
    schema, seeds = "src string, dst string, kind string, weight double", spark.createDataFrame([(0, "n0"), (0, "n3"), (1, "n5")], "query int, node string")
    told = lambda df: sorted((x["query"], x["node"], round(x["score"], 9)) for x in df.collect())
    for hops in (1, 2):
        got = graph.proximity(seeds, spark.createDataFrame(linked, schema), hops, tags=graph.tag_members(table))
        assert told(got) == told(graph.proximity(seeds, spark.createDataFrame(both, schema), hops)) != []
    shared = [(a, b, float(len(set(t) & set(u) - {None}))) for a, t in notes for b, u in notes if a < b and set(t) & set(u) - {None}]
    membership = spark.createDataFrame([(n, i % 3) for i, (n, _) in enumerate(notes)], "node string, community int")
    whole = graph.modularity(spark.createDataFrame(shared, "src string, dst string, weight double"), membership).first()[0]
    assert graph.tag_modularity(graph.tag_members(table), membership).first()[0] == pytest.approx(whole)


def test_pairs_over_tags_are_made_once(spark, monkeypatch):
    """A class is scored once for a query: what the steps write does not grow with the pairs."""
    monkeypatch.setattr(graph, "CLASS_SHARE", 7)
    monkeypatch.setattr(graph, "MOST_TASKS", 3)
    notes = spark.createDataFrame([(f"n{i}", ["all", f"t{i % 2}"]) for i in range(300)] + [("far", ["t9"])], "source string, tags array<string>")
    seeds = spark.createDataFrame([(q, f"n{q}") for q in range(4)], "query int, node string")
    work, edges = Workspace(spark, "test"), spark.createDataFrame([], "src string, dst string, kind string, weight double")
    got = graph.proximity(seeds, edges, 2, work, graph.tag_members(notes)).collect()
    assert sorted((r["query"], r["node"], round(r["score"], 6)) for r in got) == sorted((q, f"n{i}", 2.2) for q in range(4) for i in range(300) if i != q)
    folders = [f for f in Path(work.root.removeprefix("file://")).iterdir() if not f.name.startswith("members")]
    assert sum(spark.read.parquet(f"file://{f}").count() for f in folders) < 500


def test_pairs_are_only_laid_out(spark, monkeypatch):
    """Digits and left out seeds are worked out for a share of notes; above the join, pairs come from its arrays alone."""
    monkeypatch.setattr(graph, "CLASS_SHARE", 4)
    notes = spark.createDataFrame([(f"n{i}", ["all"]) for i in range(30)] + [("entity::e", ["all"]), ("m", ["all", "b"])], "source string, tags array<string>")
    seeds = spark.createDataFrame([(q, f"n{i}") for q in range(2) for i in range(9 * q + 1)], "query int, node string")
    work, edges = Workspace(spark, "test"), spark.createDataFrame([], "src string, dst string, kind string, weight double")
    got = graph.proximity(seeds, edges, 2, work, graph.tag_members(notes), digits=0)
    want = [(q, n, 2.0) for q in range(2) for n in [f"n{i}" for i in range(9 * q + 1, 30)] + ["m"]]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    linked = spark.createDataFrame([("n1", "n2", "links_to", 1.0), ("far", "n0", "links_to", 1.0)], edges.schema)
    found = sorted(tuple(r) for r in graph.proximity(seeds, linked, 2, work, graph.tag_members(notes), digits=0).collect())
    assert found == sorted([*want, (0, "far", 3.0), (1, "far", 3.0)])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "Generate explode" in above and "round(" not in above and "array_contains" not in plan


def test_components_share_batches(spark):
    """Groups are no calls of their own, and may reach over batches of any size."""
    edges = [(f"{c:02}-{i}", f"{c:02}-{j}", 1.0) for c in range(12) for i in range(6) for j in range(i + 1, 6) if (i < 3) == (j < 3) or (i, j) == (2, 3)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        found = community.communities(spark.createDataFrame(edges, "src string, dst string, weight double"), Workspace(spark, "test"))
        assert {r["node"]: r["community"] for r in found.collect()} == community.partition(edges, 2.0 * len(edges)) and found.count() == 72
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsIn" not in plan


def test_modularity_of_two_triangles(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    table = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src string, dst string, weight double")
    found = community.communities(table, Workspace(spark, "test"))
    assert {r["node"]: r["community"] for r in found.collect()} == dict.fromkeys("abc", "a") | dict.fromkeys("def", "d")
    assert graph.modularity(table, found).first()["modularity"] == pytest.approx(5 / 14)


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(7, 7), (None, 3)] + [(500, x) for x in range(501, 540)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    got = {x["node"]: x["component"] for x in connected_components(table, Workspace(spark, "test")).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(table.limit(0), Workspace(spark, "test")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_split_text_covers_everything(text, size, overlap):
    spans = chunking.split_spans(text, size, overlap)
    assert all(0 < b - a <= size for a, b in spans)
    whole, at = "", 0
    for a, b in spans:
        assert at - overlap <= a <= at and b > at
        whole, at = whole + text[at:b], b
    assert whole == text
    assert chunking.split_text(text, size, overlap) == [p for a, b in spans if (p := text[a:b].strip())]


def test_split_limits():
    assert [len(p) for p in chunking.split_text("x" * 5000, 1000, 100)] == [1000, 1000, 1000, 1000, 1000, 500]
    assert chunking.split_text("\n\n".join(["y" * 899] * 3), 1000, 100) == ["y" * 899] * 3
    assert chunking.split_text("one two three four", 11, 4) == ["one two", "two three", "four"]
    assert chunking.split_text("x" * 1000, 1000, 100) == ["x" * 1000]
    body = "intro\n\n# A\n\n## B\n```\n# not a header\n```\ntext\n### C\nmore\n# D"
    assert [p for p, _ in chunking.sections(body)] == ["", "A > B", "A > B > C", "D"]


def test_frontmatter():
    parse = vault.split_frontmatter
    assert parse("---\npublic: true\ntags: [a, ' ', b]\n---\n\nbody") == ({"public": "True"}, [], ["a", " ", "b"], "body")
    assert parse("---\nx: [\n---\nbody")[0] == {} and parse("---\nx: [\n---\nbody")[3] == "body"
    assert parse("---\nx: 1\nno end") == ({}, [], [], "---\nx: 1\nno end") and parse(None) == ({}, [], [], "")
    assert parse("---\n- a\n---\nb")[0] == {} and parse("----\nrelated: one\n---\nb")[1] == ["one"]


def test_upsert_and_partitions_by_kind(spark, tmp_path):
    units = store.UnitStore(spark, f"file://{tmp_path}/units")
    assert units.read().count() == 0
    rows = lambda *x: spark.createDataFrame([(f"{s}::{i}", s, f"{s}{i}{v}", i) for s, i, v in x], "unit_id string, source string, text string, chunk_index int")
    units.replace(rows(("a", 0, ""), ("a", 1, ""), ("b", 0, "")))
    units.replace(rows(("sum", 0, "")), "community_summary")
    for _ in range(2):  # a second time changes nothing
        units.upsert(rows(("a", 0, "new")))
        assert {(r["unit_id"], r["text"], r["kind"]) for r in units.read().collect()} == {("a::0", "a0new", ""), ("b::0", "b0", ""), ("sum::0", "sum0", "community_summary")}
    units.delete("community_summary")
    assert units.read().count() == 2


def _unit_rows(spark, *rows):
    return spark.createDataFrame([(f"{s}::{i}", s, t) for s, i, t in rows], "unit_id string, source string, text string")


def _texts(units):
    return sorted((r["unit_id"], r["text"]) for r in units.read().collect())


def test_an_upsert_of_one_source_writes_kilobytes(spark, tmp_path):
    units = store.UnitStore(spark, f"file://{tmp_path}/units")
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda x: F.md5(F.concat(F.col("id").cast("string"), x.cast("string")))), " ")
    units.replace(spark.range(1000).select(F.concat(F.lit("u"), "id").alias("unit_id"), F.concat(F.lit("s"), "id").alias("source"), words.alias("text")))
    base = units.layers()[0]
    units.upsert(_unit_rows(spark, ("s7", 0, "new")))
    first, second = units.layers()
    assert first == base and base["bytes"] > 5_000_000 and second["bytes"] < 20_000
    assert units.read().count() == 1000 and units.read().where("source = 's7'").collect()[0]["text"] == "new"


def test_layers_are_merged_and_stay_what_they_were(spark, tmp_path, monkeypatch):
    """Random changes against a dictionary, with sizes so small that all merges happen."""
    monkeypatch.setattr(store, "SMALL", 4000)
    units, want, r = store.UnitStore(spark, f"file://{tmp_path}/units"), {}, random.Random(3)
    most = 0
    for step in range(9):
        names = r.sample("abcdefghij", r.randint(1, 3))
        rows = [(s, i, f"{s}{i}@{step}") for s in names[:-1] or names for i in range(r.randint(1, 3))]
        want = {k: v for k, v in want.items() if k[0] not in names} | {(s, i): t for s, i, t in rows}
        before = units.read()  # a plan made before a change still runs after it
        count = len(_texts(units))
        units.upsert(_unit_rows(spark, *rows), sources=spark.createDataFrame([(s,) for s in names] + [(None,)], "source string"))
        assert before.count() == count and _texts(units) == sorted((f"{s}::{i}", t) for (s, i), t in want.items())
        most = max(most, len(units.layers()))
    assert store.FAN - 1 <= most <= 2 * store.FAN


def test_a_large_layer_is_not_rewritten_for_small_ones():
    layers = lambda *sizes: [{"bytes": store.SMALL * store.FAN**n} for n in sizes]
    assert [store._first_to_merge(layers(*x)) for x in ((), (9,), (9, 0, 0, 0), (9, 0, 0, 0, 0), (9, 1, 0, 0, 0), (9, 1, 1, 1, 0, 1), (2, 0, 2, 2, 2))] == [None, None, None, 1, None, 1, 0]


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    units = store.UnitStore(spark, f"file://{tmp_path}/units")
    units.replace(_unit_rows(spark, ("a", 0, "old"), ("b", 0, "b")))
    with monkeypatch.context() as broken:
        broken.setattr(store, "replace_text", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        for change in (units.upsert, units.replace):
            with pytest.raises(OSError):
                change(_unit_rows(spark, ("a", 0, "new")))
    assert _texts(units) == [("a::0", "old"), ("b::0", "b")]
    assert units.vacuum() == 3 and units.vacuum() == 0  # two layers of units, one delete vector
    units.upsert(_unit_rows(spark, ("a", 0, "new"), ("a", 0, "newer")))
    assert _texts(units) == [("a::0", "new"), ("b::0", "b")]
    units.upsert(spark.createDataFrame([], "unit_id string, source string, text string"), sources=spark.createDataFrame([("a",)], "source string"))
    assert _texts(units) == [("b::0", "b")]


def test_generation_failures_and_cache(spark):
    prompts = spark.createDataFrame([("a", "ok"), ("b", "bad")], "key string, prompt string")

    def generator(p):
        if p == "bad":
            raise ValueError("no")
        return p + "!"

    out = {r["key"]: (r["answer"], r["error"]) for r in generate_column(prompts, generator).collect()}
    assert out == {"a": ("ok!", None), "b": (None, "ValueError: no")}
    cache = spark.createDataFrame([("a", "kept"), ("z", "unused")], "key string, answer string")
    assert [tuple(r) for r in cached(prompts, cache, "key", lambda m: generate_column(m, generator)).collect()] == [("a", "kept")]


def test_agentic_rules():
    asked = []

    def generator(p):
        asked.append(p.partition("\n")[0])
        return "no" if p.startswith("GRADE") else "other words" if p.startswith("REWRITE") else "told"

    state = answer.agentic("q", lambda q: "context", generator, 2)
    assert asked == ["GRADE", "REWRITE", "ANSWER"] and state.rewrites == ["other words"] and state.max_iterations_hit and state.iterations == 2
    assert answer.agentic("q", lambda q: "", extractive_generator(), 1).answer == answer.NO_EVIDENCE_TEXT


def test_exhaustive_counts(spark):
    table = spark.createDataFrame([(1, "cats purr"), (2, "dogs bark"), (3, "boom")], "community_id int, text string")

    def generator(p):
        if "boom" in p:
            raise RuntimeError
        return extractive_generator()(p)

    out = answer.exhaustive("tell about cats", table, generator)
    assert (out["total"], out["skipped"], out["failed"]) == (3, 1, 1) and [c for c, _ in out["partials"]] == [1]


def test_benchmark_subset(spark):
    rows = spark.createDataFrame([(0, "q1", "x"), (1, "q2", "y"), (2, "q3", "x"), (3, "q4", "z")], "place int, question string, context string")
    corpus, asked = vault.benchmark_subset(rows, 2, 2)
    assert sorted(map(tuple, corpus.collect())) == [("c00000", "x"), ("c00001", "y")]
    assert sorted(map(tuple, asked.collect())) == [("q1", "c00000"), ("q2", "c00001")]
    more = spark.createDataFrame([(0, "y"), (1, "far"), (2, "far"), (3, "farther")], "place int, context string")
    corpus, asked = vault.benchmark_subset(rows, 4, 9, more)
    assert sorted(map(tuple, corpus.collect())) == [("c00000", "x"), ("c00001", "y"), ("c00002", "z"), ("c00003", "far")] and asked.count() == 4


def test_qa_benchmark(spark, tmp_path):
    (tmp_path / "qa.json").write_text('{"data": [{"paragraphs": [{"context": "c1", "qas": [{"question": "a"}, {"question": "b"}]}, {"context": "c2", "qas": [{"question": "c"}]}]}]}')
    rows = vault.qa_benchmark(spark, f"file://{tmp_path}/qa.json").orderBy("place").collect()
    assert [(r["question"], r["context"]) for r in rows] == [("a", "c1"), ("b", "c1"), ("c", "c2")]


def test_benchmark_variants(spark):
    ranks = spark.createDataFrame([(1,), (6,), (11,), (None,)], "rank int")
    assert tuple(evaluate.truncated_metrics(ranks).first()) == (4, 0.25, 0.5, (1 + 1 / 6) / 4)
    assert tuple(evaluate.truncated_metrics(ranks.limit(0)).first()) == (0, 0.0, 0.0, 0.0) and tuple(evaluate.metrics(ranks.limit(0)).first()) == (0, 0.0, 0.0)
    runs = spark.createDataFrame([(1, False, 2.0, 10), (1, True, 9.0, 99), (None, False, 4.0, 20)], "rank int, failed boolean, latency double, tokens int")
    assert tuple(evaluate.agent_metrics(runs).first()) == (3, 1, 1 / 3, 1 / 3, 3.0, 4.0, 15.0, 30)
    lines = spark.createDataFrame([(0, 0, '{"type": "result", "n": 1}'), (0, 1, "no json"), (0, 2, '{"type": "result", "n": 2}'), (0, 3, '{"type": "other"}')], "run int, place int, line string")
    assert [r["result"] for r in evaluate.last_result(lines).collect()] == ['{"type": "result", "n": 2}']
    assert evaluate.escalated([1, 3, 9], lambda n: 1.0 if n < 3 else 0.5) == [(1, 1.0), (3, 0.5)]
    files = spark.createDataFrame([("a", "red apple"), ("b", "blue sky")], "source string, text string")
    assert evaluate.whole_files(files, spark.createDataFrame([(0, "sky blue")], "query int, text string"), hashing_embedder()).where("rank = 1").first()["source"] == "b"


def test_many_query_blocks_and_patterns(spark, monkeypatch):
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "unit_id int, embedding array<double>")
    asked = vectors.where("unit_id < 9").withColumnRenamed("unit_id", "query_id")
    near = lambda: sorted((q, u, round(s, 9), r) for q, u, s, r in dense.dense_search(vectors, asked, 4, exclude_self=True).collect())
    whole = near()
    monkeypatch.setattr(dense, "BLOCK_NUMBERS", 6)
    assert near() == whole and all(q != u for q, u, *_ in whole)
    assert dense.dense_search(vectors, asked.limit(0), 4).count() == 0
    files = spark.createDataFrame([(0, "abc"), (1, "bcd"), (2, None)], "source int, text string")
    patterns = spark.createDataFrame([("b",), ("cd",), ("",), ("a",)], "pattern string")
    found = sorted(map(tuple, evaluate.containing(files, patterns).collect()))
    monkeypatch.setattr(evaluate, "PATTERN_CHARS", 1)
    assert sorted(map(tuple, evaluate.containing(files, patterns).collect())) == found == [(0, "a"), (0, "b"), (1, "b"), (1, "cd")]


def test_components_of_chains_and_hubs(spark):
    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    nation = {r["c_custkey"]: r["c_nationkey"] for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    groups = {}
    for r in orders:
        groups.setdefault(nation[r["o_custkey"]], set()).add(f"o{r['o_orderkey']}")
    want = {n: min(g | {f"n{k}"}) for k, g in groups.items() for n in g | {f"n{k}"}}
    from fathom.plans import registry
    assert {r["node"]: r["component"] for r in registry.QUERIES["connected_components"](spark, sf).collect()} == want


def test_rank_changes_and_links(spark):
    one = spark.createDataFrame([(0, 1), (1, None)], "query int, rank int")
    two = spark.createDataFrame([(0, 3), (1, 2)], "query int, rank int")
    assert {r["query"]: r["change"] for r in evaluate.rank_changes(one, two).collect()} == {0: 2, 1: None}
    proposed = spark.createDataFrame([("Topic", "Beta, topic\nALPHA,beta,none")], "topic string, raw string")
    titles = spark.createDataFrame([("Alpha",), ("Beta",), ("Topic",)], "title string")
    assert answer.select_links(proposed, titles).first()["links"] == ["Beta", "Alpha"]
