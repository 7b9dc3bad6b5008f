import http.server
import io
import json
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fathom.cli import _parser, run, serve
from fathom.config import EngineConfig
from fathom.engine import Engine
from fathom.operators.bm25 import Bm25Index
from fathom.operators.segments import SegmentedIndex
from fathom.operators.store import UnitStore
from fathom.providers import HASHING_THRESHOLD, extractive_generator, local_embedder, local_generator
from fathom.streaming.incremental import index_stream

NOTES = {
    "garden/tomatoes.md": "---\npublic: true\ntags: [plants]\n---\n# Tomatoes\n\nTomatoes need sun and water. See [[compost]].\n",
    "garden/compost.md": "---\npublic: true\ntags: [plants]\n---\n# Compost\n\nCompost feeds the soil. Worms help.\n",
    "music/fugue.md": "# Fugue\n\nA fugue layers voices over a subject. Compare [[missing]].\n",
    ".obsidian/skip.md": "tomatoes everywhere",
    "graph_report.md": "tomatoes generated",
}


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    for name, text in NOTES.items():
        (root / "vault" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "vault" / name).write_bytes(text.encode() + (b"\xff" if "fugue" in name else b""))
    return EngineConfig(vault_path=f"file://{root}/vault", store_path=f"file://{root}/store", graph_path=f"file://{root}/graph", graph_weight=0.5, graph_seed_notes=1, relevance_threshold=0.05)


def test_whole_life(spark, config):
    engine = Engine(spark, config)
    with pytest.raises(ValueError):
        Engine(spark, EngineConfig(vault_path=config.vault_path)).index(public_only=True)
    assert engine.index(public_only=True) == 2 and engine.index() == 3
    assert {r["source"] for r in engine.search(["tomatoes sun"], 5).where("rank = 1").collect()} == {"garden/tomatoes.md"}
    built = engine.build_graph()
    assert built["unresolved"] == 1 and built["edges"] >= 1
    found = {r["source"]: r for r in engine.search(["tomatoes sun"], 5).collect()}
    assert found["garden/compost.md"]["graph_rank"] == 1
    assert engine.store.read("community_summary").count() >= 1
    told = {r["query"]: r for r in engine.ask(["what do tomatoes need", "zzz qqq xxx"], 3).collect()}
    assert "sun" in told[0]["answer"] and told[1]["no_evidence"]
    assert "Compost feeds" in engine.agentic("what does compost feed").answer
    assert engine.overview("tomatoes and compost")["total"] >= 1
    dry = engine.distill("compost worms")
    assert "source" not in dry and "# compost worms" in dry["note"]
    first, second = (engine.distill("compost worms", date="2024-02-03", write=True)["source"] for _ in range(2))
    assert (first, second) == ("04-WIKI/compost-worms.md", "04-WIKI/compost-worms.new.md")
    assert engine.store.read("").where(F.col("source") == first).count() >= 1


def test_cli(spark, config):
    def call(*argv):
        return run(_parser().parse_args([*argv, "--store", config.store_path, "--vault", config.vault_path, "--graph", config.graph_path]), spark)

    assert call("index")[0] == 0
    code, text = call("vault-search", "tomatoes", "--k", "2")
    assert code == 0 and json.loads(text)["results"][0]["source"] == "garden/tomatoes.md"
    assert json.loads(call("vault-ask", "what do tomatoes need")[1])["sources"]


def test_answers_at_the_embedder_s_own_threshold(spark, config):
    assert Engine(spark, replace(config, relevance_threshold=None)).threshold == HASHING_THRESHOLD
    with pytest.raises(ValueError):
        EngineConfig(provider="elsewhere")


def test_graph_answers_are_remembered(spark, config, tmp_path):
    calls = f"{tmp_path}/calls"

    def counting(prompt):
        with open(calls, "a") as f:
            f.write(prompt.partition("\n")[0] + "\n")
        return extractive_generator()(prompt)

    own = replace(config, store_path=f"file://{tmp_path}/store", graph_path=f"file://{tmp_path}/graph")
    engine = Engine(spark, own, generator=counting)
    engine.index()
    first = engine.build_graph()
    told = open(calls).read().count("\n")
    again = engine.build_graph()
    assert open(calls).read().count("\n") == told > 0
    assert first["extraction"]["cached"] == 0 and again["extraction"]["asked"] == again["summaries"]["asked"] == 0 and again["extraction"]["cached"] >= 3
    assert engine.overview("compost")["missing"] == 0
    gold = spark.createDataFrame([(0, "tomatoes sun", ["garden/tomatoes.md"], "keyword"), (1, "compost", ["garden/compost.md"], "graph")], "query int, question string, expected array<string>, category string")
    out = engine.evaluate(gold, 5)
    assert {r["method"] for r in out["methods"].collect()} == {"grep", "dense", "bm25", "flat", "integrated"}
    assert out["sweeps"].select("setting").distinct().count() == 10 and out["changes"].count() == 2 and out["regressed"].first()[0] is False


def test_serve(spark, config):
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    lines = [ask(1, "initialize"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask(2, "tools/list"), ask(3, "tools/call", name="vault_search", arguments={"query": "tomatoes", "k": 2}), ask(4, "tools/call", name="vault_ask", arguments={}), ask(5, "nothing"), "no json"]
    sink = io.StringIO()
    assert serve(Engine(spark, config), io.StringIO("\n".join(lines)), sink) == "6 answers"
    out = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [t["name"] for t in out[1]["result"]["tools"]] == ["vault_search", "vault_ask"]
    assert json.loads(out[2]["result"]["content"][0]["text"])["results"][0]["source"] == "garden/tomatoes.md"
    assert out[3]["result"]["isError"] and out[4]["error"]["code"] == -32601 and out[5]["error"]["code"] == -32700


def test_model_server(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            out = {"embeddings": [[1.0, float(len(t))] for t in body["input"]]} if self.path == "/api/embed" else {"response": f"{body['model']}:{body['prompt'].strip()}:{body.get('format', '')}"}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert local_embedder(url, "m")(["ab", "c"]).tolist() == [[1.0, 2.0], [1.0, 1.0]]
        assert local_generator(url, "m")("ENTITIES\n\n\ntext") == "m:text:json" and local_generator(url, "m")("ANSWER\nq\n\nc") == "m:q\n\nc:"
    finally:
        server.shutdown()


def test_approximate_vectors_follow_the_store(spark, config, tmp_path):
    own = replace(config, store_path=f"file://{tmp_path}/store", graph_path=f"file://{tmp_path}/graph", vector_search="ann")
    engine = Engine(spark, own)
    engine.index()
    exact = Engine(spark, replace(own, vector_search="exact"))
    ranks = lambda e: sorted((r["query"], r["dense_rank"], r["unit"]) for r in e.search(["compost worms", "fugue"], 5).collect())
    assert engine.vectors().exists() and ranks(engine) == ranks(exact)
    written = engine.distill("compost worms", write=True)["source"]
    units = {r["unit_id"] for r in engine.store.read().where(F.col("source") == written).collect()}
    coded = {r["unit"] for r in spark.read.parquet(f"{engine.vectors().path}/codes").collect()}
    assert units and units <= coded and engine.words().n_units == engine.store.read().count()
    with pytest.raises(ValueError):
        replace(config, vector_search="other")


def test_stream_into_store(spark, tmp_path):
    arrivals, units = f"file://{tmp_path}/in", UnitStore(spark, f"file://{tmp_path}/units")
    words = SegmentedIndex(spark, f"file://{tmp_path}/words")
    schema = "source string, raw string, version int"
    long = "---\npublic: true\n---\n" + "many words here. " * 200
    for rows in ([("a", "one", 1), ("b", "two", 1), ("a", "one!", 2), ("d", long, 1)], [("a", "one!", 3), ("b", "two!", 2), ("c", "three", 1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(arrivals)
        index_stream(spark.readStream.schema(schema).parquet(arrivals), units, f"file://{tmp_path}/check", words=words).awaitTermination()
        fresh = Bm25Index.build(units.read())
        asked = spark.createDataFrame([(0, "one! two many"), (1, "three")], "query_id int, query string")
        ranked = lambda index: sorted((r["query"], r["rank"], r["unit"], round(r["score"], 9)) for r in index.search(asked, 5).collect())
        assert ranked(words) == ranked(fresh) != []
    assert len(words.segments()) == 2
    found = units.read().collect()
    assert {(r["source"], r["text"], r["public"]) for r in found if r["source"] != "d"} == {("a", "one!", False), ("b", "two!", False), ("c", "three", False)}
    assert sum(r["source"] == "d" and r["public"] for r in found) > 1 and all(r["embedding"] for r in found)
