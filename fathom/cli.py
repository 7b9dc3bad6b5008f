"""Command line: index, search, ask, graph-build, distill, agentic, eval, serve, and the JSON tools vault-search and vault-ask."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from typing import TextIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fathom.config import EngineConfig
from fathom.engine import Engine
from fathom.operators import answer, evaluate
from fathom.sources import vault


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="fathom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, argument in (("index", None), ("search", "query"), ("ask", "question"), ("graph-build", None), ("distill", "topic"), ("agentic", "question"), ("eval", "gold"), ("vault-search", "query"), ("vault-ask", "query"), ("serve", None)):
        c = commands.add_parser(name)
        if argument:
            c.add_argument(argument)
        c.add_argument("--vault", "-v")
        c.add_argument("--store", "-c")
        c.add_argument("--graph", "-g")
        c.add_argument("--k", type=int, default=8 if name == "distill" else 5)
        c.add_argument("--threshold", type=float, help="least similarity of evidence; without it the embedder's own")
        c.add_argument("--provider", choices=("builtin", "server"))
        if name == "index":
            c.add_argument("--public-only", action="store_true")
        if name == "ask":
            c.add_argument("--exhaustive", action="store_true")
        if name == "distill":
            c.add_argument("--date")
            c.add_argument("--write", action="store_true")
        if name == "agentic":
            c.add_argument("--max-iter", type=int, default=2, choices=range(1, 6))
    return parser


def run(args: argparse.Namespace, spark: SparkSession) -> tuple[int, str]:
    """(exit code, output)."""
    config = EngineConfig()
    for field, value in (("vault_path", args.vault), ("store_path", args.store), ("graph_path", args.graph), ("relevance_threshold", args.threshold), ("provider", args.provider)):
        config = replace(config, **{field: value}) if value is not None else config
    engine = Engine(spark, config)
    if args.command == "index":
        try:
            return 0, f"{engine.index(args.public_only)} chunks"
        except ValueError as e:
            return 1, str(e)
    if args.command == "graph-build":
        return 0, json.dumps(engine.build_graph())
    if args.command == "distill":
        note = engine.distill(args.topic, args.k, args.date, args.write)
        return int(note["no_evidence"]), note["note"] or answer.NO_EVIDENCE_TEXT
    if args.command == "agentic":
        state = engine.agentic(args.question, args.k, args.max_iter)
        return 0, "\n".join([*(f"rewrite: {r}" for r in state.rewrites), state.answer])
    if args.command == "eval":
        with open(args.gold, encoding="utf-8") as f:
            gold = vault.gold_set(spark, f.read()).withColumnRenamed("qid", "query")
        return 0, "\n\n".join(f"{name}\n{evaluate.report(table)}" for name, table in engine.evaluate(gold).items())
    if args.command == "serve":
        return 0, serve(engine, sys.stdin, sys.stdout)
    if args.command == "ask" and args.exhaustive:
        out = engine.overview(args.question)
        return int(not out["total"]), json.dumps({k: v for k, v in out.items() if k != "partials"} | {"communities": [c for c, _ in out["partials"]]}, ensure_ascii=False)
    if args.command in ("search", "vault-search"):
        response = vault_search(engine, args.query, args.k)
        return int(args.command == "search" and not json.loads(response)["total"]), response
    return 0, vault_ask(engine, args.question if args.command == "ask" else args.query, args.k)


def vault_search(engine: Engine, query: str, k: int = 5) -> str:
    return answer.search_response(query, engine.search([query], k), EngineConfig.clamp_k(k)).first()["response"]


def vault_ask(engine: Engine, query: str, k: int = 5) -> str:
    row = engine.ask([query], k).first()
    if row["error"]:
        return json.dumps({"error": row["error"]}, ensure_ascii=False)
    sources = [] if row["no_evidence"] else [r.asDict() for r in answer.source_rollup(engine.search([query], k)).orderBy("rank").select("rank", F.col("label").alias("source"), F.round("score", 6).alias("rrf_score")).collect()]
    return json.dumps({"query": query, "answer": row["answer"], "no_evidence": row["no_evidence"], "sources": sources}, ensure_ascii=False)


TOOLS = {"vault_search": (vault_search, "Search the notes; results with their ranks as JSON."), "vault_ask": (vault_ask, "Answer a question from the notes, with its sources, as JSON.")}


def _reply(engine: Engine, request: dict) -> dict | None:
    """The result of one request of the tool protocol; None for what wants no answer."""
    method, params = request.get("method", ""), request.get("params") or {}
    if method == "initialize":
        return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "fathom", "version": "0.2.0"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        schema = {"type": "object", "properties": {"query": {"type": "string"}, "k": {"type": "integer", "default": 5}}, "required": ["query"]}
        return {"tools": [{"name": n, "description": d, "inputSchema": schema} for n, (_, d) in TOOLS.items()]}
    if method == "tools/call":
        tool, given = TOOLS[params["name"]][0], params.get("arguments") or {}
        try:
            text, failed = tool(engine, given["query"], int(given.get("k", 5))), False
        except Exception as e:  # told to the caller; the server goes on
            text, failed = json.dumps({"error": f"{type(e).__name__}: {e}"}, ensure_ascii=False), True
        return {"content": [{"type": "text", "text": text}], "isError": failed}
    if method.startswith("notifications/"):
        return None
    raise LookupError(method)


def serve(engine: Engine, source: TextIO, sink: TextIO) -> str:
    """Serve the two tools over lines of JSON-RPC 2.0, until the source ends."""
    served = 0
    for line in source:
        if not line.strip():
            continue
        request = None
        try:
            request = json.loads(line)
            result = _reply(engine, request)
            out = None if result is None or "id" not in request else {"jsonrpc": "2.0", "id": request["id"], "result": result}
        except json.JSONDecodeError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        except LookupError as e:
            out = {"jsonrpc": "2.0", "id": request.get("id"), "error": {"code": -32601, "message": f"unknown: {e}"}}
        if out is not None:
            served += 1
            sink.write(json.dumps(out, ensure_ascii=False) + "\n")
            sink.flush()
    return f"{served} answers"


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("fathom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    code, text = run(args, spark)
    print(text, file=sys.stderr if args.command == "serve" else sys.stdout)
    return code


if __name__ == "__main__":
    sys.exit(main())
