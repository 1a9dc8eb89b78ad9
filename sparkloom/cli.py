"""Command line: index, update, cluster, embed, the tools, and a tool server."""

from __future__ import annotations

import argparse
import contextlib
import json
import sys

from pyspark.sql import SparkSession

from sparkloom import index, render
from sparkloom.api import CodeGraph
from sparkloom.sources.repo import resolve_source

TOOLS = ("search_code", "get_definition", "read_code", "get_callers", "get_callees", "impact_analysis", "get_overview", "label_community", "generate_wiki", "query")


def session() -> SparkSession:
    return SparkSession.builder.appName("sparkloom").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def call(graph: CodeGraph, tool: str, arguments: dict) -> str:
    """A tool's result as text."""
    if tool not in TOOLS:
        raise ValueError(f"no tool {tool}")
    out = getattr(graph, tool)(**arguments)
    if tool == "impact_analysis":
        return render.impact(out)
    if tool == "get_overview":
        return render.overview(out)
    if tool == "generate_wiki":
        return render.wiki(out)
    if tool == "query":
        shown, every = out
        return f"{render.as_json(shown, 200)}\n{shown.count()} of {every.count()} rows"
    return out if isinstance(out, str) else render.table(out)


def serve(graph: CodeGraph, lines=sys.stdin, out=sys.stdout) -> None:
    """JSON-RPC over standard input and output: tools/list and tools/call."""
    graph.spark.range(1).count()  # fail now if nothing works
    for line in lines:
        if not line.strip():
            continue
        asked = json.loads(line)
        answer: dict = {"jsonrpc": "2.0", "id": asked.get("id")}
        try:
            method, params = asked["method"], asked.get("params") or {}
            if method == "initialize":
                answer["result"] = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "sparkloom", "version": "1"}}
            elif method == "tools/list":
                answer["result"] = {"tools": [{"name": t, "description": (getattr(CodeGraph, t).__doc__ or t).strip(), "inputSchema": {"type": "object"}} for t in TOOLS]}
            elif method == "tools/call":
                answer["result"] = {"content": [{"type": "text", "text": call(graph, params["name"], params.get("arguments") or {})}]}
            elif asked.get("id") is None:
                continue
            else:
                answer["error"] = {"code": -32601, "message": f"no method {method}"}
        except Exception as error:  # one bad request must not end the server
            answer["error"] = {"code": -32000, "message": str(error)}
        print(json.dumps(answer), file=out, flush=True)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "update"):
        q = sub.add_parser(name)
        q.add_argument("repository")
        q.add_argument("--ignore", action="append", default=[])
        q.add_argument("--cluster", action="store_true")
        q.add_argument("--embed", action="store_true")
        q.add_argument("--json", help="write nodes and edges as JSON lines to this folder of any store")
        q.add_argument("--out", help="write one JSON document to this local file, - for standard output")
        q.add_argument("--pretty", action="store_true", help="indent the JSON document")
        q.add_argument("--stats", action="store_true")
    for name in ("cluster", "clear", "embed", "serve"):
        sub.add_parser(name)
    sub.choices["clear"].add_argument("--all", action="store_true", help="the whole store, not the communities alone")
    q = sub.add_parser("tool")
    q.add_argument("name", choices=TOOLS)
    q.add_argument("arguments", nargs="?", default="{}", help="JSON")
    for q in sub.choices.values():
        q.add_argument("--store", required=True)
    a = p.parse_args(argv)
    spark = session()
    if a.command in ("index", "update"):
        root, url = resolve_source(spark, a.repository)
        store = index.Store(spark, a.store)
        if a.command == "index":
            index.full(spark, root, store, tuple(a.ignore), url)
        else:
            mode, n = index.update(spark, root, store, tuple(a.ignore))
            print("already up to date" if mode == "current" else f"{mode} delta: {n} files extracted", file=sys.stderr)
        graph = CodeGraph(spark, a.store)
        if graph._index() is None:
            graph.index_text()
        if a.stats:
            print(render.table(graph.get_overview()["kinds"]), file=sys.stderr)
        if a.json:
            graph.nodes.write.mode("overwrite").json(f"{a.json}/nodes")
            graph.edges.write.mode("overwrite").json(f"{a.json}/edges")
        if a.out:
            with contextlib.nullcontext(sys.stdout) if a.out == "-" else open(a.out, "w", encoding="utf-8") as f:
                render.document({"nodes": graph.nodes, "edges": graph.edges}, f, a.pretty)
        failed = int(graph.store.meta()["failed"])
        if failed:
            print(f"{failed} files could not be read; see the table raw_failures", file=sys.stderr)
        if a.cluster:
            print(render.table(graph.cluster()))
        if a.embed:
            print(graph.embed())
        return 0
    graph = CodeGraph(spark, a.store)
    if a.command == "cluster":
        print(render.table(graph.cluster()))
    elif a.command == "clear":
        graph.store.clear() if a.all else graph.clear_clusters()
    elif a.command == "embed":
        print(graph.embed())
    elif a.command == "serve":
        serve(graph)
    else:
        print(call(graph, a.name, json.loads(a.arguments)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
