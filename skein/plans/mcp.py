"""The service's verbs as tools of the Model Context Protocol: JSON-RPC, one message a line, over standard streams."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from skein.plans import render
from skein.plans.service import Service


def _tool(description: str, **fields: str) -> dict:
    kinds = {k: {"type": v.rstrip("?")} for k, v in fields.items()}
    return {"description": description, "inputSchema": {"type": "object", "properties": kinds, "required": [k for k, v in fields.items() if not v.endswith("?")]}}


TOOLS = {
    "context_index": _tool("Index the repository"),
    "context_compile": _tool("Compile a task's context under a token budget", prompt="string", budget="integer?", session="string?", file="string?"),
    "context_find": _tool("Find entities by exact name", name="string"),
    "context_inspect": _tool("An entity with what uses it and what it uses", name="string", file="string?"),
    "context_related": _tool("Neighbours of an entity", name="string", depth="integer?", file="string?"),
    "context_source": _tool("An entity's source", name="string", file="string?"),
    "context_impact": _tool("What depends on an entity, or on a diff", name="string?", diff="string?"),
    "context_stats": _tool("Figures of the snapshot"),
    "context_path": _tool("Shortest path between two entities", start="string", target="string"),
    "context_similar": _tool("Bodies similar to an entity's", name="string", file="string?"),
    "context_duplicates": _tool("Undecided near-duplicate pairs", min="number?"),
    "context_decide": _tool("Decide a pair", a="string", b="string", decision="string"),
}


def call(s: Service, name: str, a: dict) -> str:
    file = a.get("file", "")
    verbs: dict[str, Callable[[], object]] = {
        "context_index": s.index,
        "context_compile": lambda: render.capsule_text(s.context(a["prompt"], int(a.get("budget", 2500)), a.get("session", ""), file)),
        "context_find": lambda: s.find(a["name"]),
        "context_inspect": lambda: {k: v.asDict(True) if k == "entity" else [r.asDict(True) for r in v.collect()] for k, v in s.inspect(a["name"], file).items()},
        "context_related": lambda: s.related(a["name"], int(a.get("depth", 2)), file),
        "context_source": lambda: s.source(a["name"], file),
        "context_impact": lambda: s.impact(a["name"]) if a.get("name") else s.impact_of_diff(a.get("diff", "HEAD"))["impacted"],
        "context_stats": s.stats,
        "context_path": lambda: s.path(a["start"], a["target"]),
        "context_similar": lambda: s.similar(a["name"], file),
        "context_duplicates": lambda: s.duplicates(float(a.get("min", 0))),
        "context_decide": lambda: s.decide(a["a"], a["b"], a["decision"]) or "saved",
    }
    got = verbs[name]()
    return got if isinstance(got, str) else render.to_json(got)


def answer(s: Service, message: dict) -> dict | None:
    """The reply to one message; none to a notification."""
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "skein", "version": "1"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, **t} for n, t in TOOLS.items()]}}
    if method == "tools/call" and params.get("name") in TOOLS:
        try:
            text, failed = call(s, params["name"], params.get("arguments") or {}), False
        except (LookupError, ValueError, OSError) as e:
            text, failed = f"{type(e).__name__}: {e}", True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}


def serve(s: Service, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
    for line in lines:
        if line.strip():
            got = answer(s, json.loads(line))
            if got is not None:
                print(json.dumps(got), file=out, flush=True)
