"""Command line: ``python -m skein.plans.cli VERB ...``; ``serve`` answers the same verbs over HTTP, ``mcp`` over standard streams."""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from skein.operators import compile as compiler
from skein.plans import mcp, render
from skein.plans.service import Service
from skein.sources import projects, store

WAREHOUSE = os.path.expanduser("~/.skein")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    p.add_argument("--project", default=".")
    p.add_argument("--warehouse", default=WAREHOUSE)
    v = p.add_subparsers(dest="verb", required=True)
    for name in ("index", "languages", "stats"):
        v.add_parser(name)
    init = v.add_parser("init")
    init.add_argument("--languages", default="")
    init.add_argument("--yes", action="store_true")
    context = v.add_parser("context")
    context.add_argument("prompt")
    benchmark = v.add_parser("benchmark")
    benchmark.add_argument("tasks")
    for x in (context, benchmark):
        x.add_argument("--budget", type=int, default=compiler.DEFAULT_BUDGET)
        x.add_argument("--ranks", default="", help="file of (base64, rank) lines that counts tokens; without it a token is four bytes")
    context.add_argument("--session", default="")
    context.add_argument("--file", default="")
    for name in ("find", "inspect", "related", "source", "similar"):
        x = v.add_parser(name)
        x.add_argument("name")
        x.add_argument("--file", default="")
        x.add_argument("--depth", type=int, default=2)
    impact = v.add_parser("impact")
    impact.add_argument("name", nargs="?")
    impact.add_argument("--git-diff", nargs="?", const="HEAD")
    path = v.add_parser("path")
    path.add_argument("start")
    path.add_argument("target")
    duplicates = v.add_parser("duplicates")
    duplicates.add_argument("--min", type=float, default=0.0)
    decide = v.add_parser("decide")
    for name in ("a", "b", "decision"):
        decide.add_argument(name)
    project = v.add_parser("project")
    project.add_argument("action", choices=("add", "list", "remove"))
    project.add_argument("name", nargs="?")
    project.add_argument("path", nargs="?")
    v.add_parser("mcp")
    serve = v.add_parser("serve")
    serve.add_argument("--port", type=int, default=7777)
    return p


def run(args: argparse.Namespace, spark) -> str:
    registry = store.Projects(f"{args.warehouse}/projects.json")
    if args.verb == "project":
        if args.action == "add":
            registry.add(args.name, args.path or ".")
        elif args.action == "remove":
            registry.remove(args.name)
        return "\n".join(f"{n}  {p}" for n, p in registry.list())
    s = Service(spark, os.path.abspath(registry.resolve(args.project)), args.warehouse)
    match args.verb:
        case "init":
            chosen = sorted(filter(None, args.languages.split(","))) or [x for x, found, _ in s.languages() if found]
            projects.save_settings(s.root, projects.load_settings(s.root) | {"languages": chosen})
            return ", ".join(chosen)
        case "languages":
            return "\n".join(f"{x}  detected={d}  enabled={e}" for x, d, e in s.languages())
        case "index":
            return render.stats_text(s.index())
        case "stats":
            return render.stats_text(s.stats())
        case "context":
            return render.capsule_text(s.context(args.prompt, args.budget, args.session, args.file, compiler.counter(args.ranks)))
        case "find":
            return render.entities_text(s.find(args.name))
        case "inspect":
            got = s.inspect(args.name, args.file)
            return render.inspection_text(got["entity"], got["fan_in"], got["fan_out"])
        case "related":
            return render.related_text(s.related(args.name, args.depth, args.file), s.entities())
        case "source":
            return s.source(args.name, args.file)
        case "similar":
            return render.pairs_text(s.similar(args.name, args.file))
        case "impact" if args.git_diff:
            return render.diff_impact_text(s.impact_of_diff(args.git_diff), s.entities())
        case "impact":
            return render.impact_text(s.impact(args.name), s.entities())
        case "path":
            return render.path_text(args.start, s.path(args.start, args.target), s.entities())
        case "duplicates":
            return render.pairs_text(s.duplicates(args.min))
        case "benchmark":
            return render.benchmark_text(*s.benchmark(args.tasks, args.budget, compiler.counter(args.ranks)))
        case "decide":
            s.decide(args.a, args.b, args.decision)
            return "saved"
    raise ValueError(args.verb)


def handler(services: Callable[[], dict[str, Service]], operations: Callable[[], list[dict]] = list) -> type[BaseHTTPRequestHandler]:
    """The read endpoints (and ``decide`` by POST) of the projects that ``services()`` gives; ``?project=`` picks one, else the first by name."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body: str) -> None:
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(body.encode())

        def service(self, q: dict[str, str]) -> Service:
            known = services()
            name = q.get("project") or min(known, default="")
            if name not in known:
                raise LookupError(f"no project {name!r}")
            return known[name]

        def do_GET(self) -> None:
            at = urlsplit(self.path)
            q = {k: v[0] for k, v in parse_qs(at.query).items()}
            name, file = q.get("name", ""), q.get("file", "")
            verbs = {
                "projects": lambda _: sorted(services()), "operations": lambda _: operations(), "stats": lambda s: s.stats(),
                "find": lambda s: s.find(name), "suggest": lambda s: s.suggest(q.get("q", ""), q.get("kind"), int(q.get("limit", 8))),
                "inspect": lambda s: {k: v.asDict(True) if k == "entity" else [r.asDict(True) for r in v.collect()] for k, v in s.inspect(name, file).items()},
                "related": lambda s: s.related(name, int(q.get("depth", 2)), file), "impact": lambda s: s.impact(name, file),
                "source": lambda s: s.source(name, file), "path": lambda s: s.path(q.get("from", ""), q.get("to", "")),
                "duplicates": lambda s: s.duplicates(float(q.get("min", 0))), "similar": lambda s: s.similar(name, file),
                "graph": lambda s: {k: [r.asDict(True) for r in d.collect()] for k, d in zip(("entities", "edges"), s.whole_graph(), strict=True)},
                "context": lambda s: s.context(q.get("prompt", ""), int(q.get("budget", 2500)), q.get("session", "")),
            }
            verb = verbs.get(at.path.strip("/").removeprefix("api/"))
            if verb is None:
                return self.answer(404, '{"error": "no such endpoint"}')
            try:
                alone = at.path.endswith(("projects", "operations"))
                self.answer(200, render.to_json(verb(None if alone else self.service(q))))
            except (LookupError, ValueError) as e:
                self.answer(400, render.to_json({"error": str(e)}))

        def do_POST(self) -> None:
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                self.service(q).decide(body["a"], body["b"], body["decision"])
                self.answer(200, '{"saved": true}')
            except (LookupError, ValueError) as e:
                self.answer(400, render.to_json({"error": str(e)}))

        def log_message(self, *args) -> None:
            pass

    return Handler


def main(argv: list[str] | None = None) -> int:
    from skein.session import local_session

    args = parser().parse_args(argv)
    spark = None if args.verb == "project" else local_session("*")
    if args.verb == "mcp":
        mcp.serve(Service(spark, os.path.abspath(args.project), args.warehouse))
        return 0
    if args.verb == "serve":  # all registered projects, watched
        from skein.streaming.watch import Supervisor

        everything = Supervisor(spark, args.warehouse, store.Projects(f"{args.warehouse}/projects.json"))
        threading.Thread(target=everything.run, daemon=True).start()
        ThreadingHTTPServer(("127.0.0.1", args.port), handler(everything.snapshot, everything.operations)).serve_forever()
    print(run(args, spark))
    return 0


if __name__ == "__main__":
    sys.exit(main())
