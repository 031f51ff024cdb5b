"""Watching, supervision, HTTP and tool calls over one small project."""

import json
import threading
import time
import urllib.request
from http.server import ThreadingHTTPServer

import pytest

from skein.plans import cli, mcp
from skein.plans.service import Service
from skein.sources.store import Projects
from skein.streaming.watch import Debouncer, Status, Supervisor, limited, listing, watch


def test_debouncer():
    now = [0.0]
    d = Debouncer(0.3, lambda: now[0])
    d.add(["a"])
    assert d.take() == []
    now[0] = 0.2
    d.add(["b", "a"])
    now[0] = 0.4
    assert d.take() == []
    now[0] = 0.6
    assert d.take() == ["a", "b"] and d.take() == []


def test_watch_retries(tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/b.py").write_text("")
    assert list(listing(str(tmp_path))) == ["a.py"]
    seen, status = [], Status("p", str(tmp_path))

    def update(paths):
        seen.append(paths)
        if len(seen) == 1:
            raise OSError("once")

    t = threading.Thread(target=watch, args=(status, update, 0.05, 0.02), daemon=True)
    t.start()
    time.sleep(0.2)
    (tmp_path / "a.py").write_text("x = 22\n")
    for _ in range(100):
        if status.updates:
            break
        time.sleep(0.05)
    status.stop.set()
    assert seen[0] == ["a.py"] == seen[1] and status.errors == 1 and "once" in status.last_error


def test_supervisor_follows_the_registry(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Service, "index", lambda self: None)
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    registry = Projects(str(tmp_path / "projects.json"))
    s = Supervisor(spark, str(tmp_path / "w"), registry)
    registry.add("x", str(tmp_path / "one"))
    assert s.reconcile() == {"x": "start"} and s.reconcile() == {}
    registry.add("x", str(tmp_path / "two"))
    assert s.reconcile() == {"x": "restart"} and s.operations()[0]["root"].endswith("two")
    registry.remove("x")
    assert s.reconcile() == {"x": "stop"} and s.snapshot() == {}


def test_index_limit(spark):
    slow = spark.range(1 << 40).selectExpr("sum(hash(id)) AS s")
    began = time.time()
    with pytest.raises(TimeoutError):
        limited(spark, 1.0, slow.collect)
    assert time.time() - began < 30 and limited(spark, 30, spark.range(5).count) == 5
    with pytest.raises(ZeroDivisionError):
        limited(spark, 30, lambda: 1 / 0)


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("surface") / "repo"
    root.mkdir()
    (root / "a.py").write_text("def low():\n    return 1\n\ndef high():\n    return low()\n")
    s = Service(spark, str(root), str(tmp_path_factory.mktemp("w")))
    s.index()
    return s


def test_http(service):
    server = ThreadingHTTPServer(("127.0.0.1", 0), cli.handler(lambda: {"p": service}))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path: json.load(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/{path}"))
    assert get("projects") == ["p"] and get("stats")["entities"] == 2
    assert [r["name"] for r in get("suggest?q=lo")] == ["low"]
    assert get("impact?name=low")[0]["depth"] == 1 and get("source?name=low").startswith("def low")
    with pytest.raises(urllib.error.HTTPError):
        get("inspect?name=none")
    body = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/api/decide", json.dumps({"a": "1", "b": "2", "decision": "duplicate"}).encode())
    assert json.load(urllib.request.urlopen(body)) == {"saved": True}
    server.shutdown()


def test_tools(service):
    ask = lambda method, **params: mcp.answer(service, {"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert len(ask("tools/list")["result"]["tools"]) == 12 and mcp.answer(service, {"method": "notifications/initialized"}) is None
    found = ask("tools/call", name="context_find", arguments={"name": "high"})["result"]
    assert json.loads(found["content"][0]["text"])[0]["name"] == "high" and not found["isError"]
    assert ask("tools/call", name="context_source", arguments={"name": "none"})["result"]["isError"]
    assert "error" in ask("nothing")


def test_command_line(service, spark, tmp_path):
    args = lambda *a: cli.parser().parse_args(["--project", service.root, "--warehouse", str(tmp_path), *a])
    assert "2 entities" in cli.run(args("index"), spark)
    assert "a.py#low" in cli.run(args("find", "low"), spark)
    assert cli.run(args("context", "call low"), spark).splitlines()[0].endswith("items")
    cli.run(args("project", "add", "one", str(tmp_path)), None)
    assert cli.run(args("project", "list"), None) == f"one  {tmp_path}"


BODY = "def {}(a, b):\n    total = 0\n    for x in a:\n        if x > b:\n            total = total + x * 2\n    return total{}\n\n"


def test_renderers_and_benchmark(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "one.py").write_text(BODY.format("sum_big", "") + "def low():\n    return 1\n\ndef high():\n    return low()\n\ndef test_high():\n    high()\n")
    (root / "two.py").write_text(BODY.format("sum_large", " + 1"))
    args = lambda *a: cli.parser().parse_args(["--project", str(root), "--warehouse", str(tmp_path / "w"), *a])
    run = lambda *a: cli.run(args(*a), spark)
    run("index")
    assert run("inspect", "low").splitlines()[0] == "Function one.py#low  one.py:8-9"
    assert run("impact", "low").splitlines() == ["1  one.py#high  direct", "2  one.py#test_high  test", "2 impacted, 1 tests"]
    assert run("path", "low", "test_high").splitlines() == ["low", "  1. CALLS one.py#high", "  2. CALLS one.py#test_high"]
    assert run("related", "low").splitlines()[0] == "1  Function  one.py#high  one.py  11"
    pair = run("similar", "sum_big").split()
    assert pair[1] == "near" and {pair[2], pair[4]} == {"one.py#sum_big", "two.py#sum_large"} and 0.3 <= float(pair[0]) < 1
    run("decide", pair[-2], pair[-1], "intentional")
    assert run("similar", "sum_big") == "" and run("duplicates", "--min", "0.1") == ""
    tasks = [{"id": "t1", "prompt": "change low", "gold_files": ["one.py"], "grep_steps": [{"pattern": "low", "note": ""}]}, {"id": "t2", "prompt": "sum large", "gold_files": ["two.py", "none.py"], "grep_steps": []}]
    (tmp_path / "tasks.json").write_text(json.dumps({"fixture": "f", "tasks": tasks}))
    lines = run("benchmark", str(tmp_path / "tasks.json")).splitlines()
    assert [x.split()[:2] for x in lines[:2]] == [["t1", "1.0"], ["t2", "0.5"]] and lines[-1].startswith("recall 0.75, precision ")
