"""Extraction, resolution, snapshot and incremental update on a small polyglot tree."""

import pytest
from pyspark.sql import functions as F

from skein.operators.extract import facts_of
from skein.operators.resolve import Config, import_paths, reachable_projects, ts_alias
from skein.plans.service import Service
from skein.sources import store

TREE = {
    "go.mod": "module example.com/x\n",
    "tsconfig.json": '{ // aliases\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}} }',
    "src/models/user.ts": "export class User { greet() { return 1; } }\nexport interface Named { name: string }\n",
    "src/models/index.ts": "export * from './user';\n",
    "src/util.ts": "export function fmt(a) { return a; }\n",
    "src/service.ts": (
        "import { User, Named } from './models';\nimport * as util from '@/util';\nimport express from 'express';\nimport { User as Direct } from './models/user';\n"
        "export class Service extends Base implements Named {\n  private user: Direct = new Direct();\n"
        "  run() { this.user.greet(); this.helper(); util.fmt(1); util.nope(); express(); missing(); unknown.call(); }\n  helper() { return local(); }\n}\n"
        "function local() { return 1; }\n"
    ),
    "pkg/a.go": 'package pkg\nimport ("fmt"; "example.com/x/pkg/store")\ntype S struct { db *store.DB }\nfunc (s *S) Do() { s.db.Query(); fmt.Println(1); store.Open(); helper(); nosuch() }\n',
    "pkg/b.go": "package pkg\nfunc helper() int { return 1 }\n",
    "pkg/b_test.go": "package pkg\nfunc TestHelper(t int) { helper() }\n",
    "pkg/store/db.go": "package store\ntype DB struct { n int }\nfunc (d *DB) Query() int { return 1 }\nfunc Open() *DB { return &DB{} }\n",
    "app/models.py": "class Repo:\n    def save(self): return 1\n",
    "app/svc.py": (
        "from .models import Repo\nfrom .gone import Nope\nimport json\nclass Svc:\n    def __init__(self, r: Repo): self.r = r\n"
        "    def go(self): self.r.save(); json.dumps(1); self.stop(); Nope(); print(1)\n    def stop(self): pass\ndef test_go(): Svc(1).go()\n"
    ),
    "node_modules/x/index.ts": "export function hidden() {}\n",
    "broken.ts": "((((((([[[[[{{{{ a b\n",
}


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "repo"
    for name, text in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    s = Service(spark, str(root), str(tmp_path_factory.mktemp("warehouse")))
    s.first = s.index()
    return s


def named_edges(s):
    snap = s.snapshot()
    names = snap.entities.select("entity_id", "name").dropDuplicates(["entity_id"])
    joined = snap.edges.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
    return sorted((r.a, r.kind, r.b) for r in joined.collect())


def test_edges_and_dispositions(service):
    assert named_edges(service) == sorted([
        ("Service", "IMPLEMENTS", "Named"), ("helper", "CALLS", "local"), ("run", "CALLS", "helper"), ("run", "CALLS", "fmt"), ("run", "CALLS", "greet"),
        ("Do", "CALLS", "Query"), ("Do", "CALLS", "Open"), ("Do", "CALLS", "helper"), ("TestHelper", "CALLS", "helper"),
        ("go", "CALLS", "save"), ("go", "CALLS", "stop"), ("test_go", "CALLS", "Svc"),
    ])
    d = service.first["dispositions"]
    assert d["bug-resolver"] == 1 and d["bug-extractor"] == 2 and d["unimplemented"] == 1
    assert service.first["failed_files"] == 1
    assert service.find("hidden").count() == 0


def test_reads(service):
    assert {r.entity_id for r in service.impact("Query").collect()} == {r.entity_id for r in service.find("Do").collect()}
    tests = service.impact("helper", "pkg/").where("is_test")
    assert tests.count() == 1
    assert service.source("local") == "function local() { return 1; }\n"
    assert service.path("run", "local").count() == 2
    assert service.related("local", 1).count() == 1
    lines = service.spark.createDataFrame([(0, 0, "+++ b/pkg/b.go"), (0, 1, "@@ -2 +2 @@")], "diff_id int, pos int, line string")
    hit = service.impact_of_diff(lines=lines)
    assert [r.name for r in hit["changed"].collect()] == ["helper"] and hit["tests"].count() == 1


def test_context_session(service):
    first = service.context("service helper", 200, "s")
    second = service.context("service helper", 200, "s")
    handles = {r.entity_id: r.handle for r in first.collect()}
    assert all(handles.get(r.entity_id, r.handle) == r.handle for r in second.collect())
    both = second.join(first.select("entity_id"), "entity_id")
    assert both.agg(F.sum("tokens")).first()[0] < first.agg(F.sum("tokens")).first()[0]


def test_incremental_equals_full(service):
    import pathlib

    path = pathlib.Path(service.root, "src/util.ts")
    path.write_text("export function nope() { return other(1); }\nfunction other(a) { return a; }\n")
    assert service.update(["src/util.ts"])["changed"] == 1
    assert service.update(["src/util.ts"])["changed"] == 0
    state = lambda: (named_edges(service), sorted(tuple(r) for r in service.snapshot().table("dispositions").select("file", "disposition", "n").collect()))
    after = state()
    service.index()
    assert state() == after
    assert ("run", "CALLS", "nope") in after[0]


def test_snapshot_guards(spark, tmp_path):
    with pytest.raises(store.BadSnapshot):
        store.Snapshot(spark, str(tmp_path))
    (tmp_path / "CURRENT.json").write_text('{"format": 1, "version": "x"}')
    with pytest.raises(store.BadSnapshot):
        store.Snapshot(spark, str(tmp_path))


def test_state_files(spark, tmp_path):
    d = store.Decisions(str(tmp_path / "d.json"))
    d.decide("b", "a", "duplicate")
    d.decide("a", "b", "intentional")
    assert d.load() == {"a_b": "intentional"}
    with pytest.raises(ValueError):
        d.decide("a", "b", "maybe")
    p = store.Projects(str(tmp_path / "p.json"))
    p.add("one", str(tmp_path))
    p.remove("absent")
    assert p.list() == [("one", str(tmp_path))] and p.resolve("one") == str(tmp_path) and p.resolve("x") == "x"
    run = spark.createDataFrame([("a", "1"), ("b", "1")], "name string, root string")
    reg = spark.createDataFrame([("b", "2"), ("c", "3")], "name string, path string")
    assert {r.name: r.action for r in store.reconcile(run, reg).collect()} == {"a": "stop", "b": "restart", "c": "start"}


def test_import_paths():
    c = Config(go_module="m", ts_base=".", ts_paths={"@/*": ["src/*"], "@/deep/*": ["lib/*"]}, cs_projects=[("Core", "App.Core", []), ("Web", "App.Web", ["Core"]), ("Lone", "App.Lone", [])])
    assert ts_alias("@/deep/x", c) == "lib/x" and ts_alias("@/x", c) == "src/x"
    assert import_paths("a/b/c.py", "py", "..x.y", c, {})[1][0] == "a/x/y.py"
    assert import_paths("a.go", "go", "m/pkg", c, {}) == (True, ["pkg"]) and import_paths("a.go", "go", "fmt", c, {}) == (False, [])
    reach = reachable_projects(c)
    assert import_paths("Web/A.cs", "cs", "App.Core.Models", c, reach) == (True, ["Core/Models"])
    assert import_paths("Lone/A.cs", "cs", "App.Core.Models", c, reach) == (False, [])


def test_csharp_facts():
    source = (
        "using System; namespace N { public class OrderService : BaseService<Order>, IOrderService { private readonly IRepo _repo;\n"
        " public OrderService(IRepo repo) { _repo = repo; } public int Count { get; set; }\n [Fact] public void Works() => Place(null);\n"
        " public void Place(Order o) { var v = new Validator(); v.Check(o); _repo.Save(o); } } static class E { public static string Up(this Order o) { return o.Name(); } } }"
    )
    row = facts_of("r", "Svc/A.cs", "cs", source.encode())
    kinds = {(e["kind"], e["name"]) for e in row["entities"]}
    assert kinds == {("Class", "OrderService"), ("Method", "ctor"), ("Property", "Count"), ("Test", "Works"), ("Method", "Place"), ("Class", "E"), ("Method", "Up")}
    refs = {(r["kind"], r["name"], r["member"], r["receiver_type"]) for r in row["refs"]}
    assert {("extends", "BaseService", "", ""), ("call", "v", "Check", "Validator"), ("call", "_repo", "Save", "IRepo"), ("type_use", "Validator", "", "")} <= refs
    assert row["ext_methods"][0]["extended_type"] == "Order"


def test_typescript_shapes():
    source = (
        "const UserModel = mongoose.model('User', schema);\nModel.methods.toJSON = function (x) { return baz(x); };\n"
        "router.get('/users', auth, async (req, res) => { const e = req.body.email; req.query.page; });\n"
        "describe('thing', () => { it('works', () => { foo(); }); });\nconst { a, b: c } = require('q');\n"
    )
    row = facts_of("r", "a.ts", "ts", source.encode())
    assert {e["name"] for e in row["entities"]} == {"UserModel", "toJSON", "GET /users (email, page)", "thing", "works"}
    assert {(i["local_name"], i["imported_name"]) for i in row["imports"]} == {("a", "a"), ("c", "b")}


def test_bad_statements_cost_themselves_only():
    good = "".join(f"def f{i}(a):\n    return g(a) + {i}\n\n" for i in range(40))
    row = facts_of("r", "a.py", "py", (good + "print 'old'\n" + "def last():\n    return 'é'\n").encode())
    assert row["parse_error"] is None and 0 < row["error_ratio"] < 0.1 and len(row["entities"]) == 41
    last = row["entities"][-1]
    assert last["name"] == "last" and last["anchor"]["start_line"] == 122
    assert facts_of("r", "a.py", "py", b"def (:\n  x y z\n")["parse_error"]


def test_slow_files_are_given_up(monkeypatch):
    import time

    from skein.operators import extract

    monkeypatch.setattr(extract, "MOST_SECONDS", 0.05)
    monkeypatch.setitem(extract.EXTRACTORS, "py", lambda *_: time.sleep(5))
    assert "0.05 s" in facts_of("r", "a.py", "py", b"x = 1\n")["parse_error"]
    monkeypatch.undo()
    assert facts_of("r", "a.py", "py", b"")["parse_error"] is None
