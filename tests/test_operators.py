"""Operators against plain Python on small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import identity
from skein.functions import text as T
from skein.operators import aggregate, graph, search, similar
from skein.operators import compile as compiler
from skein.streaming.changes import debounce


def test_identity(spark):
    row = spark.createDataFrame([("r", "Function", "f#g", "")], "a string, b string, c string, d string")
    got = row.select(identity.entity_id(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert got == identity.py_entity_id("r", "Function", "f#g")
    assert len(got) == 16


def test_text_functions(spark):
    one = spark.range(1)
    assert one.select(T.split_camel(F.lit("punchRestrictionHTTP"))).first()[0] == ["punch", "Restriction", "HTTP"]
    assert one.select(T.task_terms(F.lit("fix redWidget"))).first()[0] == ["fix", "fix", "redwidget", "red", "widget"]
    words = {"articles": "articl", "policies": "policy", "running": "runn", "passes": "pass", "glass": "glass", "tied": "tied"}
    assert {w: one.select(T.stem(F.lit(w))).first()[0] for w in words} == words | {"policies": "policy"}
    assert one.select(T.lines_of(F.lit("a\nb\nc"), F.lit(2), F.lit(3))).first()[0] == "b\nc\n"
    assert one.select(T.symbol_path(F.lit("f#g#h"))).first()[0] == "g#h"


def bfs(edges, start, undirected, depth):
    near = {}
    for a, b in edges:
        near.setdefault(b, set()).add(a)
        if undirected:
            near.setdefault(a, set()).add(b)
    seen, at = {start: 0}, [start]
    for d in range(1, depth + 1):
        at = [y for x in at for y in near.get(x, ()) if y not in seen and not seen.update({y: d})]
    return {k: v for k, v in seen.items() if v}


@pytest.mark.parametrize("undirected,depth", [(True, 2), (False, 0)])
def test_walks(spark, undirected, depth):
    random.seed(4)
    pairs = [(f"n{random.randrange(30)}", f"n{random.randrange(30)}") for _ in range(45)] + [("x", "y"), ("y", "z"), ("z", "x")]
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], "src string, dst string, kind string")
    ids = sorted({x for p in pairs for x in p})
    entities = spark.createDataFrame([(i,) for i in ids], "entity_id string")
    starts = entities.where(F.col("entity_id").isin("n1", "n2", "x"))
    run = graph.related if undirected else graph.upstream
    got = {}
    for r in run(entities, edges, starts, depth).collect():
        got.setdefault(r.start_id, {})[r.entity_id] = r.depth
        assert {r.via.src, r.via.dst} & {r.entity_id}
    plain = [(a, b) for a, b in pairs if a != b]
    assert got == {s: w for s in ("n1", "n2", "x") if s in ids and (w := bfs(plain, s, undirected, depth or 99))}


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b", "K"), ("c", "b", "K"), ("c", "d", "K")], "src string, dst string, kind string")
    entities = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "entity_id string")
    assert [(r.depth, r.entity_id) for r in graph.shortest_path(entities, edges, "a", "d").orderBy("depth").collect()] == [(1, "b"), (2, "c"), (3, "d")]
    assert graph.shortest_path(entities, edges, "a", "a").count() == 0
    assert graph.shortest_path(entities, edges, "a", "e").count() == 0


def test_hunks(spark):
    lines = ["+++ b/a.go", "@@ -1 +11,3 @@", "@@ -2 +28 @@ f", "@@ -3,2 +5,0 @@", "+++ /dev/null", "@@ -1 +0,0 @@", "+++ b/c.go", "@@ -1 +1 @@"]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "diff_id int, pos int, line string")
    assert sorted((r.file, r.s, r.e) for r in graph.diff_hunks(df).collect()) == [("a.go", 5, 5), ("a.go", 11, 13), ("a.go", 28, 28), ("c.go", 1, 1)]


def test_removal(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c")], "src string, dst string")
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    e, k = graph.remove_entities(entities, edges, entities.where("entity_id = 'a'"))
    assert e.count() == 2 and k.count() == 2 and graph.drop_dangling(e, k).count() == 1


def test_knapsack_brute_force():
    random.seed(2)
    for _ in range(60):
        n = random.randrange(1, 9)
        costs, values, room = [random.randrange(0, 12) for _ in range(n)], [random.random() for _ in range(n)], random.randrange(0, 30)
        picked = compiler.knapsack(costs, values, room)
        assert sum(costs[i] for i in picked) <= room and picked == sorted(picked, reverse=True)
        best = max(sum(values[i] for i in s) for k in range(n + 1) for s in itertools.combinations(range(n), k) if sum(costs[i] for i in s) <= room)
        if sum(costs) and room:
            assert sum(values[i] for i in picked) == pytest.approx(best)
        else:
            assert picked == []


def test_budget_monotone(spark):
    rows = [("t", f"e{i}", "primary" if i % 2 else "related", i, 10.0 / (i + 1), 3 + i % 4) for i in range(12)]
    df = spark.createDataFrame(rows, "task string, entity_id string, category string, rank int, score double, tokens int")
    totals = [compiler.budgeted(df, b).agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0] for b in (0, 10, 20, 40)]
    assert totals == sorted(totals) and totals[0] == 0


def test_similarity_stream():
    assert similar.tokenize("f(a) // x\n + 1.5 'q\\'r'") == ["f", "(", "a", ")", "+", "NUM", "STR"]
    assert similar.normalize(["foo", "(", "bar", "foo", "return"]) == ["ID1", "(", "ID2", "ID1", "return"]
    assert len(similar.shingle_hashes(list("abcdefg"))) == 3 and len(similar.shingle_hashes(["a"])) == 1


def test_renamed_body_is_found(spark):
    body = "func total(items) { let sum = 0; for (const x of items) { if (x.price > 3) { sum += x.price * x.count; } } return sum; }"
    renamed = body.replace("total", "weigh").replace("items", "boxes").replace("sum", "acc")
    other = "class A { open() { while (true) { try { this.socket.read(); } catch (e) { throw new Error(e); } } return null; } }"
    rows = [("a", "h1", body), ("b", "h2", renamed), ("c", "h1", body), ("d", "h3", other), ("e", "h4", "f() {}"), ("n", "h5", None)]
    bodies = spark.createDataFrame(rows, "entity_id string, content_hash string, body string")
    edges = spark.createDataFrame([], "src string, dst string, kind string")
    names = spark.createDataFrame([], "entity_id string, name string")
    got = {(r.a, r.b, r.exact) for r in similar.find_pairs(bodies, edges, names).collect()}
    assert got == {("a", "c", True), ("a", "b", False)}


def test_search(spark):
    rows = [("1", "Class", "Order", "a#Order", "a"), ("2", "Method", "orderBy", "a#X.orderBy", "a"), ("3", "Class", "preorder", "b#preorder", "b"), ("4", "Class", "Order", "c#Order", "c")]
    e = spark.createDataFrame(rows, "entity_id string, kind string, name string, qualified string, file string")
    assert [(r.entity_id, r.tier) for r in search.suggest(e, " ORDER ").collect()] == [("1", 0), ("4", 0), ("2", 1), ("3", 2)]
    assert search.suggest(e, "  ").count() == 0 and search.suggest(e, "order", "Class", 0).count() == 3
    assert search.find_unique(e, "Order", "c").entity_id == "4"
    with pytest.raises(search.NotUnique):
        search.find_unique(e, "Order")
    assert search.find(e, "c#Order").count() == 1


def test_aggregates(spark):
    counts = spark.createDataFrame([("resolved", 3), ("bug-resolver", 1)], "disposition string, n long")
    assert aggregate.bug_rate(counts).first()[0] == 0.25 and aggregate.bug_rate(counts.limit(0)).first()[0] == 0.0
    seen = spark.createDataFrame([("f", "a", "T"), ("f", "a", "T"), ("f", "b", "T"), ("f", "b", "U")], "file string, var string, type string")
    assert [(r["var"], r["type"]) for r in aggregate.agreed_types(seen).collect()] == [("a", "T")]


def test_baseline(spark):
    files = spark.createDataFrame([("a", "one two\nthree"), ("b", "two")], "path string, text string")
    gold = spark.createDataFrame([("t", "a"), ("t", "a"), ("u", "b")], "task string, file string")
    steps = spark.createDataFrame([("t", "tw.")], "task string, pattern string")
    got = {r.task: (r.oracle, r.traced) for r in aggregate.baseline_tokens(gold, steps, files, F.length).collect()}
    assert got == {"t": (13, 13 + len("a:1: one two\n") + len("b:1: two\n")), "u": (3, 3)}
    assert aggregate.estimator_ratio(files, F.length, F.length).first()[0] == 1.0
    rows = spark.createDataFrame([("x", "1"), ("x", "1"), ("y", "2")], "entity_id string, content_hash string")
    assert aggregate.same_entities(rows, rows) and not aggregate.same_entities(rows, rows.distinct())


def test_tiktoken_counter(spark):
    import public_tokenizers

    count = compiler.tiktoken_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert spark.createDataFrame([("hello world",), (None,)], "t string").select(count(F.col("t"))).collect() == [(2,), (0,)]


def test_debounce(spark):
    rows = [("p", "2024-01-01 00:00:00.0", "a"), ("p", "2024-01-01 00:00:00.2", "b"), ("p", "2024-01-01 00:00:01.0", "a")]
    df = spark.createDataFrame(rows, "project string, ts string, path string").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.events, r.paths) for r in debounce(df).orderBy("began").collect()] == [(2, ["a", "b"]), (1, ["a"])]


def test_stream(spark, tmp_path):
    from skein.streaming.changes import change_stream, run_incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("x = 1\n")
    seen = []
    q = run_incremental(change_stream(spark, str(tmp_path / "in"), "*.py"), lambda df, i: seen.extend(r.path for r in df.select("path").collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert len(seen) == 1


def test_pairs_of_a_copy(spark):
    """A copy has its representative's near pairs, with all copies of the partner, and its whole class."""
    rows = [("r", "c1", True, 1.0), ("r", "c2", True, 1.0), ("p", "p1", True, 1.0), ("p", "r", False, 0.7), ("x", "y", False, 0.9)]
    pairs = spark.createDataFrame([(a, b, e, s, s, s) for a, b, e, s in rows], "a string, b string, exact boolean, structural double, behavioral double, overall double")
    got = lambda e: [(r.a, r.b, r.overall) for r in similar.involving(pairs, e).collect()]
    assert sorted(got("c1")) == [("c1", "c2", 1.0), ("c1", "p", 0.7), ("c1", "p1", 0.7), ("c1", "r", 1.0)]
    assert sorted(got("r")) == [("c1", "r", 1.0), ("c2", "r", 1.0), ("p", "r", 0.7), ("p1", "r", 0.7)]
    assert sorted(got("p1")) == [("c1", "p1", 0.7), ("c2", "p1", 0.7), ("p", "p1", 1.0), ("p1", "r", 0.7)] and got("y") == [("x", "y", 0.9)]


def test_long_chains(spark):
    """Closures and paths go on beyond the hops after which what was seen is written anew."""
    n = 20
    entities = spark.createDataFrame([(f"e{i}",) for i in range(n)], "entity_id string")
    edges = spark.createDataFrame([(f"e{i}", f"e{i + 1}", "CALLS") for i in range(n - 1)], "src string, dst string, kind string")
    found = {r.entity_id: r.depth for r in graph.upstream(entities, edges, entities.where("entity_id = 'e19'")).collect()}
    assert found == {f"e{i}": n - 1 - i for i in range(n - 1)}
    path = graph.shortest_path(entities, edges, "e0", "e19").orderBy("depth").collect()
    assert [(r.depth, r.entity_id, r.via.src) for r in path] == [(i, f"e{i}", f"e{i - 1}") for i in range(1, n)]
