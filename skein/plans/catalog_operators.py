"""Registered queries of single operators: ladder, rendering, baselines, pairs, dependencies, bookkeeping."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import aggregate, graph, resolve, search, similar
from skein.operators import compile as compiler
from skein.plans import tables
from skein.plans.catalog import RETRIEVAL, WITH, _scored
from skein.plans.registered import query
from skein.session import table
from skein.sources import store
from skein.storage import shared_dir

# --- context


@query("""
SELECT o_custkey AS task, CAST(o_orderkey AS VARCHAR) AS entity_id,
  CASE WHEN sent THEN 'name' WHEN o_orderkey % 2 = 0 THEN 'skeleton' ELSE 'signature' END AS level, sent AS already_sent
FROM (SELECT *, o_orderkey % 3 = 0 AND o_orderkey % 4 >= CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS sent FROM orders)
""")
def ladder_levels(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), key.cast("string").alias("entity_id"), F.when(key % 2 == 0, "primary").otherwise("related").alias("category"), key)
    ledger = orders.where(key % 3 == 0).select("task", "entity_id", (key % 4).cast("int").alias("level"))
    return compiler.with_levels(orders.drop("o_orderkey"), ledger).select("task", "entity_id", "level", "already_sent")


_LINE = r"regexp_replace({}, '\r$', '')"


@query(f"""
WITH d AS (SELECT doc_id, 'q' || CAST(doc_id AS VARCHAR) AS qualified, doc_id % 7 + 1 AS s, doc_id % 7 + 1 + doc_id % 5 AS e,
  CASE WHEN doc_id % 9 <> 0 THEN string_split(text, chr(10)) END AS lines FROM documents),
t AS (SELECT doc_id, qualified, CASE doc_id % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'signature' WHEN 2 THEN 'skeleton' ELSE 'body' END AS level, lines,
  regexp_replace({_LINE.format("coalesce(lines[s], '')")}, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g') AS head,
  array_to_string(list_transform(lines[s:e], lambda x: {_LINE.format("x")} || chr(10)), '') AS body FROM d)
SELECT CAST(doc_id AS VARCHAR) AS entity_id, level, sha256(CASE WHEN lines IS NULL OR level = 'name' THEN qualified || CASE WHEN level = 'skeleton' THEN '  ' ELSE '' END
  WHEN level = 'body' THEN body ELSE qualified || '  ' || head END) AS digest FROM t
""")
def rendered_items(spark, sf_dir):
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    level = F.when(key % 4 == 0, "name").when(key % 4 == 1, "signature").when(key % 4 == 2, "skeleton").otherwise("body")
    start = (key % 7 + 1).cast("int")
    entities = docs.select(
        key.cast("string").alias("entity_id"), F.concat(F.lit("q"), key.cast("string")).alias("qualified"), key.cast("string").alias("file"),
        start.alias("start_line"), (start + key % 5).cast("int").alias("end_line"),
    )
    files = docs.where(key % 9 != 0).select(key.cast("string").alias("path"), "text")
    shown = compiler.rendered(docs.select(key.cast("string").alias("entity_id"), level.alias("level")), entities, files)
    return shown.select("entity_id", "level", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))


@query("""
SELECT o_custkey AS task, count(*) AS considered, CAST(coalesce(sum(o_orderkey % 13) FILTER (WHERE o_orderkey % 3 = 0), 0) AS BIGINT) AS used,
       count(*) FILTER (WHERE o_orderkey % 3 = 0) AS chosen FROM orders GROUP BY 1
""")
def capsule_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), (F.col("o_orderkey") % 13).alias("tokens"), "o_orderkey")
    return compiler.usage(rows, rows.where("o_orderkey % 3 = 0"))


@query(f"""{RETRIEVAL} SELECT task, entity_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY task ORDER BY round(score, 9) DESC, entity_id) AS INTEGER) AS rank
FROM scores WHERE kind <> 'Test' AND kind IN ('part', 'orders') QUALIFY rank <= 7""")
def seeds_in_file(spark, sf_dir):
    e, scored = _scored(spark, sf_dir)
    return compiler.seeds(scored, e.where("kind IN ('part', 'orders')"), file_part=".tbl").withColumn("score", F.round("score", 6))


_PICK = """
  SELECT d.task, d.i + 1, list_transform(range({room} + 1), lambda c: CASE WHEN t.tokens <= c AND d.st[c - t.tokens + 1].v + t.score > d.st[c + 1].v
    THEN {{'v': d.st[c - t.tokens + 1].v + t.score, 'p': list_append(d.st[c - t.tokens + 1].p, t.i)}} ELSE d.st[c + 1] END)
  FROM {name} d JOIN items t ON t.task = d.task AND t.category = '{category}' AND t.i = d.i + 1"""
_START = "SELECT task, 0 AS i, list_transform(range({room} + 1), lambda c: {{'v': 0.0::DOUBLE, 'p': []::BIGINT[]}}) AS st FROM (SELECT DISTINCT task FROM items)"


def _capsule_sql(budget: int, first: int) -> str:
    """Both knapsacks by tables of (value, picks) per capacity; every capacity is kept, so what the first leaves is known to the second."""

    def steps(name: str, category: str, room: int) -> str:
        return f"{name}(task, i, st) AS ({_START.format(room=room)} UNION ALL {_PICK.format(room=room, name=name, category=category)})"

    return f"""{RETRIEVAL}, items AS MATERIALIZED (SELECT o_custkey AS task, CAST(o_orderkey AS VARCHAR) AS entity_id, CASE WHEN o_orderkey % 3 = 0 THEN 'primary' ELSE 'related' END AS category,
  CAST(o_orderkey % 11 AS BIGINT) AS tokens, CAST(o_orderkey * 7 % 16 AS DOUBLE) AS score, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 = 0 ORDER BY o_orderkey) AS i FROM orders),
{steps("a", "primary", first)}, {steps("b", "related", budget)},
a_end AS (SELECT task, arg_max(st, i) AS st FROM a GROUP BY task), b_end AS (SELECT task, arg_max(st, i) AS st FROM b GROUP BY task),
p AS (SELECT task, CASE WHEN (SELECT sum(tokens) FROM items x WHERE x.task = a_end.task AND category = 'primary') > 0 THEN st[{first} + 1].p ELSE [] END AS picks FROM a_end),
spent AS (SELECT p.task, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS spent FROM p LEFT JOIN items t ON t.task = p.task AND category = 'primary' AND list_contains(picks, t.i) GROUP BY 1),
q AS (SELECT b_end.task, CASE WHEN (SELECT sum(tokens) FROM items x WHERE x.task = b_end.task AND category = 'related') > 0 THEN st[{budget} - spent + 1].p ELSE [] END AS picks FROM b_end JOIN spent USING (task)),
chosen AS (SELECT t.task, entity_id, category, tokens, t.i FROM items t JOIN p ON p.task = t.task AND category = 'primary' AND list_contains(picks, t.i)
  UNION ALL SELECT t.task, entity_id, category, tokens, t.i FROM items t JOIN q ON q.task = t.task AND category = 'related' AND list_contains(picks, t.i))
SELECT task, entity_id, category, tokens, CAST(row_number() OVER (PARTITION BY task ORDER BY category, i DESC) AS INTEGER) AS place FROM chosen"""


@query(_capsule_sql(30, 18))
def capsules_budgeted(spark, sf_dir):
    """Two knapsacks for each customer over their orders; prices and values repeat, so that ties decide."""
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task"), key.cast("string").alias("entity_id"), F.when(key % 3 == 0, "primary").otherwise("related").alias("category"),
        (key % 11).alias("tokens"), (key * 7 % 16).cast("double").alias("score"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(key)).alias("rank"),
    )
    return compiler.budgeted(rows, 30).select("task", "entity_id", "category", "tokens", "place")


# --- evaluation

_STEPS = ("[a-z]+ing [a-z]+tion", "^The ", "ation")


@query(f"""
WITH gold AS (SELECT DISTINCT source AS task, d.doc_id, text FROM documents d JOIN labels USING (doc_id) WHERE quality = 1 AND source IS NOT NULL),
oracle AS (SELECT task, sum(octet_length(encode(text)) // 4) AS oracle FROM gold GROUP BY 1),
steps(task, pattern) AS (SELECT DISTINCT source, pattern FROM documents, (VALUES {", ".join(f"('{p}')" for p in _STEPS)}) v(pattern) WHERE source IS NOT NULL),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
hits AS (SELECT pattern, sum(octet_length(encode(CAST(doc_id AS VARCHAR) || ':' || CAST(n AS VARCHAR) || ': ' || line || chr(10))) // 4) AS k
  FROM lines, (VALUES {", ".join(f"('{p}')" for p in _STEPS)}) v(pattern) WHERE regexp_matches(line, pattern) GROUP BY 1),
found AS (SELECT task, sum(k) AS k FROM steps JOIN hits USING (pattern) GROUP BY 1)
SELECT task, CAST(oracle AS BIGINT) AS oracle, CAST(oracle + coalesce(k, 0) AS BIGINT) AS traced, (oracle + coalesce(k, 0))::DOUBLE / oracle AS ratio FROM oracle LEFT JOIN found USING (task)
""")
def baseline_cost(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    gold = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id").select(F.col("source").alias("task"), F.col("doc_id").cast("string").alias("file"))
    steps = docs.select(F.col("source").alias("task")).distinct().crossJoin(spark.createDataFrame([(p,) for p in _STEPS], "pattern string"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return aggregate.baseline_tokens(gold, steps, files, compiler.byte_quarters)


@query("""
SELECT avg(o_orderkey % 5 / 4.0) AS recall, avg(o_orderkey % 3 / 2.0) AS precision, CAST(sum(o_orderkey % 100) AS BIGINT) AS tokens,
  1 - sum(o_orderkey % 100)::DOUBLE / sum(400) AS reduction, 1 - sum(o_orderkey % 100)::DOUBLE / sum(400) >= 0.7 AND avg(o_orderkey % 5 / 4.0) >= 0.85 AS passed FROM orders
""")
def retrieval_summary(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((key % 5 / 4).alias("recall"), (key % 3 / 2).alias("precision"), (key % 100).alias("tokens"), F.lit(400).alias("baseline"))
    return aggregate.benchmark_summary(rows)


@query("""
SELECT user_id AS file, event_type || CAST(event_id % 50 // 2 AS VARCHAR) AS var, min('T' || CAST(event_id % 2 AS VARCHAR)) AS type FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_id % 2) = 1
""")
def agreed_var_types(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"), F.concat("event_type", F.floor(F.col("event_id") % 50 / 2).cast("string")).alias("var"), F.concat(F.lit("T"), (F.col("event_id") % 2).cast("string")).alias("type"),
    )
    return aggregate.agreed_types(seen)


@query("SELECT user_id AS file, event_type AS disposition, CASE WHEN user_id % 3 = 0 THEN 2 * count(*) ELSE count(*) END AS n FROM events GROUP BY 1, 2")
def counts_merged(spark, sf_dir):
    """Files counted again take their new counts, all others keep theirs."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("disposition"))
    again = rows.where("file % 3 = 0")
    return aggregate.merge_counts(aggregate.disposition_histogram(rows, ("file",)), aggregate.disposition_histogram(again.union(again), ("file",)), again.select("file"))


# --- similarity


#: Orders whose behaviours are compared in one place.
_BLOCK = 512


@query(f"""{WITH}, acts AS (SELECT src, list_distinct(list(e.kind || ':' || coalesce(t.name, dst))) AS act FROM edges e LEFT JOIN entities t ON t.entity_id = dst WHERE src LIKE 'orders:%' GROUP BY 1),
p AS (SELECT a.src AS a, b.src AS b, CAST(replace(a.src, 'orders:', '') AS BIGINT) % 101 / 100.0 AS s, len(list_intersect(a.act, b.act)) AS shared, len(list_distinct(list_concat(a.act, b.act))) AS every
  FROM acts a JOIN acts b ON CAST(replace(b.src, 'orders:', '') AS BIGINT) = CAST(replace(a.src, 'orders:', '') AS BIGINT) + 1)
SELECT a, b, round(0.6 * s + 0.4 * shared / every, 9) AS overall FROM p""")
def combined_scores(spark, sf_dir):
    """Behaviour and a structural score of neighbouring orders, combined."""
    acts = aggregate.behaviours(tables.edges(spark, sf_dir), tables.entities(spark, sf_dir)).where("entity_id LIKE 'orders:%'")
    # neighbours stand in one block of numbers, at whose end the first of the next one stands too, so behaviours move once
    n, block = F.col("n"), F.floor(F.col("n") / _BLOCK)
    numbered = acts.select(F.substring_index("entity_id", ":", -1).cast("long").alias("n"), F.col("behaviour").alias("act"))
    dealt = numbered.withColumn("block", F.explode(F.when(n % _BLOCK == 0, F.array(block, block - 1)).otherwise(F.array(block))))
    after = F.lead(F.struct("n", "act")).over(Window.partitionBy("block").orderBy("n"))
    pairs = dealt.withColumn("b", after).where(F.col("b.n") == n + 1)
    name = lambda x: F.concat(F.lit("orders:"), x.cast("string"))
    return pairs.select(name(n).alias("a"), name(F.col("b.n")).alias("b"), F.round(similar.overall(n % 101 / 100, F.col("act"), F.col("b.act")), 9).alias("overall"))


@query("""
WITH p AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer)
SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, x.c_name AS a_name, y.c_name AS b_name, x.c_mktsegment AS a_file, y.c_mktsegment AS b_file
FROM p JOIN customer x ON x.c_custkey = a JOIN customer y ON y.c_custkey = b
WHERE contains(lower(x.c_name), '7') OR contains(lower(y.c_name), '7') OR contains(lower(x.c_mktsegment), '7') OR contains(lower(y.c_mktsegment), '7')
""")
def pairs_named(spark, sf_dir):
    """Pairs joined to both entities; one without a partner in the table is dropped."""
    rows, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    e = rows.select(key.cast("string").alias("entity_id"), F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit("#"), "c_name").alias("qualified"), F.col("c_mktsegment").alias("file"))
    pairs = rows.select(key.cast("string").alias("a"), (key + 1).cast("string").alias("b"))
    return search.filter_pairs(similar.named(pairs, e), "7").select("a", "b", "a_name", "b_name", "a_file", "b_file")


# --- graph and bookkeeping


@query(f"""{WITH}, kept AS (SELECT entity_id FROM entities WHERE NOT (kind = 'customer' AND right(entity_id, 1) = '3'))
SELECT src, dst, kind, count(*) AS n FROM edges WHERE src IN (SELECT * FROM kept) AND dst IN (SELECT * FROM kept) GROUP BY ALL""")
def edges_dangling_dropped(spark, sf_dir):
    e = tables.entities(spark, sf_dir).where("NOT (kind = 'customer' AND entity_id LIKE '%3')")
    return graph.drop_dangling(e, tables.edges(spark, sf_dir)).groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{WITH}, gone AS (SELECT entity_id FROM entities WHERE kind = 'supplier' AND entity_id LIKE '%1')
SELECT src, dst, kind, count(*) AS n FROM edges WHERE src NOT IN (SELECT * FROM gone) AND dst NOT IN (SELECT * FROM gone) GROUP BY ALL""")
def edges_after_removal(spark, sf_dir):
    e = tables.entities(spark, sf_dir)
    _, left = graph.remove_entities(e, tables.edges(spark, sf_dir), e.where("kind = 'supplier' AND entity_id LIKE '%1'"))
    return left.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT coalesce(r.n, g.n) AS name, CASE WHEN g.n IS NULL THEN 'stop' WHEN r.n IS NULL THEN 'start' WHEN r.p <> g.p THEN 'restart' ELSE 'keep' END AS action
FROM (SELECT c_name AS n, c_custkey % 5 AS p FROM customer WHERE c_custkey % 3 <> 0) r FULL JOIN (SELECT c_name AS n, c_custkey % 7 AS p FROM customer WHERE c_custkey % 4 <> 0) g ON r.n = g.n
""")
def registry_actions(spark, sf_dir):
    rows, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    running = rows.where(key % 3 != 0).select(F.col("c_name").alias("name"), (key % 5).cast("string").alias("root"))
    return store.reconcile(running, rows.where(key % 4 != 0).select(F.col("c_name").alias("name"), (key % 7).cast("string").alias("path")))


@query("""
WITH f AS (SELECT c_custkey AS k, CASE c_custkey % 2 WHEN 0 THEN 'py' ELSE 'go' END AS lang, c_custkey % 40 AS dir FROM customer),
gone AS (SELECT * FROM f WHERE k % 10 IN (3, 4)),
t AS (SELECT k, lang, k + 2 AS target_file, (k + 2) % 40 AS target_dir FROM f),
hit AS (SELECT t.k FROM t JOIN gone ON t.lang = 'py' AND target_file = gone.k AND gone.lang = 'py'
  UNION SELECT t.k FROM t JOIN gone ON t.lang = 'go' AND gone.lang = 'go' AND target_dir = gone.dir
  UNION SELECT f.k FROM f JOIN gone ON f.lang = 'go' AND gone.lang = 'go' AND f.dir = gone.dir)
SELECT 'f' || CAST(k AS VARCHAR) AS file FROM hit WHERE k NOT IN (SELECT k FROM gone)
""")
def dependents_of_changes(spark, sf_dir):
    """Python files import a file, Go files a directory; a Go directory is one unit."""
    k = F.col("c_custkey")
    lang = F.when(k % 2 == 0, "py").otherwise("go")

    def file(key):
        return F.concat(F.lit("f"), key.cast("string"))

    def folder(key):
        return F.concat(F.lit("d"), (key % 40).cast("string"))

    rows = table(spark, sf_dir, "customer")
    files = rows.select(file(k).alias("file"), lang.alias("lang"), folder(k).alias("dir"))
    targets = rows.select(file(k).alias("file"), lang.alias("lang"), F.when(k % 2 == 0, file(k + 2)).otherwise(folder(k + 2)).alias("target"))
    return resolve.dependents(files, targets, rows.where("c_custkey % 10 IN (3, 4)").select(file(k).alias("file")))


# --- snapshots


@query(f"""{WITH}, kept AS (SELECT entity_id FROM entities WHERE NOT (kind = 'customer' AND right(entity_id, 1) = '3'))
SELECT 'entity' AS what, entity_id AS a, '' AS b FROM kept UNION ALL SELECT kind, src, dst FROM edges WHERE src IN (FROM kept) AND dst IN (FROM kept)""")
def snapshot_scanned(spark, sf_dir):
    """A snapshot that replaced another one, as a reader finds it behind the pointer: edges that lead nowhere are not in it."""
    e, where = tables.entities(spark, sf_dir), f"{shared_dir(spark)}/skein-snapshot-{uuid.uuid4().hex[:12]}"
    store.write_snapshot(where, "repo", {"entities": e.limit(0), "edges": tables.edges(spark, sf_dir).limit(0)})
    store.write_snapshot(where, "repo", {"entities": e.where("NOT (kind = 'customer' AND right(entity_id, 1) = '3')"), "edges": tables.edges(spark, sf_dir)})
    found = store.Snapshot(spark, where)
    return found.all().select(F.lit("entity").alias("what"), F.col("entity_id").alias("a"), F.lit("").alias("b")).union(found.edges.select("kind", "src", "dst"))


@query(f"{WITH} SELECT entity_id, kind, name, qualified FROM entities WHERE entity_id = 'orders:7'")
def snapshot_lookup(spark, sf_dir):
    where = f"{shared_dir(spark)}/skein-snapshot-{uuid.uuid4().hex[:12]}"
    store.write_snapshot(where, "repo", {"entities": tables.entities(spark, sf_dir)})
    row = store.Snapshot(spark, where).lookup("orders:7")
    return spark.createDataFrame([row] if row else [], "entity_id string, kind string, name string, qualified string, file string").drop("file")
