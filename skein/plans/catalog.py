"""Registered queries over the provided tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import identity
from skein.functions import text as T
from skein.operators import aggregate, graph, search, similar
from skein.operators import compile as compiler
from skein.plans import tables
from skein.plans.registered import ORACLES, QUERIES, query  # noqa: F401
from skein.session import table
from skein.storage import cut, spread

FLAGSHIP = "similar_documents"


WITH = f"WITH RECURSIVE entities AS ({tables.ENTITIES_SQL}), edges AS ({tables.edges_sql()})"


# --- lookup


@query(f"{WITH} SELECT entity_id, kind, name, qualified FROM entities WHERE name = 'red widget'")
def find_exact(spark, sf_dir):
    return search.find(tables.entities(spark, sf_dir), "red widget").select("entity_id", "kind", "name", "qualified")


@query(f"{WITH} SELECT entity_id, kind, name, qualified FROM entities WHERE qualified = 'customer.tbl#Customer#000000007'")
def find_qualified(spark, sf_dir):
    return search.find(tables.entities(spark, sf_dir), "customer.tbl#Customer#000000007").select("entity_id", "kind", "name", "qualified")


_TIER = "CASE WHEN lower(name) = 'order#1' THEN 0 WHEN starts_with(lower(name), 'order#1') THEN 1 ELSE 2 END"


@query(f"{WITH} SELECT entity_id, name, {_TIER} AS tier FROM entities WHERE contains(lower(name), 'order#1') ORDER BY tier, name, file, entity_id LIMIT 8")
def suggest_tiered(spark, sf_dir):
    return search.suggest(tables.entities(spark, sf_dir), " Order#1 ", limit=8).select("entity_id", "name", "tier")


@query(f"{WITH} SELECT entity_id, name, kind FROM entities WHERE (contains(lower(name), 'ring') OR contains(lower(qualified), 'ring')) AND kind = 'part' ORDER BY name, entity_id LIMIT 25 OFFSET 25")
def browse_page(spark, sf_dir):
    return search.browse(tables.entities(spark, sf_dir), "ring", "part", page=1).select("entity_id", "name", "kind")


@query("""
SELECT doc_id AS path, line, text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
WHERE regexp_matches(text, '[a-z]+ing [a-z]+tion')
""")
def grep_lines(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return search.grep(files, "[a-z]+ing [a-z]+tion").withColumn("line", F.col("line").cast("long"))


# --- identity


@query(f"{WITH} SELECT entity_id, substr(sha256('repo' || chr(0) || 'Method' || chr(0) || qualified || chr(0) || chr(0) || 'no-disambiguator'), 1, 16) AS id FROM entities")
def entity_id_hash(spark, sf_dir):
    e = tables.entities(spark, sf_dir)
    return e.select("entity_id", identity.entity_id(F.lit("repo"), F.lit("Method"), F.col("qualified"), F.lit("")).alias("id"))


@query(f"{WITH} SELECT substr(sha256(kind || chr(0) || dst || chr(0) || src), 1, 16) AS edge_id, count(*) AS n FROM edges GROUP BY 1")
def edge_id_hash(spark, sf_dir):
    e = tables.edges(spark, sf_dir)
    return e.groupBy(identity.edge_id(F.col("kind"), F.col("dst"), F.col("src")).alias("edge_id")).agg(F.count(F.lit(1)).alias("n"))


_HASH = r"substr(sha256(regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), 1, 16)"


@query(f"SELECT content_hash, min(doc_id) AS rep, count(*) AS n FROM (SELECT doc_id, {_HASH} AS content_hash FROM documents) GROUP BY 1 HAVING count(*) > 1")
def content_hash_classes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), identity.content_hash(F.col("text")).alias("content_hash"))
    return similar.classes(docs).where("n > 1")


# --- graph


@query(f"{WITH}, i AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT src, count(*) AS n FROM edges GROUP BY 1) "
       "SELECT entity_id, CAST(coalesce(i.n, 0) AS BIGINT) AS fan_in, CAST(coalesce(o.n, 0) AS BIGINT) AS fan_out FROM entities LEFT JOIN i ON dst = entity_id LEFT JOIN o ON src = entity_id")  # fmt: skip
def fan_in_out_counts(spark, sf_dir):
    return graph.fan_counts(tables.entities(spark, sf_dir), tables.edges(spark, sf_dir))


@query(f"{WITH} SELECT kind, count(*) AS n FROM entities GROUP BY kind")
def stats_by_kind(spark, sf_dir):
    return aggregate.stats_by_kind(tables.entities(spark, sf_dir))


@query(f"""{WITH}, step AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk AS (SELECT entity_id AS start_id, entity_id, 0 AS depth FROM entities WHERE kind = 'nation'
         UNION SELECT start_id, b, depth + 1 FROM walk JOIN step ON walk.entity_id = a WHERE depth < 2)
SELECT start_id, entity_id, min(depth) AS depth FROM walk GROUP BY 1, 2 HAVING min(depth) > 0""")
def related_depth2(spark, sf_dir):
    e = tables.entities(spark, sf_dir)
    return graph.related(e, tables.edges(spark, sf_dir), e.where("kind = 'nation'"), 2).select("start_id", "entity_id", "depth")


@query(f"""{WITH}, walk AS (SELECT entity_id AS start_id, entity_id, 0 AS depth FROM entities WHERE kind = 'region'
         UNION SELECT start_id, src, depth + 1 FROM walk JOIN edges ON walk.entity_id = dst WHERE depth < 50)
SELECT start_id, entity_id, min(depth) AS depth FROM walk GROUP BY 1, 2 HAVING min(depth) > 0""")
def upstream_closure(spark, sf_dir):
    e = tables.entities(spark, sf_dir)
    return graph.upstream(e, tables.edges(spark, sf_dir), e.where("kind = 'region'")).select("start_id", "entity_id", "depth")


@query(f"""{WITH}, step AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk AS (SELECT 'region:0' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN step ON id = a WHERE depth < 5)
SELECT CAST(unnest(range(1, least_depth + 1)) AS INTEGER) AS depth FROM (SELECT min(depth) AS least_depth FROM walk WHERE id = 'part:1')""")
def shortest_path(spark, sf_dir):
    """Depths only: of several shortest paths any is right."""
    return graph.shortest_path(tables.entities(spark, sf_dir), tables.edges(spark, sf_dir), "region:0", "part:1").select("depth")


@query(f"""{WITH}, walk AS (SELECT entity_id AS start_id, entity_id, 0 AS depth FROM entities WHERE kind IN ('nation', 'part')
         UNION SELECT start_id, src, depth + 1 FROM walk JOIN edges ON walk.entity_id = dst WHERE depth < 50),
first AS (SELECT start_id, entity_id, min(depth) AS depth FROM walk GROUP BY 1, 2 HAVING min(depth) > 0)
SELECT entity_id, bool_or(depth = 1) AS direct, min(depth) AS depth, count(*) AS starts FROM first GROUP BY 1""")
def impact_multi_source(spark, sf_dir):
    e = tables.entities(spark, sf_dir)
    hit = graph.impact(e, tables.edges(spark, sf_dir), e.where("kind IN ('nation', 'part')"))
    return hit.groupBy("entity_id").agg(F.bool_or("direct").alias("direct"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("starts"))


@query("""
SELECT o_orderkey FROM orders WHERE EXISTS (
  SELECT 1 FROM customer WHERE c_custkey = o_custkey
  AND year(o_orderdate) * 12 + month(o_orderdate) <= 1997 * 12 + c_custkey % 12 + 5
  AND 1997 * 12 + c_custkey % 12 <= year(o_orderdate) * 12 + month(o_orderdate) + 2)
""")
def range_overlap_changed(spark, sf_dir):
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    e = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("file"), month.alias("start_line"), (month + 2).alias("end_line"))
    s = 1997 * 12 + F.col("c_custkey") % 12
    return graph.changed_entities(e, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), s.alias("s"), (s + 5).alias("e"))).select("o_orderkey")


@query("""
SELECT o_custkey AS diff_id, 'order-' || CAST(o_orderkey AS VARCHAR) || '.go' AS file, CAST(o_orderkey % 97 + 1 AS INTEGER) AS s,
       CAST(CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 97 + 1 WHEN 1 THEN o_orderkey % 97 + 4 ELSE o_orderkey % 97 + 1 END AS INTEGER) AS e
FROM orders WHERE o_orderkey % 5 <> 4
""")
def diff_hunks(spark, sf_dir):
    k = F.col("o_orderkey")
    new = F.when(k % 5 == 4, F.lit("+++ /dev/null")).otherwise(F.concat(F.lit("+++ b/order-"), k.cast("string"), F.lit(".go")))
    count = F.when(k % 3 == 0, ",0").when(k % 3 == 1, ",4").otherwise("")
    hunk = F.concat(F.lit("@@ -1,2 +"), (k % 97 + 1).cast("string"), count, F.lit(" @@ func"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("diff_id"), F.explode(F.array(F.struct((k * 3).alias("pos"), new.alias("line")), F.struct((k * 3 + 1).alias("pos"), hunk.alias("line")), F.struct((k * 3 + 2).alias("pos"), F.lit("+added").alias("line")))).alias("x"),
    )
    return graph.diff_hunks(rows.select("diff_id", "x.*"))


# --- aggregates


_DISPOSITION = "CASE event_type WHEN 'error' THEN 'bug-resolver' WHEN 'signup' THEN 'external-known' WHEN 'purchase' THEN 'ambiguous' ELSE 'resolved' END"


@query(f"SELECT CAST(user_id % 10 AS BIGINT) AS file, {_DISPOSITION} AS disposition, count(*) AS n FROM events GROUP BY 1, 2")
def disposition_hist(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("file"), F.expr(_DISPOSITION).alias("disposition"))
    return aggregate.disposition_histogram(rows, ("file",))


@query("SELECT count(*) FILTER (WHERE event_type = 'error') / CAST(count(*) AS DOUBLE) AS bug_rate FROM events")
def bug_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.expr(_DISPOSITION).alias("disposition"))
    return aggregate.bug_rate(aggregate.disposition_histogram(rows))


@query(f"""{WITH} SELECT src AS entity_id, array_to_string(list_sort(list_distinct(list(edges.kind || ':' || coalesce(t.name, dst)))), '|') AS behaviour
FROM edges LEFT JOIN entities t ON t.entity_id = dst GROUP BY src""")
def behaviour_sets(spark, sf_dir):
    got = aggregate.behaviours(tables.edges(spark, sf_dir), tables.entities(spark, sf_dir))
    return got.select("entity_id", F.array_join("behaviour", "|").alias("behaviour"))


@query("""
WITH items AS (SELECT source AS task, doc_id AS file FROM documents WHERE n_chars > 1000),
gold AS (SELECT source AS task, d.doc_id AS file FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1)
SELECT g.task, coalesce(hit, 0) / CAST(gold AS DOUBLE) AS recall, CASE WHEN coalesce(shown, 0) = 0 THEN 0.0 ELSE coalesce(hit, 0) / CAST(shown AS DOUBLE) END AS precision
FROM (SELECT task, count(*) AS gold FROM gold GROUP BY 1) g
LEFT JOIN (SELECT task, count(*) AS shown FROM items GROUP BY 1) s ON g.task = s.task
LEFT JOIN (SELECT items.task, count(*) AS hit FROM items JOIN gold ON items.task = gold.task AND items.file = gold.file GROUP BY 1) h ON g.task = h.task
""")
def recall_precision(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("task"), F.col("doc_id").alias("file"), "n_chars")
    gold = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("file")), "file")
    return aggregate.retrieval_quality(docs.where("n_chars > 1000").select("task", "file"), gold.select("task", "file"))


@query("""
SELECT count(*) FILTER (WHERE flagged AND want) AS tp, count(*) FILTER (WHERE flagged AND NOT want) AS fp,
       count(*) FILTER (WHERE NOT flagged AND want) AS fn, count(*) FILTER (WHERE NOT flagged AND NOT want) AS tn,
       count(*) FILTER (WHERE flagged AND want) / CAST(count(*) FILTER (WHERE flagged) AS DOUBLE) AS precision,
       count(*) FILTER (WHERE flagged AND want) / CAST(count(*) FILTER (WHERE want) AS DOUBLE) AS recall
FROM (SELECT n_chars > 800 AS flagged, quality = 1 AS want FROM documents JOIN labels USING (doc_id))
""")
def confusion_matrix(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return aggregate.confusion(joined.select((F.col("n_chars") > 800).alias("flagged"), (F.col("quality") == 1).alias("want")))


# --- retrieval

TASKS = (("t1", "Fix the redWidget rings of steelBolts"), ("t2", "blue gears, smallRing and Region bolting"))


def _tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TASKS), "task string, prompt string")


_CAMEL = T.CAMEL


def _parts_sql(x: str) -> str:
    return f"list_filter(list_transform(flatten(list_transform(regexp_extract_all({x}, '{T.WORD}'), lambda w: regexp_extract_all(w, '{_CAMEL}'))), lambda p: lower(p)), lambda p: length(p) > 1)"


def _stem_sql(x: str) -> str:
    return (
        f"CASE WHEN {x} LIKE '%ies' AND length({x}) > 5 THEN left({x}, length({x}) - 3) || 'y' WHEN {x} LIKE '%ing' AND length({x}) > 6 THEN left({x}, length({x}) - 3) "
        f"WHEN {x} LIKE '%es' AND length({x}) > 5 THEN left({x}, length({x}) - 2) WHEN {x} LIKE '%ed' AND length({x}) > 5 THEN left({x}, length({x}) - 2) "
        f"WHEN {x} LIKE '%s' AND {x} NOT LIKE '%ss' AND length({x}) > 4 THEN left({x}, length({x}) - 1) ELSE {x} END"
    )


def _tier_sql(side: str) -> str:
    a, b = "s1", f"list_transform({side}_parts, lambda p: {{'p': p, 's': {_stem_sql('p')}}})"
    stem = f"(term <> q.p AND least(length({a}), length(q.s)) >= 4 AND CASE WHEN length({a}) <= length(q.s) THEN starts_with(q.s, {a}) ELSE starts_with({a}, q.s) END)"
    return f"CASE WHEN list_contains({side}_tokens, term) THEN 1.0 WHEN len(list_filter({b}, lambda q: {stem})) > 0 THEN 0.6 ELSE 0.0 END"


_VALUES = ", ".join(f"('{t}', '{p}')" for t, p in TASKS)
RETRIEVAL = f"""{WITH}, tasks(task, prompt) AS (VALUES {_VALUES}),
terms AS (SELECT task, term, count(*) AS times FROM (
  SELECT task, unnest(flatten(list_transform(regexp_extract_all(prompt, '{T.WORD}'), lambda w: list_concat([lower(w)],
    list_filter(list_transform(regexp_extract_all(w, '{_CAMEL}'), lambda p: lower(p)), lambda p: length(p) > 1))))) AS term FROM tasks) GROUP BY 1, 2),
tok AS (SELECT *, {_parts_sql('name')} AS name_parts, {_parts_sql('path')} AS path_parts,
  list_concat(list_transform(regexp_extract_all(name, '{T.WORD}'), lambda w: lower(w)), {_parts_sql('name')}) AS name_tokens,
  list_concat(list_transform(regexp_extract_all(path, '{T.WORD}'), lambda w: lower(w)), {_parts_sql('path')}) AS path_tokens
  FROM (SELECT *, substr(qualified, instr(qualified, '#') + 1) AS path FROM entities)),
m AS (SELECT task, term, times, entity_id, kind, name, {_tier_sql('name')} AS name_tier, {_tier_sql('path')} AS path_tier
      FROM tok, (SELECT *, {_stem_sql('term')} AS s1 FROM terms)),
df AS (SELECT t.task, t.term, CAST(coalesce(sum(m.times), 0) AS BIGINT) AS df FROM terms t LEFT JOIN (SELECT * FROM m WHERE name_tier > 0 OR path_tier > 0) m
       ON t.task = m.task AND t.term = m.term GROUP BY 1, 2),
weights AS (SELECT task, term, 1 + 0.4 * ln(((SELECT count(*) FROM entities) + 1) / CAST(df + 1 AS DOUBLE)) AS weight FROM df),
points AS (SELECT m.task, entity_id, kind, CASE WHEN m.term = lower(name) THEN 10 * weight WHEN name_tier > 0 THEN 3 * weight * name_tier ELSE weight * path_tier END AS p
           FROM m JOIN weights w ON m.task = w.task AND m.term = w.term),
scores AS (SELECT task, entity_id, kind, sum(p) AS score FROM points WHERE p > 0 GROUP BY 1, 2, 3),
seeds AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(score, 9) DESC, entity_id) AS rank FROM scores WHERE kind <> 'Test' QUALIFY rank <= 7)"""


def _scored(spark, sf_dir):
    e, terms = tables.entities(spark, sf_dir), compiler.terms_of(_tasks(spark))
    found = cut(compiler.matches(terms, e), "matches")  # for the weights and for the scores
    scored = compiler.scores(terms, compiler.term_weights(terms, e, found=found), e, found)
    return e, scored.withColumn("score", F.round("score", 9))


@query(f"{RETRIEVAL} SELECT * FROM df")
def term_df(spark, sf_dir):
    return compiler.document_frequency(compiler.terms_of(_tasks(spark)), tables.entities(spark, sf_dir))


@query(f"{RETRIEVAL} SELECT task, term, round(weight, 9) AS weight FROM weights")
def idf_weights(spark, sf_dir):
    return compiler.term_weights(compiler.terms_of(_tasks(spark)), tables.entities(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query(f"{RETRIEVAL} SELECT task, entity_id, round(score, 6) AS score FROM scores")
def match_scores(spark, sf_dir):
    return _scored(spark, sf_dir)[1].withColumn("score", F.round("score", 6))


@query(f"{RETRIEVAL} SELECT task, entity_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM seeds")
def seeds_topk(spark, sf_dir):
    e, scored = _scored(spark, sf_dir)
    return compiler.seeds(scored, e).withColumn("score", F.round("score", 6))


@query(f"""{RETRIEVAL}, step AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk AS (SELECT DISTINCT entity_id AS start_id, entity_id, 0 AS depth FROM seeds UNION SELECT start_id, b, depth + 1 FROM walk JOIN step ON walk.entity_id = a WHERE depth < 2),
near AS (SELECT start_id, entity_id, min(depth) AS depth FROM walk GROUP BY 1, 2 HAVING min(depth) > 0),
best AS (SELECT task, max(round(score, 9)) AS best FROM seeds GROUP BY 1),
reached AS (SELECT s.task, n.entity_id, s.rank, round(s.score, 9) * pow(0.6, n.depth) AS score FROM seeds s JOIN near n ON s.entity_id = n.start_id JOIN best USING (task)
  WHERE round(s.score, 9) * pow(0.6, n.depth) >= 0.3 * best AND NOT EXISTS (SELECT 1 FROM seeds x WHERE x.task = s.task AND x.entity_id = n.entity_id)),
picked AS (SELECT task, entity_id, score FROM reached QUALIFY row_number() OVER (PARTITION BY task, entity_id ORDER BY rank) = 1)
SELECT task, entity_id, round(score, 6) AS score, 'primary' AS category FROM seeds UNION ALL SELECT task, entity_id, round(score, 6), 'related' FROM picked""")
def expand_decay_floor(spark, sf_dir):
    e, scored = _scored(spark, sf_dir)
    out = compiler.expand(compiler.seeds(scored, e), e, tables.edges(spark, sf_dir))
    return out.select("task", "entity_id", F.round("score", 6).alias("score"), "category")


@query()
def knapsack_budget(spark, sf_dir):
    """The capsule of each task: rendered names, token counts and two knapsacks; a search over subsets is no SQL."""
    e, scored = _scored(spark, sf_dir)
    found = compiler.expand(compiler.seeds(scored, e), e, tables.edges(spark, sf_dir))
    texts = found.join(e.select("entity_id", "qualified"), "entity_id")
    costed = texts.withColumn("tokens", compiler.byte_quarters(F.col("qualified")))
    return compiler.budgeted(costed, 60).select("task", "entity_id", "category", "tokens", "place")


@query("""
WITH d AS (SELECT conv_id AS session_id, role || ':' || CAST(length(text) % 5 AS VARCHAR) AS entity_id, min(turn) AS place FROM conversations GROUP BY 1, 2)
SELECT session_id, entity_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY place, entity_id) AS INTEGER) AS handle_no FROM d
""")
def ledger_handles(spark, sf_dir):
    return compiler.assign_handles(_deliveries(spark, sf_dir), spark.createDataFrame([], "session_id long, entity_id string, handle_no int, level int"))


def _deliveries(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.concat("role", F.lit(":"), (F.length("text") % 5).cast("string")).alias("entity_id"),
        F.col("turn").alias("place"), (F.col("turn") % 4).cast("int").alias("level"),
    )


@query("""
WITH d AS (SELECT conv_id AS session_id, role || ':' || CAST(length(text) % 5 AS VARCHAR) AS entity_id, turn, CAST(turn % 4 AS INTEGER) AS level FROM conversations),
old AS (SELECT session_id, entity_id, min(turn) AS place FROM d WHERE turn < 2 GROUP BY 1, 2),
oldh AS (SELECT session_id, entity_id, row_number() OVER (PARTITION BY session_id ORDER BY place, entity_id) AS h FROM old),
new AS (SELECT session_id, entity_id, min(turn) AS place FROM d WHERE turn >= 2 AND NOT EXISTS (SELECT 1 FROM old WHERE old.session_id = d.session_id AND old.entity_id = d.entity_id) GROUP BY 1, 2),
top AS (SELECT session_id, max(h) AS top FROM oldh GROUP BY 1),
newh AS (SELECT new.session_id, entity_id, coalesce(top, 0) + row_number() OVER (PARTITION BY new.session_id ORDER BY place, entity_id) AS h FROM new LEFT JOIN top ON new.session_id = top.session_id)
SELECT h.session_id, h.entity_id, CAST(h AS INTEGER) AS handle_no, level FROM (SELECT * FROM oldh UNION ALL SELECT * FROM newh) h
JOIN (SELECT session_id, entity_id, max(level) AS level FROM d GROUP BY 1, 2) l ON h.session_id = l.session_id AND h.entity_id = l.entity_id
""")
def ledger_max_level(spark, sf_dir):
    """Two deliveries per session: handles of the first stay, levels only rise."""
    rows = _deliveries(spark, sf_dir)
    empty = spark.createDataFrame([], "session_id long, entity_id string, handle_no int, level int")
    first = compiler.upgrade_ledger(empty, rows.where("place < 2"))
    return compiler.upgrade_ledger(first, rows.where("place >= 2"))


# --- similarity


def _bodies(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("entity_id"), identity.content_hash(F.col("text")).alias("content_hash"), F.col("text").alias("body")
    )


_QUOTES = """'"', '''', '`'"""
_TOKEN_SQL = "(?s)" + similar.TOKEN.replace("'", "''")
_COMMENT_SQL = r"//[^\n]*|(?s:/\*.*?(?:\*/|\z))"
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, {}), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_LE_BYTES = "[" + ", ".join(f"({{0}} // {256**k}::HUGEINT) % 256" for k in range(8)) + "]"
_SEED_FACTOR = pow(0x100000001B3, 8, 1 << 64)
#: A seed's first byte alone is not zero, so its eight steps are one product; that byte meets the hash's last byte only, so the product is a sum of two.
PRINTS = f"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, {_HASH} AS h FROM documents),
r AS (SELECT h, min(id) AS rep FROM c GROUP BY h),
raw AS (SELECT id, regexp_extract_all(regexp_replace(text, '{_COMMENT_SQL}', '', 'g'), '{_TOKEN_SQL}') AS toks FROM c WHERE id IN (SELECT rep FROM r)),
pos AS (SELECT id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM raw WHERE len(toks) >= {similar.LEAST_TOKENS}),
coded AS (SELECT id, i, CASE WHEN regexp_matches(t, '^\\p{{Nd}}') THEN 'NUM' WHEN left(t, 1) IN ({_QUOTES}) THEN 'STR' ELSE t END AS t FROM pos),
firsts AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY min(i)) AS k FROM coded
  WHERE regexp_matches(t, '^[\\p{{L}}_]') AND t NOT IN ('NUM', 'STR', {", ".join(f"'{k}'" for k in sorted(similar.KEYWORDS))}) GROUP BY id, t),
norm AS (SELECT id, i, coalesce('ID' || CAST(k AS VARCHAR), t) || chr(0) AS t FROM coded LEFT JOIN firsts USING (id, t)),
win AS (SELECT id, t || lead(t, 1) OVER w || lead(t, 2) OVER w || lead(t, 3) OVER w || lead(t, 4) OVER w AS s FROM norm WINDOW w AS (PARTITION BY id ORDER BY i)),
shingles AS (SELECT DISTINCT id, s FROM win WHERE s IS NOT NULL),
hashed AS MATERIALIZED (SELECT s, {_FNV.format("list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: CAST('0x' || x AS HUGEINT))")} AS h FROM (SELECT DISTINCT s FROM shingles)),
started AS (SELECT s, {_FNV.format(_LE_BYTES.format("h"))}::UHUGEINT AS g FROM hashed),
split AS MATERIALIZED (SELECT s, CAST(g % 256 AS INTEGER) AS low, CAST((g - g % 256) * {_SEED_FACTOR}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT) AS high FROM started),
lows AS MATERIALIZED (SELECT low, seed, CAST(xor(low, seed)::UHUGEINT * {_SEED_FACTOR}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT) AS part
  FROM (SELECT CAST(range AS INTEGER) AS low FROM range(256)), (SELECT CAST(range AS INTEGER) AS seed FROM range({similar.HASHES}))),
sigs AS MATERIALIZED (SELECT id, seed, CAST(min(CASE WHEN high > 18446744073709551615::UBIGINT - part THEN high - (18446744073709551615::UBIGINT - part) - 1 ELSE high + part END) AS HUGEINT) AS m
  FROM shingles JOIN split USING (s) JOIN lows USING (low) GROUP BY id, seed),
bands AS MATERIALIZED (SELECT id, {_FNV.format("flatten(list(" + _LE_BYTES.format("m") + " ORDER BY seed))")} AS key FROM sigs GROUP BY id, seed // {similar.HASHES // similar.BANDS})"""


@query(f"""{PRINTS}, near AS (SELECT a.id AS a, b.id AS b, count(*) FILTER (WHERE a.m = b.m) / {similar.HASHES}.0::DOUBLE AS structural
  FROM (SELECT DISTINCT x.id AS a, y.id AS b FROM bands x JOIN bands y ON x.key = y.key AND x.id < y.id) p JOIN sigs a ON a.id = p.a JOIN sigs b ON b.id = p.b AND a.seed = b.seed GROUP BY 1, 2)
SELECT rep AS a, id AS b, true AS exact, 1.0::DOUBLE AS structural, 1.0::DOUBLE AS behavioral, 1.0::DOUBLE AS overall FROM c JOIN r USING (h) WHERE id <> rep
UNION ALL SELECT a, b, false, structural, 0.0, structural FROM near WHERE structural >= {similar.LEAST_OVERALL}""")
def similar_documents(spark, sf_dir):
    """Near-duplicate pairs of documents by normalised token shingles."""
    none = spark.createDataFrame([], "src string, dst string, kind string"), spark.createDataFrame([], "entity_id string, name string")
    return similar.find_pairs(spread(_bodies(spark, sf_dir), "entity_id"), *none)


@query(f"""{PRINTS} SELECT id AS entity_id, signature, buckets FROM
  (SELECT id, sha256(string_agg(CAST(CASE WHEN m >= 9223372036854775808::HUGEINT THEN m - 18446744073709551616::HUGEINT ELSE m END AS VARCHAR), ',' ORDER BY seed)) AS signature FROM sigs GROUP BY id)
  JOIN (SELECT id, count(DISTINCT key) AS buckets FROM bands GROUP BY id) USING (id)""")
def token_fingerprints(spark, sf_dir):
    """Of each class's representative: a digest of its 64 minima, and how many buckets it is in."""
    bodies = spread(_bodies(spark, sf_dir), "entity_id")
    prints = similar.fingerprints(bodies.join(similar.classes(bodies).select(F.col("rep").alias("entity_id")), "entity_id", "left_semi"))
    signature = F.sha2(F.encode(F.array_join(F.transform("sig", lambda x: x.cast("string")), ","), "UTF-8"), 256)
    return prints.select("entity_id", signature.alias("signature"), F.size(F.array_distinct("bands")).cast("long").alias("buckets"))


@query(f"""
WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_HASH} AS h FROM documents), r AS (SELECT h, min(id) AS rep FROM c GROUP BY h),
p AS (SELECT least(id, rep) AS a, greatest(id, rep) AS b FROM c JOIN r USING (h) WHERE id <> rep)
SELECT a, b, a || '_' || b AS pair_key FROM p WHERE (length(a) + length(b)) % 2 = 0
""")
def undecided_pairs(spark, sf_dir):
    bodies = _bodies(spark, sf_dir)
    pairs = bodies.join(similar.classes(bodies), "content_hash").where(F.col("entity_id") != F.col("rep")).select(F.least("rep", "entity_id").alias("a"), F.greatest("rep", "entity_id").alias("b"))
    decided = pairs.where((F.length("a") + F.length("b")) % 2 == 1).select(identity.pair_key(F.col("a"), F.col("b")).alias("pair_key"), F.lit("duplicate").alias("decision"))
    return similar.undecided(pairs, decided)


# --- change feed


@query("""
WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id AS project, min(ts) AS began, count(*) AS events, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS paths FROM s GROUP BY user_id, sid
""")
def debounce_sessions(spark, sf_dir):
    from skein.streaming.changes import debounce

    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), "ts", F.col("event_type").alias("path"))
    return debounce(changes, "30 minutes").select("project", "began", "events", F.array_join("paths", ",").alias("paths"))


# --- resolution


def _synthetic_sources(spark, sf_dir) -> dict[str, DataFrame]:
    """Customers as Python files, orders as their functions, events as calls; each file imports one name from the next."""
    c, o, e = (table(spark, sf_dir, t) for t in ("customer", "orders", "events"))

    def file(key):
        return F.concat(F.lit("c"), key.cast("string"), F.lit(".py"))

    name = F.concat(F.lit("o"), (F.col("o_orderkey") % 50).cast("string"))
    key = F.col("c_custkey")
    text = F.lit("")
    return {
        "files": c.select(file(key).alias("file"), F.lit("py").alias("lang"), text.alias("content_hash")),
        "entities": o.select(
            F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("entity_id"), F.lit("Function").alias("kind"), F.lit("py").alias("lang"),
            name.alias("qualified"), name.alias("name"), text.alias("owner"), file(F.col("o_custkey")).alias("file"),
        ),
        "refs": e.select(
            F.col("event_id").alias("ref_id"), file(F.col("user_id")).alias("file"), F.lit("py").alias("lang"), F.lit("call").alias("kind"), F.lit("s").alias("src"),
            F.lit("unqualified").alias("scope"), F.concat(F.lit("o"), (F.col("event_id") % 60).cast("string")).alias("name"), text.alias("member"), text.alias("receiver_type"),
            F.lit(1).alias("start_line"),
        ),
        "imports": c.select(
            file(key).alias("file"), F.lit("py").alias("lang"), F.lit(0).alias("ord"), F.concat(F.lit("o"), (key % 50).cast("string")).alias("local_name"),
            F.concat(F.lit(".c"), (key + 1).cast("string")).alias("source"), F.concat(F.lit("o"), (key % 50).cast("string")).alias("imported_name"),
            F.lit(False).alias("is_namespace"), F.lit(False).alias("is_default"),
        ),
        "reexports": spark.createDataFrame([], "file string, ord int, source string, is_star boolean, exported_name string, local_alias string"),
        "ext_methods": spark.createDataFrame([], "file string, entity_id string, name string, extended_type string"),
        "field_types": spark.createDataFrame([], "file string, lang string, owner string, field string, type string"),
    }


@query("""
WITH names AS (SELECT o_custkey AS f, 'o' || CAST(o_orderkey % 50 AS VARCHAR) AS name, count(*) AS k, min('e' || CAST(o_orderkey AS VARCHAR)) AS dst FROM orders GROUP BY 1, 2),
refs AS (SELECT event_id AS ref_id, user_id AS f, 'o' || CAST(event_id % 60 AS VARCHAR) AS name FROM events),
bare AS (SELECT DISTINCT name FROM names),
j AS (SELECT r.*, n.k, n.dst, i.c_custkey IS NOT NULL AS imported, t.c_custkey IS NOT NULL AS there, x.k AS k2, x.dst AS dst2, b.name IS NOT NULL AS anywhere
  FROM refs r LEFT JOIN names n ON n.f = r.f AND n.name = r.name
  LEFT JOIN customer i ON i.c_custkey = r.f AND 'o' || CAST(i.c_custkey % 50 AS VARCHAR) = r.name
  LEFT JOIN customer t ON t.c_custkey = r.f + 1
  LEFT JOIN names x ON x.f = r.f + 1 AND x.name = r.name
  LEFT JOIN bare b ON b.name = r.name)
SELECT ref_id, CASE WHEN k = 1 THEN 'resolved' WHEN k > 1 THEN 'ambiguous' WHEN imported AND NOT there THEN 'bug-extractor' WHEN imported AND k2 = 1 THEN 'resolved'
  WHEN imported THEN 'bug-resolver' WHEN anywhere THEN 'ambiguous' ELSE 'external-unknown' END AS disposition,
  CASE WHEN k = 1 THEN dst WHEN k IS NULL AND imported AND there AND k2 = 1 THEN dst2 END AS dst FROM j
""")
def resolve_cascade(spark, sf_dir):
    from skein.operators import resolve

    return resolve.resolve(_synthetic_sources(spark, sf_dir)).select("ref_id", "disposition", "dst")


from skein.plans import catalog_extraction, catalog_operators, catalog_resolution  # noqa: E402, F401  they enter their own queries
