"""Registered queries of extraction: a few source files in each language for every customer, and what they must yield.

A file is a template: ``~k`` stands for the customer's key, ``~a`` for a number of parameters (the key modulo 3) and ``~p`` for as
many parameters. The oracles know the templates and, by hand, what stands in them: an entity by its first and last text, a reference
by the text around the place marked ``|``. Places, lines, identities and hashes are computed in SQL from the files' text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators.extract import LISTS, extract_facts, tables_of
from skein.operators.resolve import Config, edges_of, resolve
from skein.plans.registered import ORACLES, QUERIES, query
from skein.session import table
from skein.sources import files as sources
from skein.storage import cut, spread

REPO = "repo"


@dataclass
class Source:
    """``entities``: (kind, owner, name, disambiguator, first text, last text); ``refs``: (kind, source entity, scope, name, member,
    receiver type, place); ``facts``: (what, four values) of imports, re-exports, extension methods and field types; ``edges``: (source,
    kind, target, place)."""

    path: str
    params: tuple[str, str, str]
    text: str
    entities: list[tuple] = field(default_factory=list)
    refs: list[tuple] = field(default_factory=list)
    facts: list[tuple] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)


TS = [Source("src/m~k/service.ts", ("", "a", "a, b"), """\
import { User~k, Named as N~k } from './models/m~k';
import * as util from '@/util~k';
import express from 'express~k';
const { load~k: ld~k } = require('lib~k');
const whole~k = require('whole~k');
export * from './star~k';
export { One~k as Two~k } from './one~k';
// é is two bytes; no(call) here
export class Service~k extends Base~k implements Named~k {
  private user: Direct~k = new Direct~k();
  constructor(private repo: Repo~k) { super(); }
  async run~k(~p) { this.user.greet(1); this.helper~k(2); util.fmt(3); this.repo.save(4); }
  helper~k() { return local~k(5); }
}
export interface Named~k { name: string; find(x): void }
enum Color~k { Red, Green }
type Alias~k = string | number;
export function local~k(~p) { const u = new User~k(6); u.greet(7); return free~k(8); }
const schema~k = z.object('s~k');
router.get('/items/~k', auth, (req, res) => { use(req.query.page, req.body.size); });
Proto~k.prototype.go~k = function (~p) { return 1; };
it('does ~k', () => { local~k(9); });
""", [
    ("Class", "", "Service~k", "", "class Service~k", "\n}"),
    ("Method", "Service~k", "constructor", "arity:1", "constructor(", "super(); }"),
    ("Method", "Service~k", "run~k", "arity:~a", "async run~k(", "save(4); }"),
    ("Method", "Service~k", "helper~k", "arity:0", "helper~k() {", "(5); }"),
    ("Interface", "", "Named~k", "", "interface Named~k", "}"),
    ("Enum", "", "Color~k", "", "enum Color~k", "}"),
    ("TypeAlias", "", "Alias~k", "", "type Alias~k", ";"),
    ("Function", "", "local~k", "arity:~a", "function local~k(", "free~k(8); }"),
    ("Class", "", "schema~k", "", "schema~k = z", ")"),
    ("Function", "", "GET /items/~k (page, size)", "byte", "(req, res) =>", "}"),
    ("Method", "Proto~k", "go~k", "arity:~a", "Proto~k.prototype", "1; }"),
    ("Test", "", "does ~k", "byte", "it('does", "})"),
], [
    ("extends", "Service~k", "unqualified", "Base~k", "", "", "extends |Base~k"),
    ("implements", "Service~k", "unqualified", "Named~k", "", "", "implements |Named~k"),
    ("type_use", "", "unqualified", "Direct~k", "", "", "new |Direct~k("),
    ("call", "Service~k.run~k", "qualified", "user", "greet", "Direct~k", "user.|greet(1"),
    ("call", "Service~k.run~k", "unqualified", "helper~k", "", "", "this.|helper~k(2"),
    ("call", "Service~k.run~k", "qualified", "util", "fmt", "", "util.|fmt(3"),
    ("call", "Service~k.run~k", "qualified", "repo", "save", "Repo~k", "repo.|save(4"),
    ("call", "Service~k.helper~k", "unqualified", "local~k", "", "", "|local~k(5"),
    ("type_use", "local~k", "unqualified", "User~k", "", "", "new |User~k(6"),
    ("call", "local~k", "qualified", "u", "greet", "User~k", "u.|greet(7"),
    ("call", "local~k", "unqualified", "free~k", "", "", "|free~k(8"),
    ("call", "", "qualified", "z", "object", "", "z.|object("),
    ("call", "", "qualified", "router", "get", "", "router.|get("),
    ("call", "GET /items/~k (page, size)", "unqualified", "use", "", "", "|use(req"),
    ("call", "does ~k", "unqualified", "local~k", "", "", "|local~k(9"),
], [
    ("import", "User~k", "./models/m~k", "User~k", ""), ("import", "N~k", "./models/m~k", "Named", ""), ("import", "util", "@/util~k", "", "namespace"),
    ("import", "express", "express~k", "", "default"), ("import", "ld~k", "lib~k", "load~k", ""), ("import", "whole~k", "whole~k", "", "default"),
    ("reexport", "", "./star~k", "", "star"), ("reexport", "Two~k", "./one~k", "One~k", ""),
], [
    ("Service~k", "IMPLEMENTS", "Named~k", "implements |Named~k"), ("Service~k.run~k", "CALLS", "Service~k.helper~k", "this.|helper~k(2"),
    ("Service~k.helper~k", "CALLS", "local~k", "|local~k(5"), ("does ~k", "CALLS", "local~k", "|local~k(9"),
])]

GO = [Source("pkg~k/a.go", ("", "a int", "a int, b int"), """\
package pkg
import ("fmt"; st "example.com/x~k/store"; _ "example.com/blank")
type Base~k struct { n int }
type S~k struct {
	Base~k
	db *st.DB
	count, total int
}
type Doer~k interface { Do(x int) int }
type Id~k int
func (s *S~k) Do~k(~p) int {
	s.db.Query(1); fmt.Println(2); helper~k(3)
	v := Base~k{}
	v.Show(4)
	return s.Other(5)
}
func helper~k(~p) int { f := func() int { return 1 }; return f(/* é */) }
""", [
    ("Class", "", "Base~k", "", "Base~k struct", "}"),
    ("Class", "", "S~k", "", "S~k struct", "\n}"),
    ("Interface", "", "Doer~k", "", "Doer~k interface", "}"),
    ("TypeAlias", "", "Id~k", "", "Id~k int", "int"),
    ("Method", "S~k", "Do~k", "arity:~a", "func (s *S~k)", "\n}"),
    ("Function", "", "helper~k", "arity:~a", "func helper~k(", "*/) }"),
], [
    ("extends", "S~k", "unqualified", "Base~k", "", "", "{\n\t|Base~k\n"),
    ("call", "S~k.Do~k", "qualified", "db", "Query", "", "db.|Query(1"),
    ("call", "S~k.Do~k", "qualified", "fmt", "Println", "", "fmt.|Println(2"),
    ("call", "S~k.Do~k", "unqualified", "helper~k", "", "", "|helper~k(3"),
    ("call", "S~k.Do~k", "qualified", "v", "Show", "Base~k", "v.|Show(4"),
    ("call", "S~k.Do~k", "qualified", "s", "Other", "S~k", "s.|Other(5"),
    ("call", "helper~k", "local", "f", "", "", "return |f(/"),
], [
    ("import", "fmt", "fmt", "", "namespace"), ("import", "st", "example.com/x~k/store", "", "namespace"),
    ("field", "Base~k", "n", "int", ""), ("field", "S~k", "db", "st.DB", ""), ("field", "S~k", "count", "int", ""), ("field", "S~k", "total", "int", ""),
], [("S~k", "EXTENDS", "Base~k", "{\n\t|Base~k\n"), ("S~k.Do~k", "CALLS", "helper~k", "|helper~k(3")]), Source("pkg~k/a_test.go", ("", "a int", "a int, b int"), """\
package pkg
import "testing"
func TestDo~k(t *testing.T) { helper~k(1) }
func Testify~k(~p) { t.Run("x") }
""", [
    ("Test", "", "TestDo~k", "", "func TestDo~k", "}"),
    ("Function", "", "Testify~k", "arity:~a", "func Testify~k", "}"),
], [
    ("call", "TestDo~k", "unqualified", "helper~k", "", "", "|helper~k(1"),
    ("call", "Testify~k", "qualified", "t", "Run", "testing.T", "t.|Run("),
], [("import", "testing", "testing", "", "namespace")], [("TestDo~k", "CALLS", "helper~k", "|helper~k(1")])]

CS = [Source("app~k/Thing.cs", ("", "int a", "int a, Dictionary<int, int> b"), """\
using System.Text;
using Al~k = My.Space~k;
namespace N~k;
public interface IThing~k { void Act~k(int x); }
public enum Mode~k { On, Off }
public delegate int Fold~k(int a, int b);
public class Base~k { }
public class Thing~k : Base~k, IThing~k
{
    private readonly Repo~k _repo; // é
    public Store~k Store { get; set; }
    public Thing~k(Repo~k repo) { _repo = repo; }
    public void Act~k(int x) { _repo.Save(1); this.Store.Load(2); Help~k(3); var w = new Widget~k(); w.Spin(4); }
    private int Help~k(~p) => Free~k(5);
    [Fact]
    public void Works~k() { Inner~k(6); void Inner~k(int q) { } }
}
public static class Ext~k { public static int Twice~k(this Thing~k t, int n) { return n; } }
""", [
    ("Interface", "", "IThing~k", "", "interface IThing~k", "; }"),
    ("Method", "IThing~k", "Act~k", "arity:1", "void Act~k(int x);", ";"),
    ("Enum", "", "Mode~k", "", "enum Mode~k", "}"),
    ("TypeAlias", "", "Fold~k", "", "delegate int", ")"),
    ("Class", "", "Base~k", "", "class Base~k", "}"),
    ("Class", "", "Thing~k", "", "class Thing~k", "\n}"),
    ("Property", "Thing~k", "Store", "", "public Store~k", "}"),
    ("Method", "Thing~k", "ctor", "arity:1", "public Thing~k(", "}"),
    ("Method", "Thing~k", "Act~k", "arity:1", "public void Act~k", "}"),
    ("Method", "Thing~k", "Help~k", "arity:~a", "private int Help~k", "(5);"),
    ("Test", "Thing~k", "Works~k", "arity:0", "[Fact]", "} }"),
    ("Class", "", "Ext~k", "", "class Ext~k", "} }"),
    ("Method", "Ext~k", "Twice~k", "arity:2", "public static int", "}"),
], [
    ("extends", "Thing~k", "unqualified", "Base~k", "", "", ": |Base~k"),
    ("extends", "Thing~k", "unqualified", "IThing~k", "", "", ", |IThing~k"),
    ("call", "Thing~k.Act~k", "qualified", "_repo", "Save", "Repo~k", "_repo.|Save(1"),
    ("call", "Thing~k.Act~k", "qualified", "Store", "Load", "Store~k", "Store.|Load(2"),
    ("call", "Thing~k.Act~k", "unqualified", "Help~k", "", "", "|Help~k(3"),
    ("type_use", "Thing~k.Act~k", "unqualified", "Widget~k", "", "", "new |Widget~k"),
    ("call", "Thing~k.Act~k", "qualified", "w", "Spin", "Widget~k", "w.|Spin(4"),
    ("call", "Thing~k.Help~k", "unqualified", "Free~k", "", "", "|Free~k(5"),
    ("call", "Thing~k.Works~k", "local", "Inner~k", "", "", "|Inner~k(6"),
], [
    ("import", "", "System.Text", "", "namespace"), ("import", "Al~k", "My.Space~k", "", "namespace"),
    ("extension", "Twice~k", "Thing~k", "", ""), ("field", "Thing~k", "_repo", "Repo~k", ""), ("field", "Thing~k", "Store", "Store~k", ""),
], [
    ("Thing~k", "EXTENDS", "Base~k", ": |Base~k"), ("Thing~k", "IMPLEMENTS", "IThing~k", ", |IThing~k"), ("Thing~k.Act~k", "CALLS", "Thing~k.Help~k", "|Help~k(3"),
])]

PY = [Source("app/svc~k.py", ("", "a", "a, b"), """\
import json
import os.path as osp
from .models~k import Repo~k as R~k, Other~k
class Base~k: pass
class Svc~k(Base~k, json.Thing):
    # é
    limit: Cap~k = None
    def __init__(self, r: R~k):
        self.r = r
    def go~k(self, ~p):
        self.r.save(1); self.limit.hold(0)
        json.dumps(2)
        self.stop~k(3)
        w = Widget~k(4)
        w.spin(5)
    async def stop~k(self): pass
def test_go~k():
    Svc~k(6).go~k(7)
def free~k(~p):
    def inner(): return 1
    return inner()
""", [
    ("Class", "", "Base~k", "", "class Base~k", "pass"),
    ("Class", "", "Svc~k", "", "class Svc~k", "self): pass"),
    ("Method", "Svc~k", "__init__", "arity:2", "def __init__", "= r"),
    ("Method", "Svc~k", "go~k", "arity:+", "def go~k", "spin(5)"),
    ("Method", "Svc~k", "stop~k", "arity:1", "async def stop~k", "pass"),
    ("Test", "", "test_go~k", "", "def test_go~k", "(7)"),
    ("Function", "", "free~k", "arity:~a", "def free~k", "return inner()"),
], [
    ("extends", "Svc~k", "unqualified", "Base~k", "", "", "(|Base~k"),
    ("extends", "Svc~k", "qualified", "json", "Thing", "", "|json.Thing"),
    ("call", "Svc~k.go~k", "qualified", "r", "save", "R~k", "|self.r.save(1"),
    ("call", "Svc~k.go~k", "qualified", "limit", "hold", "Cap~k", "|self.limit.hold"),
    ("call", "Svc~k.go~k", "qualified", "json", "dumps", "", "|json.dumps(2"),
    ("call", "Svc~k.go~k", "qualified", "self", "stop~k", "Svc~k", "|self.stop~k(3"),
    ("call", "Svc~k.go~k", "unqualified", "Widget~k", "", "", "|Widget~k(4"),
    ("call", "Svc~k.go~k", "qualified", "w", "spin", "Widget~k", "|w.spin(5"),
    ("call", "test_go~k", "unqualified", "Svc~k", "", "", "|Svc~k(6"),
    ("call", "free~k", "local", "inner", "", "", "return |inner()"),
], [
    ("import", "json", "json", "", "namespace"), ("import", "osp", "os.path", "", "namespace"),
    ("import", "R~k", ".models~k", "Repo~k", ""), ("import", "Other~k", ".models~k", "Other~k", ""),
], [
    ("Svc~k", "EXTENDS", "Base~k", "(|Base~k"), ("Svc~k.go~k", "CALLS", "Svc~k.stop~k", "|self.stop~k(3"), ("test_go~k", "CALLS", "Svc~k", "|Svc~k(6"),
])]

LANGUAGES = {"ts": TS, "go": GO, "cs": CS, "py": PY}


def _filled(template: str, params: tuple[str, str, str]) -> Column:
    key, out = F.col("c_custkey"), F.lit(template)
    many = F.element_at(F.array(*map(F.lit, params)), (key % 3 + 1).cast("int"))
    for mark, value in (("~k", key.cast("string")), ("~a", (key % 3).cast("string")), ("~p", many)):
        out = F.replace(out, F.lit(mark), value)
    return out


def _facts(spark, sf_dir, lang: str, lists: tuple[str, ...] = LISTS) -> DataFrame:
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    files = None
    for s in LANGUAGES[lang]:
        some = customers.select(_filled(s.path, s.params).alias("rel_path"), F.lit(lang).alias("lang"), F.encode(_filled(s.text, s.params), "UTF-8").alias("content"))
        files = some if files is None else files.union(some)
    return extract_facts(files, REPO, lists)


def _table(spark, sf_dir, lang: str, name: str) -> DataFrame:
    return tables_of(_facts(spark, sf_dir, lang, (name,)), REPO)[name]


def _written_tables(spark, sf_dir, lang: str) -> dict[str, DataFrame]:
    """For reading several more than once: files are extracted once."""
    return tables_of(cut(_facts(spark, sf_dir, lang), "facts"), REPO)


def _str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sub(x: str, params: tuple[str, str, str]) -> str:
    many = f"CASE k % 3 WHEN 0 THEN {_str(params[0])} WHEN 1 THEN {_str(params[1])} ELSE {_str(params[2])} END"
    return f"replace(replace(replace({x}, '~k', CAST(k AS VARCHAR)), '~a', CAST(k % 3 AS VARCHAR)), '~p', {many})"


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_str, r)) + ")" for r in rows)


def _with(s: Source, lang: str) -> str:
    """Files f(k, file, unit, text) and entities e of one kind of file."""
    unit = "file" if lang in ("ts", "py") else "regexp_extract(file, '(.*)/', 1)"
    sub = lambda x: _sub(x, s.params)
    return f"""f0 AS (SELECT k, {sub(_str(s.path))} AS file, {sub(_str(s.text))} AS text FROM (SELECT c_custkey AS k FROM customer)),
f AS (SELECT *, {unit} AS unit FROM f0),
e0(kind, owner, name, dis, head, tail) AS (VALUES {_rows(s.entities)}),
e1 AS (SELECT k, file, unit, text, kind, {sub('owner')} AS owner, {sub('name')} AS name, {sub('dis')} AS dis, strpos(text, {sub('head')}) AS a, {sub('tail')} AS tail FROM f, e0),
e2 AS (SELECT *, substr(text, a, strpos(substr(text, a), tail) + length(tail) - 1) AS body, substr(text, 1, a - 1) AS before,
  CASE WHEN owner = '' THEN name ELSE owner || '.' || name END AS short FROM e1),
e3 AS (SELECT *, unit || '#' || short AS qualified, strlen(before) AS start_byte,
  CASE dis WHEN 'byte' THEN 'byte:' || strlen(before) WHEN 'arity:+' THEN 'arity:' || (k % 3 + 1) ELSE dis END AS mark FROM e2),
e AS (SELECT *, substr(sha256('{REPO}' || chr(0) || kind || chr(0) || qualified || chr(0) || mark), 1, 16) AS entity_id FROM e3)"""


def _lines(before: str) -> str:
    return f"CAST(length({before}) - length(replace({before}, chr(10), '')) AS INTEGER)"


def _all(lang: str, select) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (WITH {_with(s, lang)} {select(s)})" for s in LANGUAGES[lang])


def _entities_sql(s: Source) -> str:
    return f"""SELECT entity_id, kind, qualified, name, owner, file, CAST(start_byte AS BIGINT) AS start_byte, CAST(start_byte + strlen(body) AS BIGINT) AS end_byte,
{_lines('before')} + 1 AS start_line, {_lines('before')} + {_lines('body')} + 1 AS end_line, substr(sha256(body), 1, 16) AS content_hash FROM e"""


def _refs_sql(s: Source) -> str:
    sub = lambda x: _sub(x, s.params)
    return f""", r0(kind, src, scope, name, member, receiver, place) AS (VALUES {_rows(s.refs)}),
r1 AS (SELECT f.file, kind, {sub('src')} AS src, scope, {sub('name')} AS name, {sub('member')} AS member, {sub('receiver')} AS receiver_type,
  substr(text, 1, strpos(text, replace({sub('place')}, '|', '')) + strpos(place, '|') - 2) AS before FROM f, r0)
SELECT r1.file, r1.kind, coalesce(entity_id, '') AS src, scope, r1.name, member, receiver_type, CAST(strlen(r1.before) AS BIGINT) AS start_byte, {_lines('r1.before')} + 1 AS start_line
FROM r1 LEFT JOIN e ON e.file = r1.file AND e.short = r1.src"""


def _facts_sql(s: Source) -> str:
    sub = lambda x: _sub(x, s.params)
    return f", w(what, a, b, c, d) AS (VALUES {_rows(s.facts)}) SELECT file, what, {sub('a')} AS a, {sub('b')} AS b, {sub('c')} AS c, d FROM f, w"


def _edges_sql(s: Source) -> str:
    sub = lambda x: _sub(x, s.params)
    return f""", x0(src, kind, dst, place) AS (VALUES {_rows(s.edges)}),
x AS (SELECT *, substr(text, 1, strpos(text, replace({sub('place')}, '|', '')) + strpos(place, '|') - 2) AS before FROM f, x0)
SELECT unit || '#' || {sub('src')} AS src, kind, unit || '#' || {sub('dst')} AS dst, file || ':' || ({_lines('before')} + 1) AS evidence FROM x"""


def _entities(spark, sf_dir, lang: str) -> DataFrame:
    at = [F.col(f"anchor.{c}") for c in ("start_byte", "end_byte", "content_hash")]
    return _table(spark, sf_dir, lang, "entities").select("entity_id", "kind", "qualified", "name", "owner", "file", *at, "start_line", "end_line")


def _references(spark, sf_dir, lang: str) -> DataFrame:
    return _table(spark, sf_dir, lang, "refs").select("file", "kind", "src", "scope", "name", "member", "receiver_type", "start_byte", "start_line")


def _bindings(spark, sf_dir, lang: str) -> DataFrame:
    """The four lists of a file as one, so that its row is read once."""
    facts = cut(_facts(spark, sf_dir, lang, ("imports", "reexports", "ext_methods", "field_types")), "facts")

    def of(name: str, what: str, a: str | None, b: str, c: str | None, d) -> Column:
        def row(x: Column) -> Column:
            values = (F.lit(what), *(F.lit("") if k is None else x[k] for k in (a, b, c)), d(x))
            return F.struct(*(v.alias(k) for k, v in zip(("what", "a", "b", "c", "d"), values, strict=True)))

        return F.transform(name, row)

    none = lambda x: F.lit("")
    every = F.concat(
        of("imports", "import", "local_name", "source", "imported_name", lambda x: F.when(x["is_namespace"], "namespace").when(x["is_default"], "default").otherwise("")),
        of("reexports", "reexport", "local_alias", "source", "exported_name", lambda x: F.when(x["is_star"], "star").otherwise("")),
        of("ext_methods", "extension", "name", "extended_type", None, none), of("field_types", "field", "owner", "field", "type", none),
    )
    return facts.where("parse_error IS NULL").select("file", F.explode(every).alias("x")).select("file", "x.*")


def _edges(spark, sf_dir, lang: str) -> DataFrame:
    """From text to edges: extraction, then the cascade; what isn't declared in the sources makes no edge."""
    t = _written_tables(spark, sf_dir, lang)
    named = t["entities"].select("entity_id", "qualified")
    found = edges_of(resolve(t, Config())).select("src", "kind", "dst", "evidence")
    named_ends = found.join(named.toDF("src", "from"), "src").join(named.toDF("dst", "to"), "dst")
    return named_ends.select(F.col("from").alias("src"), "kind", F.col("to").alias("dst"), "evidence")


def _register(lang: str) -> None:
    for what, run, sql in (("entities", _entities, _entities_sql), ("references", _references, _refs_sql), ("bindings", _bindings, _facts_sql), ("edges", _edges, _edges_sql)):
        name = f"extract_{lang}_{what}"
        QUERIES[name] = lambda spark, sf_dir, run=run: run(spark, sf_dir, lang)
        ORACLES[name] = _all(lang, sql)


for _lang in LANGUAGES:
    _register(_lang)


# --- which files are read, what is given up, which lines are shown


@query("""
WITH f AS (SELECT event_id AS k, list_value('src/a/', '.git/', 'x/node_modules/y/', '', 'a/.hidden/', 'lib/build/', 'building/')[event_id % 7 + 1]
  || list_value('m.ts', 'm.TSX', 'm.go', 'm.cs', 'm.py', 'yarn.lock', 'm.rs', 'go', 'm.d.ts', '.ts', 'go.sum')[event_id % 11 + 1] AS path FROM events)
SELECT k AS event_id, path, event_id % 7 NOT IN (1, 2, 4, 5) AND event_id % 11 NOT IN (5, 10) AS kept,
  list_value('ts', 'ts', 'go', 'cs', 'py', NULL, NULL, NULL, 'ts', 'ts', NULL)[event_id % 11 + 1] AS lang, NOT (event_id % 5 = 0 AND event_id % 3 < 2) AS is_text
FROM f JOIN events ON k = event_id""")
def files_dispatched(spark, sf_dir):
    """Excluded directories and files, languages by extension, text by its first 8,192 bytes (a NUL stands at 0, 8,191, 8,192 or nowhere)."""
    e, pick = F.col("event_id"), lambda by, *xs: F.element_at(F.array(*map(F.lit, xs)), (e % by + 1).cast("int"))
    path = F.concat(
        pick(7, "src/a/", ".git/", "x/node_modules/y/", "", "a/.hidden/", "lib/build/", "building/"),
        pick(11, "m.ts", "m.TSX", "m.go", "m.cs", "m.py", "yarn.lock", "m.rs", "go", "m.d.ts", ".ts", "go.sum"),
    )
    before = pick(3, 0, 8191, 8192)
    content = F.encode(F.concat(F.repeat(F.lit("x"), before), F.when(e % 5 == 0, F.lit("\x00")).otherwise("y")), "UTF-8")
    rows = table(spark, sf_dir, "events").select("event_id", path.alias("path"), content.alias("content"))
    return rows.select("event_id", "path", sources.kept(F.col("path")).alias("kept"), sources.language(F.col("path")).alias("lang"), sources.is_text(F.col("content")).alias("is_text"))


@query("""SELECT 'f' || c_custkey || list_value('.ts', '.go', '.cs', '.py')[c_custkey % 4 + 1] AS file, c_custkey % 3 = 0 AS given_up, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS entities FROM customer""")
def files_given_up(spark, sf_dir):
    """Every third file has unmatched brackets or bad statements above a tenth of it: it yields nothing, the others all of theirs."""
    key = F.col("c_custkey")
    langs = ["ts", "go", "cs", "py"]
    good = ["function f() { return 1 }", "package p\nfunc f() int { return 1 }", "class f { }", "def f():\n    return 1\n"]
    bad = ["((((( [[[ {{{ function f() { return 1 }", "package p\nfunc f( { {{ ((", "class f { { { ( (", "def f(:\n  ) return ][\n"]
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (key % 4 + 1).cast("int"))
    files = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(
        F.concat(F.lit("f"), key.cast("string"), F.lit("."), pick(langs)).alias("rel_path"), pick(langs).alias("lang"),
        F.encode(F.when(key % 3 == 0, pick(bad)).otherwise(pick(good)), "UTF-8").alias("content"),
    )
    return extract_facts(files, REPO).select("file", F.col("parse_error").isNotNull().alias("given_up"), F.size("entities").alias("entities"))


@query(r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, doc_id % 4 AS a, doc_id % 4 + doc_id % 3 - 1 AS b FROM documents)
SELECT doc_id, array_to_string(list_transform(list_slice(lines, greatest(a, 1), greatest(b, 0)), lambda x: regexp_replace(x, '\r$', '') || chr(10)), '') AS shown,
  coalesce(regexp_replace(lines[a], '\r$', ''), '') AS line FROM t WHERE text IS NOT NULL AND a > 0""")
def lines_shown(spark, sf_dir):
    """Line ranges, also empty and beyond the end, and single lines of whole texts."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("a", (F.col("doc_id") % 4).cast("int")).where("a > 0")
    end = (F.col("a") + F.col("doc_id") % 3 - 1).cast("int")
    return docs.select("doc_id", text.lines_of(F.col("text"), F.col("a"), end).alias("shown"), text.first_line(F.col("text"), F.col("a")).alias("line"))
