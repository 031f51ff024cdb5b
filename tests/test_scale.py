"""Work is dealt over tasks and done once, whatever the tables' files look like."""

import os

import pytest

from skein.operators.extract import EXTRACTORS, facts_of
from skein.plans import catalog_extraction, catalog_operators  # noqa: F401  registers its queries
from skein.plans.registered import QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the provided tables are absent")


def plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


@needs_tables
@pytest.mark.parametrize("lang", sorted(EXTRACTORS))
def test_extraction_is_dealt_over_tasks(spark, lang):
    """The customers of one file in one row group came to one task."""
    cores = spark.sparkContext.defaultParallelism
    assert cores > 1
    assert QUERIES[f"extract_{lang}_entities"](spark, SF).rdd.getNumPartitions() >= cores
    assert QUERIES[f"extract_{lang}_references"](spark, SF).rdd.getNumPartitions() >= cores


@needs_tables
@pytest.mark.parametrize("lang", sorted(EXTRACTORS))
def test_files_are_extracted_once(spark, lang):
    """Four tables of bindings took four extractions, edges seven."""
    assert "MapInArrow" not in plan(QUERIES[f"extract_{lang}_bindings"](spark, SF))
    assert "MapInArrow" in plan(QUERIES[f"extract_{lang}_entities"](spark, SF))


@pytest.mark.parametrize("lang", ["ts", "go", "cs"])
def test_sources_that_end_anywhere(lang):
    """Looking ahead of the last token finds nothing and ends in no error."""
    for s in catalog_extraction.LANGUAGES[lang]:
        for end in range(len(s.text)):
            found = facts_of("repo", s.path, lang, s.text[:end].encode())
            assert found["parse_error"] is None or "can't be parsed" in found["parse_error"]


@needs_tables
@pytest.mark.parametrize("lang", sorted(EXTRACTORS))
def test_only_lists_that_are_read_leave_the_workers(spark, lang):
    """All six lists of every file went to the JVM, whichever were read."""
    assert "refs#" in plan(QUERIES[f"extract_{lang}_references"](spark, SF))
    assert "refs#" not in plan(QUERIES[f"extract_{lang}_entities"](spark, SF))
    assert "entities#" not in plan(QUERIES[f"extract_{lang}_references"](spark, SF))
    assert "refs#" not in plan(QUERIES[f"extract_{lang}_bindings"](spark, SF))


def test_long_file_with_a_wide_letter():
    """Each place was counted from the file's start; a file of 1 MB took over five seconds and was given up."""
    found = facts_of("repo", "a.ts", "ts", ("é();\n" + "call();\n" * 150_000).encode())
    assert found["parse_error"] is None and len(found["refs"]) == 150_001
    assert found["refs"][-1]["start_byte"] == 6 + 8 * 149_999 and found["refs"][-1]["start_line"] == 150_001


@pytest.mark.parametrize("lang", ["ts", "go", "cs"])
def test_tokens_at_once_are_those_one_by_one(lang):
    from skein.operators.extract.lexer import Unit

    odd = ["a / b /* c */ // d\n'e' \"f\\\"g\" `h\ni` $\"j\" @k 1.5 \u0664 \U0001d7ce \u0085\u00a0é \x1c :=", "/* open", "'open", "", "x /= 2; y = a ? /r(/.test(z) : 0", "return /[/(]/g; (1)"]
    for source in odd + [s.text for s in catalog_extraction.LANGUAGES[lang]]:
        u = Unit("repo", "a", lang, source)
        got = u.texts[: u.n], u.kinds[: u.n], u.ats, [u.lines[i] for i in range(u.n)]
        u._scan_slowly() if lang == "ts" or "/r" not in source and "/[" not in source else None
        assert got == (u.texts[: u.n], u.kinds[: u.n], u.ats, [source[:i].count("\n") + 1 for i in u.ats])


def test_large_candidate_sets_are_dealt(spark, monkeypatch):
    """A set joins its references last, in as many tasks as their candidates ask for; before, each reference carried its candidates."""
    from pyspark.sql import functions as F

    from skein.operators import resolve

    monkeypatch.setattr(resolve, "MOST_CANDIDATES", 10)
    names = [f"e{i}" for i in range(5)]
    tables = {
        "files": spark.createDataFrame([(f"d{i}/a.go", "go", "") for i in range(3)], "file string, lang string, content_hash string"),
        "entities": spark.createDataFrame([(n, "Function", "go", "", "f", "", f"d{i % 2}/a.go") for i, n in enumerate(names)], "entity_id string, kind string, lang string, qualified string, name string, owner string, file string"),
        "refs": spark.createDataFrame(
            [(i, f"d{i % 3}/a.go", "go", "call", "s", "unqualified", "f" if i % 5 else "gone", "", "", 1) for i in range(60)],
            "ref_id bigint, file string, lang string, kind string, src string, scope string, name string, member string, receiver_type string, start_line int",
        ),
        "imports": spark.createDataFrame([], "file string, lang string, ord int, local_name string, source string, imported_name string, is_namespace boolean, is_default boolean"),
        "reexports": spark.createDataFrame([], "file string, ord int, source string, is_star boolean, exported_name string, local_alias string"),
        "ext_methods": spark.createDataFrame([], "file string, entity_id string, name string, extended_type string"),
        "field_types": spark.createDataFrame([], "file string, lang string, owner string, field string, type string"),
    }
    found = {r.ref_id: (r.disposition, r.candidates) for r in resolve.resolve(tables, candidates=lambda ids: F.array_join(ids, " ")).collect()}
    seen = {0: "e0 e2 e4", 1: "e1 e3", 2: "e0 e1 e2 e3 e4"}
    assert found == {i: ("ambiguous", seen[i % 3]) if i % 5 else ("bug-extractor", None) for i in range(60)}


@needs_tables
def test_tasks_are_budgeted_in_batches(spark):
    """Each task was a group of its own in pandas."""
    shown = plan(QUERIES["capsules_budgeted"](spark, SF))
    assert "MapInArrow" in shown and "FlatMapGroups" not in shown


def test_steps_group_a_pair_once_and_repeat_no_ends(spark):
    """Steps carried their edge's ends beside their own, and were grouped once for each way."""
    from skein.operators import graph

    rows = [("a", "b", "USES"), ("b", "a", "CALLS"), ("a", "b", "CALLS"), ("c", "b", "USES"), ("b", "b", "USES"), ("d", None, "USES"), ("c", "d", None), ("c", "d", "USES")]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string")
    for undirected in (True, False):
        steps = graph._steps(edges, undirected)
        assert "via" not in steps.columns
        got = sorted((r.at, r.to, r.via.src, r.via.dst, r.via.kind or "") for r in steps.select("at", "to", graph._via().alias("via")).collect())
        best: dict = {}
        for s, d, k in rows:
            for at, to in ((d, s), (s, d)) if undirected else ((d, s),):
                if d is not None and at != to:
                    best[at, to] = min(best.get((at, to), (s, d, k or "")), (s, d, k or ""))
        assert got == sorted((*ends, *e) for ends, e in best.items())


@needs_tables
def test_work_of_the_findings_of_round_2_is_done_once(spark):
    """Neighbours' behaviours were made twice; every pattern was looked for once a task; ids were gathered before a semi-join; bodies came to two tasks."""
    assert plan(QUERIES["combined_scores"](spark, SF)).count("collect_set") == 1
    assert "Aggregate [pattern" in plan(QUERIES["baseline_cost"](spark, SF))
    assert "Distinct" not in plan(QUERIES["edges_dangling_dropped"](spark, SF))
    assert "Generate explode(array_distinct(concat" not in plan(QUERIES["seeds_topk"](spark, SF))
    assert QUERIES["token_fingerprints"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


ASKED = [("entities",), ("refs",), ("imports", "reexports", "ext_methods", "field_types")]


@pytest.mark.parametrize("lang", ["cs", "py", "ts"])
def test_only_what_is_asked_for_is_extracted(lang):
    """Every list of a file was extracted, whichever were read; those read are the same, their order included."""
    for s in catalog_extraction.LANGUAGES[lang]:
        source = s.text.replace("~k", "7").replace("~a", "1").replace("~p", s.params[1]).encode()
        every = facts_of("repo", s.path, lang, source)
        for lists in ASKED:
            some = facts_of("repo", s.path, lang, source, lists)
            assert {k: some[k] for k in lists} == {k: every[k] for k in lists}
            assert ("entities" in lists) == bool(some["entities"]) and ("refs" in lists) == bool(some["refs"])


def test_file_of_many_functions():
    """Each reference looked at every function of its file; 12,000 of both took over five seconds, and the file was given up."""
    found = facts_of("repo", "a.cs", "cs", ("class C {\n" + "".join(f"void m{i}() {{ f(); }}\n" for i in range(12_000)) + "}").encode(), ("refs",))
    assert found["parse_error"] is None and len({r["src"] for r in found["refs"]}) == len(found["refs"]) == 12_000


def test_long_expressions_and_chains():
    """Nodes were walked by recursion; a sum of a thousand calls ended in an error, and the file was given up. Lists agree on it."""
    chain = "if a == 0: pass\n" + "".join(f"elif a == {i}: import m{i}\n" for i in range(1, 300))
    source = (f"class C: pass\nx = {' + '.join(f'f({i})' for i in range(1_500))}\n{chain}").encode()
    found = [facts_of("repo", "a.py", "py", source, lists) for lists in ASKED]
    assert [f["parse_error"] for f in found] == [None] * 3
    assert len(found[0]["entities"]) == 1 and len(found[1]["refs"]) == 1_500 and [x["source"] for x in found[2]["imports"]] == [f"m{i}" for i in range(1, 300)]
    assert [r["start_byte"] for r in found[1]["refs"]] == sorted(r["start_byte"] for r in found[1]["refs"])
