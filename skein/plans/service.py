"""One façade over a repository's snapshot; command line and HTTP are thin adapters of it."""

from __future__ import annotations

import functools
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.identity import sha_hex
from skein.operators import aggregate, graph, search, similar
from skein.operators import compile as compiler
from skein.operators import resolve as resolver
from skein.operators.extract import extract_facts, tables_of
from skein.sources import files as source_files
from skein.sources import projects, store
from skein.storage import cut


class Service:
    def __init__(self, spark: SparkSession, root: str, warehouse: str):
        self.spark, self.root, self.repo = spark, root.rstrip("/"), root.rstrip("/").rpartition("/")[2]
        self.state = store.state_dir(warehouse, root)
        self.decisions = store.Decisions(f"{self.state}/decisions.json")

    # --- index

    def languages(self) -> list[tuple[str, bool, bool]]:
        """(language, detected, enabled)."""
        found = source_files.detect_languages(self.spark, self.root)
        enabled = projects.enabled_languages(self.root, found)
        return [(x, x in found, x in enabled) for x in ("ts", "go", "cs", "py")]

    def sources(self) -> DataFrame:
        return source_files.as_text(source_files.scan(self.spark, self.root))

    def _resolved(self, tables: dict[str, DataFrame]) -> DataFrame:
        return cut(resolver.resolve(tables, projects.config_of(self.root)), "resolved")

    def _publish(self, tables: dict[str, DataFrame], edges: DataFrame, counts: DataFrame) -> dict:
        config = projects.config_of(self.root)
        where = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", r"/[^/]*$", "")).otherwise(".")
        targets = resolver.import_targets(tables["imports"], tables["reexports"], tables["files"].withColumn("dir", where), config)
        store.write_snapshot(self.state, self.repo, {**tables, "edges": edges, "dispositions": counts, "targets": targets})
        return self.stats()

    def index(self) -> dict:
        """Read, extract and resolve everything, and publish a snapshot."""
        began = time.time()
        enabled = [x for x, _, on in self.languages() if on]
        facts = cut(extract_facts(source_files.scan(self.spark, self.root, enabled), self.repo), "facts")
        tables = tables_of(facts, self.repo)
        resolved = self._resolved(tables)
        counts = aggregate.disposition_histogram(resolved, ("file",)).withColumn("repo", F.lit(self.repo))
        out = self._publish(tables, resolver.edges_of(resolved), counts)
        return out | {"seconds": time.time() - began, "failed_files": facts.where("parse_error IS NOT NULL").count()}

    def update(self, changed: list[str]) -> dict:
        """Index changed paths again, and resolve them and whatever depended on them before or does now.

        Equal contents are no change. A file that fails keeps its previous facts.
        Edges are replaced by source file, so nothing is counted twice.
        """
        old = self.snapshot()
        names = self.spark.createDataFrame([(p,) for p in sorted(set(changed))], "file string")
        on_disk = source_files.scan(self.spark, self.root).withColumnRenamed("rel_path", "file").join(names, "file")
        fresh = cut(extract_facts(on_disk.withColumnRenamed("file", "rel_path"), self.repo), "fresh")
        before = old.table("files")
        same = fresh.join(before.select("file", "content_hash"), ["file", "content_hash"], "left_semi").select("file")
        failed = fresh.where("parse_error IS NOT NULL").select("file")
        moved = cut(names.join(same.union(failed), "file", "left_anti"), "moved")
        if moved.isEmpty():
            return self.stats() | {"changed": 0, "resolved_again": 0}
        new = tables_of(fresh.join(moved, "file", "left_semi"), self.repo)
        merged = {k: cut(old.table(k).join(moved, "file", "left_anti").unionByName(new[k]), k) for k in new}
        where = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", r"/[^/]*$", "")).otherwise(".")
        config = projects.config_of(self.root)
        now = merged["files"].withColumn("dir", where)
        later = resolver.import_targets(merged["imports"], merged["reexports"], now, config)
        hit = resolver.dependents(before.withColumn("dir", where), old.table("targets"), moved).union(resolver.dependents(now, later, moved)).union(moved).distinct()
        hit = cut(hit, "impacted")
        again = self._resolved({**merged, "refs": merged["refs"].join(hit, "file", "left_semi")})
        edges = old.edges.join(hit.withColumnRenamed("file", "src_file"), "src_file", "left_anti").unionByName(resolver.edges_of(again))
        counts = aggregate.merge_counts(old.table("dispositions"), aggregate.disposition_histogram(again, ("file",)).withColumn("repo", F.lit(self.repo)), hit)
        gone = names.join(on_disk.select("file"), "file", "left_anti")
        counts = counts.join(gone, "file", "left_anti")
        return self._publish(merged, cut(edges, "edges"), cut(counts, "counts")) | {"changed": moved.count(), "resolved_again": hit.count()}

    def snapshot(self) -> store.Snapshot:
        return store.Snapshot(self.spark, self.state)

    def entities(self) -> DataFrame:
        return self.snapshot().entities

    # --- reads

    def stats(self) -> dict:
        snap = self.snapshot()
        counts = snap.table("dispositions").groupBy("disposition").agg(F.sum("n").alias("n"))
        return {
            "repo": self.repo, "files": snap.table("files").count(), "entities": snap.entities.count(), "edges": snap.edges.count(),
            "kinds": {r.kind: r.n for r in aggregate.stats_by_kind(snap.entities).collect()},
            "dispositions": {r.disposition: r.n for r in aggregate.in_display_order(counts).collect()},
            "bug_rate": aggregate.bug_rate(counts).first().bug_rate,
        }

    def find(self, name: str) -> DataFrame:
        return search.find(self.entities(), name)

    def suggest(self, query: str, kind: str | None = None, limit: int = 8) -> DataFrame:
        return search.suggest(self.entities(), query, kind, limit)

    def inspect(self, name: str, file_part: str = "") -> dict:
        snap = self.snapshot()
        e = search.find_unique(snap.entities, name, file_part)
        return {"entity": e, "fan_in": graph.fan_in(snap.edges, e.entity_id), "fan_out": graph.fan_out(snap.edges, e.entity_id)}

    def source(self, name: str, file_part: str = "") -> str:
        e = search.find_unique(self.entities(), name, file_part)
        return source_files.line_range(self.sources(), e.file, e.start_line, e.end_line)

    def _start(self, entity_id: str) -> DataFrame:
        return self.spark.createDataFrame([(entity_id,)], "entity_id string")

    def related(self, name: str, depth: int = 2, file_part: str = "") -> DataFrame:
        snap = self.snapshot()
        e = search.find_unique(snap.entities, name, file_part)
        return graph.related(snap.entities, snap.edges, self._start(e.entity_id), depth)

    def impact(self, name: str, file_part: str = "") -> DataFrame:
        snap = self.snapshot()
        e = search.find_unique(snap.entities, name, file_part)
        return graph.impact(snap.entities, snap.edges, self._start(e.entity_id))

    def impact_of_diff(self, ref: str = "HEAD", lines: DataFrame | None = None) -> dict[str, DataFrame]:
        """changed: entities a diff touches; impacted: what leads to them; tests: the tests among those."""
        snap = self.snapshot()
        hunks = graph.diff_hunks(projects.diff_lines(self.spark, self.root, ref) if lines is None else lines)
        changed = cut(graph.changed_entities(snap.entities, hunks), "changed")
        hit = cut(graph.impact(snap.entities, snap.edges, changed.select("entity_id").distinct()), "impact")
        found = hit.groupBy("entity_id").agg(F.min("depth").alias("depth"), F.bool_or("is_test").alias("is_test"))
        return {"changed": changed, "impacted": found, "tests": found.where("is_test")}

    def path(self, start: str, target: str) -> DataFrame:
        snap = self.snapshot()
        a, b = search.find_unique(snap.entities, start), search.find_unique(snap.entities, target)
        return graph.shortest_path(snap.entities, snap.edges, a.entity_id, b.entity_id)

    def whole_graph(self) -> tuple[DataFrame, DataFrame]:
        snap = self.snapshot()
        return snap.entities, snap.edges

    # --- context

    def context(self, prompt: str, budget: int = compiler.DEFAULT_BUDGET, session: str = "", file_part: str = "", count=compiler.byte_quarters) -> DataFrame:
        """The capsule of a task: chosen items with handles, in delivery order. A session remembers what it was given."""
        snap = self.snapshot()
        e = snap.entities
        tasks = self.spark.createDataFrame([("task", prompt)], "task string, prompt string")
        terms = cut(compiler.terms_of(tasks), "terms")
        scored = compiler.scores(terms, cut(compiler.term_weights(terms, e), "weights"), e)
        found = compiler.expand(compiler.seeds(scored, e, file_part), e, snap.edges)
        ledger_file = store.Ledger(f"{self.state}/ledger-{sha_hex(session.encode(), 16)}.json") if session else None
        ledger = ledger_file.table(self.spark, session) if ledger_file else self.spark.createDataFrame([], "session_id string, entity_id string, handle_no int, level int")
        levelled = compiler.with_levels(found, ledger.select(F.lit("task").alias("task"), "entity_id", "level"))
        texts = cut(compiler.rendered(levelled, e, self.sources()).withColumn("tokens", count(F.col("text"))), "candidates")
        chosen = cut(compiler.budgeted(texts, budget), "capsule")
        number = F.array_position(F.array(*[F.lit(x) for x in compiler.LEVELS]), F.col("level")) - 1
        delivered = chosen.select(F.lit(session).alias("session_id"), "entity_id", number.cast("int").alias("level"), "place")
        after = cut(compiler.upgrade_ledger(ledger, delivered), "ledger")
        if ledger_file:
            ledger_file.store(after)
        handles = after.select("entity_id", F.concat(F.lit("E"), F.col("handle_no").cast("string")).alias("handle"))
        return chosen.join(handles, "entity_id").orderBy("place")

    def benchmark(self, task_file: str, budget: int = compiler.DEFAULT_BUDGET, count=compiler.byte_quarters) -> tuple[DataFrame, DataFrame]:
        """A task set compiled as one batch: per task (task, recall, precision, tokens, baseline), and the summary row.

        The baseline of a task is its gold files and the output of its search steps, read whole.
        """
        snap = self.snapshot()
        e = snap.entities
        tasks = cut(store.load_tasks(self.spark, task_file).withColumnRenamed("id", "task"), "tasks")
        terms = cut(compiler.terms_of(tasks.select("task", "prompt")), "terms")
        scored = compiler.scores(terms, cut(compiler.term_weights(terms, e), "weights"), e)
        found = compiler.expand(compiler.seeds(scored, e), e, snap.edges)
        texts = self.sources()
        shown = cut(compiler.rendered(compiler.with_levels(found), e, texts).withColumn("tokens", count(F.col("text"))), "candidates")
        chosen = cut(compiler.budgeted(shown, budget), "capsules")
        gold = tasks.select("task", F.explode("gold_files").alias("file"))
        steps = tasks.select("task", F.explode("grep_steps.pattern").alias("pattern"))
        quality = aggregate.retrieval_quality(chosen.select("task", "file"), gold)
        spent = chosen.groupBy("task").agg(F.sum("tokens").alias("tokens"))
        baseline = aggregate.baseline_tokens(gold, steps, texts, count).select("task", F.col("traced").alias("baseline"))
        out = cut(quality.join(spent, "task", "left").join(baseline, "task", "left").fillna(0, ["tokens", "baseline"]), "benchmark")
        return out.orderBy("task"), aggregate.benchmark_summary(out)

    # --- similarity

    def _pairs(self, least: float) -> DataFrame:
        snap = self.snapshot()
        e = snap.entities.where(F.col("kind").isin("Function", "Method")).dropDuplicates(["entity_id"])
        texts = self.sources().withColumnRenamed("path", "file")
        bodies = e.join(texts, "file").select("entity_id", F.col("anchor.content_hash").alias("content_hash"), T.lines_of(F.col("text"), F.col("start_line"), F.col("end_line")).alias("body"))
        return similar.find_pairs(bodies, snap.edges, snap.entities, least)

    def duplicates(self, least: float = similar.LEAST_OVERALL) -> DataFrame:
        found = similar.undecided(self._pairs(least if least > 0 else similar.LEAST_OVERALL), self.decisions.table(self.spark))
        return similar.named(found, self.entities()).orderBy(F.desc("overall"), "pair_key")

    def similar(self, name: str, file_part: str = "") -> DataFrame:
        e = search.find_unique(self.entities(), name, file_part)
        found = similar.undecided(similar.involving(cut(self._pairs(0.0), "pairs"), e.entity_id), self.decisions.table(self.spark))
        return similar.named(found, self.entities()).orderBy(F.desc("overall"), "pair_key")

    def decide(self, a: str, b: str, decision: str) -> None:
        self.decisions.decide(a, b, decision)


@functools.cache
def service(root: str, warehouse: str) -> Service:
    from skein.session import local_session

    return Service(local_session("*"), root, warehouse)
