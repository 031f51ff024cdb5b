"""Results as text and JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def rows_text(df: DataFrame, *columns: str) -> str:
    """One line a row, fields by two spaces; rows come a partition at a time."""
    return "\n".join("  ".join("" if r[c] is None else str(r[c]) for c in columns) for r in df.select(*columns).toLocalIterator())


def entities_text(df: DataFrame) -> str:
    return rows_text(df, "entity_id", "kind", "qualified", "file", "start_line")


def stats_text(stats: dict) -> str:
    head = f"{stats['repo']}: {stats['files']} files, {stats['entities']} entities, {stats['edges']} edges, bug rate {stats['bug_rate']:.1%}"
    return "\n".join([head, *(f"  {k}: {n}" for k, n in stats["dispositions"].items())])


def capsule_text(items: DataFrame) -> str:
    rows = items.collect()
    lines = [f"[{r.handle}] {r.category} {r.level}{' (sent)' if r.already_sent else ''}: {r.text}" for r in rows]
    return "\n".join([f"{sum(r.tokens for r in rows)} tokens, {len(rows)} items", *lines])


def inspection_text(entity, fan_in: DataFrame, fan_out: DataFrame) -> str:
    head = f"{entity.kind} {entity.qualified}  {entity.file}:{entity.start_line}-{entity.end_line}"
    return f"{head}\nin:\n{rows_text(fan_in, 'kind', 'src')}\nout:\n{rows_text(fan_out, 'kind', 'dst')}"


def related_text(df: DataFrame, entities: DataFrame) -> str:
    """Entities by distance, each with its place."""
    places = entities.select("entity_id", "kind", "qualified", "file", "start_line").dropDuplicates(["entity_id"])
    return rows_text(df.join(places, "entity_id").orderBy("depth", "qualified"), "depth", "kind", "qualified", "file", "start_line")


def impact_text(df: DataFrame, entities: DataFrame) -> str:
    """What leads to the start, nearest first; callers one step away and tests are marked, and the last line counts them."""
    names = entities.select("entity_id", "qualified").dropDuplicates(["entity_id"])
    lines, tests = [], 0
    for r in df.join(names, "entity_id").orderBy("depth", "qualified").toLocalIterator():
        tests += r.is_test
        lines.append(f"{r.depth}  {r.qualified}{'  direct' if r.depth == 1 else ''}{'  test' if r.is_test else ''}")
    return "\n".join([*lines, f"{len(lines)} impacted, {tests} tests"])


def diff_impact_text(parts: dict[str, DataFrame], entities: DataFrame) -> str:
    return f"changed:\n{rows_text(parts['changed'].orderBy('qualified'), 'kind', 'qualified', 'file', 'start_line')}\nimpacted:\n{impact_text(parts['impacted'], entities)}"


def path_text(start: str, hops: DataFrame, entities: DataFrame) -> str:
    """One line a hop, by the edge kind that leads there."""
    names = entities.select("entity_id", "qualified").dropDuplicates(["entity_id"])
    steps = hops.join(names, "entity_id").orderBy("depth").collect()
    return "\n".join([start, *(f"  {r.depth}. {r.via.kind} {r.qualified}" for r in steps)]) if steps else f"no path from {start}"


def pairs_text(df: DataFrame) -> str:
    """One line a pair: score, whether the bodies are equal, both names with their files, and the key that ``decide`` takes."""
    return "\n".join(f"{r.overall:.2f}  {'exact' if r.exact else 'near '}  {r.a_qualified} ({r.a_file})  {r.b_qualified} ({r.b_file})  {r.a} {r.b}" for r in df.toLocalIterator())


def benchmark_text(tasks: DataFrame, summary: DataFrame) -> str:
    s = summary.first()
    tail = f"recall {s.recall:.2f}, precision {s.precision:.2f}, {s.tokens} tokens, reduction {s.reduction or 0:.1%}: {'pass' if s.passed else 'fail'}"
    return "\n".join([rows_text(tasks, "task", "recall", "precision", "tokens", "baseline"), tail])


def to_json(value) -> str:
    if isinstance(value, DataFrame):
        return "[" + ",".join(value.toJSON().collect()) + "]"
    return json.dumps(value, default=str)
