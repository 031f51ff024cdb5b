"""From files to facts: one nested row per file, in parallel over files.

An extractor is ``extract(repo, file, source, lists)``. A file that fails, takes over
five seconds, or has too large a share of errors (unmatched brackets; in Python
statements that don't parse) yields a row with ``parse_error`` and no
facts, and costs nobody else anything.
"""

from __future__ import annotations

import contextlib
import gc
import signal
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skein.functions.identity import sha_hex
from skein.operators.extract import cs, go, py, ts
from skein.operators.extract.lexer import LISTS
from skein.schemas import FACTS

EXTRACTORS = {"ts": ts.extract, "go": go.extract, "cs": cs.extract, "py": py.extract}
MOST_ERRORS, MOST_SECONDS = 0.10, 5.0
#: Files whose facts leave a worker together.
MOST_ROWS = 500


class _TooSlow(Exception):
    pass


@contextlib.contextmanager
def _at_most(seconds: float):
    """Ends the block by an exception after ``seconds``; signals reach main threads only, which is where Spark's workers run."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise _TooSlow(f"over {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


@contextlib.contextmanager
def _no_collection():
    """Facts and syntax trees are many small objects without cycles: looking for cycles while they are made finds none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def facts_of(repo: str, file: str, lang: str, content: bytes, lists: tuple[str, ...] = LISTS) -> dict:
    """The row of a file; an extractor leaves out what only lists other than ``lists`` need."""
    row = {"file": file, "lang": lang, "parse_error": None, "error_ratio": 0.0, "content_hash": sha_hex(content), **{k: [] for k in LISTS}}
    try:
        with _at_most(MOST_SECONDS):
            found = EXTRACTORS[lang](repo, file, content.decode(errors="replace"), lists)
        if not isinstance(found, dict):
            row["error_ratio"] = found.error_ratio
            if found.error_ratio > MOST_ERRORS:
                return row | {"parse_error": f"{found.error_ratio:.0%} of it can't be parsed"}
            found = found.facts()
        return row | found
    except Exception as e:  # noqa: BLE001  one bad file must not end the job
        return row | {"parse_error": f"{type(e).__name__}: {e}"[:300]}


def extract_facts(files: DataFrame, repo: str, lists: tuple[str, ...] = LISTS) -> DataFrame:
    """FACTS rows from (rel_path, lang, content), of their lists only ``lists``. Files that come in few partitions are best dealt anew (``storage.spread``) first."""
    facts = files.sparkSession.createDataFrame([], FACTS)
    facts = facts.drop(*(k for k in LISTS if k not in lists)).schema
    schema = to_arrow_schema(facts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, MOST_ROWS):
                part = batch.slice(first, MOST_ROWS)
                with _no_collection():
                    rows = [facts_of(repo, *f, lists) for f in zip(*(part.column(c).to_pylist() for c in ("rel_path", "lang", "content")), strict=True)]
                    found = pa.RecordBatch.from_pylist(rows, schema)
                    del rows
                yield found

    return files.select("rel_path", "lang", "content").mapInArrow(run, facts)


def tables_of(facts: DataFrame, repo: str) -> dict[str, DataFrame]:
    """The flat tables of good files, as far as ``facts`` has their lists; list places become ``ord``, references get stable numbers."""
    good = facts.where("parse_error IS NULL")
    columns = {
        "entities": [
            "x.entity_id", "x.kind", "lang", F.lit(repo).alias("repo"), "x.qualified", "x.name", "x.owner",
            F.lit("").alias("signature"), F.lit("").alias("doc_summary"), "x.anchor", "file", F.col("x.anchor.start_line").alias("start_line"), F.col("x.anchor.end_line").alias("end_line"),
        ],
        "refs": [F.xxhash64("file", "ord").alias("ref_id"), "file", "lang", "x.*"],
        "imports": ["file", "lang", "ord", "x.*"],
        "reexports": ["file", "ord", "x.*"],
        "ext_methods": ["file", "x.*"],
        "field_types": ["file", "lang", "x.*"],
    }
    flat = {k: good.select("file", "lang", F.posexplode(k).alias("ord", "x")).select(*c) for k, c in columns.items() if k in facts.columns}
    return flat | {"files": good.select("file", "lang", "content_hash")}
