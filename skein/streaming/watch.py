"""Watching source trees: polled changes, debounced per project, and one supervisor over all registered projects."""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import SparkSession

from skein.plans.service import Service
from skein.sources.files import EXTENSIONS, SKIPPED_DIRS, SKIPPED_FILES
from skein.sources.store import Projects

QUIET_S, POLL_S, REGISTRY_S = 0.3, 0.2, 5.0
#: A first index that takes longer is given up; the watch goes on.
INDEX_S = 60.0
T = TypeVar("T")


def listing(root: str) -> dict[str, tuple[int, int]]:
    """Relative path to (modified, size) of every source file."""
    found = {}
    for at, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in SKIPPED_DIRS)
        for f in files:
            if f.rpartition(".")[2].lower() in EXTENSIONS and f not in SKIPPED_FILES:
                try:
                    s = os.stat(full := os.path.join(at, f))
                except OSError:  # gone meanwhile
                    continue
                found[os.path.relpath(full, root)] = (s.st_mtime_ns, s.st_size)
    return found


class Debouncer:
    """Collects paths until none has come for ``quiet`` seconds; what isn't taken stays and grows, nothing is lost."""

    def __init__(self, quiet: float = QUIET_S, clock: Callable[[], float] = time.monotonic):
        self.quiet, self.clock, self.pending, self.last = quiet, clock, set(), 0.0

    def add(self, paths) -> None:
        paths = set(paths)
        if paths:
            self.pending |= paths
            self.last = self.clock()

    def take(self) -> list[str]:
        if not self.pending or self.clock() - self.last < self.quiet:
            return []
        out, self.pending = sorted(self.pending), set()
        return out


@dataclass
class Status:
    """What a project's watcher did so far."""

    project: str
    root: str
    updates: int = 0
    files: int = 0
    errors: int = 0
    last_error: str = ""
    last_update: float = 0.0
    stop: threading.Event = field(default_factory=threading.Event, repr=False)

    def public(self) -> dict:
        return {k: getattr(self, k) for k in ("project", "root", "updates", "files", "errors", "last_error", "last_update")}


def watch(status: Status, update: Callable[[list[str]], object], quiet: float = QUIET_S, poll: float = POLL_S) -> None:
    """Call ``update(paths)`` per debounced batch until ``status.stop``; a failed batch is tried again with the next."""
    before, waiting = listing(status.root), Debouncer(quiet)
    while not status.stop.wait(poll):
        now = listing(status.root)
        waiting.add(p for p in before.keys() | now.keys() if before.get(p) != now.get(p))
        before = now
        batch = waiting.take()
        if not batch:
            continue
        try:
            update(batch)
            status.updates += 1
            status.files += len(batch)
            status.last_update = time.time()
        except Exception as e:  # noqa: BLE001  one project's failure must not end its watch
            status.errors += 1
            status.last_error = f"{type(e).__name__}: {e}"[:300]
            waiting.add(batch)


def limited(spark: SparkSession, seconds: float, work: Callable[[], T]) -> T:
    """``work()``, of which no Spark job goes on after ``seconds``: a ``TimeoutError`` then, whatever it ended with."""
    tag, done, late = f"skein-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def end() -> None:
        if not done.wait(seconds):
            late.set()
            while not done.is_set():  # jobs that start after the first call end as well
                spark.sparkContext.cancelJobsWithTag(tag)
                done.wait(0.5)

    spark.sparkContext.addJobTag(tag)
    watcher = threading.Thread(target=end, daemon=True)
    watcher.start()
    try:
        return work()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"over {seconds:g} s") from e
        raise
    finally:
        done.set()
        spark.sparkContext.removeJobTag(tag)


class Supervisor:
    """One watcher per registered project, kept in step with the registry. Safe to read from other threads."""

    def __init__(self, spark: SparkSession, warehouse: str, registry: Projects):
        self.spark, self.warehouse, self.registry = spark, warehouse, registry
        self._lock, self._running = threading.RLock(), {}

    def snapshot(self) -> dict[str, Service]:
        with self._lock:
            return {n: s for n, (s, _, _) in self._running.items()}

    def operations(self) -> list[dict]:
        with self._lock:
            return [st.public() for _, st, _ in self._running.values()]

    def set(self, name: str, root: str) -> None:
        self.remove(name)
        service, status = Service(self.spark, root, self.warehouse), Status(name, root)

        def run() -> None:
            try:
                limited(self.spark, INDEX_S, service.index)
            except Exception as e:  # noqa: BLE001  its watch goes on
                status.errors, status.last_error = 1, f"{type(e).__name__}: {e}"[:300]
            watch(status, service.update)

        thread = threading.Thread(target=run, daemon=True)
        with self._lock:
            self._running[name] = (service, status, thread)
        thread.start()

    def remove(self, name: str) -> None:
        with self._lock:
            found = self._running.pop(name, None)
        if found:
            found[1].stop.set()

    def reconcile(self) -> dict[str, str]:
        """Start, stop and restart watchers as the registry says; returns what was done."""
        registered, done = dict(self.registry.list()), {}
        with self._lock:
            running = {n: st.root for n, (_, st, _) in self._running.items()}
        for name in running.keys() | registered.keys():
            if name not in registered:
                self.remove(name)
                done[name] = "stop"
            elif running.get(name) != registered[name]:
                done[name] = "restart" if name in running else "start"
                self.set(name, registered[name])
        return done

    def run(self, every: float = REGISTRY_S, stop: threading.Event | None = None) -> None:
        stop = stop or threading.Event()
        while True:
            self.reconcile()
            if stop.wait(every):
                break
        for name in list(self.snapshot()):
            self.remove(name)
