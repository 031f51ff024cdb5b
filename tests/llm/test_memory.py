"""What a Python worker holds after its task."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from skein.llm._runs import trimmed


def held() -> float:
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_an_idle_worker_gives_memory_back():
    """Freed blocks below a kept one stayed with the worker: 300 MB each in op2_token_store and op10_lm_score."""
    kept = []

    def run(batches):
        for batch in batches:
            parts = [np.ones(12_000) for _ in range(2_000)]  # 190 MB of blocks that are not mapped one by one
            kept.append(np.ones(12_000))
            del parts
            yield batch

    def left(task) -> float:
        before = held()
        assert sum(b.num_rows for b in task(iter([pa.RecordBatch.from_pydict({"x": [1, 2]})]))) == 2
        return held() - before

    assert left(run) > 150
    assert left(trimmed(run)) < 50


def test_remembered_parts_are_bounded():
    from skein.llm.token_store import Encoder

    assert Encoder.__init__.__defaults__[0] <= 600_000
