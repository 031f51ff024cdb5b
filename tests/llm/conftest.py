import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_fixtures import docs, empty, rows  # noqa: E402, F401
