"""Project files read on the driver: repository settings, tsconfig, go.mod, csproj; and git diffs."""

from __future__ import annotations

import json
import posixpath
import re
import subprocess
import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from skein.operators.resolve import Config
from skein.sources.files import SKIPPED_DIRS

SETTINGS = ".skein.json"


def load_settings(root: str) -> dict:
    """Settings of a repository; what can't be read counts as absent."""
    try:
        found = json.loads(Path(root, SETTINGS).read_text())
        return found if isinstance(found, dict) else {}
    except (OSError, ValueError):
        return {}


def save_settings(root: str, settings: dict) -> None:
    Path(root, SETTINGS).write_text(json.dumps(settings, indent=2) + "\n")


def enabled_languages(root: str, detected: list[str]) -> list[str]:
    named = load_settings(root).get("languages")
    return [x for x in named if x in ("ts", "go", "cs", "py")] if isinstance(named, list) and named else detected


def _json(text: str) -> dict:
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", text))


def tsconfig(root: str) -> tuple[str, dict[str, list[str]]]:
    """(base, paths): of a chain of ``extends`` the nearest file that states a value wins, wholly."""
    base, paths, seen = None, None, set()
    at = Path(root, "tsconfig.json")
    while at not in seen and at.is_file():
        seen.add(at)
        try:
            found = _json(at.read_text())
        except ValueError:
            break
        options = found.get("compilerOptions", {})
        if base is None and "baseUrl" in options:
            base = posixpath.normpath(posixpath.join(at.parent.relative_to(root).as_posix() if at.parent != Path(root) else ".", options["baseUrl"]))
        if paths is None and "paths" in options:
            paths = options["paths"]
        parent = found.get("extends")
        if not isinstance(parent, str) or not parent.startswith("."):
            break
        at = (at.parent / (parent if parent.endswith(".json") else f"{parent}.json")).resolve()
    return base or "", paths or {}


def go_module(root: str) -> str:
    try:
        for line in Path(root, "go.mod").read_text().splitlines():
            if line.startswith("module "):
                return line.removeprefix("module ").strip()
    except OSError:
        pass
    return ""


def cs_projects(root: str) -> list[tuple[str, str, list[str]]]:
    out = []
    for path in sorted(Path(root).rglob("*.csproj")):
        inside = path.relative_to(root)
        if any(p.startswith(".") or p in SKIPPED_DIRS for p in inside.parts[:-1]):
            continue
        try:
            tree = ET.parse(path)
        except (ET.ParseError, OSError):
            continue
        here = inside.parent.as_posix()
        name = next((x.text for x in tree.iter() if x.tag.rpartition("}")[2] == "RootNamespace" and x.text), path.stem)
        refs = [x.get("Include", "").replace("\\", "/") for x in tree.iter() if x.tag.rpartition("}")[2] == "ProjectReference"]
        out.append((here, name.strip(), [posixpath.dirname(posixpath.normpath(posixpath.join(here, r))) or "." for r in refs if r]))
    return out


def config_of(root: str) -> Config:
    base, paths = tsconfig(root)
    return Config(go_module(root), base, paths, cs_projects(root))


def diff_lines(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """(diff_id, pos, line) of the working tree against ``ref``."""
    text = subprocess.run(["git", "-C", root, "diff", "--unified=0", ref or "HEAD"], capture_output=True, text=True, check=True).stdout
    return diff_table(spark, text)


def diff_table(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(text.splitlines())], "diff_id int, pos int, line string")
