"""Source trees as tables: scan, exclusion, language dispatch and detection, line ranges."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T

#: Directories and lockfiles that are never read.
SKIPPED_DIRS = ".git .next bin build coverage dist generated node_modules out target vendor".split()
SKIPPED_FILES = "Cargo.lock Gemfile.lock composer.lock go.sum package-lock.json pnpm-lock.yaml yarn.lock".split()
EXTENSIONS = {"ts": "ts", "tsx": "ts", "go": "go", "cs": "cs", "py": "py"}
MARKERS = {"tsconfig.json": "ts", "go.mod": "go", "pyproject.toml": "py", "requirements.txt": "py", "setup.py": "py"}
SNIFFED = 8192


def relative(path: Column, root: str) -> Column:
    base = root.rstrip("/")
    bare = base.removeprefix("file://").removeprefix("file:")
    return F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), "^" + _quoted(bare) + "/", "")


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def kept(rel_path: Column) -> Column:
    """Neither in a hidden or skipped directory nor a lockfile."""
    parts = F.split(rel_path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    bad = F.exists(dirs, lambda d: d.startswith(".") | d.isin(*SKIPPED_DIRS))
    return ~bad & ~F.element_at(parts, -1).isin(*SKIPPED_FILES)


def is_text(content: Column) -> Column:
    """No NUL among the first bytes."""
    return ~F.regexp_like(F.hex(F.substring(content, 1, SNIFFED)), F.lit("^(?:..)*?00"))


def language(rel_path: Column) -> Column:
    ext = F.lower(F.regexp_extract(rel_path, r"\.([^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]


def scan(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """(path, rel_path, lang, content) of the sources under ``root``; only files of known languages are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{%s}" % ",".join(EXTENSIONS)).load(root)
    files = raw.select("path", relative(F.col("path"), root).alias("rel_path"), "content")
    files = files.withColumn("lang", language(F.col("rel_path"))).where(kept(F.col("rel_path")) & is_text(F.col("content")))
    if languages is not None:
        files = files.where(F.col("lang").isin(*languages))
    return files.select("path", "rel_path", "lang", "content")


def as_text(files: DataFrame) -> DataFrame:
    return files.select(F.col("rel_path").alias("path"), F.decode("content", "UTF-8").alias("text"))


def detect_languages(spark: SparkSession, root: str) -> list[str]:
    """Languages of a marker file at the root or of any source file."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(relative(F.col("path"), root).alias("p"))
    marks = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])[F.col("p")]
    found = listing.where(kept(F.col("p"))).select(F.explode(F.array(marks, language(F.col("p")), F.when(F.col("p").rlike(r"^[^/]+\.(csproj|sln)$"), "cs"))).alias("lang"))
    return sorted(r.lang for r in found.where("lang IS NOT NULL").distinct().collect())


def line_range(files: DataFrame, path: str, start: int, end: int) -> str:
    row = files.where(F.col("path") == path).select(T.lines_of(F.col("text"), F.lit(start), F.lit(end)).alias("t")).first()
    return row.t if row else ""


def base_name(path: str) -> str:
    return posixpath.basename(path)
