"""The provided tables as a code graph: nodes ``<table>:<key>``, edges along foreign keys."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import table

#: table -> key column, name expression
NODES = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name"),
    "customer": ("c_custkey", "c_name"),
    "supplier": ("s_suppkey", "s_name"),
    "part": ("p_partkey", "p_name"),
    "orders": ("o_orderkey", "concat('Order#', cast(o_orderkey as string))"),
}
#: source table, its key, target table, foreign key, kind
LINKS = (
    ("nation", "n_nationkey", "region", "n_regionkey", "USES"),
    ("customer", "c_custkey", "nation", "c_nationkey", "USES"),
    ("supplier", "s_suppkey", "nation", "s_nationkey", "USES"),
    ("orders", "o_orderkey", "customer", "o_custkey", "CALLS"),
    ("lineitem", "l_orderkey", "part", "l_partkey", "CALLS"),
    ("lineitem", "l_orderkey", "supplier", "l_suppkey", "CALLS"),
)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, (key, label) in NODES.items():
        parts.append(
            table(spark, sf_dir, name).select(
                F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("entity_id"), F.lit(name).alias("kind"),
                F.expr(label).alias("name"), F.concat(F.lit(f"{name}.tbl#"), F.expr(label)).alias("qualified"), F.lit(f"{name}.tbl").alias("file"),
            )
        )
    return functools.reduce(DataFrame.union, parts)


def edges(spark: SparkSession, sf_dir: str, *sources: str) -> DataFrame:
    """All edges, or those that leave the named tables (order lines leave their order)."""
    parts = []
    for name, key, target, foreign, kind in LINKS:
        if sources and name not in sources:
            continue
        owner = "orders" if name == "lineitem" else name
        parts.append(
            table(spark, sf_dir, name).select(
                F.concat(F.lit(f"{owner}:"), F.col(key).cast("string")).alias("src"),
                F.concat(F.lit(f"{target}:"), F.col(foreign).cast("string")).alias("dst"), F.lit(kind).alias("kind"),
            )
        )
    return functools.reduce(DataFrame.union, parts)


def _label(expr: str) -> str:
    return expr.replace("as string", "AS VARCHAR")


ENTITIES_SQL = " UNION ALL ".join(
    f"SELECT '{n}:' || CAST({k} AS VARCHAR) AS entity_id, '{n}' AS kind, {_label(e)} AS name, '{n}.tbl#' || {_label(e)} AS qualified, '{n}.tbl' AS file FROM {n}"
    for n, (k, e) in NODES.items()
)


def edges_sql(*sources: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{'orders' if n == 'lineitem' else n}:' || CAST({k} AS VARCHAR) AS src, '{t}:' || CAST({f} AS VARCHAR) AS dst, '{kind}' AS kind FROM {n}"
        for n, k, t, f, kind in LINKS
        if not sources or n in sources
    )
