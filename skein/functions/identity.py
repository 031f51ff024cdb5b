"""Stable identities: the same value from a DataFrame expression and from plain Python."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for the missing disambiguator of functions and methods.
NO_DISAMBIGUATOR = "\x00no-disambiguator"


def _sha16(*parts: Column) -> Column:
    joined = []
    for i, p in enumerate(parts):
        joined += [F.lit("\x00")] * (i > 0) + [F.coalesce(p, F.lit(""))]
    return F.substring(F.sha2(F.encode(F.concat(*joined), "UTF-8"), 256), 1, 16)


def entity_id(repo: Column, kind: Column, qualified: Column, disambiguator: Column) -> Column:
    empty = F.coalesce(disambiguator, F.lit("")) == ""
    callable_ = kind.isin("Function", "Method")
    return _sha16(repo, kind, qualified, F.when(callable_ & empty, F.lit(NO_DISAMBIGUATOR)).otherwise(disambiguator))


def edge_id(kind: Column, dst: Column, evidence: Column) -> Column:
    """Not a key: the source takes no part in it."""
    return _sha16(kind, dst, evidence)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.encode(F.regexp_replace(text, r"^\s+|\s+$", ""), "UTF-8"), 256), 1, 16)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("_", F.least(a, b), F.greatest(a, b))


def sha_hex(data: bytes, chars: int = 16) -> str:
    return hashlib.sha256(data).hexdigest()[:chars]


def py_entity_id(repo: str, kind: str, qualified: str, disambiguator: str = "") -> str:
    if kind in ("Function", "Method") and not disambiguator:
        disambiguator = NO_DISAMBIGUATOR
    return sha_hex("\x00".join((repo, kind, qualified, disambiguator)).encode())


def py_content_hash(text: str) -> str:
    return sha_hex(text.strip().encode())


def repo_state_name(path: str) -> str:
    """Directory name of a repository's state: its last path part and eight hex digits of the whole."""
    return f"{path.rstrip('/').rpartition('/')[2]}-{sha_hex(path.encode(), 8)}"
