"""Text expressions of retrieval: words, camel parts, stems and match tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[A-Za-z][A-Za-z0-9]*"
CAMEL = r"[A-Z]?[a-z0-9]+|[A-Z]+(?:[A-Z][a-z]|$)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def split_camel(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit(f"({CAMEL})"), F.lit(1))


def camel_parts(text: Column) -> Column:
    """Lower-case camel parts of more than one character, of every word."""
    parts = F.flatten(F.transform(words(text), split_camel))
    return F.filter(F.transform(parts, F.lower), lambda p: F.length(p) > 1)


def task_terms(text: Column) -> Column:
    """Every word in lower case followed by its camel parts, so a plain word stands twice."""
    return F.flatten(
        F.transform(
            words(text),
            lambda w: F.concat(F.array(F.lower(w)), F.filter(F.transform(split_camel(w), F.lower), lambda p: F.length(p) > 1)),
        )
    )


def token_set(text: Column) -> Column:
    return F.array_distinct(F.concat(F.transform(words(text), F.lower), camel_parts(text)))


def stem(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 5), F.concat(F.left(word, n - 3), F.lit("y")))
        .when(word.endswith("ing") & (n > 6), F.left(word, n - 3))
        .when(word.endswith("es") & (n > 5), F.left(word, n - 2))
        .when(word.endswith("ed") & (n > 5), F.left(word, n - 2))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 4), F.left(word, n - 1))
        .otherwise(word)
    )


def stem_match(term: Column, token: Column) -> Column:
    """Different words of which the shorter stem, of four characters at least, begins the longer."""
    a, b = stem(term), stem(token)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (term != token) & (F.length(short) >= 4) & long.startswith(short)


def match_tier(term: Column, tokens: Column, parts: Column) -> Column:
    """1.0 for a token, 0.6 for a stem match with a camel part, else 0."""
    return (
        F.when(F.array_contains(tokens, term), F.lit(1.0))
        .when(F.exists(parts, lambda p: stem_match(term, p)), F.lit(0.6))
        .otherwise(F.lit(0.0))
    )


def symbol_path(qualified: Column) -> Column:
    """What stands after the first ``#``; all of it if there is none."""
    at = F.instr(qualified, "#")
    return F.when(at > 0, F.substr(qualified, at + 1)).otherwise(qualified)


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines_of(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, counted from 1, each ended by a line feed."""
    picked = F.slice(F.split(text, "\n", -1), F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0)))
    return F.array_join(F.transform(picked, lambda x: F.concat(F.regexp_replace(x, r"\r$", ""), F.lit("\n"))), "")


def first_line(text: Column, number: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.try_element_at(F.split(text, "\n", -1), number.cast("int")), F.lit("")), r"\r$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
