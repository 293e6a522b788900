"""Glob patterns as regular expressions, built with Column code so a rule's patterns are compiled once per rule.

Dialects
    simple       tag filters: ``*``, exact, ``*x*``, ``x*``, ``*x``; any other ``*`` is a plain character
    simple_name  the same for file names, where ``**`` only tests the end of the name
    fnmatch      ``*``, ``?``, ``[seq]``, ``[!seq]``; case-sensitive
    find_iname   as fnmatch, case-insensitive
    ps_like      as fnmatch without ``!`` negation, case-insensitive
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIALECTS = ("simple", "simple_name", "fnmatch", "find_iname", "ps_like")
_TOKENS = r"(?s)(\[!?\]?[^\]]*\]|.)"


def _literal(text: Column) -> Column:
    return F.regexp_replace(text, r"(\p{Punct})", r"\\$1")


def _edge_stars(pattern: Column, dialect: str) -> Column:
    size = F.length(pattern)
    starts, ends = pattern.startswith("*"), pattern.endswith("*")
    tail = F.substring(pattern, 2, 2**30)
    body = pattern.substr(F.lit(1), size - 1)
    middle = pattern.substr(F.lit(2), size - 2)
    double = F.lit(r"\*.*|.*\*") if dialect == "simple" else F.lit(r".*\*")
    return (
        F.when(pattern == "*", F.lit(".*"))
        .when(pattern == "**", double)
        .when(starts & ends, F.concat(F.lit(".*"), _literal(middle), F.lit(".*")))
        .when(ends, F.concat(_literal(body), F.lit(".*")))
        .when(starts, F.concat(F.lit(".*"), _literal(tail)))
        .otherwise(_literal(pattern))
    )


def _bracket(token: Column, negation: Column) -> Column:
    inner = token.substr(F.lit(2), F.length(token) - 2)
    negated = negation & inner.startswith("!")
    members = F.when(negated, F.substring(inner, 2, 2**30)).otherwise(inner)
    # Everything but the range sign is a plain member of the class.
    members = F.regexp_replace(members, r"([\\\[\]\^&])", r"\\$1")
    return F.when(F.length(members) == 0, _literal(token)).otherwise(
        F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), members, F.lit("]"))
    )


def _wildcards(pattern: Column, negation: Column) -> Column:
    def piece(token: Column) -> Column:
        return (
            F.when(token == "*", F.lit(".*"))
            .when(token == "?", F.lit("."))
            .when(F.length(token) > 1, _bracket(token, negation))
            .otherwise(_literal(token))
        )

    return F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(_TOKENS), F.lit(1)), piece), "")


def glob_body(pattern: Column, dialect: str) -> Column:
    """Regular expression for one pattern, without anchors."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown glob dialect: {dialect}")
    if dialect.startswith("simple"):
        return _edge_stars(pattern, dialect)
    return _wildcards(pattern, F.lit(dialect != "ps_like"))


def _any_of(patterns: Column, body: Callable[[Column], Column], ignore_case: Column) -> Column:
    flags = F.when(ignore_case, F.lit("(?isu)")).otherwise(F.lit("(?s)"))
    bodies = F.array_join(F.transform(patterns, lambda p: body(p)), "|")
    return F.when(F.size(patterns) > 0, F.concat(flags, F.lit(r"\A(?:"), bodies, F.lit(r")\z"))).otherwise(F.lit("(?!)"))


def globs_regex(patterns: Column, dialect: str) -> Column:
    """One anchored expression that holds when any pattern of the array matches; an empty array matches nothing."""
    return _any_of(patterns, lambda p: glob_body(p, dialect), F.lit(dialect in ("find_iname", "ps_like")))


def wildcards_regex(patterns: Column, negation: Column, ignore_case: Column) -> Column:
    """``globs_regex`` for dialects with wildcards anywhere, where the dialect differs from row to row."""
    return _any_of(patterns, lambda p: _wildcards(p, negation), ignore_case)


def glob_match(name: Column, pattern: Column, dialect: str) -> Column:
    return glob_any(name, F.array(pattern), dialect)


def glob_any(name: Column, patterns: Column, dialect: str) -> Column:
    return F.rlike(name, globs_regex(patterns, dialect))
