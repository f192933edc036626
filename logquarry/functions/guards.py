"""Guards on statements (G2) and delete conditions.

Each rule is one pattern, and the table of rules serves both a single text on the driver and a column of texts.
Rules look for words, not for structure: a listed word inside a literal or an alias counts, and so does a trailing
semicolon.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions import patterns as P

OK, EMPTY, NOT_READ_ONLY, UNSAFE, ENGINE = "ok", "empty", "not_read_only", "unsafe", "engine_access"


@dataclass(frozen=True)
class Rule:
    """A text that has `pattern` anywhere gets `verdict`; `says` begins the message."""

    verdict: str
    pattern: str
    says: str


_OTHER_WORD = r"^(?!(?:" + "|".join(P.READ_ONLY_WORDS) + r")(?![A-Za-z]))"
_EMPTY = Rule(EMPTY, r"^$", "a statement without text")
_ENGINE = Rule(ENGINE, P.ENGINE_ACCESS, "reaches past the tables it was given")
QUERY_RULES = (
    _EMPTY,
    Rule(NOT_READ_ONLY, _OTHER_WORD, "does not start with " + ", ".join(P.READ_ONLY_WORDS)),
    Rule(UNSAFE, P.UNSAFE_QUERY, "holds a word or mark that reading needs not"),
    _ENGINE,
)
FILTER_RULES = (
    Rule(EMPTY, r"^$", "a delete without a condition"),
    Rule(UNSAFE, P.UNSAFE_FILTER, "holds a word or mark that no condition needs"),
    _ENGINE,
)


def _first_broken(text: str, rules: tuple[Rule, ...]) -> Rule | None:
    text = text.strip(P.BLANKS)
    return next((r for r in rules if re.search(r.pattern, text, re.IGNORECASE)), None)


def _verdict(text: Column, rules: tuple[Rule, ...]) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(P.BLANKS))
    out = F.lit(OK)
    for rule in reversed(rules):
        out = F.when(bare.rlike(P.java(rule.pattern, True)), rule.verdict).otherwise(out)
    return out


def _refuse(text: str | None, rules: tuple[Rule, ...]) -> None:
    if rule := _first_broken(text or "", rules):
        raise ValueError(_message(rule, (text or "").strip(P.BLANKS)))


def _message(rule: Rule, text: str) -> str:
    return f"refused, {rule.says}: {text}" if text else f"refused, {rule.says}"


def check_query(query: str) -> None:
    """Raise ValueError unless `query` is one read-only statement over given tables."""
    _refuse(query, QUERY_RULES)


def first_broken_query_rule(query: str) -> Rule | None:
    """The rule that `check_query` turns a statement away by."""
    return _first_broken(query, QUERY_RULES)


def check_filter(condition: str) -> None:
    """Raise ValueError unless `condition` may stand in a WHERE clause."""
    _refuse(condition, FILTER_RULES)


def query_verdict(query: Column) -> Column:
    """The outcome of `check_query` for a column of statements."""
    return _verdict(query, QUERY_RULES)


def query_rejection(query: Column) -> Column:
    """What `check_query` would say; null for a statement that it lets through."""
    verdict, bare = query_verdict(query), F.btrim(query, F.lit(P.BLANKS))
    said = F.lit(None).cast("string")
    for rule in QUERY_RULES:
        begin = f"refused, {rule.says}"
        said = F.when(verdict == rule.verdict, begin if rule is _EMPTY else F.concat(F.lit(begin + ": "), bare)).otherwise(said)
    return said


def unsafe_token(query: Column) -> Column:
    """The first forbidden token, upper case; null when there is none."""
    found = [F.regexp_extract(query, P.java(p, True), 0) for p in (P.UNSAFE_QUERY, P.ENGINE_ACCESS)]
    return F.coalesce(*[F.when(token != "", F.upper(token)) for token in found])


def filter_is_safe(condition: Column) -> Column:
    """The outcome of `check_filter` for a column of conditions."""
    return _verdict(condition, FILTER_RULES) == OK
