"""Glob patterns: of names as in a shell, and of values with backslash escapes. Both are case-sensitive."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, functions as F


def glob_regex(pattern: str) -> str:
    """A regular expression that matches whole values as the glob does; also valid in Java.

    ``*`` and ``?`` are wildcards, brackets stand for themselves. A backslash makes
    a wildcard, a bracket or a backslash after it plain; before other characters,
    and at the end, it is one itself.
    """
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and pattern[at + 1 : at + 2] in ("\\", "*", "?", "[", "]"):
            at += 1
            out.append(re.escape(pattern[at]))
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        at += 1
    return "(?s)^" + "".join(out) + r"\z"


def glob(column: Column, pattern: str) -> Column:
    """Whether the column matches; the pattern ``*`` alone is true of null as well."""
    if pattern == "*":
        return F.lit(True)
    head = pattern[:-1]
    if pattern.endswith("*") and not set(head) & set("*?\\"):
        return column.startswith(head)  # pushed down to the scan
    return column.rlike(glob_regex(pattern))


def matches_value(pattern: str, value: str) -> bool:
    return re.match(glob_regex(pattern).replace(r"\z", r"\Z"), value) is not None


def is_glob(name: str) -> bool:
    """Whether a name is a pattern: it has ``*``, ``?`` or a pair of brackets."""
    return re.search(r"[*?]|\[.*\]", name) is not None


def matches(pattern: str, name: str) -> bool:
    """Whether a name is this, or matches it as a pattern with ``*``, ``?`` and ``[...]``."""
    return fnmatch.fnmatchcase(name, pattern) if is_glob(pattern) else name == pattern
