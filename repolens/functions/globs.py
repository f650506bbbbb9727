"""Glob patterns as regular expressions. ``*`` and ``?`` also match a path separator; invalid globs match nothing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str | None:
    """An anchored regular expression that Java and Python read alike, or None for an invalid glob."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        c = glob[i]
        if c == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            body = "^" + body[1:] if body[0] in "!^" else body
            out.append("[" + body.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return None if depth else "(?s)^" + "".join(out) + "$"


def any_glob(globs: list[str]) -> str:
    """One expression for all globs; matches nothing where none is valid."""
    parts = [r[len("(?s)^") : -1] for g in globs if (r := glob_to_regex(g))]
    return "(?s)^(?:" + "|".join(parts) + ")$" if parts else "(?!)"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike(any_glob(globs)) if globs else F.lit(False)


def first_match(path: Column, globs_by_name: list[tuple[str, list[str]]]) -> Column:
    """Name of the first entry one of whose globs matches, or null."""
    return reduce(lambda rest, item: F.when(matches_any(path, item[1]), item[0]).otherwise(rest), reversed(globs_by_name), F.lit(None).cast("string"))
