"""Glob dialects, compiled on the driver to anchored regular expressions that Java and RE2 both read.

walker: exclusion patterns (a trailing slash is a prefix); rules: as walker, with [!x] and without the slash rule; layer:
path layers, where ? crosses slashes; match: one segment a star, as file-name matching does it; loose: clone exclusions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DIALECTS = ("walker", "rules", "layer", "match", "loose")


def glob_regex(pattern: str, dialect: str = "rules") -> str | None:
    """The regular expression of a glob, or None for one that can match nothing (an invalid class)."""
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    if dialect == "walker" and pattern.endswith("/"):
        return f"^{glob_regex(pattern.rstrip('/'), 'rules')[1:-1]}(?:/.*)?$"
    out, i, n = "", 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            if dialect == "match":
                out, i = out + "[^/]*", i + 1
            elif pattern.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif pattern.startswith("**", i):
                out = out[:-1] + "(?:/.*)?" if out.endswith("/") and i + 2 == n else out + ".*"
                i += 2
            else:
                out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + ("." if dialect == "layer" else "[^/]"), i + 1
        elif c == "[" and dialect != "layer":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            body = "^" + body[1:] if body[0] in "!^" and dialect != "match" or body[0] == "^" else body
            try:
                re.compile(f"[{body}]")
            except re.error:
                return None
            out, i = out + f"[{body}]", end + 1
        elif c == "\\" and i + 1 < n and dialect != "layer":
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + (re.escape(c) if not c.isalnum() and c not in "/_-" else c), i + 1
    return f"^{out}$"


def glob_match(path: Column, pattern: str, dialect: str = "rules") -> Column:
    """Whether path matches; patterns without slash and ** are tried on the last segment as well (walker, rules, match)."""
    regex = glob_regex(pattern, dialect)
    if regex is None:
        return F.lit(False)
    whole = path.rlike(regex)
    if dialect in ("walker", "rules", "match") and "/" not in pattern and "**" not in pattern:
        return whole | F.element_at(F.split(path, "/"), -1).rlike(regex)
    if dialect == "loose":
        return whole | F.contains(path, F.lit(pattern.replace("*", "").strip("/"))) if pattern.strip("*/") else whole
    return whole


def any_glob(path: Column, patterns: list[str], dialect: str = "rules") -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | glob_match(path, p, dialect)
    return out


def suffix_match(path: Column, pattern: str) -> Column:
    """Whether the path or any end of it after a slash matches a walker's glob, as they are or both in lower case."""
    out = F.lit(False)
    for text, glob in ((path, pattern), (F.lower(path), pattern.lower())):
        if (regex := glob_regex(glob, "walker")) is not None:
            out = out | text.rlike("^(?:.*/)?" + regex[1:])
    return out


def layer_match(path: Column, pattern: str) -> Column:
    """A layer's path: prefix; around a single **, prefix (its last slash aside) and a suffix that the name or the rest of the path matches."""
    if pattern.count("**") != 1:
        return path.startswith(pattern)
    head, tail = pattern.split("**")
    head, tail = head.removesuffix("/"), tail.removeprefix("/")
    under = path.startswith(head) if head else F.lit(True)
    if not tail:
        return under
    return under & (glob_match(path, tail, "match") | path.endswith(tail) | F.contains(path, F.lit(tail)))


def gitignore_glob(line: str) -> str | None:
    """A .gitignore line as an exclusion glob; None for blanks, comments and negations."""
    line = line.strip()
    if not line or line[0] in "#!":
        return None
    if line.startswith("/"):
        line = line[1:]
        return line + "**" if line.endswith("/") else line
    if line.endswith("/"):
        return line + "**"
    return line if "/" in line else f"**/{line}"
