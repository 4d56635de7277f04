"""Fixes for violations: planned by DataFrames, carried out by the driver one after another, taken back if one fails.

Changing files is a side effect: it never runs in executors. A fix is a list of actions; those of one that fails are undone
in reverse order.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable
from dataclasses import dataclass, field
from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.paths import parent


def fixable(violations: DataFrame, rule: str = "") -> DataFrame:
    """Violations that carry a fix (`autofix`) and whose rule contains the text."""
    return violations.where(F.col("autofix").isNotNull() & F.contains("rule", F.lit(rule)))


def possible_importers(moves: DataFrame, files: DataFrame) -> DataFrame:
    """source, path: files that may import a moved one, as one's directory is the other's or above it.

    Equality joins on exploded parents, both ways; never a nested loop.
    """

    def ups(c):
        parts = F.split(c, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))

    a = moves.select("source", parent(F.col("source")).alias("d"))
    b = files.where("not is_dir").select("path", parent(F.col("path")).alias("d"))
    below = a.join(b.select("path", F.explode(ups(F.col("d"))).alias("d")), "d")
    above = a.select("source", F.explode(ups(F.col("d"))).alias("d")).join(b, "d")
    return below.select("source", "path").unionByName(above.select("source", "path")).where("source != path").distinct()


@dataclass
class Action:
    """move: path to target; write: text to path; replace: old by text in path."""

    kind: str
    path: str
    target: str = ""
    text: str = ""
    old: str = ""


@dataclass
class Outcome:
    applied: int = 0
    failed: int = 0
    skipped: int = 0
    errors: list[str] = field(default_factory=list)


def _do(root: str, a: Action):
    """Does the action and returns what takes it back."""
    path = os.path.join(root, a.path)
    if a.kind == "move":
        target = os.path.join(root, a.target)
        if os.path.exists(target):
            raise FileExistsError(target)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        shutil.move(path, target)
        return lambda: shutil.move(target, path)
    old = None
    if os.path.exists(path):
        with open(path, newline="") as f:
            old = f.read()
    if a.kind == "replace" and (old is None or a.old not in old):
        raise ValueError(f"{a.path} doesn't contain {a.old!r}")
    if a.kind not in ("write", "replace"):
        raise ValueError(f"unknown action {a.kind!r}")
    os.makedirs(os.path.dirname(path), exist_ok=True)

    def put(text: str) -> None:
        with open(path, "w", newline="") as f:
            f.write(text)

    put(a.text if a.kind == "write" else old.replace(a.old, a.text))
    return (lambda: os.remove(path)) if old is None else (lambda: put(old))


def apply_fixes(root: str, fixes: Iterable[tuple[list[Action], bool]], dry_run: bool = False, unsafe: bool = False) -> Outcome:
    """fixes: (actions, safe). A fix that isn't safe is skipped unless asked for; a dry run skips all."""
    out = Outcome()
    for actions, safe in fixes:
        if dry_run or not (safe or unsafe):
            out.skipped += 1
            continue
        undo = []
        try:
            for a in actions:
                undo.append(_do(root, a))
            out.applied += 1
        except (OSError, ValueError) as e:
            for back in reversed(undo):
                back()
            out.failed += 1
            out.errors.append(str(e))
    return out


def scaffold(folder: str, templates: dict[str, str], **values: str) -> list[str]:
    """Writes files from templates (names and texts with $name); refuses if one exists, before any is written."""
    made = {os.path.join(folder, Template(n).substitute(values)): Template(t).substitute(values) for n, t in templates.items()}
    for path in made:
        if os.path.exists(path):
            raise FileExistsError(path)
    for path, text in made.items():
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
    return list(made)
