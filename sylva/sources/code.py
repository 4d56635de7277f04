"""Imports, exports, directives and lines of source text as tables, by regular expressions over a contents table.

contents: path, text. One row per import: source_file, import_path, is_relative, line; per export: source_file, name, line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.paths import extension


def lines(table: DataFrame, key: str, text: str, first: int | None = None) -> DataFrame:
    """key, n (from 1), line."""
    rows = table.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    return rows.where(F.col("n") <= first) if first else rows


def hrefs(table: DataFrame, html: str) -> DataFrame:
    return table.withColumn("href", F.explode(F.regexp_extract_all(F.col(html), F.lit('href="([^"]*)"'), 1)))


#: Extensions of each language, and for each the patterns of an import line (the first group that isn't empty counts).
LANGUAGES = {
    "typescript": (".ts", ".tsx", ".js", ".jsx", ".mjs"),
    "go": (".go",),
    "python": (".py",),
    "java": (".java",),
    "cpp": (".cpp", ".cc", ".c", ".h", ".hpp"),
    "csharp": (".cs",),
}
PYTHON_FROM, PYTHON_IMPORT = r"^\s*from\s+(\.*(?:[A-Za-z_]\w*(?:\.\w+)*)?)\s*import\b", r"^\s*import\s+([^#;]+)"
IMPORTS = {
    "typescript": r"""(?:from\s+['"]([^'"]+)['"]|import\s+['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)|import\(\s*['"]([^'"]+)['"]\s*\))""",
    "go": r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*(?://.*)?$""",
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;",
    "cpp": r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]""",
    "csharp": r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",
}
EXPORTS = {
    "typescript": r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum|abstract\s+class)\s+(\w+)",
    "go": r"^(?:func|type|const|var)\s+(?:\([^)]*\)\s*)?([A-Z]\w*)",
    "python": r"^(?:async\s+)?(?:def|class)\s+([A-Za-z]\w*)",
    "java": r"^\s*public\s+(?:(?:abstract|final|static)\s+)*(?:class|interface|enum|record)\s+(\w+)",
    "cpp": r"^\s*(?:class|struct|namespace)\s+(\w+)",
    "csharp": r"^\s*public\s+(?:(?:abstract|sealed|static|partial)\s+)*(?:class|interface|enum|struct|record|delegate\s+[\w<>\[\],.?]+)\s+(\w+)",
}
#: Lists of names: export { a, b as c } and __all__ = ["a", "b"], on one line.
EXPORT_LIST, PYTHON_ALL = r"^\s*export\s*(?:type\s*)?\{([^}]*)\}", r"^__all__\s*\+?=\s*[\[(](.*)$"


def language(path: Column) -> Column:
    e = extension(path)
    return F.coalesce(*[F.when(e.isin(*x), F.lit(n)) for n, x in LANGUAGES.items()])


def code_lines(contents: DataFrame) -> DataFrame:
    """path, lang, n, line, and what a line inherits: block (Go imports), comment (a block comment of C or C++ that is open), scope."""
    rows = contents.select("path", language(F.col("path")).alias("lang"), F.posexplode(F.split("text", "\n")).alias("n", "line")).where("lang is not null").withColumn("n", F.col("n") + 1)
    w = Window.partitionBy("path").orderBy("n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("line").rlike(r"^\s*import\s*\("), True).when(F.col("line").rlike(r"^\s*\)"), False)
    bare = F.regexp_replace("line", r'"(?:[^"\\]|\\.)*"', '""')  # what strings hold is no comment
    comment = F.when(F.col("lang") != "cpp", False).when(bare.rlike(r"/\*(?!.*\*/)"), True).when(bare.rlike(r"\*/"), False)
    scope = F.nullif(F.regexp_extract("line", r"^\s*(?:package|namespace)\s+([\w.]+)", 1), F.lit(""))
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    rows = rows.withColumn("block", F.coalesce(last(opens), F.lit(False))).withColumn("comment", F.coalesce(last(comment), F.lit(False))).withColumn("scope", last(scope))
    return rows.where(~F.col("line").rlike(r"^\s*//"))


def imports(contents: DataFrame) -> DataFrame:
    rows = code_lines(contents)
    found = []
    modules = F.transform(F.split(F.regexp_extract("line", PYTHON_IMPORT, 1), ","), lambda m: F.regexp_extract(m, r"^\s*([A-Za-z_][\w.]*)", 1))
    every = F.filter(F.concat(F.array(F.regexp_extract("line", PYTHON_FROM, 1)), modules), lambda x: x != "")
    found.append(rows.where("lang = 'python'").select(F.col("path").alias("source_file"), "lang", F.explode(every).alias("import_path"), F.col("n").alias("line"), F.col("line").alias("_text"), "scope"))
    for lang, pattern in IMPORTS.items():
        groups = pattern.count("([")
        part = rows.where(F.col("lang") == lang)
        if lang == "go":
            part = part.where(F.col("block") | F.col("line").rlike(r"^\s*import\s"))
        if lang == "typescript":  # a line may hold several
            hits = [F.regexp_extract_all("line", F.lit(pattern), g) for g in range(1, groups + 1)]
            target = F.explode(F.filter(F.flatten(F.array(*hits)), lambda x: x != ""))
        else:
            target = F.coalesce(*[F.nullif(F.regexp_extract("line", pattern, g), F.lit("")) for g in range(1, groups + 1)])
            target = F.regexp_replace(target, r"\.\*$", "") if lang == "java" else target
        found.append(part.select(F.col("path").alias("source_file"), "lang", target.alias("import_path"), F.col("n").alias("line"), F.col("line").alias("_text"), "scope").where("import_path is not null"))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    relative = (
        F.when(F.col("lang") == "cpp", F.col("_text").rlike('include\\s*"'))
        .when(F.col("lang") == "java", F.coalesce(F.col("import_path").startswith(F.concat("scope", F.lit("."))), F.lit(False)))
        .when(F.col("lang") == "csharp", F.coalesce(F.split("import_path", r"\.")[0] == F.split("scope", r"\.")[0], F.lit(False)))
        .when(F.col("lang") == "typescript", F.col("import_path").rlike("^[./]"))
        .otherwise(F.col("import_path").startswith("."))
    )
    return rows.select("source_file", "import_path", relative.alias("is_relative"), "line")


def exports(contents: DataFrame) -> DataFrame:
    """source_file, name, is_default, line; what a Python file lists in __all__ replaces its definitions, C and C++ count outside block comments."""
    rows = code_lines(contents).where("not comment")
    cases = F.coalesce(*[F.when(F.col("lang") == n, F.regexp_extract("line", p, 1)) for n, p in EXPORTS.items()])
    listed = F.transform(F.split(F.regexp_extract("line", EXPORT_LIST, 1), ","), lambda x: F.trim(F.regexp_replace(x, r"^.*\sas\s", "")))
    unnamed = F.when(F.col("line").rlike(r"^\s*export\s+default\b") & (cases == ""), F.lit("default")).otherwise(F.lit(""))
    more = F.when(F.col("lang") == "typescript", F.concat(listed, F.array(unnamed))).otherwise(F.array(F.lit("")))
    said = F.regexp_extract_all(F.regexp_extract("line", PYTHON_ALL, 1), F.lit("['\"]([^'\"]+)['\"]"), 1)
    rows = rows.withColumn("said", F.when(F.col("lang") == "python", said).otherwise(F.slice(said, 1, 0)))
    rows = rows.withColumn("whole", F.max(F.size("said")).over(Window.partitionBy("path")) > 0)  # the file lists its names somewhere
    own = F.when((F.col("lang") == "python") & (F.col("whole") | cases.startswith("_")), F.lit("")).otherwise(cases)
    found = rows.withColumn("name", F.explode(F.array_distinct(F.concat(F.array(own), more, "said")))).where("name != ''")
    found = found.where(~((F.col("lang") == "cpp") & ~F.col("path").rlike(r"\.(h|hpp)$")))
    return found.select(F.col("path").alias("source_file"), "name", F.col("line").rlike(r"export\s+default").alias("is_default"), F.col("n").alias("line"))


def directives(contents: DataFrame, marker: str, first: int = 100) -> DataFrame:
    """path, line, type, rules, reason of `marker:ignore a-rule b-rule reason` and `marker:no-test reason` comments."""
    rows = lines(contents, "path", "text", first).where(F.col("line").rlike(r"^\s*(//|#|/\*|\*|<!--|--)") & F.contains("line", F.lit(f"{marker}:")))
    body = F.trim(F.regexp_replace(F.regexp_extract("line", f"{marker}:(.*)$", 1), r"(\*/|-->)\s*$", ""))
    rows = rows.withColumn("_b", body).withColumn("type", F.regexp_extract("_b", r"^(ignore|no-test)\b", 1)).where("type != ''")
    rest = F.trim(F.regexp_replace("_b", r"^(ignore|no-test)", ""))
    named = F.regexp_extract(rest, r"^((?:[a-z0-9][a-z0-9]*(?:-[a-z0-9]+)+(?:\s+|$))*)", 1)
    rules = F.when(F.col("type") == "ignore", F.filter(F.split(F.trim(named), r"\s+"), lambda x: x != "")).otherwise(F.expr("cast(array() as array<string>)"))
    reason = F.when(F.col("type") == "ignore", F.trim(F.substr(rest, F.length(named) + 1))).otherwise(rest)
    return rows.select("path", F.col("n").alias("line"), "type", rules.alias("rules"), reason.alias("reason"))


def language_profile(docs: DataFrame) -> DataFrame:
    n = docs.groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("most"))
    clamp = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "lang"))  # over languages
    return n.select("lang", "n", rank.alias("rank"), clamp(F.floor(F.col("n") * 12 / 10), 20, 100).alias("max_files"), clamp(F.col("most") + 2, 4, 10).alias("max_depth"))


#: Rows of a block of vectors; every block of queries meets every block of rows.
BLOCK = 1024


def semantic_clones(vectors: DataFrame, limit: int) -> DataFrame:
    """The most similar pairs (a report of `limit` rows) of a query set, every 20th vector, with all other vectors.

    A pair of two queries counts once, with the smaller id as a. Vectors that are null or zero have no similarity.
    """
    v = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("e")).where("id is not null and e is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
            while len(ids) >= BLOCK:
                yield packed(ids[:BLOCK], rows[:BLOCK])
                del ids[:BLOCK], rows[:BLOCK]
        if ids:
            yield packed(ids, rows)

    def packed(ids: list[int], rows: list[list[float]]) -> pa.RecordBatch:
        e = np.array(rows, "<f8")
        return pa.RecordBatch.from_pydict({"ids": [np.array(ids, "<i8").tobytes()], "e": [e.tobytes()]})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ia, ea, ib, eb in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                ia, ib = np.frombuffer(ia, "<i8"), np.frombuffer(ib, "<i8")
                ea, eb = np.frombuffer(ea, "<f8").reshape(len(ia), -1), np.frombuffer(eb, "<f8").reshape(len(ib), -1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = (ea @ eb.T) / np.outer(np.sqrt((ea * ea).sum(1)), np.sqrt((eb * eb).sum(1)))
                s = np.where(s < 0, -1, 1) * np.floor(np.abs(s) * 1e5 + 0.5) / 1e5
                s[(ia[:, None] == ib) | (ib % 20 == 0) & (ib < ia[:, None]) | ~np.isfinite(s)] = -9
                least = np.partition(s, -limit, None)[-limit] if s.size > limit else -9
                x, y = np.nonzero((s >= least) & (s > -9))
                order = np.lexsort((ib[y], ia[x], -s[x, y]))[:limit]
                x, y = x[order], y[order]
                yield pa.RecordBatch.from_pydict({"a": ia[x], "b": ib[y], "similarity": s[x, y]})

    blocks = lambda t: t.mapInArrow(pack, "ids binary, e binary")
    pairs = blocks(v.where("id % 20 = 0")).crossJoin(blocks(v).toDF("ids_b", "e_b"))
    return pairs.mapInArrow(best, "a bigint, b bigint, similarity double").orderBy(F.desc("similarity"), "a", "b").limit(limit)
