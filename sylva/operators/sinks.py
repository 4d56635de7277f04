"""Violations as text, JSON and JUnit XML, clones as text and SARIF: lines are built by plans; one document is put together from them at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_lines(violations: DataFrame) -> DataFrame:
    return violations.select(F.concat_ws(": ", "path", "message").alias("line")).orderBy("line")


def json_document(violations: DataFrame, version: str = "1.0") -> DataFrame:
    """One row: the report as JSON (a report is read as a whole; its rows are gathered here on purpose)."""
    rows = violations.agg(F.array_sort(F.collect_list(F.struct("rule", "path", "message"))).alias("results"))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(F.to_json(F.struct(F.lit(version).alias("version"), stamp.alias("timestamp"), F.size("results").alias("violations"), "results")).alias("json"))


def _escape(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def junit_suites(violations: DataFrame) -> DataFrame:
    """rule, failures, xml: a test suite for each rule, with a case for each violation."""
    case = F.format_string('<testcase name="%s"><failure message="%s"/></testcase>', _escape(F.col("path")), _escape(F.col("message")))
    suites = violations.groupBy("rule").agg(F.count("*").alias("failures"), F.array_join(F.array_sort(F.collect_list(case)), "").alias("cases"))
    return suites.select("rule", "failures", F.format_string('<testsuite name="%s" tests="%d" failures="%d">%s</testsuite>', _escape(F.col("rule")), "failures", "failures", "cases").alias("xml")).orderBy("rule")


FORMATS = {"text": text_lines, "json": json_document, "junit": junit_suites, "junit-xml": junit_suites}


def format_violations(violations: DataFrame, kind: str) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    return FORMATS[kind](violations)


def detailed_lines(violations: DataFrame) -> DataFrame:
    """line, with what is known besides (expected, actual, context, suggestions), each on a line of its own; nulls are left out."""
    named = [F.concat(F.lit(f"  {c.capitalize()}: "), c) for c in ("expected", "actual", "context") if c in violations.columns]
    hints = [F.concat(F.lit("  Suggestions:"), F.array_join(F.transform("suggestions", lambda s: F.concat(F.lit("\n    - "), s)), ""))] if "suggestions" in violations.columns else []
    hints = [F.when(F.size("suggestions") > 0, h) for h in hints]
    return violations.select(F.concat_ws("\n", F.concat_ws(": ", "path", "message"), *named, *hints).alias("line")).orderBy("line")


def clone_summary(pairs: DataFrame) -> DataFrame:
    """One row: clones, tokens, and the number of pairs within one text."""
    return pairs.agg(F.count("*").alias("clones"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"), F.count_if(F.col("a") == F.col("b")).alias("within"))


def clone_lines(pairs: DataFrame) -> DataFrame:
    """One line a pair, the longest first."""
    at = lambda x: F.concat(F.col(x).cast("string"), F.lit(":"), F.col(f"start_{x}").cast("string"))
    return pairs.orderBy(F.desc("tokens"), "a", "b", "start_a", "start_b").select(F.concat(at("a"), F.lit(" = "), at("b"), F.lit(" ("), F.col("tokens").cast("string"), F.lit(" tokens)")).alias("line"))


def clone_results(pairs: DataFrame, kind: str = "exact") -> DataFrame:
    """json: each pair as a result of a SARIF 2.1.0 run; its places are tokens, so they are properties and not regions."""

    def place(x: str):
        at = F.struct(F.struct(F.col(x).cast("string").alias("uri")).alias("artifactLocation")).alias("physicalLocation")
        return F.struct(at, F.struct(F.col(f"start_{x}").alias("startToken"), F.col("tokens").alias("tokens")).alias("properties"))

    text = F.concat(F.lit("Clone of "), F.col("tokens").cast("string"), F.lit(" tokens"))
    return pairs.select(F.to_json(F.struct(F.lit(f"code-clone-{kind}").alias("ruleId"), F.lit("warning").alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place("a")).alias("locations"), F.array(place("b")).alias("relatedLocations"))).alias("json"))


def clone_sarif(pairs: DataFrame, kind: str = "exact", tool: str = "sylva") -> DataFrame:
    """One row: a SARIF 2.1.0 report (read as a whole, so gathered on purpose; clone_results is the table of its results)."""
    head = f'{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"{tool}"}}}},"results":['
    return clone_results(pairs, kind).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("json")), ","), F.lit("]}]}")).alias("json"))
