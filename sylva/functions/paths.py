"""Paths and names as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the name on; a name that begins with its only dot is all extension."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]+$", 1)


def depth(path: Column, is_dir: Column) -> Column:
    return F.size(F.split(path, "/")) - 1 + is_dir.cast("int")


def short_path(path: Column) -> Column:
    """The last two segments of three or more."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(path)


def clean(path: Column) -> Column:
    """Without . and empty segments, .. taken back; leading .. stay."""

    def fold(done: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return F.when(s.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), fold), "/")


def resolve_import(source: Column, target: Column) -> Column:
    """A relative import as a path; others stay."""
    return F.when(target.startswith("."), clean(F.concat_ws("/", parent(source), target))).otherwise(target)


def leading_parents(target: Column) -> Column:
    """How many ../ a relative import begins with."""
    return (F.length(F.regexp_extract(F.regexp_replace(target, r"^\./", ""), r"^((?:\.\./)*)", 1)) / 3).cast("int")


def is_camel(s: Column) -> Column:
    return ~s.rlike("[-_ ]") & ~s.rlike("^[A-Z]")


def is_pascal(s: Column) -> Column:
    return ~s.rlike("[-_ ]") & ((s == "") | s.rlike("^[A-Z]"))


def is_kebab(s: Column) -> Column:
    return ~s.rlike("[_ ]") & (s == F.lower(s))


def is_snake(s: Column) -> Column:
    return ~s.rlike("[- ]") & (s == F.lower(s))


STYLES = {"camelCase": is_camel, "PascalCase": is_pascal, "kebab-case": is_kebab, "snake_case": is_snake, "lowercase": lambda s: s == F.lower(s), "UPPERCASE": lambda s: s == F.upper(s)}


def detect_style(s: Column) -> Column:
    """The first style in the order of STYLES, else mixed."""
    return F.coalesce(*[F.when(f(s), F.lit(n)) for n, f in STYLES.items()], F.lit("mixed"))


def words_of(s: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(s, "(?<=.)([A-Z])", "_$1"), "[_-]+"), lambda w: w != "")


def _title(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))


def to_pascal(s: Column) -> Column:
    return F.array_join(F.transform(words_of(s), _title), "")


def to_camel(s: Column) -> Column:
    p = to_pascal(s)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))


def to_kebab(s: Column) -> Column:
    return F.lower(F.array_join(words_of(s), "-"))


def to_snake(s: Column) -> Column:
    return F.lower(F.array_join(words_of(s), "_"))


def first_match(cases: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The value of the first condition that holds, in order."""
    if not cases:
        return F.lit(default)
    return reduce(lambda out, c: out.when(*[c[0], F.lit(c[1])]), cases[1:], F.when(cases[0][0], F.lit(cases[0][1]))).otherwise(F.lit(default))


def test_name(path: Column) -> Column:
    """The name of a source file's adjacent test, by extension."""
    s, e = stem(path), extension(path)
    return (
        F.when(e == ".go", F.concat(s, F.lit("_test.go")))
        .when(e.isin(".ts", ".tsx"), F.concat(s, F.lit(".test"), e))
        .when(e.isin(".js", ".jsx"), F.concat(s, F.lit(".spec"), e))
        .when(e == ".py", F.concat(F.lit("test_"), s, e))
        .when(e.isin(".java", ".cs"), F.concat(s, F.lit("Test"), e))
        .otherwise(F.concat(s, F.lit("_test"), e))
    )
