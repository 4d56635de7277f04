"""Metrics of functions of Go-like code: Halstead counts and cognitive complexity, from tokens and running states.

There is no syntax tree: brackets are prefix sums, a block is what its last pending keyword says, and a token belongs to the
function whose body is open. All states are windows of one file in the order of its tokens. Functions within functions count
to the one around them; for complexity they count nothing, as they are values. Not told apart: a function type without a body
that a composite literal follows at its level, and a labelled statement, which counts like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.graph import cut
from sylva.operators.metrics import halstead_values, rollup
from sylva.sources.lexer import KEYWORDS, lexed

#: Names of the language that are no operands.
BUILTINS = (
    "bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr "
    "append cap close complex copy delete imag len make new panic print println real recover true false iota nil"
).split()
NESTING, JUMPS = ("if", "for", "switch", "select", "else"), ("break", "continue", "goto", "fallthrough")
STATEMENTS = ("if", "range", "select", "case", "return", "defer", "go", *JUMPS)
SIGNS = "+ - * / % & | ^ << >> &^ && || == != < <= > >= ! = := += -= *= /= %= &= |= ^= <<= >>= &^= ++ --".split()


#: Tokens that a task sorts by files, so that its windows fit in memory; a file with more is one task's.
TOKENS_A_TASK = 1 << 18


def dealt(contents: DataFrame) -> DataFrame:
    """path, raw, line of each file, dealt by path as arrays into as many parts as the tokens need.

    The windows of states all sort by file, and with a fixed number of parts these sorts would spill as the input grows.
    """
    files = cut(lexed(contents).select("path", "raw", "line"))
    n = files.agg(F.sum(F.size("raw"))).first()[0] or 0
    return files.repartition(max(-(-n // TOKENS_A_TASK), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")


def states(contents: DataFrame) -> DataFrame:
    """A row a token that lies in a function's body: path, name, line (the function's), pos, v, cost and operator or operand (null if neither)."""
    v = F.col("v")
    rows = dealt(contents).select("path", F.posexplode(F.arrays_zip("raw", "line")).alias("pos", "x")).select("path", "pos", F.col("x.raw").alias("v"), F.col("x.line").alias("at"))
    order = Window.partitionBy("path").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w=before: F.coalesce(F.sum(c).over(w), F.lit(0))
    is_one = lambda *names: F.when(v.isin(*names), 1).otherwise(0)
    rows = rows.withColumns({"prev": F.lag("v").over(order), "prev2": F.lag("v", 2).over(order), "next": F.lead("v").over(order), "above": F.lag("at").over(order), "braces": total(is_one("{") - is_one("}")), "inner": total(is_one("(", "[") - is_one(")", "]"))})
    word = v.rlike(r"^[A-Za-z_\x80-\x{10ffff}]") & ~v.isin(*KEYWORDS)
    # an opening bracket and its closing one have the same level and depth
    rows = rows.withColumns({"level": F.col("braces") - is_one("}"), "depth": F.col("inner") - is_one(")", "]"), "within": F.col("inner") + is_one("(", "["), "word": word})
    opens = (v == "{") & ~F.coalesce(F.col("prev").isin("struct", "interface"), F.lit(False))
    fresh = F.coalesce(F.col("above") < F.col("at"), F.lit(True))
    top = (F.col("braces") == 0) & (F.col("inner") == 0) & fresh & v.isin("func", "type", "var", "const", "import") & ~F.coalesce(F.col("prev").isin("=", ",", ":="), F.lit(False))
    last = lambda cond, value, w: F.last(F.when(cond, value), True).over(w)
    rows = rows.withColumns({"top": last(top, F.struct(v.alias("kind"), "pos", F.col("at").alias("line")), order), "begin": last(fresh, v, order)})

    same = Window.partitionBy("path", "level", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pending = last(v.isin(*NESTING, "func") | opens, v, same)
    rows = rows.withColumn("pending", pending).withColumn("kind", F.when(opens & F.col("pending").isin(*NESTING, "func"), F.col("pending")))
    level = Window.partitionBy("path", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("closed", F.when(v == "}", last(v == "{", F.coalesce("kind", F.lit("")), level)))
    around = Window.partitionBy("path", F.when(v == "{", F.col("level")).otherwise(F.col("braces") - 1)).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("block", last(v == "{", F.coalesce("kind", F.lit("")), around))
    later = lambda names, *keys: F.last(F.when(v.isin(*names), v), True).over(Window.partitionBy("path", *keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"ranges": later(("range", "{"), "level", "depth") == "range", "types": later(("type", "{"), "level") == "type", "slices": later((":", "]"), "level", "within") == ":"})

    inside = F.col("level") > 0
    step = lambda names: F.when(inside & F.col("kind").isin(*names), 1).when(inside & F.col("closed").isin(*names), -1).otherwise(0)
    own = Window.partitionBy("path", "top.pos").orderBy("pos")
    called = F.col("word") & (F.col("braces") == 0) & (F.col("inner") == 0) & F.col("prev").isin("func", ")")
    receiver = F.col("word") & (F.col("prev") == "(") & (F.col("prev2") == "func") & ~F.col("next").isin(")", ".", "[") & (F.col("braces") == 0)
    rows = rows.withColumns({
        "nesting": total(step(NESTING)), "muted": total(step(("func",))), "called": F.first(F.when(called, v), True).over(own), "receiver": F.first(F.when(receiver, v), True).over(own),
        "body": last(opens & (F.col("level") == 0) & (F.col("depth") == 0), F.col("top.kind") == "func", before) & (F.col("top.kind") == "func"),
    })
    cost = F.when(v.isin("if", "for", "switch", "select", "go", *JUMPS), 1 + F.col("nesting")).when(v == "case", 1).otherwise(0)
    name = F.when(F.col("receiver").isNull(), F.col("called")).otherwise(F.format_string("(%s).%s", "receiver", "called"))
    rows = rows.where(inside & F.col("body"))
    return rows.select("path", name.alias("name"), F.col("top.line").alias("line"), F.col("top.pos").alias("start"), "pos", "v", F.when(F.col("muted") > 0, 0).otherwise(cost).alias("cost"), _operator().alias("operator"), _operand().alias("operand"))


def _operator() -> Column:
    v, prev, after = F.col("v"), F.coalesce("prev", F.lit("")), F.coalesce("next", F.lit(""))
    value = prev.rlike(r"^[A-Za-z_\x80-\x{10ffff}]") & ~prev.isin(*KEYWORDS) | prev.isin(")", "]", "}")
    declared = (v == "=") & F.col("begin").isin("var", "const")
    signature = (prev == ")") & (F.coalesce("pending", F.lit("")) == "func")
    index = value & (prev != "}") & ~((prev == "]") & (after == "]"))
    return (
        F.when(v.isin(*STATEMENTS), v)
        .when((v == "for") & ~F.coalesce("ranges", F.lit(False)), v)
        .when(v == "switch", F.when(F.coalesce("types", F.lit(False)), "type-switch").otherwise(v))
        .when(v == "default", F.when(F.col("block") == "select", "case").otherwise(v))
        .when(v.isin("=", ":=") & ((after == "range") | declared), None)
        .when(v.isin(*SIGNS), v)
        .when((v == "<-") & (after != "chan") & (prev != "chan"), v)
        .when(v == "(", F.when(prev == ".", ".(type)").when(value & ~signature, "()"))
        .when((v == "[") & index, F.when(F.coalesce("slices", F.lit(False)), "[:]").otherwise("[]"))
    )


def _operand() -> Column:
    v = F.col("v")
    return F.when(F.col("word") & ~v.isin(*BUILTINS) | v.rlike("^[`\"'0-9]") | v.rlike("^[.][0-9]"), v)


def function_metrics(contents: DataFrame) -> DataFrame:
    """path, name, line, complexity, n1, n2, big_n1, big_n2, volume, difficulty, effort of each function (contents: path, text).

    A method's name has its receiver's: "(r).Name". A function without a body or with an empty one has no row; null texts have none.
    """
    keys = ("path", "start", "name", "line")
    different = lambda c: F.size(F.collect_set(c)).cast("bigint")  # noqa: E731 - of one function; rows stay where their file is
    sums = states(contents).groupBy(*keys).agg(
        F.sum("cost").alias("complexity"), different("operator").alias("n1"), different("operand").alias("n2"), F.count("operator").alias("big_n1"), F.count("operand").alias("big_n2")
    )
    return halstead_values(sums).drop("start")


def file_metrics(functions: DataFrame, value: str = "complexity") -> DataFrame:
    """total, average, most and functions of each file."""
    return rollup(functions, "path", value)
