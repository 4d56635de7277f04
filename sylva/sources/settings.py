"""Settings by a running scan over lines: sections and keys of TOML-like files, keys of a header between `---` lines.

Sections are scanned in windows of one file each, in the order of its lines; headers within their own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NAME = r"""(?:[A-Za-z0-9_-]+|"[^"]*"|'[^']*')"""
_NAMES = rf"{_NAME}(?:\s*\.\s*{_NAME})*"
_STRING = r""""(?:[^"\\]|\\.)*"|'[^']*'"""
_HEADER = rf"^\s*(?:\[\s*({_NAMES})\s*\]|\[\[\s*({_NAMES})\s*\]\])\s*$"
_SETTING = rf"^\s*({_NAMES})\s*=\s*(\S.*?)\s*$"
_PAIR = rf"({_NAME})\s*=\s*({_STRING}|[^,{{}}\s]+)"


def lines(texts: DataFrame) -> DataFrame:
    """path, n (from 0), line of each text; a carriage return at a line's end is none of it."""
    return texts.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.regexp_replace("line", "\r$", ""))


def _before(name: Column) -> Column:
    """The sum over the lines of a file before this one."""
    return F.coalesce(F.sum(name).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _plain(name: Column) -> Column:
    """A dotted name without blanks around its dots and without quotes."""
    return F.regexp_replace(F.regexp_replace(name, r"\s*\.\s*", "."), r"""["']""", "")


def _value(raw: Column) -> Column:
    """A quoted string without its quotes, anything else as it is written."""
    return F.when(raw.rlike(r"""^(?:"[^"]*"|'[^']*')$"""), raw.substr(F.lit(2), F.length(raw) - 2)).otherwise(raw)


def _times(text: Column, what: str) -> Column:
    return F.size(F.split(text, what)) - 1


def sections(texts: DataFrame) -> DataFrame:
    """path, n, kind, section, key, value, quoted of TOML-like texts (path, text).

    kind: "section" (a header, or the table within braces of a setting), "setting", or "error" for a line that is none of these. Lines within
    brackets or a triple-quoted string belong to the setting before them. A dotted key counts to the section that its beginning
    names. Settings within braces are taken one level deep, from the setting's own line. Null texts have no rows.
    """
    rows = lines(texts.where("text is not null")).withColumn("_inside", _before(_times(F.col("line"), "\"\"\"|'''")) % 2 == 1)
    bare = F.regexp_replace(F.regexp_replace("line", f"(\"\"\"|''').*", ""), f"({_STRING})|#.*", "$1")  # the line without its comment
    rows = rows.withColumn("_bare", F.when(F.col("_inside"), "").otherwise(bare))
    mute = F.regexp_replace("_bare", _STRING, "")
    rows = rows.withColumn("_depth", _before(_times(mute, r"[\[{(]") - _times(mute, r"[\]})]")))
    blank = F.col("_inside") | F.col("_bare").rlike(r"^\s*$")
    rows = rows.where((F.col("_depth") <= 0) & ~(blank & ~F.col("line").rlike("\"\"\"|'''") | F.col("_inside")))
    title = _plain(F.concat(F.regexp_extract("_bare", _HEADER, 1), F.regexp_extract("_bare", _HEADER, 2)))
    rows = rows.withColumn("_title", F.when(title != "", title))
    rows = rows.withColumn("_section", F.coalesce(F.last("_title", True).over(Window.partitionBy("path").orderBy("n")), F.lit("")))
    # a triple-quoted value was cut off with its quotes, which stand for it
    full = F.when(F.col("line").rlike("\"\"\"|'''"), F.concat("_bare", F.lit('""'))).otherwise(F.col("_bare"))
    rows = rows.withColumn("_name", _plain(F.regexp_extract(full, _SETTING, 1))).withColumn("_raw", F.regexp_extract(full, _SETTING, 2))
    whole = F.concat_ws(".", F.when(F.col("_section") != "", F.col("_section")), "_name")
    entry = lambda kind, section, key=F.lit(None), raw=F.lit(None): F.struct(
        F.lit(kind).alias("kind"), section.alias("section"), key.cast("string").alias("key"), _value(raw.cast("string")).alias("value"), raw.cast("string").rlike("^[\"']").alias("quoted")
    )
    own = entry("setting", F.regexp_extract(whole, r"^(.*)\.[^.]*$", 1), F.regexp_extract(whole, r"([^.]*)$", 1), F.col("_raw"))
    braces = F.col("_raw").startswith("{")
    pairs = F.transform(F.regexp_extract_all("_raw", F.lit(f"(?:{_PAIR})"), F.lit(0)), lambda p: entry("setting", whole, _plain(F.regexp_extract(p, _PAIR, 1)), F.regexp_extract(p, _PAIR, 2)))
    inner = F.concat(F.array(entry("section", whole)), pairs)
    found = F.when(F.col("_title").isNotNull(), F.array(entry("section", F.col("_title")))).when(F.col("_name") == "", F.array(entry("error", F.col("_section"))))
    found = found.when(braces, inner).otherwise(F.array(own))
    return rows.select("path", "n", F.explode(found).alias("f")).select("path", "n", "f.*")


#: Lines of a header that begin at its margin and are right: blanks, comments, keys, items and ends of lists.
_KEY = r"""^("[^"]*"|'[^']*'|[^\s#\[\]{},&*!|>'"%@`:-](?:[^:#]|:(?=\S)|(?<=\S)#)*?|-(?=\S)[^:]*?)\s*:(?:\s|$)"""
_MARGIN = r"^(?:$|\s|#|-(?:\s|$)|[\]}])"


def header_keys(text: Column) -> Column:
    """The keys (array, null without a right header) at the margin of the block between a text's first line, `---`, and the next such line.

    Blanks around the whole text don't count. A header with a line that is no key, no item, no comment and no continuation
    isn't right; an empty header has no keys. A null text has null keys. All of it stays in the text's own row.
    """
    rows = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\r?\n")
    fences = F.transform(rows, lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) == "---")
    end = F.array_position(F.slice(fences, 2, F.greatest(F.size(rows), F.lit(1))), True)  # the header's lines and the one that ends it
    block = F.slice(rows, F.lit(2), F.greatest(end - 1, F.lit(0)).cast("int"))
    key = lambda x: F.regexp_replace(F.regexp_extract(x, _KEY, 1), r"""^["']|["']$""", "")
    wrong = F.exists(block, lambda x: (key(x) == "") & ~x.rlike(_MARGIN))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(block, key), lambda k: k != "")))
    return F.when(text.rlike(r"^\s*---") & F.get(fences, F.lit(0)) & (end > 0) & ~wrong, found)


def front_matter(texts: DataFrame) -> DataFrame:
    """path and keys (see header_keys) of each text."""
    return texts.select("path", header_keys(F.col("text")).alias("keys"))
