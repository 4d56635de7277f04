"""All queries over the supplied tables, and the SQL that each must agree with.

pages play files (host/lang/id as paths), page links imports, documents contents, event transitions a small cyclic graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.functions import paths as P
from sylva.functions.globs import glob_match, layer_match
from sylva.operators import clones, code_metrics, documents, graph, languages, metrics, predicates as R, profile, project as J, sinks, structure as S, workflows
from sylva.sources import code, settings

URL_PATH = r"(^https?://|[?#].*$)"
_PATH = r"regexp_replace(url, '(^https?://|[?#].*$)', '', 'g')"
_PAGES = f"p AS (SELECT page_id, {_PATH} AS path, html FROM pages), f AS (SELECT *, regexp_extract(path, '^(.*)/[^/]+$', 1) AS parent, len(string_split(path, '/')) - 1 AS depth FROM p)"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "pages")
    return S.files_from(t, F.regexp_replace("url", URL_PATH, ""))


def links(spark: SparkSession, d: str) -> DataFrame:
    """source_file, import_path: the hrefs of pages."""
    return code.hrefs(pages(spark, d), "html").select(F.col("path").alias("source_file"), F.col("href").alias("import_path"))


_LINKS = _PAGES + ", l AS (SELECT path AS source_file, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS import_path FROM f)"


def transitions(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null")


_MOVES = "m AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT src, dst FROM m WHERE dst IS NOT NULL)"

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


@register("q01_max_files_in_dir", f"WITH {_PAGES} SELECT 'max-files-in-dir' AS rule, parent AS path, 'contains ' || count(*) || ' files, exceeds limit of 5' AS message FROM f WHERE NOT regexp_matches(path, '{S.TEST_NAME}') GROUP BY parent HAVING count(*) > 5")
def q01(spark, d):
    return S.max_files(pages(spark, d), 5)


@register("q02_max_depth_override", f"WITH {_PAGES}, x AS (SELECT *, CASE WHEN regexp_matches(path, '^[^/]*/en/[^/]*$') THEN 2 WHEN regexp_matches(path, '^[^/]*/de/.*$') THEN 1 ELSE 3 END AS lim FROM f) SELECT 'max-depth' AS rule, path, 'exceeds maximum depth of ' || lim AS message FROM x WHERE depth > lim")
def q02(spark, d):
    return S.max_depth(pages(spark, d), 3, {"*/en/*": 2, "*/de/**": 1})


@register("q03_max_subdirs", f"WITH {_PAGES}, g AS (SELECT DISTINCT parent FROM f), h AS (SELECT regexp_extract(parent, '^(.*)/[^/]+$', 1) AS path, count(*) AS n FROM g GROUP BY 1) SELECT 'max-subdirs' AS rule, path, 'contains ' || n || ' subdirectories, exceeds limit of 2' AS message FROM h WHERE n > 2 AND path <> ''")
def q03(spark, d):
    return S.max_subdirs(pages(spark, d), 2)


@register("q04_case_conflicts", f"WITH {_LINKS}, n AS (SELECT DISTINCT import_path AS path, regexp_extract(import_path, '^(.*)/[^/]+$', 1) AS parent FROM l), w AS (SELECT *, first(path) OVER (PARTITION BY parent, lower(regexp_extract(path, '[^/]*$')) ORDER BY path) AS fst FROM n) SELECT 'case-conflicts' AS rule, path, 'conflicts with ' || fst AS message FROM w WHERE path <> fst")
def q04(spark, d):
    return S.case_conflicts(S.files_from(links(spark, d).select(F.col("import_path").alias("p")).distinct(), F.col("p")))


@register("q05_uniqueness", "SELECT p_brand, p_name, count(*) AS n, string_agg(k, ',' ORDER BY k) AS members FROM (SELECT p_brand, p_name, p_partkey::VARCHAR AS k FROM part) GROUP BY 1, 2 HAVING count(*) > 1")
def q05(spark, d):
    return S.uniqueness(read(spark, d, "part").withColumn("k", F.col("p_partkey").cast("string")), "p_brand", "p_name", member="k")


@register("q06_file_existence", f"WITH {_PAGES}, dirs AS (SELECT DISTINCT parent AS path FROM f UNION SELECT DISTINCT regexp_extract(parent, '^(.*)/[^/]+$', 1) FROM f), r(pattern, rx, lo, hi) AS (VALUES ('*', '.', 1, 4), ('1*', '^1', 0, 1), ('index.html', '^index\\.html$', 0, 9)), x AS (SELECT dirs.path, r.pattern, count(f.path) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM dirs CROSS JOIN r LEFT JOIN f ON f.parent = dirs.path AND regexp_matches(regexp_extract(f.path, '[^/]*$'), r.rx) WHERE dirs.path <> '' GROUP BY 1, 2) SELECT path, pattern, n FROM x WHERE n < lo OR n > hi")
def q06(spark, d):
    f = pages(spark, d)
    return S.file_existence(S.directories(f), f, {"*": (1, 4), "1*": (0, 1), "index.html": (0, 9)})


@register("q07_disallowed_patterns", f"WITH {_PAGES}, g(pattern, rx) AS (VALUES ('**/fr/**', '^(?:.*/)?fr(?:/.*)?$'), ('**/*9', '^(?:.*/)?[^/]*9$')) SELECT 'disallowed-patterns' AS rule, path, 'matches disallowed pattern ' || pattern AS message FROM f JOIN g ON regexp_matches(path, rx) WHERE NOT regexp_matches(path, '^(?:.*/)?1[^/]*$')")
def q07(spark, d):
    return S.disallowed(pages(spark, d), ["**/fr/**", "**/*9", "!**/1*"])


_DETECT = "CASE WHEN NOT regexp_matches(s, '[-_ ]') AND NOT regexp_matches(s, '^[A-Z]') THEN 'camelCase' WHEN NOT regexp_matches(s, '[-_ ]') AND (s = '' OR regexp_matches(s, '^[A-Z]')) THEN 'PascalCase' WHEN NOT regexp_matches(s, '[_ ]') AND s = lower(s) THEN 'kebab-case' WHEN NOT regexp_matches(s, '[- ]') AND s = lower(s) THEN 'snake_case' WHEN s = lower(s) THEN 'lowercase' WHEN s = upper(s) THEN 'UPPERCASE' ELSE 'mixed' END"


@register("q08_naming_convention", f"WITH n AS (SELECT DISTINCT p_name AS path, regexp_replace(p_name, '\\.[^.]*$', '') AS s FROM part) SELECT 'naming-convention' AS rule, path, 'is ' || {_DETECT} || ', should be kebab-case' AS message FROM n WHERE regexp_matches(s, '[_ ]') OR s <> lower(s)")
def q08(spark, d):
    return S.naming(read(spark, d, "part").select(F.col("p_name").alias("path")).distinct(), {"*": "kebab-case"})


@register("q08b_name_words", "WITH n AS (SELECT DISTINCT p_type AS path FROM part) SELECT path, lower(path) AS kebab, upper(path[1]) || lower(path[2:]) AS capital FROM n")
def q08b(spark, d):
    n = read(spark, d, "part").select(F.col("p_type").alias("path")).distinct()
    low = F.lower("path")
    return n.select("path", P.to_kebab(low).alias("kebab"), P.to_pascal(low).alias("capital"))


@register("q09_regex_match", f"WITH {_PAGES} SELECT 'regex-match' AS rule, path, 'does not satisfy ^[0-9]+$|^${{1}}-' AS message FROM f WHERE NOT regexp_matches(regexp_extract(path, '[^/]*$'), '^[0-9]+$|^' || string_split(path, '/')[2] || '-')")
def q09(spark, d):
    return S.regex_match(pages(spark, d), "**", r"^[0-9]+$|^${1}-")


@register("q10_predicate_all_any_none", "SELECT doc_id, source || '/' || lang || '/' || doc_id AS path FROM documents WHERE n_chars > 2000 AND (lang = 'de' OR source LIKE 'src1%') AND NOT (doc_id % 2 = 0 OR lang = 'fr')")
def q10(spark, d):
    t = read(spark, d, "documents").withColumn("path", F.concat_ws("/", "source", "lang", "doc_id")).withColumn("is_dir", F.lit(False)).withColumn("size_bytes", F.col("n_chars"))
    p = R.every(R.size_greater_than(2000), R.either(R.path_contains("/de/"), R.path_starts_with("src1")), R.none_of(F.col("doc_id") % 2 == 0, R.path_matches("*/fr/*")))
    return t.where(p).select("doc_id", "path")


@register("q11_require_file", f"WITH {_PAGES} SELECT 'require-file' AS rule, '.' AS path, 'README.md is missing' AS message WHERE NOT EXISTS (SELECT 1 FROM f WHERE path LIKE '%README.md')")
def q11(spark, d):
    return R.require_file(pages(spark, d), "require-file", R.path_ends_with("README.md"), "README.md is missing")


def _children(spark, d):
    return {"depth": q02(spark, d), "patterns": q07(spark, d)}


@register("q12_composite_and", None)
def q12a(spark, d):
    c = _children(spark, d)
    return R.all_of("both", **c).groupBy("rule").agg(F.count("*").alias("n"))


_sql["q12_composite_and"] = f"SELECT 'both[depth]' AS rule, count(*) AS n FROM ({_sql['q02_max_depth_override']}) HAVING count(*) > 0 UNION ALL SELECT 'both[patterns]', count(*) FROM ({_sql['q07_disallowed_patterns']}) HAVING count(*) > 0"


@register("q12_composite_or", f"SELECT 'either' AS rule, '.' AS path, 'none of the alternatives holds' AS message WHERE EXISTS ({_sql['q02_max_depth_override']}) AND EXISTS ({_sql['q07_disallowed_patterns']})")
def q12o(spark, d):
    return R.any_of("either", **_children(spark, d))


@register("q12_composite_not", f"SELECT 'not' AS rule, '.' AS path, 'the negated rule holds' AS message WHERE NOT EXISTS ({_sql['q11_require_file']})")
def q12n(spark, d):
    return R.not_rule("not", q11(spark, d))


@register("q12_composite_xor", f"SELECT 'one' AS rule, '.' AS path, 'not exactly one alternative holds' AS message WHERE (SELECT count(*) FROM (SELECT EXISTS ({_sql['q02_max_depth_override']}) AS v UNION ALL SELECT EXISTS ({_sql['q11_require_file']})) WHERE NOT v) <> 1")
def q12x(spark, d):
    return R.exactly_one_of("one", depth=q02(spark, d), readme=q11(spark, d))


@register("q13_conditional_rule", f"SELECT * FROM ({_sql['q02_max_depth_override']}) WHERE EXISTS (SELECT 1 FROM pages WHERE url LIKE '%/fr/%')")
def q13(spark, d):
    return R.conditional(pages(spark, d), R.path_contains("/fr/"), q02(spark, d))


_LAYER = "CASE WHEN path LIKE 'th%' THEN 'th' WHEN regexp_matches(path, '^[^/]*/de/') THEN 'german' WHEN path LIKE 'a%' THEN 'a' END"


@register("q14_layer_assignment", f"WITH {_PAGES} SELECT page_id, {_LAYER} AS layer FROM f")
def q14(spark, d):
    layers = [("th", layer_match(F.col("path"), "th**")), ("german", glob_match(F.col("path"), "*/de/**", "layer")), ("a", layer_match(F.col("path"), "a"))]
    return pages(spark, d).select("page_id", S.layer_of(F.col("path"), layers).alias("layer"))


@register("q15_layer_boundaries", f"WITH {_MOVES}, t AS (SELECT src, dst, count(*) AS n FROM e GROUP BY 1, 2) SELECT src, dst, n FROM t WHERE src <> dst AND NOT (src = 'view' OR (src = 'click' AND dst = 'purchase'))")
def q15(spark, d):
    e = graph.edge_counts(transitions(spark, d))
    nodes = e.select(F.col("src").alias("path")).union(e.select("dst")).distinct().withColumn("layer", F.col("path"))
    return graph.layer_violations(e, nodes, [("view", "*"), ("click", "purchase")]).select("src", "dst", "n")


@register("q16_path_layers", f"WITH {_PAGES} SELECT path, 'german' AS layer, 'en' AS forbidden FROM f WHERE regexp_matches(path, '^[^/]*/de/') AND regexp_matches(path, '/1[0-9]*$') UNION ALL SELECT path, 'english', 'fr' FROM f WHERE regexp_matches(path, '^[^/]*/en/') AND regexp_matches(path, '/2[0-9]*$')")
def q16(spark, d):
    spec = [("german", "*/de/**", "**/1*", "en"), ("english", "*/en/**", "**/2*", "fr")]
    hits = F.array_compact(F.array(*[F.when(glob_match(F.col("path"), g) & F.col("path").rlike(f"/{bad[3]}[0-9]*$"), F.struct(F.lit(n).alias("layer"), F.lit(x).alias("forbidden"))) for n, g, bad, x in spec]))
    return pages(spark, d).select("path", F.explode(hits).alias("h")).select("path", "h.layer", "h.forbidden")


#: Every page imports the pages of its host and language whose number begins as its own without the last figure.
_PREFIXES = "t AS (SELECT path AS src, regexp_extract(path, '^(.*).$', 1) AS dst FROM f), x AS (SELECT DISTINCT path FROM f), h AS (SELECT dst, min(x.path) AS path FROM (SELECT DISTINCT dst FROM t) JOIN x ON starts_with(x.path, dst) GROUP BY 1)"


def prefix_edges(spark, d):
    return pages(spark, d).select(F.col("path").alias("src"), F.regexp_extract("path", "^(.*).$", 1).alias("dst"))


@register("q17_incoming_refs", f"WITH {_PAGES}, {_PREFIXES} SELECT h.path, count(*)::BIGINT AS refs FROM t JOIN h ON t.dst = h.dst GROUP BY 1")
def q17(spark, d):
    return graph.incoming_refs(prefix_edges(spark, d), pages(spark, d))


@register("q18_orphans", f"WITH {_PAGES}, {_PREFIXES} SELECT path FROM x WHERE NOT regexp_matches(path, '/en/') AND path NOT IN (SELECT path FROM h)")
def q18(spark, d):
    return graph.orphans(pages(spark, d).select("path").distinct(), prefix_edges(spark, d), F.col("path").rlike("/en/"))


#: Targets that lack an extension, an index file, the end or the beginning of a path.
_TARGETS = """fs AS (SELECT DISTINCT CASE page_id % 4 WHEN 0 THEN path || '.ts' WHEN 1 THEN path || '/index.js' WHEN 2 THEN path || '.py' ELSE path END AS path FROM f),
e AS (SELECT DISTINCT page_id, path AS src, CASE WHEN page_id % 5 = 4 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) WHEN page_id % 5 = 3 THEN regexp_extract(path, '^[^/]*/(.*)$', 1) ELSE path END AS dst FROM f)"""


def targets(spark, d):
    p, n = pages(spark, d), F.col("page_id")
    path = F.when(n % 4 == 0, F.concat("path", F.lit(".ts"))).when(n % 4 == 1, F.concat("path", F.lit("/index.js"))).when(n % 4 == 2, F.concat("path", F.lit(".py"))).otherwise(F.col("path"))
    dst = F.when(n % 5 == 4, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).when(n % 5 == 3, F.regexp_extract("path", "^[^/]*/(.*)$", 1)).otherwise(F.col("path"))
    return p.select(path.alias("path")).distinct(), p.select("page_id", F.col("path").alias("src"), dst.alias("dst"))


def _cascade(ends: list[str], last: str) -> str:
    tries = ", ".join(f"({i}, '{x}')" for i, x in enumerate(ends))
    return f"s(o, v) AS (VALUES {tries}), c AS (SELECT e.dst, o, fs.path FROM (SELECT DISTINCT dst FROM e) e CROSS JOIN s JOIN fs ON fs.path = e.dst || s.v UNION ALL SELECT e.dst, 99, min(fs.path) FROM (SELECT DISTINCT dst FROM e) e JOIN fs ON {last}(fs.path, e.dst) GROUP BY 1), h AS (SELECT dst, arg_min(path, o) AS target FROM c GROUP BY 1)"


@register("q18b_layer_targets", f"WITH {_PAGES}, {_TARGETS}, {_cascade(['', *graph.LAYER_EXTENSIONS, *('/' + x for x in graph.INDEX_FILES)], 'starts_with')} SELECT e.page_id, h.target FROM e LEFT JOIN h ON h.dst = e.dst")
def q18b(spark, d):
    f, e = targets(spark, d)
    return graph.layer_targets(e, f).select("page_id", "target")


@register("q18c_cycle_targets", f"WITH {_PAGES}, {_TARGETS}, {_cascade([''], 'ends_with')} SELECT e.page_id, h.target FROM e LEFT JOIN h ON h.dst = e.dst")
def q18c(spark, d):
    f, e = targets(spark, d)
    return graph.cycle_targets(e, f).select("page_id", "target")


@register("q19_edges", f"WITH {_MOVES} SELECT src, dst, count(*) AS n FROM e GROUP BY 1, 2")
def q19(spark, d):
    return graph.edge_counts(transitions(spark, d))


_CUSTOMERS = "e AS (SELECT DISTINCT c_nationkey AS src, (c_custkey * 7 + c_nationkey) % 25 AS dst FROM customer)"


def nation_edges(spark, d):
    c = read(spark, d, "customer")
    return c.select(F.col("c_nationkey").cast("bigint").alias("src"), ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % 25).cast("bigint").alias("dst")).distinct()


_PARTS = """e AS (
    SELECT DISTINCT src, dst FROM (
        SELECT p_partkey AS src, lead(p_partkey) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS dst FROM part
        UNION ALL
        SELECT p_partkey, CASE WHEN p_partkey = max(p_partkey) OVER (PARTITION BY p_brand, p_size) THEN min(p_partkey) OVER (PARTITION BY p_brand, p_size) END FROM part)
    WHERE src <> dst)"""


def part_edges(spark, d):
    """A sparse graph that grows with its table: each part leads to the next one of its brand and type, the last of its brand and size to the first."""
    p = read(spark, d, "part").withColumn("p_partkey", F.col("p_partkey").cast("bigint"))
    kind, size = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey"), Window.partitionBy("p_brand", "p_size")
    key = F.col("p_partkey")
    on = p.select(key.alias("src"), F.lead("p_partkey").over(kind).alias("dst"))
    back = p.select(key.alias("src"), F.when(key == F.max("p_partkey").over(size), F.min("p_partkey").over(size)).alias("dst"))
    return on.union(back).where("src != dst").distinct()


@register("q20_reachability", f"WITH RECURSIVE {_PARTS}, r(node, distance) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, r.distance + 1 FROM r JOIN e ON e.src = r.node WHERE r.distance < 4) SELECT node, min(distance) AS distance FROM r GROUP BY 1")
def q20(spark, d):
    return graph.reachable(part_edges(spark, d), spark.createDataFrame([(0,)], "node bigint"), 4)


_REACH = "r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)"


@register(
    "q21_scc",
    f"""WITH RECURSIVE {_PARTS}, {_REACH}, n AS (SELECT src AS x FROM e UNION SELECT dst FROM e)
    SELECT x AS node, coalesce((SELECT min(r.b) FROM r JOIN r s ON s.a = r.b AND s.b = r.a WHERE r.a = x), x) AS component FROM n""",
)
def q21(spark, d):
    return graph.strongly_connected(part_edges(spark, d))


@register("q21b_cycle_edges", f"WITH RECURSIVE {_PARTS}, {_REACH} SELECT e.src, e.dst FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.a = e.dst AND r.b = e.src)")
def q21b(spark, d):
    return graph.cycle_edges(part_edges(spark, d))


@register("q22_test_adjacency", "SELECT 'test-adjacency' AS rule, conv_id || '/' || turn AS path, 'has no test' AS message FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations t WHERE t.role = 'assistant' AND t.conv_id = c.conv_id AND t.turn = c.turn + 1)")
def q22(spark, d):
    c = read(spark, d, "conversations").withColumn("path", F.concat_ws("/", "conv_id", "turn"))
    return S.missing_tests(c.where("role = 'user'"), c.where("role = 'assistant'"), F.concat_ws("/", "conv_id", F.col("turn") + 1))


@register("q23_test_location", "SELECT 'test-location' AS rule, doc_id::VARCHAR AS path, 'has no source beside it' AS message FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id OR l.doc_id = d.doc_id + 1)")
def q23(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"))
    sources = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("path"))
    return S.misplaced_tests(docs, sources, [F.col("path"), (F.col("path").cast("bigint") + 1).cast("string")])


def tokens(text: str = "text"):
    return F.regexp_extract_all(F.lower(text), F.lit(r"([^\s]+)"), 1)


_GRAMS = "t AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x09-\\x0D\\x20]+') AS w FROM documents), g AS (SELECT doc_id, pos - 1 AS pos, array_to_string(w[pos:pos + 19], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM t WHERE len(w) >= 20))"


def repeated(spark, d):
    return clones.repeated_grams(read(spark, d, "documents"), "doc_id", tokens())


@register("q24_kgram_shingles", f"WITH {_GRAMS} SELECT doc_id, count(*) AS n, min(md5(gram)) AS first, max(md5(gram)) AS last FROM g GROUP BY 1")
def q24(spark, d):
    return clones.shingle_summary(read(spark, d, "documents"), "doc_id", tokens())


@register("q25_cross_doc_collisions", f"WITH {_GRAMS} SELECT md5(gram) AS gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def q25(spark, d):
    return clones.collisions(repeated(spark, d), "doc_id")


_CLONES = f"""WITH {_GRAMS}, p AS (SELECT doc_id, pos, md5(gram) AS h FROM g),
r AS (SELECT h, min((doc_id, pos)) AS rep FROM p GROUP BY h HAVING count(*) > 1),
f AS (SELECT h, doc_id, min(pos) AS pos FROM p GROUP BY h, doc_id),
-- the diagonals on which a document has the first place of another's k-gram
d AS (SELECT DISTINCT rep[1] AS a, doc_id AS b, f.pos - rep[2] AS shift FROM f JOIN r ON r.h = f.h WHERE doc_id <> rep[1]),
-- all equal k-grams on them, and each later place in a document with the first one there
m AS (SELECT d.a, d.b, d.shift, x.pos AS pa FROM d JOIN p y ON y.doc_id = d.b JOIN p x ON x.doc_id = d.a AND x.pos = y.pos - d.shift AND x.h = y.h
  UNION ALL SELECT p.doc_id, p.doc_id, p.pos - f.pos, f.pos FROM p JOIN f ON f.h = p.h AND f.doc_id = p.doc_id WHERE p.pos > f.pos),
i AS (SELECT *, pa - row_number() OVER (PARTITION BY a, b, shift ORDER BY pa) AS island FROM m)
SELECT a, b, min(pa) AS start_a, min(pa) + shift AS start_b, count(*) + 19 AS tokens FROM i GROUP BY a, b, shift, island"""


@register("q26_clone_pairs", _CLONES)
def q26(spark, d):
    return clones.clone_pairs(clones.repeated_texts(read(spark, d, "documents"), "doc_id", tokens()), "doc_id")


@register("q26b_clone_passages", f"WITH {_GRAMS}, p AS (SELECT doc_id, pos, md5(gram) AS h, lag(md5(gram)) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM g), c AS (SELECT h, count(*) AS places, count(before) = count(*) AND count(DISTINCT before) = 1 AS one FROM p GROUP BY 1 HAVING count(*) > 1), s AS (SELECT p.*, c.places, c.one AND c.places = b.places AS on_ FROM p JOIN c ON c.h = p.h LEFT JOIN c b ON b.h = p.before), i AS (SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM s) SELECT arg_min(h, pos) AS passage, doc_id, min(pos) AS start, count(*) + 19 AS tokens, min(places) AS places FROM i GROUP BY doc_id, part")
def q26b(spark, d):
    return clones.passages(read(spark, d, "documents"), "doc_id", tokens())


#: Each brand as a file with a function for each part; parts of a size and type have the same function, those of a type the same but for names.
_CODE = """c AS (SELECT p_brand || '.go' AS path, string_agg('func Size' || p_size || '(n int) string {' || chr(10) || '  // ' || p_name || chr(10)
    || CASE WHEN p_size % 2 = 0 THEN '  if n > ' || p_size || ' { return `' || p_type || '` }' ELSE '  for n != 0 { n >>= ' || p_size || ' }' END
    || chr(10) || '  return "' || p_type || '"' || chr(10) || '}' || chr(10), '' ORDER BY p_partkey) AS text FROM part GROUP BY p_brand)"""
_LEXED = (
    _CODE
    + r""", s AS (SELECT path, regexp_extract_all(text, '//[^\n]*|`[^`]*`|"[^"]*"|[0-9]+|[A-Za-z_][A-Za-z0-9_]*|>>=|!=|\n|[^\s]') AS x FROM c),
u AS (SELECT path, unnest(x) AS tok, unnest(range(len(x))) AS i FROM s),
v AS (SELECT *, 1 + count(*) FILTER (tok = chr(10)) OVER (PARTITION BY path ORDER BY i) AS line FROM u),
l AS (SELECT path, list(tok ORDER BY i) AS raw, list(line ORDER BY i) AS at,
    list(CASE WHEN regexp_matches(tok, '^[`"0-9]') THEN '_LIT_' WHEN regexp_matches(tok, '^[A-Za-z_]') AND tok NOT IN ('func', 'if', 'for', 'return') THEN '_ID_' ELSE tok END ORDER BY i) AS w
    FROM v WHERE tok <> chr(10) AND NOT starts_with(tok, '//') GROUP BY path)"""
)


def code_parts(spark, d):
    """path, p_partkey, text: the functions of each file, in the order of p_partkey."""
    size, says = F.col("p_size").cast("string"), lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    body = F.when(F.col("p_size") % 2 == 0, says("  if n > ", size, " { return `", F.col("p_type"), "` }")).otherwise(says("  for n != 0 { n >>= ", size, " }"))
    text = says("func Size", size, "(n int) string {\n  // ", F.col("p_name"), "\n", body, '\n  return "', F.col("p_type"), '"\n}\n')
    return read(spark, d, "part").select(F.concat("p_brand", F.lit(".go")).alias("path"), "p_partkey", text.alias("text")).where("text is not null")


@register(
    "q54_code_clones",
    f"""WITH {_LEXED}, m AS ({_CLONES.replace(_GRAMS.split("), g AS")[0], "t AS (SELECT path AS doc_id, w FROM l")})
    SELECT m.a, m.b, start_a, start_b, tokens, x.at[start_a + 1] AS line_a, y.at[start_b + 1] AS line_b, x.at[start_a + tokens] - x.at[start_a + 1] + 1 AS lines,
           CASE WHEN x.raw[start_a + 1:start_a + tokens] = y.raw[start_b + 1:start_b + tokens] THEN 'exact' ELSE 'renamed' END AS type
    FROM m JOIN l x ON x.path = m.a JOIN l y ON y.path = m.b WHERE tokens >= 60 AND x.at[start_a + tokens] - x.at[start_a + 1] + 1 >= 8""",
)
def q54(spark, d):
    return clones.code_clones(code_parts(spark, d), min_tokens=60, min_lines=8, order=(F.asc_nulls_last("p_partkey"), "text"))


@register("q27_index_stats", f"WITH {_GRAMS}, c AS (SELECT md5(gram) AS gram, count(*) AS n FROM g GROUP BY 1) SELECT count(*) AS hashes, sum(n)::BIGINT AS shingles, count(*) FILTER (n > 1) AS collisions FROM c")
def q27(spark, d):
    return clones.index_stats(read(spark, d, "documents"), "doc_id", tokens())


_TOKENS = "t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[.,;:!?|#*$%&<>]')) AS value FROM documents)"


@register("q28_halstead", f"WITH {_TOKENS}, x AS (SELECT *, regexp_matches(value, '^[^A-Za-z]') AS op FROM t), h AS (SELECT doc_id, count(DISTINCT CASE WHEN op THEN value END) AS n1, count(DISTINCT CASE WHEN NOT op THEN value END) AS n2, count(*) FILTER (op) AS big_n1, count(*) FILTER (NOT op) AS big_n2 FROM x GROUP BY 1) SELECT *, round((big_n1 + big_n2) * log2(n1 + n2), 6) AS volume, round(CASE WHEN n2 > 0 THEN n1 / 2.0 * big_n2 / n2 ELSE 0 END, 6) AS difficulty FROM h")
def q28(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z]+|[.,;:!?|#*$%&<>])"), 1)).alias("value"))
    h = metrics.halstead(t.withColumn("is_operator", F.col("value").rlike("^[^A-Za-z]")), "doc_id")
    return h.select("doc_id", "n1", "n2", "big_n1", "big_n2", F.round("volume", 6).alias("volume"), F.round("difficulty", 6).alias("difficulty"))


@register("q29_cognitive", "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '</?(?:div|ul|section|article|li|nav)\\b')) AS tag, generate_subscripts(regexp_extract_all(html, '</?(?:div|ul|section|article|li|nav)\\b'), 1) AS pos FROM pages), n AS (SELECT *, greatest(coalesce(sum(CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS nesting FROM t) SELECT page_id, sum(CASE WHEN tag LIKE '</%' THEN 0 ELSE 1 + nesting END)::BIGINT AS complexity FROM n GROUP BY 1")
def q29(spark, d):
    t = read(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(</?(?:div|ul|section|article|li|nav)\b)"), 1)).alias("pos", "tag"))
    closes = F.col("tag").startswith("</")
    return metrics.cognitive(t, "page_id", "pos", F.when(closes, -1).otherwise(1), ~closes)


@register("q30_metric_rollup", "SELECT source, sum(n_chars)::BIGINT AS total, round(avg(n_chars), 6) AS average, max(n_chars) AS most, count(*) AS functions FROM documents GROUP BY 1")
def q30(spark, d):
    return metrics.rollup(read(spark, d, "documents"), "source", "n_chars").withColumn("average", F.round("average", 6))


@register("q31_lang_profile", "WITH n AS (SELECT lang, count(*) AS n, max(n_chars) AS most FROM documents GROUP BY 1) SELECT lang, n, row_number() OVER (ORDER BY n DESC, lang) AS rank, least(greatest(n * 12 // 10, 20), 100) AS max_files, least(greatest(most + 2, 4), 10) AS max_depth FROM n")
def q31(spark, d):
    return code.language_profile(read(spark, d, "documents"))


@register("q32_imports_extract", f"WITH {_LINKS} SELECT source_file, import_path, count(*) AS n FROM l GROUP BY 1, 2")
def q32(spark, d):
    return links(spark, d).groupBy("source_file", "import_path").agg(F.count("*").alias("n"))


@register("q33_directive_scan", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, min(n) AS line, count(*) AS hits FROM l WHERE n <= 100 AND regexp_matches(line, '(?i)^(released|licensed|this work is licensed) under') GROUP BY 1")
def q33(spark, d):
    rows = code.lines(read(spark, d, "documents"), "doc_id", "text", 100).where(F.col("line").rlike("(?i)^(released|licensed|this work is licensed) under"))
    return rows.groupBy("doc_id").agg(F.min("n").alias("line"), F.count("*").alias("hits"))


@register("q34_deep_relative", "SELECT 'deep-relative-imports' AS rule, 'src/' || p_partkey AS path, 'goes up ' || (p_size % 6) || ' directories' AS message FROM part WHERE p_size % 6 >= 3")
def q34(spark, d):
    i = read(spark, d, "part").select(F.concat(F.lit("src/"), "p_partkey").alias("source_file"), F.concat(F.repeat(F.lit("../"), F.col("p_size") % 6), F.lit("lib/x")).alias("import_path"))
    return S.deep_relative_imports(i, 3)


@register("q35_junit_counts", f"SELECT rule, count(*) AS failures FROM ((SELECT * FROM ({_sql['q01_max_files_in_dir']})) UNION ALL (SELECT * FROM ({_sql['q02_max_depth_override']})) UNION ALL (SELECT * FROM ({_sql['q07_disallowed_patterns']})) UNION ALL (SELECT * FROM ({_sql['q22_test_adjacency']}))) GROUP BY 1")
def q35(spark, d):
    return R.union_all([q01(spark, d), q02(spark, d), q07(spark, d), q22(spark, d)]).groupBy("rule").agg(F.count("*").alias("failures"))


@register("q36_resolve_path", f"WITH {_PAGES} SELECT page_id, regexp_extract(path, '^([^/]*)/', 1) || '/lib/' || (page_id % 7) AS target FROM f")
def q36(spark, d):
    i = pages(spark, d)
    return i.select("page_id", P.resolve_import(F.concat_ws("/", F.split("path", "/")[0], F.lit("x"), F.lit("y")), F.concat(F.lit("./.././x/../lib//"), F.col("page_id") % 7)).alias("target"))


@register("q37_semantic_clones", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id AND (b.vec_id % 20 != 0 OR a.vec_id < b.vec_id) WHERE a.vec_id % 20 = 0 ORDER BY 3 DESC, 1, 2 LIMIT 100")
def q37(spark, d):
    return code.semantic_clones(read(spark, d, "embeddings"), 100)


@register("q38_index_files", "SELECT l.doc_id, 'no label' AS missing FROM documents l WHERE lang = 'es' AND NOT EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = l.doc_id)")
def q38(spark, d):
    return read(spark, d, "documents").where("lang = 'es'").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("no label").alias("missing"))


@register("q39_missing_headings", "WITH h(w) AS (VALUES ('The'), ('der'), (' of ')) SELECT doc_id::VARCHAR AS path, array_to_string(list_sort(list(w)), '|') AS missing FROM documents JOIN h ON NOT contains(text, w) GROUP BY 1")
def q39(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return S.missing_headings(docs, ["The", "der", " of "]).select("path", F.array_join(F.array_sort("missing"), "|").alias("missing"))


@register("q40_resolve_cascade", f"WITH {_PAGES}, x AS (SELECT DISTINCT path FROM f), e AS (SELECT page_id, path AS src, regexp_extract(path, '^(.*)[0-9]$', 1) AS dst FROM f), s(o, v) AS (VALUES (0, ''), (1, '1'), (2, '5'), (3, '9')), h AS (SELECT e.page_id, arg_min(x.path, o) AS target FROM e CROSS JOIN s JOIN x ON x.path = e.dst || s.v GROUP BY 1) SELECT e.page_id, h.target FROM e LEFT JOIN h ON e.page_id = h.page_id")
def q40(spark, d):
    f = pages(spark, d)
    e = f.select("page_id", F.col("path").alias("src"), F.regexp_extract("path", "^(.*)[0-9]$", 1).alias("dst"))
    return graph.resolve(e, f, ("1", "5", "9")).select("page_id", "target")


@register("q41_missing_gates", "WITH s AS (SELECT conv_id AS job, lower(concat_ws(' ', text, role)) AS t FROM conversations), g(message, p) AS (VALUES ('asks nothing', '\\?'), ('has no figure', '[0-9]')) SELECT job, message FROM s CROSS JOIN g GROUP BY job, message HAVING NOT bool_or(regexp_matches(t, p))")
def q41(spark, d):
    steps = read(spark, d, "conversations").select(F.col("conv_id").alias("job"), F.col("role").alias("name"), F.col("text").alias("run"))
    return workflows.missing_gates(steps, {"asks nothing": r"\?", "has no figure": "[0-9]"}, "job")


@register("q42_recommended_limits", f"WITH {_PAGES}, u AS (SELECT DISTINCT string_split(parent, '/') AS parts FROM f WHERE parent != ''), i AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM u), x AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS path FROM i), s AS (SELECT count(*) AS n FROM x WHERE contains(path, '/') GROUP BY regexp_extract(path, '^(.*)/[^/]+$', 1)), c AS (SELECT count(*) AS n FROM f WHERE parent != '' GROUP BY parent) SELECT least(greatest((SELECT coalesce(max(depth), 0) FROM f) + 2, 4), 10)::BIGINT AS max_depth, least(greatest(floor((SELECT coalesce(max(n), 0) FROM c) * 1.2), 20), 100)::BIGINT AS max_files, least(greatest((SELECT coalesce(max(n), 0) FROM s) + 3, 10), 30)::BIGINT AS max_subdirs")
def q42(spark, d):
    return profile.recommended_limits(pages(spark, d))


@register("q43_mermaid", f"WITH {_CUSTOMERS}, b AS (SELECT n_nationkey AS k, 'n' || substr(md5('world/' || n_regionkey || '/' || n_name), 1, 12) || '[\"' || n_regionkey || '/' || n_name || '\"]' AS box FROM nation) SELECT 'graph LR' AS line UNION ALL SELECT '  ' || x.box || ' --> ' || y.box FROM e JOIN b x ON x.k = e.src JOIN b y ON y.k = e.dst UNION ALL SELECT '  ' || box FROM b WHERE k NOT IN (SELECT src FROM e)")
def q43(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.concat_ws("/", F.lit("world"), "n_regionkey", "n_name").alias("path"))
    e = nation_edges(spark, d).join(n.toDF("src", "from"), "src").join(n.toDF("dst", "to"), "dst").select(F.col("from").alias("src"), F.col("to").alias("dst"))
    return graph.mermaid_lines(n.select("path"), e)


@register("q44_clone_summary", f"SELECT count(*) AS clones, coalesce(sum(tokens), 0)::BIGINT AS tokens, count(*) FILTER (a = b) AS within FROM ({_sql['q26_clone_pairs']})")
def q44(spark, d):
    return sinks.clone_summary(q26(spark, d))


@register("q45_clone_sarif_results", f"""SELECT '{{"ruleId":"code-clone-exact","level":"warning","message":{{"text":"Clone of ' || tokens || ' tokens"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || a || '"}}}},"properties":{{"startToken":' || start_a || ',"tokens":' || tokens || '}}}}],"relatedLocations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || b || '"}}}},"properties":{{"startToken":' || start_b || ',"tokens":' || tokens || '}}}}]}}' AS json FROM ({_sql['q26_clone_pairs']})""")
def q45(spark, d):
    return sinks.clone_results(q26(spark, d))


#: Pages as TypeScript files; each imports the one of its folder without its last figure, and the German one of its name (German ones themselves).
_FOLDERS = [{"name": "english", "path": "**/en/", "dependsOn": ["french"]}, {"name": "german", "path": "**/de/"}, {"name": "rest", "path": "", "dependsOn": ["*"]}]
_PROJECT = f"""WITH {_PAGES}, x AS (SELECT DISTINCT 'site/' || folder || '/' || name AS path, 'site' AS host, folder, name FROM (SELECT string_split(path, '/')[2] AS folder, string_split(path, '/')[3] AS name FROM f WHERE regexp_matches(path, '^[^/]+/[^/]+/[0-9]+$'))),
fs AS (SELECT path || '.ts' AS path, CASE WHEN contains(path, 'en/') THEN 'english' WHEN contains(path, 'de/') THEN 'german' ELSE 'rest' END AS layer FROM x),
e AS (SELECT path || '.ts' AS src, rtrim(host || '/' || folder || '/' || left(name, -1), '/') AS dst FROM x UNION ALL SELECT path || '.ts', host || '/de/' || name FROM x),
r AS (SELECT e.dst, min(fs.path) AS path FROM (SELECT DISTINCT dst FROM e) e JOIN fs ON starts_with(fs.path, e.dst) GROUP BY 1),
n AS (SELECT r.path, count(*) AS refs FROM e JOIN r ON r.dst = e.dst GROUP BY 1),
t AS (SELECT src, coalesce(a.path, r.path) AS target FROM e LEFT JOIN fs a ON a.path = e.dst || '.ts' LEFT JOIN r ON r.dst = e.dst)"""


def project_files(spark, d):
    """Files with text, of the pages whose path is host/folder/figures; all hosts are one site, so that files link one another."""
    p = pages(spark, d).where(F.col("path").rlike("^[^/]+/[^/]+/[0-9]+$")).select(F.regexp_replace("path", "^[^/]+", "site").alias("path")).distinct()
    name = F.element_at(F.split("path", "/"), -1)
    text = F.concat(F.lit("// a page\nimport a from './"), F.substring(name, F.lit(1), F.length(name) - 1), F.lit("'\nimport { b } from \"../de/"), name, F.lit('";\n'))
    return S.files_from(p.withColumn("text", text), F.concat("path", F.lit(".ts")))


def project(spark, d):
    f = project_files(spark, d)
    return J.dependency_graph(f, f.select("path", "text"), _FOLDERS)


@register("q46_dependency_graph", f"{_PROJECT} SELECT fs.path, layer, coalesce(refs, 0)::BIGINT AS refs FROM fs LEFT JOIN n ON n.path = fs.path")
def q46(spark, d):
    return project(spark, d).files


@register("q47_layer_rule", f"{_PROJECT} SELECT 'enforce-layer-boundaries' AS rule, t.src AS path, 'layer ''' || a.layer || ''' cannot import from layer ''' || b.layer || ''' (imported: ' || t.target || ')' AS message FROM t JOIN fs a ON a.path = t.src JOIN fs b ON b.path = t.target WHERE a.layer <> b.layer AND a.layer <> 'rest'")
def q47(spark, d):
    return J.layer_boundaries(project(spark, d), _FOLDERS)


@register("q48_orphan_rule", f"{_PROJECT} SELECT 'disallow-orphaned-files' AS rule, path, 'file is orphaned (not imported by any other file)' AS message FROM fs WHERE path NOT IN (SELECT path FROM n) AND NOT starts_with(path, 'site/fr') AND NOT regexp_matches(path, '/1[0-9]*[.]ts$')")
def q48(spark, d):
    return J.orphaned_files(project(spark, d), ["site/fr/**", "1*.ts"])


@register("q49_import_cycles", f"{_PROJECT} SELECT 'disallow-import-cycles' AS rule, path, 'cyclic dependency detected' AS message FROM fs WHERE regexp_matches(path, '^[^/]*/de/')")
def q49(spark, d):
    return J.import_cycles(project(spark, d))


#: All pages as TypeScript files in a folder for each host: each imports the next one of its host (the last the first), and the one with half its number.
_RINGS = f"""{_PAGES}, h AS (SELECT page_id AS id, string_split(path, '/')[1] AS host FROM f),
x AS (SELECT id, host || '/' || id || '.ts' AS path, coalesce(lead(id) OVER w, first(id) OVER (PARTITION BY host ORDER BY id)) AS next, host FROM h WINDOW w AS (PARTITION BY host ORDER BY id)),
e AS (SELECT path AS src, host || '/' || next || '.ts' AS dst FROM x UNION SELECT x.path, y.path FROM x JOIN x y ON y.id = x.id // 2),
{_REACH},
k AS (SELECT r.a AS node, min(r.b) AS component FROM r JOIN r s ON s.a = r.b AND s.b = r.a GROUP BY 1)"""


def rings(spark, d):
    p = pages(spark, d).select(F.col("page_id").alias("id"), F.split_part("path", F.lit("/"), F.lit(1)).alias("host"))
    w = Window.partitionBy("host").orderBy("id")
    p = p.withColumn("next", F.coalesce(F.lead("id").over(w), F.first("id").over(w)))
    half = p.select(F.col("id").alias("half"), F.col("host").alias("half_host"))
    p = p.join(half, F.expr("id div 2 = half"))
    text = F.format_string("import a from './%d.ts'\nimport b from '../%s/%d.ts'\n", "next", "half_host", "half")
    f = S.files_from(p.withColumn("text", text), F.concat("host", F.lit("/"), "id", F.lit(".ts")))
    return J.dependency_graph(f, f.select("path", "text"))


@register("q49b_import_rings", f"WITH RECURSIVE {_RINGS.removeprefix('WITH ')} SELECT DISTINCT 'disallow-import-cycles' AS rule, component AS path, 'cyclic dependency detected' AS message FROM k")
def q49b(spark, d):
    return J.import_cycles(rings(spark, d))


@register(
    "q53_cycle_reports",
    f"""WITH RECURSIVE {_RINGS.removeprefix('WITH ')},
    i AS (SELECT e.src, e.dst, a.component FROM e JOIN k a ON a.node = e.src JOIN k b ON b.node = e.dst AND b.component = a.component),
    back(component, node, d) AS (SELECT DISTINCT component, component, 0 FROM i UNION SELECT i.component, i.src, d + 1 FROM back JOIN i ON i.component = back.component AND i.dst = back.node WHERE d < (SELECT count(*) FROM x)),
    left_(component, node, d) AS (SELECT component, node, min(d) FROM back GROUP BY ALL),
    size_ AS (SELECT component, min(d) AS files FROM back WHERE node = component AND d > 0 GROUP BY 1),
    way(component, node, steps) AS (
        SELECT component, component, [component] FROM size_
        UNION ALL
        SELECT way.component, i.dst, list_append(steps, i.dst) FROM way JOIN i ON i.component = way.component AND i.src = way.node
        JOIN size_ ON size_.component = way.component JOIN left_ ON left_.component = way.component AND left_.node = i.dst
        WHERE len(steps) < files AND left_.d = files - len(steps)),
    best AS (SELECT component, files, min(steps) AS steps FROM way JOIN size_ USING (component) WHERE len(steps) = files GROUP BY ALL)
    SELECT 'disallow-import-cycles' AS rule, steps[-1] AS path, 'cyclic dependency detected' AS message, 'cycle: ' || array_to_string(steps, ' -> ') || ' -> ' || component AS context,
           'Break the cycle with an interface or abstraction; Apply dependency inversion to invert the import direction' AS suggestions, files FROM best""",
)
def q53(spark, d):
    return J.cycle_reports(rings(spark, d)).withColumn("suggestions", F.array_join("suggestions", "; "))



_GERMAN, _FRENCH = (f"'layer ''mixed'' file contains path from layer ''{x}'' which is not in its allowed dependencies (canDependOn: [english])'" for x in ("german", "french"))
_MIXED = "NOT regexp_matches(path, '^[^/]*/de/') AND regexp_matches(path, '^m[.]')"


@register("q50_path_layer_rule", f"WITH {_PAGES}, m AS (SELECT path, 'layer ''german'' file contains forbidden path pattern ''**/1*''' AS message FROM f WHERE regexp_matches(path, '^[^/]*/de/') AND regexp_matches(path, '(^|/)1[^/]*$') UNION ALL SELECT path, {_GERMAN} FROM f WHERE {_MIXED} AND contains(path, '/de/') UNION ALL SELECT path, {_FRENCH} FROM f WHERE {_MIXED} AND contains(path, '/fr/')) SELECT 'path-based-layers' AS rule, path, message FROM m")
def q50(spark, d):
    layers = [{"name": "german", "patterns": ["*/de/**", "x/de/**"], "forbiddenPaths": ["**/1*"]}, {"name": "mixed", "patterns": ["m.**"], "canDependOn": ["english"]}, {"name": "english", "patterns": ["*/en/**"]}, {"name": "french", "patterns": ["x/fr/**"]}]
    return J.path_layers(pages(spark, d), layers)


@register("q51_uniqueness_rule", f"WITH {_PAGES}, g(pattern, rx) AS (VALUES ('1*', '^1'), ('*5', '5$')), x AS (SELECT DISTINCT path, parent FROM f) SELECT 'uniqueness-constraints' AS rule, CASE parent WHEN '' THEN '.' ELSE parent END AS path, 'multiple files match pattern ''' || pattern || ''' (singleton constraint violated): ' || string_agg(x.path, ', ' ORDER BY x.path) AS message FROM x JOIN g ON regexp_matches(regexp_extract(x.path, '[^/]*$'), rx) GROUP BY parent, pattern HAVING count(*) > 1")
def q51(spark, d):
    p = pages(spark, d).select("path", "parent_path", "is_dir").distinct()
    return J.uniqueness_constraints(p, {"1*": "singleton", "*5": "unique", "*": "any"})


#: Documents as sources and tests in folders by language; a test has another's number.
_TESTS = "d AS (SELECT lang || '/' || CASE doc_id % 3 WHEN 0 THEN 'test_u' || doc_id // 3 || '_pbt.py' WHEN 1 THEN 'u' || doc_id // 4 || '.py' ELSE 'u' || doc_id // 5 || '_test.go' END AS path FROM documents), x AS (SELECT DISTINCT path, regexp_extract(path, '^(.*)/', 1) AS dir, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][a-z]+$', '') AS stem, contains(path, 'test') AS test FROM d)"


@register("q52_test_location_rule", f"WITH {_TESTS}, s AS (SELECT DISTINCT dir, stem FROM x WHERE NOT test) SELECT 'test-location' AS rule, path, 'test file not adjacent to source code and not in integration test directory ''en/''' AS message FROM x WHERE test AND dir <> 'en' AND NOT EXISTS (SELECT 1 FROM s WHERE s.dir = x.dir AND s.stem = regexp_replace(regexp_replace(x.stem, '^test_', ''), '(_pbt|_test)$', ''))")
def q52(spark, d):
    n = F.col("doc_id")
    name = F.when(n % 3 == 0, F.concat(F.lit("test_u"), F.floor(n / 3), F.lit("_pbt.py"))).when(n % 3 == 1, F.concat(F.lit("u"), F.floor(n / 4), F.lit(".py"))).otherwise(F.concat(F.lit("u"), F.floor(n / 5), F.lit("_test.go")))
    t = read(spark, d, "documents").select(F.concat_ws("/", "lang", name).alias("p")).distinct()
    return J.test_location(S.files_from(t, F.col("p")), ["**"], "en")


#: Layers of the hosts, for the export.
_HOST_LAYER = "CASE WHEN starts_with({0}, 'th') THEN 'domain' WHEN starts_with({0}, 'm') THEN 'application' WHEN starts_with({0}, 'blog') THEN 'shop' END"


@register(
    "q57_dot_lines",
    f"""WITH RECURSIVE {_RINGS.removeprefix('WITH ')},
    s(node, d) AS (SELECT min(path), 0 FROM x UNION SELECT e.dst, d + 1 FROM s JOIN e ON e.src = s.node WHERE d < 5),
    g AS (SELECT DISTINCT node AS path, 'n' || substr(md5(node), 1, 12) AS id, {_HOST_LAYER.format('node')} AS layer FROM s)
    SELECT unnest(['digraph "hosts" {{', '  rankdir=LR;', '  node [shape=box, style=rounded];', '  edge [arrowhead=vee];', '  // Legend', '  subgraph cluster_legend {{', '    label="Layers";', '    style=filled;', '    fillcolor="#F0F0F0";',
        '    legend0 [label="domain", color="#2E7D32", fillcolor="#C8E6C9", style="rounded,filled"];', '    legend1 [label="application", color="#1565C0", fillcolor="#BBDEFB", style="rounded,filled"];',
        '    legend2 [label="shop", color="black", fillcolor="#FFFFFF", style="rounded,filled"];', '  }}', '}}']) AS line
    UNION ALL SELECT '  ' || id || ' [label="' || path || '", ' || CASE layer WHEN 'domain' THEN 'color="#2E7D32", fillcolor="#C8E6C9"' WHEN 'application' THEN 'color="#1565C0", fillcolor="#BBDEFB"'
        WHEN 'shop' THEN 'color="black", fillcolor="#FFFFFF"' ELSE 'color="gray", fillcolor="#F5F5F5"' END || ', style="rounded,filled"];' FROM g
    UNION ALL SELECT '  ' || a.id || ' -> ' || b.id || CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.a = e.dst AND r.b = e.src) THEN ' [color="orange", style="bold", penwidth=2.0];'
        WHEN a.layer = 'domain' AND b.layer = 'application' THEN ' [color="red", style="bold", penwidth=2.0];' ELSE ' [color="black", style="solid", penwidth=1.0];' END
        FROM e JOIN g a ON a.path = e.src JOIN g b ON b.path = e.dst""",
)
def q57(spark, d):
    project = rings(spark, d)
    layer = lambda c: F.when(F.col(c).startswith("th"), "domain").when(F.col(c).startswith("m"), "application").when(F.col(c).startswith("blog"), "shop")
    edges = graph.cut(J.resolved_edges(project))
    on_cycle = graph.cycle_edges(edges).withColumn("cycle", F.lit(True))
    nodes = graph.shown_nodes(project.files.withColumn("layer", layer("path")), edges, depth=5)
    marked = edges.join(on_cycle, ["src", "dst"], "left").withColumn("violation", (layer("src") == "domain") & (layer("dst") == "application"))
    return graph.dot_lines(nodes, marked, ("domain", "application", "shop"), "hosts")


#: Pages as files of four languages, each second one of a folder the test of the one before; hosts that don't begin with m or b as projects in projects.
_TREE = f"""{_PAGES}, t AS (
    SELECT string_split(path, '/')[1] AS host, coalesce(string_split(path, '/')[2], '') AS folder, page_id,
           row_number() OVER (PARTITION BY string_split(path, '/')[1], coalesce(string_split(path, '/')[2], '') ORDER BY page_id) AS n FROM f),
w AS (SELECT host, folder, page_id, 'p' || (n + 1) // 2 AS name, n % 2 = 0 AS test,
        CASE folder WHEN 'fr' THEN '.py' WHEN 'de' THEN '.go' WHEN 'en' THEN '.ts' ELSE '.rs' END AS ext FROM t),
k AS (SELECT page_id, host || '/' || CASE WHEN folder = 'fr' AND test THEN 'tests/' || CASE WHEN page_id % 3 = 0 THEN 'E2E/' ELSE '' END ELSE folder || '/' END
        || CASE WHEN test AND ext = '.py' THEN 'test_' ELSE '' END || name || CASE WHEN test AND ext = '.ts' THEN '.spec' WHEN test AND ext <> '.py' THEN '_test' ELSE '' END || ext AS path FROM w)"""


def tree(spark, d):
    p = pages(spark, d)
    part = lambda i: F.coalesce(F.get(F.split("path", "/"), F.lit(i)), F.lit(""))
    t = p.select("page_id", part(0).alias("host"), part(1).alias("folder"))
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("host", "folder").orderBy("page_id")))
    test, folder = F.col("n") % 2 == 0, F.col("folder")
    ext = F.when(folder == "fr", ".py").when(folder == "de", ".go").when(folder == "en", ".ts").otherwise(".rs")
    away = F.concat(F.lit("tests/"), F.when(F.col("page_id") % 3 == 0, "E2E/").otherwise(""))
    where = F.when((folder == "fr") & test, away).otherwise(F.concat(folder, F.lit("/")))
    end = F.when(test & (ext == ".ts"), ".spec").when(test & (ext != ".py"), "_test").otherwise("")
    path = F.concat("host", F.lit("/"), where, F.when(test & (ext == ".py"), "test_").otherwise(""), F.lit("p"), F.expr("(n + 1) div 2"), end, ext)
    return t.select("host", "folder", path.alias("path"))


_PACKAGE = '{"dependencies": {"react": "19"}, "devDependencies": {"x": "1"}}'


@register(
    "q55_nearest_manifest",
    f"""WITH {_TREE}, h AS (SELECT DISTINCT host FROM w WHERE NOT regexp_matches(host, '^[mb]')),
    a(root, language, manifest) AS (
        SELECT host, CASE WHEN contains(host, 'org') THEN 'typescript' ELSE 'javascript' END, host || '/package.json' FROM h
        UNION ALL SELECT DISTINCT host || '/fr', 'python', host || '/fr/requirements.txt' FROM w JOIN h USING (host) WHERE folder = 'fr'
        UNION ALL SELECT DISTINCT host || '/de', 'rust', host || '/de/Cargo.toml' FROM w WHERE folder = 'de'),
    e AS (SELECT path FROM k UNION SELECT manifest FROM a UNION SELECT host || '/tsconfig.json' FROM h WHERE contains(host, 'org') UNION SELECT root || '/setup.py' FROM a WHERE language = 'python'),
    j AS (SELECT e.path, max(length(a.root)) AS n FROM e JOIN a ON starts_with(e.path, a.root || '/') GROUP BY 1)
    SELECT e.path, a.root, a.language, a.manifest FROM e LEFT JOIN (j JOIN a ON a.root = left(j.path, j.n)) ON j.path = e.path""",
)
def q55(spark, d):
    t = tree(spark, d)
    h = t.where("not host rlike '^[mb]'").select("host", "folder").distinct()
    named = lambda rows, where, name, text=None: rows.select(F.concat(*where, F.lit(f"/{name}")).alias("path"), F.lit(text).alias("text"))
    french = h.where("folder = 'fr'")
    rows = t.select("path", F.lit(None).cast("string").alias("text"))
    for more in (
        named(h, ["host"], "package.json", _PACKAGE), named(h.where("contains(host, 'org')"), ["host"], "tsconfig.json"),
        named(french, ["host", F.lit("/fr")], "setup.py"), named(french, ["host", F.lit("/fr")], "requirements.txt"), named(t.where("folder = 'de'"), ["host", F.lit("/de")], "Cargo.toml"),
    ):
        rows = rows.union(more)
    return languages.nearest_manifest(S.files_from(rows.distinct(), F.col("path")))


@register(
    "q56_test_profile",
    f"""WITH {_TREE}, x AS (
        SELECT DISTINCT path, CASE regexp_extract(path, '[.][a-z]+$') WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.ts' THEN 'typescript' ELSE 'rust' END AS language,
               CASE WHEN regexp_matches(path, '(_test|[.]spec)[.]|/test_') THEN regexp_replace(regexp_replace(path, '(_test|[.]spec)[.]', '.'), '/test_', '/') END AS source FROM k),
    y AS (SELECT x.*, string_split(x.path, '/') AS parts, CASE WHEN source IN (SELECT path FROM x) THEN 'adjacent' WHEN contains(x.path, '/tests/') AND source IS NOT NULL THEN 'separate' END AS pattern,
               CASE WHEN source IS NOT NULL AND contains(x.path, '/E2E/') THEN regexp_extract(x.path, '^(.*/E2E)/', 1) END AS integration FROM x)
    SELECT language, count(*) AS files, count(source) AS tests, max_by(pattern, parts) FILTER (pattern IS NOT NULL) AS test_pattern,
           max(CASE WHEN pattern = 'separate' THEN 'tests' END) AS test_dir, max_by(integration, parts) FILTER (integration IS NOT NULL) AS integration_dir FROM y GROUP BY 1""",
)
def q56(spark, d):
    return languages.test_profile(S.files_from(tree(spark, d), F.col("path")))


#: Each brand as a settings file: a header for parts of some sizes, a string for each part, a list of three lines for some.
_SETTINGS = """c AS (SELECT p_brand || '.toml' AS path, string_agg(CASE WHEN p_size % 3 = 0 THEN '[ tool . size' || p_size || ' ]  # size' || chr(10) ELSE '' END
    || 'name' || p_partkey || ' = "' || p_name || ' # [' || p_type || '"  # a part' || chr(10)
    || CASE WHEN p_size % 5 = 0 THEN 'sizes.part' || p_partkey || ' = [' || chr(10) || '  ' || p_size || ', # ]' || chr(10) || ']' || chr(10) ELSE '' END, '' ORDER BY p_partkey) AS text FROM part GROUP BY p_brand)"""


def settings_files(spark, d):
    head = F.when(F.col("p_size") % 3 == 0, F.format_string("[ tool . size%d ]  # size\n", "p_size")).otherwise("")
    tail = F.when(F.col("p_size") % 5 == 0, F.format_string("sizes.part%d = [\n  %d, # ]\n]\n", "p_partkey", "p_size")).otherwise("")
    text = F.concat(head, F.format_string('name%d = "%s # [%s"  # a part\n', "p_partkey", "p_name", "p_type"), tail)
    files = read(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", text.alias("t")))).alias("t"))
    return files.select(F.concat("p_brand", F.lit(".toml")).alias("path"), F.array_join(F.transform("t", lambda x: x["t"]), "").alias("text"))


@register(
    "q58_settings_sections",
    rf"""WITH {_SETTINGS}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM c),
    h AS (SELECT *, 'tool.' || nullif(regexp_extract(line, '^\[ tool . (size[0-9]+) \]', 1), '') AS title FROM l),
    s AS (SELECT *, coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY path ORDER BY n), '') AS section FROM h)
    SELECT path, n::INT AS n, CASE WHEN title IS NULL THEN 'setting' ELSE 'section' END AS kind,
           CASE WHEN line NOT LIKE 'sizes.%' THEN section WHEN section = '' THEN 'sizes' ELSE section || '.sizes' END AS section,
           nullif(regexp_extract(line, '^(?:sizes[.])?([a-z]+[0-9]+) = ', 1), '') AS key,
           CASE WHEN line LIKE 'name%' THEN regexp_extract(line, '"([^"]*)"', 1) WHEN line LIKE 'sizes%' THEN '[' END AS value,
           CASE WHEN title IS NULL THEN line LIKE 'name%' END AS quoted FROM s WHERE title IS NOT NULL OR contains(line, ' = ')""",
)
def q58(spark, d):
    return settings.sections(settings_files(spark, d))


#: Documents as decisions (even ids) and specifications, with their whole texts after a header or a heading.
_DECISIONS = """f AS (SELECT doc_id % 2 = 0 AS decision, doc_id % 3 <> 0 AS dated, doc_id % 5 = 0 AS odd, lang,
    'docs/' || CASE WHEN doc_id % 2 = 0 THEN 'adr/adr-' ELSE 'Feature-' END || doc_id || '.md' AS path,
    CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'Status: ' || lang || chr(10) || CASE WHEN doc_id % 3 <> 0 THEN 'date: ' || doc_id || chr(10) ELSE '' END
            || CASE WHEN doc_id % 5 = 0 THEN 'only words' || chr(10) ELSE '' END || '---' || chr(10) || '## Considered Options' || chr(10) || text
        ELSE '## Success Criteria' || chr(10) || CASE WHEN lang = 'en' THEN 'SC-' || doc_id || chr(10) ELSE '' END || text END AS text FROM documents)"""
_WORDS = {"adr-required-headings": ["## Considered Options", "The ", " der "], "spec-required-headings": [" of ", "## Success Criteria", " und "]}


def _lacking(form: str, headings: list[str]) -> str:
    before, after = (x.replace("'", "''") for x in form.split("%s"))
    lacks = f"[h for h in [{', '.join(f"'{h}'" for h in headings)}] if NOT contains(text, h)]"
    return f"CASE WHEN len({lacks}) > 0 THEN '{before}' || array_to_string({lacks}, chr(10) || '  - ') || '{after}' END"


@register(
    "q59_specification_rule",
    f"""WITH {_DECISIONS}, m AS (
        SELECT path, {_lacking(documents.DECISION_LACKS, _WORDS["adr-required-headings"])} AS message FROM f WHERE decision
        UNION ALL SELECT path, '{documents.NO_HEADER.replace("'", "''")}' FROM f WHERE decision AND odd
        UNION ALL SELECT path, 'ADR must include a ''date'' field.' FROM f WHERE decision AND NOT odd AND NOT dated
        UNION ALL SELECT path, {_lacking(documents.SPEC_LACKS, _WORDS["spec-required-headings"])} FROM f WHERE NOT decision
        UNION ALL SELECT path, '{documents.SPEC_FORMS[2][2].replace("'", "''")}' FROM f WHERE NOT decision AND NOT contains(text, 'SC-')
        UNION ALL SELECT '.', '{documents.NO_SPEC_FOLDER % ", ".join(documents.SPEC_FOLDERS)}')
    SELECT 'spec-adr' AS rule, path, message FROM m WHERE message IS NOT NULL""",
)
def q59(spark, d):
    t, line = read(spark, d, "documents"), lambda *parts: F.concat(*parts, F.lit("\n"))
    even, ident = F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")
    dated = F.when(F.col("doc_id") % 3 != 0, line(F.lit("date: "), ident)).otherwise("")
    odd = F.when(F.col("doc_id") % 5 == 0, "only words\n").otherwise("")
    decision = F.concat(F.lit("---\n"), line(F.lit("Status: "), "lang"), dated, odd, F.lit("---\n## Considered Options\n"), "text")
    spec = F.concat(F.lit("## Success Criteria\n"), F.when(F.col("lang") == "en", line(F.lit("SC-"), ident)).otherwise(""), "text")
    path = F.concat(F.lit("docs/"), F.when(even, "adr/adr-").otherwise("Feature-"), ident, F.lit(".md"))
    files = t.select(path.alias("path"), F.when(even, decision).otherwise(spec).alias("text"))
    return documents.specifications_and_decisions(S.files_from(files, F.col("path")), _WORDS)


@register(
    "q60_linter_settings",
    """WITH s AS (SELECT 's' || s_suppkey || '/' AS root, s_suppkey AS k, s_acctbal > 1000 AS scanned FROM supplier), m AS (
        SELECT root || '.semgrep.yml' AS path, 'missing required config file: .semgrep.yml' AS message FROM s WHERE NOT scanned
        UNION ALL SELECT root || 'pyproject.toml', CASE WHEN k % 3 = 0 THEN 'Python project missing [tool.pyright] configuration' WHEN k % 3 = 1 THEN 'pyright typeCheckingMode should be "strict"' END FROM s WHERE k % 7 <> 0
        UNION ALL SELECT root || 'pyproject.toml', 'Python project missing [tool.ruff] configuration' FROM s WHERE k % 2 = 0 AND k % 7 <> 0
        UNION ALL SELECT root || 'pyproject.toml', 'could not parse pyproject.toml: line 1' FROM s WHERE k % 7 = 0
        UNION ALL SELECT root || 'tsconfig.json', CASE WHEN k % 11 = 0 THEN 'could not parse tsconfig.json' WHEN k % 5 <> 0 THEN 'TypeScript project should have strict mode enabled' END FROM s)
    SELECT 'linter-config' AS rule, path, message FROM m WHERE message IS NOT NULL""",
)
def q60(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select("*", F.concat(F.lit("s"), k.cast("string")).alias("root"))
    types = F.when(k % 3 == 1, '[tool.pyright]\ntypeCheckingMode = "basic"\n').when(k % 3 == 2, 'tool.pyright = { typeCheckingMode = "strict" }\n').otherwise("")
    python = F.concat(F.when(k % 7 == 0, "no setting\n").otherwise(""), types, F.when(k % 2 == 1, "[tool.ruff]\n").otherwise(""))
    script = F.concat(F.lit('{"compilerOptions": {"strict": '), (k % 5 == 0).cast("string"), F.when(k % 11 == 0, "").otherwise("}}"))
    named = lambda rows, name, text: rows.select(F.concat("root", F.lit(f"/{name}")).alias("path"), text.alias("text"))
    rows = named(s, "pyproject.toml", python).union(named(s, "tsconfig.json", script)).union(named(s.where("s_acctbal > 1000"), ".semgrep.yml", F.lit("")))
    deep = named(s, "deep/.semgrep.yml", F.lit(""))  # not at the root
    return documents.linter_settings(S.files_from(rows.union(deep), F.col("path")), s.select("root"))


def method_files(spark, d):
    """Each brand as a folder with a method for each part: branches in a loop for even sizes, as many cases as the size's rest by four."""
    even = F.when(F.col("p_size") % 2 == 0, F.format_string("      if i == %d { break } // if\n", "p_size")).otherwise("")
    cases = F.expr("array_join(transform(slice(array(1, 2, 3), 1, p_size % 4), k -> format_string('  case %d: return %d\n', k, k)), '')")
    body = F.format_string(
        "func (p *Part) F%d(n int) int {\n  if n > %d {\n    for i := range n {\n%s    }\n  } else {\n    go run(n)\n  }\n  switch n {\n%s  default: n++\n  }\n  f := func() { if n > 0 { n-- } }\n  f()\n  return n\n}\n",
        "p_partkey", "p_size", even, cases,
    )
    folder = F.expr("p_partkey div 40")
    files = read(spark, d, "part").groupBy("p_brand", folder.alias("k")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", body.alias("f")))).alias("f"))
    return files.select(F.format_string("%s/%d.go", "p_brand", "k").alias("path"), F.array_join(F.transform("f", lambda x: x["f"]), "type T struct { a int }\n").alias("text"))


@register(
    "q61_function_metrics",
    """WITH m AS (SELECT p_brand || '/' || p_partkey // 40 || '.go' AS path, '(p).F' || p_partkey AS name, p_size % 2 = 0 AS even, p_size % 4 AS k, p_size AS s FROM part),
    h AS (SELECT path, name, 6 + CASE WHEN even THEN 7 ELSE 0 END + k AS complexity, 11 + CASE WHEN even THEN 2 ELSE 0 END + CASE WHEN k > 0 THEN 1 ELSE 0 END AS n1,
            6 + k - CASE WHEN s <= k THEN 1 ELSE 0 END AS n2, 14 + CASE WHEN even THEN 3 ELSE 0 END + 2 * k AS big_n1, 14 + CASE WHEN even THEN 2 ELSE 0 END + 2 * k AS big_n2 FROM m)
    SELECT *, round((big_n1 + big_n2) * log2(n1 + n2), 6) AS volume, round(n1 / 2.0 * big_n2 / n2, 6) AS difficulty FROM h""",
)
def q61(spark, d):
    m = code_metrics.function_metrics(method_files(spark, d))
    return m.select("path", "name", "complexity", "n1", "n2", "big_n1", "big_n2", F.round("volume", 6).alias("volume"), F.round("difficulty", 6).alias("difficulty"))


#: Suppliers as files of six languages, by nation and key, each with two exported names, one that isn't, and two directives.
_SOURCES = """s AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS n, s_nationkey % 6 AS c, 'f' || s_suppkey || ['.ts', '.go', '.py', '.java', '.hpp', '.cs'][s_nationkey % 6 + 1] AS path, s_suppkey % 2 = 0 AS even FROM supplier)"""


def source_files(spark, d):
    k, c = F.col("s_suppkey"), F.col("s_nationkey") % 6
    texts = {
        ".ts": "// @sylva:ignore max-depth test-adjacency old\nimport a from './aN';\nexport class SN {}\nexport default function defN() {}\nfunction hidden() {}\nconst z = require('zN');\n",
        ".go": 'package p\n// @sylva:no-test one N\nimport (\n\t"fmt"\n\tx "lib/aN"\n)\nfunc SN() {}\ntype DefN struct{}\nfunc hidden() {}\n',
        ".py": "# @sylva:ignore\nimport os, aN.b\nfrom .zN import y\ndef SN(): pass\ndef _hidden(): pass\nclass DefN: pass\n",
        ".java": "package com.sN;\nimport com.sN.A;\nimport java.util.*;\npublic class SN {}\nclass Hidden {}\npublic interface DefN {}\n",
        ".hpp": '#include <map>\n#include "aN.h"\n/* class Hidden {};\n*/\nclass SN {};\nstruct DefN {};\n',
        ".cs": "using System;\nnamespace Own.N;\nusing Own.AN;\npublic class SN {}\ninternal class Hidden {}\npublic interface DefN {}\n",
    }
    text = F.array(*map(F.lit, texts.values()))[c]
    more = F.when((c == 2) & (k % 2 == 0), F.format_string("__all__ = ['S%d', 'only']\n", k)).otherwise("")  # replaces what the file defines
    return read(spark, d, "supplier").select(F.concat(F.format_string("f%d", k), F.array(*map(F.lit, texts))[c]).alias("path"), F.concat(F.regexp_replace(text, "N(?![A-Z])", k.cast("string")), more).alias("text"))


@register(
    "q62_exports",
    f"""WITH {_SOURCES}, e AS (
        SELECT path, n AS name, FALSE AS is_default, [3, 7, 4, 4, 5, 4][c + 1] AS line FROM s WHERE NOT (c = 2 AND even)
        UNION ALL SELECT path, CASE c WHEN 0 THEN 'def' ELSE 'Def' END || k, c = 0, [4, 8, 6, 6, 6, 6][c + 1] FROM s WHERE NOT (c = 2 AND even)
        UNION ALL SELECT path, unnest([n, 'only']), FALSE, 7 FROM s WHERE c = 2 AND even)
    SELECT path AS source_file, name, is_default, line::INT AS line FROM e""",
)
def q62(spark, d):
    return code.exports(source_files(spark, d))


@register(
    "q63_imports_of_languages",
    f"""WITH {_SOURCES}, i AS (
        SELECT path, CASE c WHEN 0 THEN './a' || k WHEN 1 THEN 'fmt' WHEN 2 THEN 'os' WHEN 3 THEN 'com.s' || k || '.A' WHEN 4 THEN 'map' ELSE 'System' END AS import_path, c IN (0, 3) AS is_relative, [2, 4, 2, 2, 1, 1][c + 1] AS line FROM s
        UNION ALL SELECT path, CASE c WHEN 0 THEN 'z' || k WHEN 1 THEN 'lib/a' || k WHEN 2 THEN '.z' || k WHEN 3 THEN 'java.util' WHEN 4 THEN 'a' || k || '.h' ELSE 'Own.A' || k END, c IN (2, 4, 5), [6, 5, 3, 3, 2, 3][c + 1] FROM s
        UNION ALL SELECT path, 'a' || k || '.b', FALSE, 2 FROM s WHERE c = 2)
    SELECT path AS source_file, import_path, is_relative, line::INT AS line FROM i""",
)
def q63(spark, d):
    return code.imports(source_files(spark, d))


@register(
    "q64_directives",
    f"""WITH {_SOURCES} SELECT path, CASE c WHEN 1 THEN 2 ELSE 1 END::INT AS line, CASE c WHEN 1 THEN 'no-test' ELSE 'ignore' END AS type,
        CASE c WHEN 0 THEN 'max-depth,test-adjacency' ELSE '' END AS rules, CASE c WHEN 0 THEN 'old' WHEN 1 THEN 'one ' || k ELSE '' END AS reason FROM s WHERE c < 3""",
)
def q64(spark, d):
    return code.directives(source_files(spark, d), "@sylva").withColumn("rules", F.array_join("rules", ","))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
