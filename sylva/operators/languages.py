"""Languages of a tree: by extension, by the nearest manifest above a file, and where a language's tests stand.

files: path, is_dir; for the reading of package.json also text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.paths import basename, extension, parent

#: Extensions of languages, marks of tests' names, manifests (the first of a directory counts), directories without projects.
EXTENSIONS = {
    ".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".java": "java", ".rs": "rust",
    ".rb": "ruby", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".cs": "csharp",
}
TEST_MARKS = {
    "go": ("_test",), "python": ("test_", "_test"), "typescript": (".test", ".spec"), "javascript": (".test", ".spec"), "java": ("Test", "IT"),
    "rust": ("_test",), "ruby": ("_spec",), "cpp": ("test_", "_test"), "c": ("test_", "_test"), "csharp": ("Test", "Tests", ".test"),
}
MANIFESTS = {
    "go.mod": "go", "pyproject.toml": "python", "setup.py": "python", "requirements.txt": "python", "package.json": "javascript", "tsconfig.json": "typescript",
    "Cargo.toml": "rust", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java", "Gemfile": "ruby",
}
MANIFEST_ENDS = {".csproj": "csharp", ".sln": "csharp"}
SKIPPED = ("node_modules", ".git", "vendor", ".venv", "venv", "env", "__pycache__", "dist", "build", "target", "bin", "obj", ".next", ".nuxt", "coverage")
TEST_DIRS, INTEGRATION = ("tests", "test", "__tests__", "spec"), ("integration", "e2e", "functional")


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def file_language(path: Column) -> Column:
    return lookup(extension(path), EXTENSIONS)


def manifests(files: DataFrame) -> DataFrame:
    """root, language, manifest, react of each directory with a manifest; of several the first by name.

    A package.json is TypeScript's if it depends on typescript, or on react beside a tsconfig.json.
    """
    name = basename(F.col("path"))
    ends = F.coalesce(*[F.when(name.endswith(e), F.lit(x)) for e, x in MANIFEST_ENDS.items()])
    known = files.where("not is_dir").withColumn("language", F.coalesce(lookup(name, MANIFESTS), ends)).where("language is not null")
    known = known.where(~F.exists(F.split(parent(F.col("path")), "/"), lambda p: p.isin(*SKIPPED)))
    text = F.col("text") if "text" in files.columns else F.lit(None).cast("string")
    depends = lambda kind: F.coalesce(F.from_json(F.get_json_object(text, f"$.{kind}"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    has = lambda kind, what: F.map_contains_key(depends(kind), what)
    own = (name == "package.json") & text.isNotNull()
    known = known.select(
        parent(F.col("path")).alias("root"), name.alias("name"), "language", F.col("path").alias("manifest"),
        (own & has("dependencies", "react")).alias("react"), (own & (has("dependencies", "typescript") | has("devDependencies", "typescript"))).alias("typed"),
    )
    rows = known.groupBy("root").agg(F.min_by(F.struct("language", "manifest", "react", "typed"), "name").alias("m"), F.bool_or(F.col("name") == "tsconfig.json").alias("config"))
    typed = F.col("m.typed") | (F.col("m.react") & F.col("config"))
    return rows.select("root", F.when(typed, "typescript").otherwise(F.col("m.language")).alias("language"), F.col("m.manifest").alias("manifest"), F.col("m.react").alias("react"))


def nearest_manifest(files: DataFrame) -> DataFrame:
    """path, root, language, manifest: the deepest directory above each file that has a manifest (null: none).

    A file's directories are exploded and joined with the manifests by equality; the deepest that is found is kept.
    """
    own = files.where("not is_dir").select("path").distinct()
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("root")))
    found = own.select("path", F.inline(up)).join(manifests(files), "root").groupBy("path").agg(F.max_by(F.struct("root", "language", "manifest"), "depth").alias("m"))
    return own.join(found, "path", "left").select("path", "m.root", "m.language", "m.manifest")


def test_profile(files: DataFrame) -> DataFrame:
    """language, files, tests, test_pattern, test_dir, integration_dir of each language, as its tests' names and places say.

    A test is adjacent if its directory has a file with its name without the mark, else separate if it lies in a directory
    of tests. The last test by path that is either decides the pattern and the last integration test its directory; the
    first separate one decides the directory of tests.
    """
    path = F.col("path")
    name, ext = basename(path), extension(path)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    rows = files.where("not is_dir").select("path").distinct().withColumn("language", file_language(path)).where("language is not null")
    rows = rows.withColumns({"dir": parent(path), "name": name, "stem": stem, "ext": ext, "parts": F.split(path, "/")})
    bare = lambda mark: F.ltrim(F.replace(F.replace("stem", F.lit(mark), F.lit("")), F.lit(".."), F.lit(".")), F.lit("."))
    case = F.lit(None).cast("string")
    for language, marks in reversed(TEST_MARKS.items()):
        for mark in reversed(marks):
            case = F.when((F.col("language") == language) & F.contains("stem", F.lit(mark)), F.concat(bare(mark), "ext")).otherwise(case)
    rows = rows.withColumn("source", case)
    sources = rows.select(F.col("dir").alias("_dir"), F.col("name").alias("_name")).distinct()
    rows = rows.join(sources, (F.col("dir") == F.col("_dir")) & (F.col("source") == F.col("_name")), "left")
    in_tests = F.get(F.filter("parts", lambda p: p.isin(*TEST_DIRS)), F.lit(0))
    pattern = F.when(F.col("source").isNull(), None).when(F.col("_name").isNotNull(), "adjacent").when(in_tests.isNotNull(), "separate")
    marked = lambda x: F.lower(x).rlike("|".join(INTEGRATION))
    first = F.array_position(F.transform("parts", marked), True)
    integration = F.when(F.col("source").isNotNull() & marked(path), F.array_join(F.slice("parts", F.lit(1), first.cast("int")), "/"))
    rows = rows.withColumns({"pattern": pattern, "test_dir": F.when(pattern == "separate", in_tests), "integration": integration})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("parts")))
    return rows.groupBy("language").agg(
        F.count("*").alias("files"), F.count("source").alias("tests"), last("pattern").alias("test_pattern"),
        F.min_by("test_dir", F.when(F.col("test_dir").isNotNull(), F.col("parts"))).alias("test_dir"), last("integration").alias("integration_dir"),
    )
