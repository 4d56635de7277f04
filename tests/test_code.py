"""Imports and exports by language: strings that look like comments, lists, aliases."""

from sylva.sources import code


def test_imports_and_exports(spark):
    texts = {
        "a.py": 'P = "src/*"\nimport os, a.b as c\nfrom . import x\nfrom ..pkg.mod import y\n__all__ = ["f", \'g\']\ndef h(): pass\ndef _own(): pass',
        "b.ts": 'const g = "**/*.ts"\nimport x from "./x"\nexport { p, q as r }\nexport default () => 1\nexport class K {}',
        "C.java": "package com.me;\nimport com.me.util.*;\nimport static java.util.List;",
        "d.cs": "using A = B.C;\nusing static System.Math;\npublic delegate void Done(int x);",
        "e.h": 'const char* p = "/*";\n#include "own.h"\n/* class Hidden {\n class Also { */\nclass Shown {',
    }
    t = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {(r.source_file, r.import_path, r.is_relative) for r in code.imports(t).collect()}
    assert got == {("a.py", "os", False), ("a.py", "a.b", False), ("a.py", ".", True), ("a.py", "..pkg.mod", True), ("b.ts", "./x", True), ("C.java", "com.me.util", True), ("C.java", "java.util.List", False), ("d.cs", "B.C", False), ("d.cs", "System.Math", False), ("e.h", "own.h", True)}
    names = {(r.source_file, r.name) for r in code.exports(t).collect()}
    assert {("a.py", "f"), ("a.py", "g"), ("b.ts", "p"), ("b.ts", "r"), ("b.ts", "default"), ("b.ts", "K"), ("d.cs", "Done"), ("e.h", "Shown")} <= names
    assert not names & {("a.py", "_own"), ("a.py", "h"), ("b.ts", "q"), ("e.h", "Also")}


def test_lists_of_names_replace_definitions(spark):
    texts = {"all.py": "def b(): pass\n__all__ = ['a', '_c']\nclass D: pass", "defs.py": "def b(): pass\ndef _c(): pass\nasync def d(): pass", "a.go": 'import (\n  "fmt"\n  x "a/b" // b\n)\nfunc (t *T) Do() {}\nfunc own() {}\ntype K struct{}', "x.h": '/* old\n#include "gone.h"\nclass Gone {\n*/\nstruct Here {'}
    t = spark.createDataFrame(list(texts.items()), "path string, text string")
    names = {}
    for r in code.exports(t).collect():
        names.setdefault(r.source_file, set()).add(r.name)
    assert names == {"all.py": {"a", "_c"}, "defs.py": {"b", "d"}, "a.go": {"Do", "K"}, "x.h": {"Here"}}
    assert {(r.source_file, r.import_path) for r in code.imports(t).collect()} == {("a.go", "fmt"), ("a.go", "a/b"), ("x.h", "gone.h")}
