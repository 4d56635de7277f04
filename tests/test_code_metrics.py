"""Complexity and Halstead counts of functions, counted by hand."""

from sylva.operators import code_metrics
from sylva.operators.code_metrics import file_metrics, function_metrics


def measured(spark, body, head="func f(n int) int"):
    text = f"package p\n\ntype T struct {{\n\tif_ int\n}}\n\n{head} {{\n{body}\n}}\n\nvar after = map[string]int{{\"a\": 1}}\n"
    rows = function_metrics(spark.createDataFrame([("x.go", text)], "path string, text string")).collect()
    assert len(rows) == 1
    return rows[0]


def cost(spark, body):
    return measured(spark, body).complexity


def test_complexity(spark):
    assert cost(spark, "return n") == 0
    assert cost(spark, "if n > 0 {\n return 1\n}\nreturn 0") == 1
    assert cost(spark, "if a {\n x()\n} else if b {\n y()\n} else {\n if c { z() }\n}") == 1 + 1 + 2
    assert cost(spark, "for i := 0; i < n; i++ {\n for _, x := range xs {\n  if x { continue }\n }\n}") == 1 + 2 + 3 + 4
    assert cost(spark, "switch n {\ncase 1, 2:\n if a { b() }\ncase 3:\ndefault:\n go run()\n}") == 1 + 1 + 2 + 1 + 2
    assert cost(spark, "select {\ncase <-c:\n return 1\ndefault:\n}\nswitch x := y.(type) {\ncase int:\n}") == 1 + 1 + 1 + 1
    assert cost(spark, "g := func(a int) (int, error) {\n if a > 0 { return 1, nil }\n return 0, nil\n}\ndefer func() { for { } }()\nif g { }") == 1
    assert cost(spark, "x := T{if_: 1}\ny := []struct{ a int }{{1}, {2}}\nif x.if_ == len(y) {\n z := map[string]T{\"}\": {2}}\n if z { }\n}") == 1 + 2
    assert cost(spark, "{\n { if a { } }\n}\ns := \"if {\" // if {\n/* for { */") == 1


def counts(spark, body):
    r = measured(spark, body)
    return r.n1, r.n2, r.big_n1, r.big_n2


def test_halstead(spark):
    assert counts(spark, "return n") == (1, 1, 1, 1)
    assert counts(spark, "x := n + 1\nx = x * n\nreturn x") == (5, 3, 5, 7)
    assert counts(spark, "for i := range xs { f(i, xs[i], xs[1:i]) }") == (4, 4, 4, 9)
    assert counts(spark, "for i := 0; i < 3; i++ { }") == (4, 3, 4, 5)
    assert counts(spark, "var c = make(chan int)\nvar d <-chan int\nc <- 1\nx := <-d\nvar p *int = &x") == (5, 5, 6, 8)
    assert counts(spark, "switch t := v.(type) {\ncase []byte:\ndefault:\n a[t][1] = *t\n}") == (8, 4, 9, 6)
    assert counts(spark, "m := map[string][]int{\"a\": {1}}\nreturn len(m) > 0 && !ok") == (6, 5, 6, 6)
    r = measured(spark, "return n")
    assert (r.volume, r.difficulty, r.effort) == (2.0, 0.5, 1.0)


def test_names_and_edges(spark):
    text = """package p
import ("fmt")
func plain() { a() }
func (r *T[K]) Method(x interface{ M() }) (int, error) {
	if x { b() }
}
func (T) unnamed() struct{ a int } { c() }
func generic[K any](k K) { d() }
var literal = func() { if e { } }
type F func(int) error
var table = []func(){
	func() { if e { } },
}
func empty() {}
func outside()
type S struct { f func() }
func last() { for { } }"""
    table = spark.createDataFrame([("a.go", text), ("b.go", "func f() { if a { } }"), ("null.go", None), ("empty.go", ""), ("broken.go", "}}}} func f( {{{ if")], "path string, text string")
    rows = function_metrics(table.where("path <> 'broken.go'")).collect()
    got = {(r.path, r.name): (r.line, r.complexity) for r in rows}
    assert got == {
        ("a.go", "plain"): (3, 0), ("a.go", "(r).Method"): (4, 1), ("a.go", "unnamed"): (7, 0), ("a.go", "generic"): (8, 0), ("a.go", "last"): (17, 1), ("b.go", "f"): (1, 1),
    }
    function_metrics(table).count()
    total = {r.path: (r.total, r.functions, r.most) for r in file_metrics(function_metrics(table.where("path <> 'broken.go'"))).collect()}
    assert total == {"a.go": (2, 5, 1), "b.go": (1, 1, 1)}
    assert function_metrics(table.limit(0)).count() == 0


def test_parts_grow_with_tokens(spark, monkeypatch):
    """Files are dealt as arrays, once, into parts of some tokens each; the windows need no exchange of their own."""
    text = "func f(n int) int {\n if n > 0 { return 1 }\n return 0\n}\n"
    files = spark.createDataFrame([(f"{i}.go", text) for i in range(40)], "path string, text string")
    want = sorted(tuple(r) for r in function_metrics(files).collect())
    monkeypatch.setattr(code_metrics, "TOKENS_A_TASK", 20)
    assert code_metrics.dealt(files).rdd.getNumPartitions() > 30
    found = function_metrics(files)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert len(want) == 40 and sorted(tuple(r) for r in found.collect()) == want
