"""What a DOT export shows, and its lines."""

from sylva.operators import graph


def test_shown_nodes(spark):
    files = spark.createDataFrame([("a", "x", 0), ("b", "x", 1), ("c", "y", 1), ("d", "x", 2), ("e", None, 0)], "path string, layer string, refs bigint")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")], "src string, dst string")
    shown = lambda **kw: {r.path for r in graph.shown_nodes(files, edges, **kw).collect()}
    assert shown() == set("abcde") and shown(layer="x") == set("abd") and shown(depth=1) == set("abe") and shown(depth=2) == set("abce")
    assert shown(layer="x", depth=3) == set("abd")  # over c
    assert shown(layer="y", depth=2) == {"c"}  # no root: the first one
    assert shown(layer="none", depth=2) == set()


def test_dot_lines(spark):
    nodes = spark.createDataFrame([("src/app/main.go", "cmd"), ("b.go", None), ("c.go", "own")], "path string, layer string")
    edges = spark.createDataFrame([("b.go", "c.go", True, True), ("c.go", "b.go", False, True), ("b.go", "gone.go", False, False), ("src/app/main.go", "b.go", None, None)], "src string, dst string, cycle boolean, violation boolean")
    lines = [r.line for r in graph.dot_lines(nodes, edges, ("cmd", "own"), "t").collect()]
    assert lines[0] == 'digraph "t" {' and lines[-1] == "}" and lines[-2] == "  }" and len(lines) == 4 + 3 + 3 + 8 + 1
    assert sum('color="orange"' in x for x in lines) == 1 and sum('color="red"' in x for x in lines) == 1 and sum("penwidth=1.0" in x for x in lines) == 1
    (main,) = [x for x in lines if 'label="app/main.go"' in x]
    assert 'color="#424242", fillcolor="#E0E0E0"' in main and any('color="gray", fillcolor="#F5F5F5"' in x for x in lines)
    assert [r.line for r in graph.dot_lines(nodes.limit(0), edges).collect()][-2:] == ["  // No nodes to display", "}"]
    assert not any("legend" in r.line for r in graph.dot_lines(nodes, edges).collect())
