"""Strongly connected components by contraction, and witness cycles, against plain walks."""

import glob
import random

import pytest

from sylva.operators import graph


def plain(edges):
    """Node to the smallest node that it reaches and is reached from."""
    out, nodes = {}, sorted({x for e in edges for x in e})
    for s, d in edges:
        out.setdefault(s, set()).add(d)
    reach = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        reach[n] = seen
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def shortest(edges, root):
    """The first of the shortest cycles through root."""
    out = {}
    for s, d in edges:
        out.setdefault(s, set()).add(d)
    ways, seen = [(root,)], {root}
    while ways:
        closed = [w for w in ways if root in out.get(w[-1], ())]
        if closed:
            return list(min(closed))
        new = {}
        for w in sorted(ways):
            for m in out.get(w[-1], ()):
                if m not in seen:
                    new.setdefault(m, (*w, m))
        seen |= set(new)
        ways = list(new.values())
    return None


def table(spark, edges, kind="bigint"):
    return spark.createDataFrame(edges, f"src {kind}, dst {kind}")


def check(spark, edges, kind="bigint"):
    assert {r.node: r.component for r in graph.strongly_connected(table(spark, edges, kind)).collect()} == plain(edges)


@pytest.mark.parametrize("seed", [1])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 120
    check(spark, [(rng.randrange(n), min(n - 1, rng.randrange(n) if rng.random() < 0.3 else rng.randrange(n) // 2 + 20)) for _ in range(150 + 40 * seed)])


def test_chain_ring_and_chain_of_components(spark, monkeypatch):
    """A chain and a ring of 1,000 nodes end in one round each, a line of small rings in a few."""
    turns = []
    pointed = graph.pointed
    monkeypatch.setattr(graph, "pointed", lambda e, turn: turns.append(turn) or pointed(e, turn))
    chain = [(i, i + 1) for i in range(1000)]
    check_only = {r.component == r.node for r in graph.strongly_connected(table(spark, chain)).collect()}
    assert check_only == {True} and len(turns) == 1
    ring = [((7 * i) % 1000, (7 * i + 7) % 1000) for i in range(1000)]
    turns.clear()
    assert {r.component for r in graph.strongly_connected(table(spark, ring)).collect()} == {0} and len(turns) == 1
    line = [e for i in range(0, 30, 2) for e in ((i, i + 1), (i + 1, i), (i + 1, i + 2))]
    turns.clear()
    check(spark, line)
    assert len(turns) <= 12


def test_acyclic_files(spark):
    """10,000 files with three imports each, of files that come later."""
    rng = random.Random(5)
    edges = [(i, rng.randrange(i + 1, 10_001)) for i in range(10_000) for _ in range(3)]
    assert graph.strongly_connected(table(spark, edges)).where("node != component").count() == 0


def test_one_large_component_and_tables(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(1500)] + [(400, 400), (None, 3), (3, None)]
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir', '/nowhere')}/sylva/graph-*"))
    got = {r.node: r.component for r in graph.strongly_connected(table(spark, edges)).collect()}
    assert got == plain([e for e in edges if None not in e])
    left = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir', '/nowhere')}/sylva/graph-*")) - before
    assert len(left) <= 1
    assert graph.strongly_connected(table(spark, edges[:0])).count() == 0


def test_witness_cycles(spark):
    edges = [("b", "a"), ("a", "b"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "d"), ("f", "f"), ("a", "c"), ("x", "y"), ("c", "e")]
    got = {r.component: (r.length, r.cycle) for r in graph.witness_cycles(table(spark, edges, "string")).collect()}
    assert got == {"a": (2, ["a", "b"]), "c": (2, ["c", "e"]), "f": (1, ["f"])}
    rng = random.Random(8)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(190)] + [(200 + i, 200 + (i + 1) % 17) for i in range(17)]
    label = plain(edges)
    want = {c: shortest([e for e in edges if label[e[0]] == label[e[1]] == c], c) for c in set(label.values())}
    got = {r.component: r.cycle for r in graph.witness_cycles(table(spark, edges)).collect()}
    assert got == {c: w for c, w in want.items() if w}
    assert graph.witness_cycles(table(spark, [(1, 2), (2, 3)])).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 21])
def test_chains_and_kernel(spark, monkeypatch, most):
    """A web of long chains ends after one round of chains, with smallest nodes inside chains; a larger kernel takes labels."""
    calls = []
    chained = graph.chained
    monkeypatch.setattr(graph, "KERNEL_EDGES", most)
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    monkeypatch.setattr(graph, "chained", lambda e: calls.append(1) or chained(e))
    rng = random.Random(9)
    edges, new = [], 1000
    for _ in range(60 if most else 6):  # chains between 25 nodes, whose names are greater than those of the chains
        a, b = 5000 + rng.randrange(25), 5000 + rng.randrange(25)
        inner = rng.sample(range(new, new + 40), rng.randrange(1, 40))
        new += 40
        edges += zip([a, *inner], [*inner, b])
    edges += [(9000 + i, 9000 + (i + 1) % 50) for i in range(50)] + [(9000, 5003), (9010, 9011), (4000, 9000), (5001, 4001)]
    check(spark, edges)
    assert most == 0 or len(calls) <= 1


def test_few_tables_for_few_edges(spark, monkeypatch):
    """A line of rings below KERNEL_EDGES takes a fixed number of tables, a ring of 300 nodes no round a node."""
    tables = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: tables.append(1) or cut(df))
    web = [e for i in range(0, 200, 2) for e in ((i, i + 1), (i + 1, i), (i + 1, i + 2))] + [(1000 + i, 1000 + (i + 1) % 300) for i in range(300)]
    label = plain(web)
    want = {c: shortest([e for e in web if label[e[0]] == label[e[1]] == c], c) for c in (0, 1000)}
    got = {r.component: r.cycle for r in graph.witness_cycles(table(spark, web)).collect()}
    assert len(got) == 101 and {c: got[c] for c in want} == want
    assert len(tables) <= 24


def test_large_components_are_walked_in_rounds(spark, monkeypatch):
    rng = random.Random(11)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)] + [(f"é{i}", f"é{(i + 1) % 5}") for i in range(5)] + [("z", "z")]
    found = {r.component: (r.length, r.cycle) for r in graph.witness_cycles(table(spark, edges, "string")).collect()}
    monkeypatch.setattr(graph, "KERNEL_EDGES", 4)
    assert {r.component: (r.length, r.cycle) for r in graph.witness_cycles(table(spark, edges, "string")).collect()} == found


def test_few_edges_go_to_the_kernel_as_they_are(spark, monkeypatch):
    """Parts that have cycles take no rounds where one task may have all edges, whatever their form; then the same by rounds."""
    from sylva.operators import project

    rng = random.Random(3)
    names = [f"f{i}.ts" for i in range(60)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(70)} | {(names[0], names[0])})
    rows = table(spark, edges, "string")
    assert {r.node: r.component for r in graph.components(rows).collect()} == plain(edges)
    rounds = []
    whole = graph.strongly_connected
    monkeypatch.setattr(graph, "strongly_connected", lambda e: rounds.append(1) or whole(e))
    files = spark.createDataFrame([(n,) for n in names], "path string")
    want = {c for c in plain(edges).values() if any(plain(edges)[s] == plain(edges)[d] == c for s, d in edges)}
    graph_of = project.Project(files, rows.selectExpr("src", "dst", "dst AS written"))
    found = project.import_cycles(graph_of)
    assert {r.path for r in found.collect()} == want and not rounds
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    assert {r.path for r in project.import_cycles(graph_of).collect()} == want and rounds
    assert graph.components(rows.limit(0)).count() == 0
