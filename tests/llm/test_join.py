"""op4's tree and its way with large groups, against brute force."""

import itertools
from collections import Counter

import numpy as np
import pytest

from sylva.llm import op04_ngram_join as op04

from .test_ops import brute_components


def joined(pairs, labels):
    parent = {x: x for x in labels.tolist()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(labels[a])] = find(labels[b])
    return {x: min(y for y in parent if find(y) == find(x)) for x in parent}


def test_tree_join_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(300):
        percent, m = int(rng.choice([60, 70, 85])), int(rng.integers(2, 30))
        base = rng.choice(60, 40, replace=False)
        sets = [np.array(sorted({*base[rng.random(40) < rng.choice([0.5, 0.95])].tolist(), *rng.integers(0, 80, rng.integers(1, 4)).tolist()})) for _ in range(m)]
        n, labels, none = np.array([len(s) for s in sets]), rng.integers(0, m, m), np.zeros(m, int)
        links = lambda i, j: 100 * len({*sets[i].tolist()} & {*sets[j].tolist()}) >= percent * len({*sets[i].tolist()} | {*sets[j].tolist()})
        want = {(i, j) for i, j in itertools.combinations(range(m), 2) if labels[i] != labels[j] and links(i, j)}
        got = op04.tree_join(sets, n, none, labels, percent, every=True)
        assert len(got) == len(want) and {tuple(sorted(x)) for x in got} == want
        assert joined(op04.tree_join(sets, n, none, labels, percent), labels) == joined(want, labels)
        rest = op04.rest_of(n, percent)
        heads = [s[: len(s) - r] for s, r in zip(sets, rest)]
        assert want <= {tuple(sorted(x)) for x in op04.tree_join(heads, n, rest, labels, percent, every=True)}


def test_classes_in_pairs_are_marked_without_listing_pairs():
    """What in_pairs marks are the ends of all pairs; its result has a row a set, not a pair."""
    rng = np.random.default_rng(6)
    for _ in range(100):
        m = int(rng.integers(2, 40))
        base = rng.choice(60, 40, replace=False)
        sets = [np.sort(base[rng.random(40) < rng.choice([0.6, 0.95])]) for _ in range(m)]
        n, labels = np.array([len(s) for s in sets]), rng.integers(0, m, m)
        rest = rng.integers(0, 5, m)
        want = {x for pair in op04.tree_join(sets, n, rest, labels, 85, every=True) for x in pair}
        assert op04.in_pairs(sets, n, rest, labels, 85) == sorted(want)


def copies(rng, n_base, n_copies, words, changes):
    rows = []
    for _ in range(n_base):
        base = [f"w{x}" for x in rng.integers(0, 5000, words)]
        for _ in range(n_copies):
            w = list(base)
            for j in rng.integers(0, words, rng.integers(0, changes)):
                w[j] = f"x{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(w[: words - int(rng.integers(0, 4))])))
    return rows


@pytest.mark.parametrize("limits, k, percent", [({}, 5, 80), ({"BLOCK": 3, "GROUP": 4, "SPLIT": 2, "HOT_MIN": 2}, 4, 85), ({"BLOCK": 5, "GROUP": 40, "HOT_ROWS": 4}, 5, 80)])
def test_large_groups_lose_no_link(spark, monkeypatch, limits, k, percent):
    for name, value in limits.items():
        monkeypatch.setattr(op04, name, value)
    rng = np.random.default_rng(3)
    rows = copies(rng, 1, 60, 60, 7) + [(1000 + i, t) for i, t in copies(rng, 5, 8, 40, 6)] + [(5000, "a b"), (5001, "A  b"), (5002, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = op04.jaccard_join(df, k, percent).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components([(i, t or "") for i, t in rows], k, percent))
