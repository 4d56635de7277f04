"""op6's units grow with the vocabulary, and both levels are normalised."""

import numpy as np

from sylva.llm import op06_lm


def trained(n, tokens=40_000):
    rng = np.random.default_rng(n)
    mass = 1 / np.arange(1, n + 1)
    model = op06_lm.LogBilinear(np.log(mass / mass.sum()))
    unit = rng.choice(n, tokens, p=mass / mass.sum()).astype(np.int32)
    unit[1::2] = (unit[::2] * 7 + 1) % n
    one, two = op06_lm.contexts(unit, np.zeros(tokens, int), n)
    return model, one, two, unit


def test_units_grow_with_the_vocabulary():
    sizes = [op06_lm.number_of_units(v) for v in (10, 10_000, 1_000_000, 100_000_000)]
    assert sizes == [512, 1000, 10_000, 100_000]
    for n in sizes[:3]:
        model = op06_lm.LogBilinear(np.log(1 / np.arange(1, n + 1)))
        assert np.diff(model.starts).max() <= 2 * n**0.5 + 2 and len(model.starts) <= 2 * n**0.5 + 3


def test_tokens_are_normalised_at_both_levels():
    model, one, two, unit = trained(1600)
    model.train(one, two, unit, np.random.default_rng(1), 0.1)
    every = np.arange(1600, dtype=np.int32)
    for a, b in ((3, 7), (1600, 1600), (1500, 2)):
        assert abs(np.exp(model.log_probs(np.full(1600, a), np.full(1600, b), every)).sum() - 1) < 1e-4


def test_words_past_the_old_512_units_are_learnt_from_context():
    model, one, two, unit = trained(1600, 400_000)
    before = model.log_probs(one, two, unit)
    for _ in range(4):
        model.train(one, two, unit, np.random.default_rng(1), 0.1)
    rare = (unit > 512) & (np.arange(len(unit)) % 2 == 1)
    assert (model.log_probs(one, two, unit) - before)[rare].mean() > 0.5


def test_a_larger_vocabulary_gives_more_units_to_a_corpus(spark, monkeypatch):
    made = []
    plain = op06_lm.train_model
    monkeypatch.setattr(op06_lm, "train_model", lambda t, units, u, n: made.append(len(u)) or plain(t, units, u, n))
    rows = [(i, " ".join(f"w{(i * 31 + j * 7) % 4000}" for j in range(200))) for i in range(200)]
    got = op06_lm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas()
    assert np.isfinite(got["score"]).all() and made and made[0] > op06_lm.UNITS


def test_scores_do_not_depend_on_partitions_and_beat_the_base(spark, monkeypatch):
    monkeypatch.setattr(op06_lm, "LEAST_BUCKET", 50_000)  # several buckets a round
    monkeypatch.setattr(op06_lm, "PER_UNIT", 1)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{'abcd'[(i + j) % 4]}{rng.integers(0, 3)}" for j in range(800))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [op06_lm.score(df.repartition(n)).toPandas().sort_values("doc_id") for n in (1, 7)]
    for other in found[1:]:
        assert np.allclose(found[0]["score"], other["score"], rtol=1e-6, atol=0)
    held = found[0][found[0]["held_out"]]
    ratio = held["score"].sum() / held["base_score"].sum()
    assert ratio < 0.55  # the letter is certain, its figure isn't: at best 0.44


def test_moves_are_the_mean_of_those_that_moved_a_row():
    model = op06_lm.LogBilinear(np.log(1 / np.arange(1, 601)))
    start = model.flat()
    model.r[3] += 1
    a = model.moved(start)
    model.r[3] += 2
    model.r[5] -= 1
    b = model.moved(start)
    model.load(start)
    model.move(a[0] + b[0], a[1] + b[1])
    want = start.copy()
    want[3 * 16 : 4 * 16] += 2
    want[5 * 16 : 6 * 16] -= 1
    assert np.allclose(model.flat(), want, atol=1e-5)


def test_kernels_equal_plain_sums_for_small_and_large_scores(monkeypatch):
    """Scores are the same whether normalisers need the largest score or not, and whatever the slices; terms of noise are -sigma."""
    rng = np.random.default_rng(2)
    n = 40
    model = op06_lm.LogBilinear(np.log(rng.dirichlet(np.ones(n))))
    unit = rng.integers(0, n, 300).astype(np.int32)
    one, two = op06_lm.contexts(unit, np.sort(rng.integers(0, 9, 300)), n)
    model.train(one, two, unit, rng)
    for scale in (1, 200):
        model.q, model.qc = model.q * np.float32(scale), model.qc * np.float32(scale)
        h = (model.r[one] * model.c[0] + model.r[two] * model.c[1]).astype(float)
        full = lambda s: s - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1, keepdims=True)) - s.max(1, keepdims=True)
        of_class, want = full(h @ model.qc.T + model.bc), []
        for i, p in enumerate(model.place[unit]):
            k = model.class_of[p]
            a, b = model.starts[k], model.starts[k + 1]
            want.append(of_class[i, k] + full(h[i : i + 1] @ model.q[a:b].T + model.b[a:b])[0, p - a])
        for safe, part, many in ((60.0, 1 << 12, 1 << 16), (-1.0, 7, 50)):
            for name, x in (("SAFE", safe), ("PART", part), ("SLICE", many)):
                monkeypatch.setattr(op06_lm, name, x)
            assert np.allclose(model.log_probs(one, two, unit), want, rtol=1e-4, atol=1e-3)
    s = rng.normal(0, 40, 50).astype(np.float32)
    assert np.allclose(op06_lm.noise_terms(s.copy()), -1 / (1 + np.exp(-np.clip(s, -30, 30))), rtol=1e-6)
    index, rows = rng.integers(0, 9, 100), rng.normal(size=(100, 3))
    at, got = op06_lm.sums(index + (1 << 17), rows)
    assert (at == np.unique(index) + (1 << 17)).all() and np.allclose(got, [rows[index == i].sum(0) for i in np.unique(index)])
