"""The cheap tests before op8's transducers hold for every text in which the transducer finds something."""

import random

import pytest

from sylva.llm import op08_pii

CASES = [
    ("ip", "one zero dot zero dot zero dot five"),
    ("ip", "eight dot eight dot eight dot eight"),
    ("ip", "x:one zero dot zero dot zero dot five"),
    ("phone", "4 four 1 five 5 five 5 one 2 three"),
    ("phone", "'four' 1 'five' 555 four one five two six seven one five five five"),
    ("phone", "+four one five five five five two six"),
    ("email", "john\n@\nexample . com"),
]


@pytest.mark.parametrize("kind, text", CASES)
def test_gates_let_through(kind, text):
    assert kind in [k for k, _, _ in op08_pii.find_pii(text)[1]]


def test_gate_is_implied_by_the_pattern():
    draw, words = random.Random(6), [*op08_pii.DIGIT_WORDS, "dot", "plus", "punkt", "4", "17", "go", "+", "'", ":"]
    hits = 0
    for _ in range(20_000):
        few = draw.sample(words, draw.randint(1, 6))
        text = "".join(draw.choice(few) + draw.choice([" ", " ", " ", ", ", ".", "-", "\n", " (", "", "'"]) for _ in range(draw.randint(4, 20)))
        found = op08_pii.spelled(text)
        hits += bool(found)
        assert not found or op08_pii._may_be_spelled(text)
    assert hits > 100


def test_long_zeros_and_long_names_are_linear():
    """Long zeros are a number like any other; a name is tried once, whatever its host ends in."""
    import time

    from sylva.llm.op08_pii import find_pii

    base, every = find_pii("0" * 50_000 + ".1.1.1")
    assert base == [("ip", 0, 50_006)] == every
    assert find_pii("0" * 50_000 + "256.1.1.1")[0] == []
    for text in ("a" * 1_000_000 + " (at) x (dot) 1", "._" * 500_000 + " (at) x (dot) 1", "a." * 400_000 + " (at) " + "x." * 400_000 + "1", ("a" * 1000 + " (at) x (dot) 1 ") * 900):
        began = time.time()
        assert find_pii(text)[1] == []
        assert time.time() - began < 20
