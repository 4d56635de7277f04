"""op8's transducers: offsets, composition, random disguises, linear time."""

import random
import time

import pytest

from sylva.llm import op08_pii as op08

FOUND = [
    ("john at example dot shop", "email", "john at example dot shop"),
    ("x (at) a.b.c.d.e.f.g.h (dot) com", "email", "x (at) a.b.c.d.e.f.g.h (dot) com"),
    ("jane at mail dot one two three dot com", "email", "jane at mail dot one two three dot com"),
    ("call +1 (4l5) 555-O671 now", "phone", "+1 (4l5) 555-O671"),
    ("ask a.b.c.d.e.f.g dot h at example dot com, please", "email", "a.b.c.d.e.f.g dot h at example dot com"),
    ("host 10 [dot] 0 (dot) 0 dot 1 is up", "ip", "10 [dot] 0 (dot) 0 dot 1"),
    ("j.doe42 at host.tld", "email", "j.doe42 at host.tld"),
    ("john @ example . com", "email", "john @ example . com"),
    ("mаry (аt) example dot org", "email", "mаry (аt) example dot org"),
]


@pytest.mark.parametrize("text, kind, span", FOUND)
def test_found(text, kind, span):
    assert [(k, text[s:e]) for k, s, e in op08.find_pii(text)[1]] == [(kind, span)]


@pytest.mark.parametrize("text", ["we met at ten dot matrix printers", "look at this. Then go", "see fig. one, two and three", "at last dot by dot he drew", "it was 5 o'clock, l0ve", "one. two. three. four. five"])
def test_prose_is_left_alone(text):
    assert op08.find_pii(text)[1] == []


def test_random_disguises_are_mapped_back():
    """Identifiers disguised at random, in prose: each is found at its own place, nothing else is."""
    draw = random.Random(4)
    at, dot = [" (at) ", "[at]", " @ ", "{at}", " (@) ", " at "], [" (dot) ", "[dot]", " dot ", "."]
    digit = {str(i): w for i, w in enumerate("zero one two three four five six seven eight nine".split())}
    filler = "lorem ipsum dolor sit amet consetetur sadipscing elitr".split()
    for _ in range(400):
        say = lambda: " ".join(draw.choice(filler) for _ in range(draw.randint(1, 12)))
        kind = draw.choice(["email", "phone", "ip"])
        if kind == "email":
            mark = draw.choice(at)
            marks = dot[:3] if mark == " at " else dot
            x = draw.choice(["kim", "kim_7", "a.b"]) + mark + "".join(draw.choice(["mail", "x-1", "ab"]) + draw.choice(marks) for _ in range(draw.randint(1, 9))) + draw.choice(["com", "org", "de"])
        elif kind == "phone":
            x = " ".join(["plus", *(digit[c] for c in str(draw.randint(10**9, 10**11)))])
        else:
            x = " dot ".join(" ".join(digit[c] for c in str(draw.randint(0, 255))) for _ in range(4))
        before = say() + ": "
        text = before + x + ", " + say()
        wide = draw.random() < 0.3
        if wide:
            text = text.replace("a", "а")  # Cyrillic
        spans = op08.find_pii(text)[1]
        assert [k for k, _, _ in spans] == [kind], (text, spans)
        assert spans[0][1:] == (len(before), len(before) + len(x)), (text, spans)


@pytest.mark.parametrize("text", ["a" * 1_000_000 + " x (dot) y", "a." * 500_000 + "@", "one " * 250_000, "x at " * 200_000 + "y dot com", "a (at) " * 140_000, "1 2 3 one " * 100_000, "dot " * 250_000 + "(at)", "9l" * 500_000, "a dot " * 160_000 + "com (at)", "kim at " + "a." * 400_000])
def test_long_texts_take_seconds(text):
    began = time.time()
    op08.find_pii(text)
    assert time.time() - began < 20
