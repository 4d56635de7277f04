"""License scans against containment at every place, by plain sets."""

import random
import re

import pytest

from sylva.llm import op05_licenses as op

PASSAGES = [(name, t) for name, texts in op.TEMPLATES.items() for t in texts]


def shingles(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return [tuple(w[i : i + op.SHINGLE]) for i in range(len(w) - op.SHINGLE + 1)]


def contained(template, text):
    """The largest share of the template's shingles in any stretch of the text as long as the template and a quarter more."""
    own, g = shingles(template), shingles(text)
    reach, wanted = len(own) + max(1, len(own) // 4), set(own)
    return max((len(wanted & set(g[i : i + reach])) for i in range(len(g))), default=0) / len(wanted)


@pytest.mark.parametrize("name,template", PASSAGES, ids=[f"{n}-{i}" for i, (n, _) in enumerate(PASSAGES)])
def test_recall_and_precision_against_every_place(name, template):
    rng = random.Random(name)
    matcher = op.Matcher({name: (template,)})
    filler = [f"w{i}" for i in range(300)]
    words, rows = template.split(), []
    for i in range(40):
        passage = list(words)
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            passage[rng.randrange(len(passage))] = rng.choice(filler)
        if i % 3 == 0:
            passage = passage[rng.randint(0, len(passage) // 3) :]
        if i % 5 == 0:
            passage.insert(rng.randrange(len(passage)), rng.choice(filler))
        rows.append(" ".join(rng.choices(filler, k=rng.randint(0, 80)) + passage + rng.choices(filler, k=rng.randint(0, 80))))
    share = [contained(template, x) for x in rows]
    found = [bool(x) for x in matcher.scan([x.encode() for x in rows])]
    assert not any(f and s < op.THRESHOLD for f, s in zip(found, share))
    should = [f for f, s in zip(found, share) if s >= op.THRESHOLD]
    assert should and sum(should) >= 0.99 * len(should)
    assert not any(s == 1 and not f for f, s in zip(found, share))
