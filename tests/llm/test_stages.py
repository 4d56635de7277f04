"""Every stage of the pipeline on odd and empty tables whose columns have the names that operators use inside."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sylva.llm import op03_quality, op09_mix

NAMES = ("row_id", "times", "folded", "own_sha", "kept_sha", "_id", "_keep", "_sha", "shard", "doc", "position")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(odd, name, stage):
    docs = odd.withColumns({c: F.lit(1) for c in NAMES})
    for table in (docs.limit(0), docs):
        out = stage(docs.sparkSession, table, "")
        assert (out.count() > 0) == (table is docs)
        assert name == "bpe_encode" or out.columns == docs.columns


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    k = corpus_pipeline.WORDS
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def both(docs, odd):
    return docs.unionByName(odd.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10_000).select(docs.columns))


def test_quality_keeps_what_the_rules_keep(spark, both):
    good = Counter(r.doc_id for r in op03_quality.quality(both).where("kept").select("doc_id").collect())
    assert Counter(r.doc_id for r in corpus_pipeline.quality_rules(spark, both, "").collect()) == good


def test_exact_and_near_duplicates_against_plain_sets(spark, both):
    rows = both.collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    kept = corpus_pipeline.exact_duplicates(spark, both, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    sets = {r.doc_id: shingle_set(r.text) for r in rows if r.doc_id in set(first.values())}
    label = {i: i for i in sets}
    by_shingle = {}
    for i, s in sets.items():
        for g in s:
            by_shingle.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= corpus_pipeline.PERCENT * len(sets[a] | sets[b])]
    assert links
    for _ in sets:
        moved = False
        for a, b in links:
            least = min(label[a], label[b])
            moved |= label[a] != least or label[b] != least
            label[a] = label[b] = least
        if not moved:
            break
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, kept, "").collect()) == sorted(i for i, c in label.items() if i == c)


def test_mix_takes_documents_in_the_order_of_their_positions(spark, both):
    mixed = op09_mix.mix(both, whole=True).collect()
    want = Counter(i for r in mixed for i in [r.doc_id] * r.copies)
    places = sorted([(r.position, r.doc_id) for r in mixed if r.copies] + [(r.position_again, r.doc_id) for r in mixed if r.copies > 1], key=lambda x: x[0])
    at = {}
    for p, i in places:
        at.setdefault(i, []).append(p)
    got = [r.doc_id for r in corpus_pipeline.mix_sources(spark, both, "").collect()]
    assert Counter(got) == want
    order = [at[i].pop(0) for i in got]
    assert all(x <= y + 1e-12 for x, y in zip(order, order[1:]))
    taken, target = Counter(), {}
    for r in mixed:
        taken[r.source_size, r.target] += r.taken
    assert all(abs(n - t) <= max(r.size for r in mixed) for (_, t), n in taken.items())
