"""The pipeline's near-duplicates against all pairs of sets."""

from __future__ import annotations

import random
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from corpora import frame
from test_corpus import classes

from sonde.functions import staging
from sonde.llm import shingle_join, simhash


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def corpus():
    """Texts with 0 to 12 words changed, some with a line that all share."""
    rng = random.Random(5)
    words = [f"{x}{y}{z}" for x in "bdfgk" for y in "aeiou" for z in "lmnrst"]
    line = " ".join(rng.choices(words, k=12))
    out = []
    for _ in range(12):
        base = rng.choices(words, k=150)
        for changes in range(0, 13, 2):
            w = list(base)
            for at in rng.sample(range(150), changes):
                w[at] = rng.choice(words)
            out.append(" ".join(w) + (f" {line}" if rng.random() < 0.5 else ""))
    return [(k, t, "s") for k, t in enumerate([*out, out[3], line, "", "", "three Words only", "three words only"])]


def test_near_texts_are_found_whatever_bits_they_differ_in(spark):
    rows = corpus()
    label = classes([t for _, t, _ in rows], lambda a, b: similarity(a, b) >= 0.8)
    assert 12 < len(set(label)) < 84
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = {r["doc_id"] for r in stage(spark, frame(spark, rows), "").collect()}
    assert kept == {label.index(x) for x in set(label)}
    near = next((a, b) for i, (_, a, _) in enumerate(rows) for _, b, _ in rows[:i] if similarity(a, b) >= 0.8 and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 2)
    assert len(stage(spark, frame(spark, [(1, near[0], "s"), (2, near[1], "s")]), "").collect()) == 1


def variants(rng, middle):
    """Near copies of one text with 1 to 6 words changed, with or without that text itself."""
    words = [f"{x}{y}{z}" for x in "bdfgk" for y in "aeiou" for z in "lmnrst"]
    base = rng.choices(words, k=150)
    out = [" ".join(base)] if middle else []
    for k in range(240):
        w = list(base)
        for at in rng.sample(range(150), 1 + k % 6):
            w[at] = rng.choice(words)
        out.append(" ".join(w))
    return [(k, t, "s") for k, t in enumerate(rng.sample(out, len(out)))]


@pytest.mark.parametrize("middle", [True, False])
def test_a_large_group_of_near_copies_is_not_compared_each_with_each(spark, monkeypatch, middle):
    rows = variants(random.Random(7), middle)
    label = classes([t for _, t, _ in rows], lambda a, b: similarity(a, b) >= 0.8)
    asked, compare = [], shingle_join.similar

    def counted(pairs, texts):
        asked.append(pairs.count())
        return compare(pairs, texts)

    monkeypatch.setattr(shingle_join, "similar", counted)
    kept = {r["doc_id"] for r in simhash.keep_one_of_similar(frame(spark, rows)).collect()}
    assert kept == {label.index(x) for x in set(label)}
    assert sum(asked) < 6 * len(rows)


def test_sketches_differ_in_no_more_bits_than_the_sets_in_shingles():
    texts = [t for _, t, _ in corpus()[:40]]
    sets = [shingle_join.shingles(t) for t in texts]
    sketches = [shingle_join.sketch(h).view(np.uint64) for h in sets]
    assert all(len(s) * 64 == shingle_join.SKETCH for s in sketches)
    apart = [(int(np.bitwise_count(s ^ z).sum()), len(np.setxor1d(g, h))) for s, g in zip(sketches, sets, strict=True) for z, h in zip(sketches, sets, strict=True)]
    assert all(bits <= hashes for bits, hashes in apart)
    # texts that have nothing in common are told apart
    assert max(bits for bits, _ in apart) > 150


def test_sets_that_were_compared_do_not_stay_on_disk(spark):
    before = set(staging._MADE)
    simhash.keep_one_of_similar(frame(spark, corpus()[:30])).collect()
    made = [Path(p.removeprefix("file://")) for p in staging._MADE if p not in before]
    assert [p.name for p in made if p.name.startswith("sets-")]
    assert not [p.name for p in made if p.name.startswith("sets-") and p.exists()]
