import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm.reading import features, isotonic, rarities, reading_levels, train, FREQUENCIES, Words

VOCABULARY = {
    1: "the cat is big and red it sat on my box we like him now".split(),
    2: "usually delivery arrived within several days and everything works nicely around our kitchen every morning".split(),
    3: "although craftsmanship seems considerable the combination between durability and convenience justifies expectations".split(),
    4: "notwithstanding photometric uniformity presupposes electrochemical passivation whose heuristic extrapolation obfuscates interpretability".split(),
}


def text(level, rng, n=60):
    out = []
    while len(out) < n:
        size = rng.randrange(4, 6 + 4 * level)
        out += [rng.choice(VOCABULARY[level]) for _ in range(size)]
        out[-1] += "."
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    docs = [(i, text(1 + i % 4, rng)) for i in range(400)]
    codes = " ".join(f"Zelquarenlofanmer{rng.randrange(10**9)}" for _ in range(25))
    docs += [(900, docs[2][1] + " " + codes), (901, None), (902, ""), (903, "?! 12"), (904, docs[3][1].upper().replace(" ", "\n")), (905, docs[3][1] * 300), (None, docs[3][1]), (2**53 + 1, docs[3][1])]
    labels = [(i, "r1", 1 + i % 4) for i in range(120)] + [(0, "r2", 4), (0, "r3", 1), (5, "r2", 9), (7, "r2", None), (77777, "r1", 2)]
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(labels, "doc_id bigint, rater string, reading_level int")


def test_held_out_levels(corpus):
    got = {r.doc_id: r for r in reading_levels(*corpus).collect()}
    held = range(120, 400)
    assert np.mean([got[i].reading_level == 1 + i % 4 for i in held]) > 0.95
    assert got[900].reading_level == 3 and got[904].reading_level == got[905].reading_level == 4
    assert [got[i].reading_level for i in (901, 902, 903)] == [None, None, None] or got[903].reading_level in (1, 2, None)
    assert None not in got and got[2**53 + 1].reading_level == 4
    assert got[902].n_words == 0 and got[905].n_words > 15_000


def test_labels_are_needed(corpus):
    docs, labels = corpus
    with pytest.raises(ValueError, match="levels"):
        train(docs, labels.limit(0))
    got = {r.doc_id: r for r in reading_levels(docs, labels.limit(0)).collect()}
    assert all(r.reading_level is None for r in got.values()) and got[902].n_words == got[901].n_words == 0 and got[904].n_words > 50
    assert reading_levels(docs.limit(0), labels).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 4)), min_size=1, max_size=30))
def test_isotonic_is_monotone_and_keeps_the_mean(points):
    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    knots, values = isotonic(x, y)
    assert (np.diff(values) >= -1e-12).all() and (np.diff(knots) >= 0).all() and y.min() <= values.min() and values.max() <= y.max()


def test_texts_without_words():
    rarity = rarities(np.ones(FREQUENCIES + 1))
    for t in (None, "", "?!", "12 34"):
        dense, buckets, _ = features(t, rarity)
        assert not dense.any() and not len(buckets)


def test_words_numbered_anew_change_nothing(monkeypatch):
    rng = random.Random(3)
    rarity = rarities(np.full(FREQUENCIES + 1, 100.0))
    texts = [text(1 + i % 4, rng) for i in range(12)]
    alone = [features(t, rarity) for t in texts]
    monkeypatch.setattr(Words, "LIMIT", 5)
    known = Words()
    for (dense, buckets, n), t in zip(alone, texts, strict=True):
        d, b, m = features(t, rarity, known)
        assert (d == dense).all() and (b == buckets).all() and n == m
