import random
from collections import Counter

import numpy as np
import pytest

from strataline.llm.contamination import PARTS, ItemIndex, Windows, covered_words, leaks
from strataline.llm.words import words

NAMES = ["Balu", "Corin", "Dema", "Elko", "Fanu", "Goril", "Hame", "Iska", "Jondo", "Kelba"]
THINGS = ["kettle", "anchor", "lantern", "pedal", "winch", "barrel", "compass", "ladder", "needle", "basket"]
ACTS = ["cleaned", "weighed", "painted", "borrowed", "returned", "measured", "hid", "sold"]


def item(rng):
    """Sentences of one template with details of their own."""
    out = []
    for _ in range(6):
        a, b = rng.sample(NAMES, 2)
        x, y = rng.sample(THINGS, 2)
        out.append(f"After {rng.randrange(2, 99)} days {a} {rng.choice(ACTS)} the {x} that {b} had {rng.choice(ACTS)} near the {y}.")
    return " ".join(out)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(8)
    return {i: item(rng) for i in range(1, 31)}


def mangle(text, rng, rate=0.06):
    out = []
    for w in text.split():
        r = rng.random()
        out += [] if r < rate / 2 else [w, "really"] if r < rate else [w.upper()]
    return "<p>" + "<br/>\n".join(" ".join(out[i : i + 9]) for i in range(0, len(out), 9)) + "</p>"


def half(text):
    s = text.split(". ")
    return ". ".join(s[:4])


def test_leaks(spark, items):
    rng = random.Random(9)
    filler = "I like the new handle and it came in a small box last week. " * 5
    docs = [
        (1, items[1]), (2, filler + items[2] + filler), (3, mangle(items[3], rng)), (4, filler + half(items[4])), (5, items[5].replace("days", "days​").replace("e", "é")),
        (6, filler), (7, item(rng) + item(rng)), (8, items[6].split(". ")[0]), (9, None), (10, ""), (11, items[7] + " " + items[8]), (12, filler * 200 + items[9]), (12, filler * 200 + items[9]), (None, items[10]), (2**53 + 1, items[11]),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string").repartition(3)
    wanted = spark.createDataFrame([(*i, 0) for i in items.items()] + [(99, None, 0), (98, "", 0)], "item_id bigint, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id) for r in leaks(df, wanted).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (11, 7), (11, 8), (12, 9), (2**53 + 1, 11)]


def test_empty_tables(spark, items):
    docs = spark.createDataFrame([(1, items[1])], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks(docs, none).count() == 0
    assert leaks(docs.limit(0), spark.createDataFrame(list(items.items()), "item_id bigint, text string")).count() == 0


def test_items_in_blocks_give_the_same(spark, items, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in items.items()], "doc_id bigint, text string")
    wanted = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    whole = sorted(map(tuple, leaks(docs, wanted).select("doc_id", "item_id").collect()))
    monkeypatch.setattr("strataline.llm.contamination.ITEM_BLOCK", 7)
    assert sorted(map(tuple, leaks(docs, wanted).select("doc_id", "item_id").collect())) == whole == [(i, i) for i in sorted(items)]


@pytest.mark.parametrize("radius", [2, 3, *(r for _, r in PARTS), 13])
def test_blocks_find_every_fingerprint_within_the_radius(radius):
    rng = np.random.default_rng(2)
    windows = Windows(20, radius, rng.integers(0, 2**63, 200, np.uint64), rng.integers(0, 50, 200).astype(np.int32))
    prints = windows.prints[rng.integers(0, len(windows.prints), 400)].copy()
    for k in range(len(prints)):
        for bit in rng.choice(64, rng.integers(0, radius + 3), replace=False):
            prints[k] ^= np.uint64(1) << np.uint64(bit)
    w, i = windows.hits(prints)
    far = np.bitwise_count(prints[:, None] ^ windows.prints[None, :])
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == {(int(a), int(windows.owners[b])) for a, b in zip(*np.nonzero(far <= radius), strict=True)}


@pytest.mark.parametrize("every", [12, 9, 8, 7, 6, 5])
def test_one_word_changed_in_few_is_found(items, every):
    rows = [(i, words(t)) for i, t in items.items()]
    index = ItemIndex(rows, Counter(w for _, ws in rows for w in set(ws)), len(rows))
    texts = [["before"] * 12 + [f"other{k}" if k % every == every // 2 else w for k, w in enumerate(ws)] + ["after"] * 12 for _, ws in rows]
    found = index.search_all(texts)
    assert np.mean([dict(f).get(i, 0) >= 0.5 for (i, _), f in zip(rows, found, strict=True)]) >= 0.9


def test_without_near_fingerprints_nothing_is_found(items, monkeypatch):
    rows = [(i, words(t)) for i, t in items.items()]
    index = ItemIndex(rows, Counter(w for _, ws in rows for w in set(ws)), len(rows))
    assert dict(index.search(rows[0][1]))[rows[0][0]] > 0.95
    monkeypatch.setattr(Windows, "hits", lambda self, prints: (np.zeros(0, np.int64), np.zeros(0, np.int32)))
    assert index.search(rows[0][1]) == []


def test_alignments_do_not_depend_on_what_they_are_stacked_with():
    rng = np.random.default_rng(3)
    weights = [rng.random(m) + 0.5 for m in (20, 35, 50)]
    sames = [rng.random((len(w), n)) < 0.05 for w, n in zip(weights, (30, 80, 10), strict=True)]
    for k, x in enumerate(sames):
        x[np.arange(10), np.arange(10)] = True
        alone = covered_words([weights[k]], [x])[0]
        assert (covered_words(weights, sames)[k] == alone).all() and alone.any()


def test_altered_parts_of_items_are_found():
    """Seven tenths of an item with a fifth of the words changed, dropped or put in between; half of its words are kept."""
    rng = random.Random(20)
    places = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "ru") for b in ("len", "dor", "vis", "tam") for c in ("a", "o", "eth", "ur")]
    rows = [(i, words(" ".join(f"{item(rng)} {' '.join(rng.sample(places, 6))}".split()))) for i in range(1, 41)]
    index = ItemIndex(rows, Counter(w for _, ws in rows for w in set(ws)), len(rows))
    cases = lost = 0
    for i, ws in rows:
        part, kept, out = ws[: int(0.7 * len(ws)) + 1], 0, ["some", "other", "words", "before"] * 5
        for w in part:
            r = rng.random() if rng.random() < 0.2 else 1.0
            kept += r > 2 / 3
            out += ["altered"] if r < 1 / 3 else [] if r < 2 / 3 else [w, "between"] if r < 1 else [w]
        if kept >= 0.52 * len(ws):
            cases += 1
            lost += dict(index.search(out)).get(i, 0) < 0.5
    assert cases > 20 and lost <= 0.05 * cases, (lost, cases)


def test_words_in_another_order_or_with_other_details_are_no_leak(items):
    rng = random.Random(21)
    rows = [(i, words(t)) for i, t in items.items()]
    index = ItemIndex(rows, Counter(w for _, ws in rows for w in set(ws)), len(rows))
    for _, ws in rows:
        assert all(s < 0.5 for _, s in index.search(rng.sample(ws, len(ws)))) and all(s < 0.5 for _, s in index.search(words(item(rng))))
