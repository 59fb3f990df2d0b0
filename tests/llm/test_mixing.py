import random
from itertools import product

import pytest

from strataline.llm.mixing import largest_total, mix, quotas, route, token_counts, tokenizer, VOCABULARY

TARGETS = "source string, target_share double, max_repeats int"


def test_tokens_round_trip(spark):
    texts = ["Hello world", "Größe café 12345", "<|endoftext|>", "a" * 20_000, "", None]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")
    got = {r.doc_id: r.tokens for r in token_counts(df).collect()}
    enc = tokenizer(VOCABULARY)
    for i, t in enumerate(texts):
        assert got[i] == (len(enc.encode_ordinary(t)) if t else 0)
        assert not t or enc.decode(enc.encode_ordinary(t)) == t


def test_route_repeats_only_where_needed():
    got = route({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 100, "b": 130}, {"a": 2, "b": 2})
    assert sum(v for (_, s), v in got.items() if s == "a") == 100 and sum(v for (_, s), v in got.items() if s == "b") == 120
    got = route({("a",): 100, ("a", "b"): 50}, {"a": 80, "b": 40}, {"a": 3, "b": 1})
    assert got == {(("a",), "a"): 80, (("a", "b"), "b"): 40}


def cost(table, flows):
    used = {p: sum(flows.get((p, s), 0) for s in p) for p in table}
    return sum(sum(max(0, used[p] - k * table[p]) for k in range(1, 4)) for p in table)


def test_route_against_all_flows():
    table, repeats = {("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": 2, "b": 3}
    for qa, qb in product(range(7), range(7)):
        best = None
        arcs = [(p, s) for p in table for s in p]
        for amounts in product(*[range(table[p] * repeats[s] + 1) for p, s in arcs]):
            f = dict(zip(arcs, amounts, strict=True))
            if any(sum(v for (q, _), v in f.items() if q == p) > table[p] * max(repeats[s] for s in p) for p in table):
                continue
            got = {s: sum(v for (_, t), v in f.items() if t == s) for s in "ab"}
            if got["a"] <= qa and got["b"] <= qb:
                key = (-(got["a"] + got["b"]), cost(table, f))
                best = key if best is None else min(best, key)
        flows = route(table, {"a": qa, "b": qb}, repeats)
        assert (-sum(flows.values()), cost(table, flows)) == best


def test_largest_total():
    table, shares, repeats = {("a",): 1000, ("b",): 30}, {"a": 0.7, "b": 0.3}, {"a": 1, "b": 3}
    total = largest_total(table, shares, repeats)
    assert 298 <= total <= 304 and quotas({}, 5) == {}


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows = random.Random(4), []
    for i in range(600):
        source = rng.choices(["big", "mid", "tiny", "untargeted", None], [60, 25, 4, 8, 3])[0]
        rows.append((i, source, " ".join(rng.choice(["red", "green", "box", "of", "sand", "12"]) for _ in range(rng.randrange(5, 60)))))
    rows += [(1000 + k, "mid" if k % 2 else "big", "the very same text in two sources") for k in range(300)]
    rows += [(2000, "tiny", None), (2001, "tiny", "")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumnRenamed("x", "x")


def test_mixture(spark, corpus):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.35, 2), ("tiny", 0.1, 4), ("nowhere", 0.05, 5), (None, 0.1, 1)], TARGETS)
    selection, report = mix(corpus, targets)
    shares = {r.source: r.asDict() for r in report.collect()}
    for s, x in (("big", 0.5), ("mid", 0.35), ("tiny", 0.1)):
        assert shares[s]["share"] == pytest.approx(x / 0.95, abs=0.01)
    assert shares["nowhere"]["share"] == 0 and sum(r["share"] for r in shares.values()) == pytest.approx(1)
    rows = selection.collect()
    cap = {"big": 1, "mid": 2, "tiny": 4}
    assert all(1 <= r.repeats <= cap[r.source] for r in rows)
    assert len({(r.doc_id, r.source) for r in rows}) == len(rows) and sum(r.doc_id >= 1000 for r in rows) <= 2
    assert sorted(map(tuple, mix(corpus.repartition(7), targets)[0].collect())) == sorted(map(tuple, rows))
    assert sorted(map(tuple, mix(corpus, targets, seed=5)[0].collect())) != sorted(map(tuple, rows))


def test_greater_total_fills_sources_to_their_caps(spark, corpus):
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 4)], TARGETS)
    _, report = mix(corpus, targets, total_tokens=8000)
    got = {r.source: r for r in report.collect()}
    assert got["tiny"].taken_tokens == 4 * got["tiny"].available_tokens < 4000 and got["big"].taken_tokens == pytest.approx(4000, abs=100)


def test_nothing_to_mix(spark, corpus):
    targets = spark.createDataFrame([("nowhere", 1.0, 2)], TARGETS)
    selection, report = mix(corpus, targets)
    assert selection.count() == 0 and report.first().share == 0
    assert mix(corpus.limit(0), targets)[0].count() == 0 and mix(corpus, targets.limit(0))[1].count() == 0
