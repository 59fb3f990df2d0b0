import random

import regex

from strataline import common
from strataline.common import stage
from strataline.operators import load_profile
from strataline.operators.load_profile import basics, conformity, departures, expressions, induce, profile, reported_wrong, value_counts

COLUMNS = ["id", "name", "score", "grp"]


def people(spark, change=None, loads=8):
    rng, rows = random.Random(3), []
    for load in range(1, loads + 1):
        for i in range(150):
            row = [load * 1000 + i if rng.random() > 0.01 else None, rng.choice("ABC") + "ab" + rng.choice(["x", "y"]) + " Xy", round(rng.gauss(50, 5), 2), rng.choice(["g1", "g1", "g2"])]
            if rng.random() < 0.05:
                row[1] = None
            rows.append(("s", load, *(change(load, i, row) if change else row)))
    return spark.createDataFrame(rows, "site string, load_no int, id bigint, name string, score double, grp string")


def found(spark, change=None, loads=8):
    values, counts = profile(people(spark, change, loads), "site", "load_no", COLUMNS)
    return {(r.load, r.column_name, r.reason) for r in departures(values, counts, {"score": (0.0, 100.0)}).collect()}


def test_ordinary_loads(spark):
    # Ids rise from load to load, so only their distribution may be told apart.
    assert {x for x in found(spark) if x[1] != "id"} == set()


def test_planted_departures(spark):
    def change(load, i, row):
        if load == 2 and i < 70:
            row[1] = None
        if load == 3 and i < 60:
            row[1] = f"{row[1] or 'Aab Xy'}!"
        if load == 4:
            row[2] += 20
        if load == 5 and i == 0:
            row[2] = 999.0
        if load == 6 and i < 60:
            row[3] = "other"
        if load == 7:
            row[2] = [40.0, 50.0, 60.0][i % 3]
        return row

    got = found(spark, change)
    for want in ((2, "name", "null"), (3, "name", "shape"), (4, "score", "distribution"), (5, "score", "range"), (6, "grp", "mix"), (7, "score", "repetition")):
        assert want in got
    assert {(a, b) for a, b, _ in got if b != "id"} == {(2, "name"), (3, "name"), (4, "score"), (5, "score"), (6, "grp"), (7, "score")}


def test_few_loads_have_only_domain_cases(spark):
    assert {x[2] for x in found(spark, lambda load, i, row: [row[0], None, -5.0, row[3]] if load == 1 else row, loads=2)} == {"range"}


def test_reports(spark):
    counts = basics(value_counts(people(spark, loads=1), "site", "load_no", ["grp"]))
    told = spark.createDataFrame([("s", 1, "grp", 0, 3), ("s", 9, "grp", 0, 2)], "source string, load int, column_name string, null_count bigint, distinct_count bigint")
    assert [(r.load, r.column_name) for r in reported_wrong(counts, told).collect()] == [(1, "grp")]


def test_expressions_and_conformity(spark):
    df = spark.createDataFrame([("s", 1, f"AB-{i:04d}") for i in range(200)] + [("s", 1, "?!"), ("s", 1, ""), ("s", 1, None)], "site string, load_no int, badge string")
    values = value_counts(df, "site", "load_no", ["badge"])
    assert [r.expression for r in expressions(values).collect()] == ["^(?=[\\s\\S]{7,7}$)\\p{Lu}+\\-[0-9]+$"]
    assert [(r.held, r.nonconforming) for r in conformity(values).collect()] == [(202, 2)]


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([("s", 1, None, None)], "site string, load_no int, score double, name string")
    values, counts = profile(df, "site", "load_no", ["score", "name"])
    assert all(r.null_count == 1 and r.distinct_count == 0 for r in counts.collect())
    assert departures(values, counts).count() == 0
    values, counts = profile(df.limit(0), "site", "load_no", ["score", "name"])
    assert counts.count() == 0 and departures(values, counts).count() == 0


def test_mix_is_compared_whatever_the_number_of_values(spark):
    """A load of garbage groups does not switch the comparison off for the other loads."""

    def change(load, i, row):
        if load == 2 and i < 100:
            row[3] = "g" + "abcdefghijklmnopqrstuvwxyz"[i % 26] + str(i)
        if load == 6 and i < 100:
            row[3] = "g2"
        return row

    assert (6, "grp", "mix") in found(spark, change)


def test_names_of_another_population(spark):
    """Names of the same shape and repetition that no other load has."""
    rng = random.Random(5)
    letters = "abcdefghij"
    known, strange = ([f"{c}{x}{y}{z}" for x in letters for y in letters for z in letters[:2]] for c in ("Ka", "Zu"))
    df = spark.createDataFrame([("s", load, rng.choice(strange if load == 5 else known)) for load in range(1, 9) for _ in range(300)], "site string, load_no int, name string")
    values, counts = profile(df, "site", "load_no", ["name"])
    assert {(r.load, r.reason) for r in departures(values, counts).collect()} == {(5, "mix")}


def induced(spark, texts):
    return {r.shape: r.expression for r in induce(spark.createDataFrame([("s", "c", t) for t in texts], "source string, column_name string, value string")).collect()}


def test_shapes_are_merged_where_that_is_shorter(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["k", "r", "Q", "e", "Z"]) for _ in range(rng.randint(2, 9)))
    texts = sorted({" ".join(word() for _ in range(rng.randint(2, 25))) for _ in range(60)})
    got = induced(spark, texts)
    assert len(set(got.values())) == 1 and len(got) > 50
    (expression,) = set(got.values())
    assert expression.endswith("$)[\\p{Lu}\\p{Ll}]+(?: [\\p{Lu}\\p{Ll}]+)+$")
    assert all(regex.match(expression, t) for t in texts) and not regex.match(expression, "rk 9") and not regex.match(expression, "rke")


def test_usual_shapes_stay_apart_and_odd_texts_earn_nothing(spark):
    usual = [f"Ab{chr(97 + i % 26)}{chr(97 + i // 26)} Cd" for i in range(200)]
    odd = ["zymotechnicallyoverlong", "QUITEUNEXPECTEDWORD", "x1y22z333 #", "What is this doing here"]
    got = induced(spark, usual + odd)
    assert set(got) == {"Aa Aa"} and all(regex.match(got["Aa Aa"], t) for t in usual) and not any(regex.match(got["Aa Aa"], t) for t in odd)


def test_seventy_odd_values_in_one_load_hide_nothing(spark):
    def change(load, i, row):
        if load == 5:
            row[3] = "g1"
        if load == 8 and i < 70:
            row[3] = f"odd{i}!{i % 7}"
        return row

    got = found(spark, change)
    assert {(5, "grp", "mix"), (8, "grp", "shape")} <= got


def test_nothing_that_grows_with_the_loads_is_broadcast(spark, monkeypatch):
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    monkeypatch.setattr(load_profile, "stage", written)
    # A lookup so small that it is broadcast on purpose would hide what the planner chooses.
    monkeypatch.setattr(common, "is_small", lambda table: False)
    values, counts = profile(people(spark, lambda load, i, row: row[:3] + ["g9"] if load == 3 else row), "site", "load_no", COLUMNS)
    told = counts.select("source", "load", "column_name", "null_count", (counts["distinct_count"] + 1).alias("distinct_count"))
    out = departures(values, counts).unionByName(reported_wrong(counts, told))
    assert {(r["load"], r["column_name"]) for r in out.collect()} >= {(3, "grp")}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
