"""Column profiles of loads and their departures (problem 4).

Per load and column: counts, ranges, and the coverage of regular expressions that minimum description
length induces over all distinct values of a source's column. Loads are compared with the median of their
source's loads, so a few bad loads do not move the reference.

Everything starts from value counts (one row per source, load, column and value), which are formed map-side; a
hot source or load is spread over its values. What follows is of the size of columns x loads x
expressions, and never gathered on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.common import salted_lookup, sort_join, stage

#: A departure must exceed CHANCE standard errors and EFFECT in share; distributions (greatest difference of the
#: cumulative shares) and repetition, which are smoother, must exceed SHIFT_CHANCE and SHIFT.
CHANCE, EFFECT, SHIFT_CHANCE, SHIFT = 6.0, 0.08, 5.0, 0.15
#: Least loads of a source for comparisons; pools of the values too rare to compare one by one; cut
#: points of numeric distributions; widths by which a value must leave the usual range.
MIN_LOADS, POOLS, CUTS, REACH = 4, 16, 20, 1.5
#: Least rows of a value for its share to exceed CHANCE errors where its usual share is 0 (the error is then at least sqrt(0.5) / (n + 1)).
LEAST_ROWS = 4

#: Bits to keep one more expression in the list, whatever it says.
EXPRESSION_BITS = 16.0

UNIT = ["source", "load", "column_name"]


def shape(text: Column) -> Column:
    """Character classes of a text: runs of capitals, small letters and digits become A, a and 9."""
    out = F.regexp_replace(text, r"\p{Lu}+", "A")
    out = F.regexp_replace(out, r"\p{Ll}+", "a")
    return F.regexp_replace(out, r"[0-9]+", "9")


def value_counts(df: DataFrame, source: str, load: str, columns: Sequence[str]) -> DataFrame:
    """(source, load, column_name, value as text, n, data_type, number). NaN counts as a value; null as null."""
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    long = df.select(F.col(source).alias("source"), F.col(load).alias("load"), F.inline(F.array(*cells)))
    counts = long.groupBy(*UNIT, "value").agg(F.count(F.lit(1)).alias("n"))
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])
    return counts.withColumns({"data_type": types[F.col("column_name")], "number": F.when(F.col("column_name").isin(numeric), F.col("value").cast("double"))})


def basics(values: DataFrame) -> DataFrame:
    """row_count, null_count, distinct_count, min, max and mean of every column of every load."""
    real = F.col("number").isNotNull() & ~F.isnan("number")
    return values.groupBy(*UNIT, "data_type").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.min(F.when(real, F.col("number"))).alias("min_value"),
        F.max(F.when(real, F.col("number"))).alias("max_value"),
        (F.sum(F.when(real, F.col("number") * F.col("n"))) / F.sum(F.when(real, F.col("n")))).alias("mean_value"),
    )


#: A word or number repeated with one sign between is one group; the marks enclose what repeats.
REPEATED, OPEN, CLOSE = r"([w9])(?:([^w9])\1)(?:\2\1)*", "\ue000", "\ue001"


def _expression(code: Column, shortest: Column, longest: Column) -> Column:
    """The regular expression of a code of character classes, with the lengths it allows."""
    out = F.regexp_replace(code, rf"([^\p{{L}}\p{{N}}\s{OPEN}{CLOSE}])", r"\\$1")
    for mark, classes in (("w", r"[\\p{Lu}\\p{Ll}]+"), ("A", r"\\p{Lu}+"), ("a", r"\\p{Ll}+"), ("9", "[0-9]+"), (OPEN, "(?:"), (CLOSE, ")+")):
        out = F.regexp_replace(out, mark, classes)
    return F.concat(F.lit(r"^(?=[\s\S]{"), shortest, F.lit(","), longest, F.lit("}$)"), out, F.lit("$"))


def induce(text: DataFrame) -> DataFrame:
    """Regular expressions induced per source and text column of distinct values: source, column_name, shape, expression.

    Two-part code over all distinct values: an expression is kept if writing it down plus coding its values within it (which
    expression, class letters per position, lengths per run) is shorter than the best code without it. Shapes (runs of capitals,
    small letters, digits) are merged into words of any letters, and these into words that repeat, wherever one expression for all
    of them makes the code shorter than their own expressions and free text together. Values of other shapes do not conform.
    """
    v = F.col("value")
    digits, letters = F.length(F.regexp_replace(v, r"[^0-9]", "")), F.length(F.regexp_replace(v, r"[^\p{Lu}\p{Ll}]", ""))
    runs = lambda code: F.length(F.regexp_replace(code, "[^Aa9w]", ""))
    at = ["source", "column_name"]
    shapes = text.withColumn("shape", shape(v)).groupBy(*at, "shape").agg(
        F.count(F.lit(1)).alias("values"), F.min(F.length("value")).alias("shortest"), F.max(F.length("value")).alias("longest"),
        F.sum(F.length("value")).alias("chars"), F.sum(digits).alias("digits"), F.sum(letters).alias("letters"),
    )
    shapes = shapes.withColumn("words", F.regexp_replace("shape", "[Aa]+", "w")).withColumn("groups", F.regexp_replace("words", REPEATED, f"$1{OPEN}$2$1{CLOSE}"))
    shapes = stage(shapes.withColumn("pieces", F.col("values") * runs(F.col("shape"))).withColumn("word_pieces", F.col("values") * runs(F.col("words"))))
    totals = stage(shapes.groupBy(*at).agg(F.sum("values").alias("total")))

    def own(code: str, alphabet: int, pieces: str) -> Column:
        inner = F.col("digits") * math.log2(10) + F.col("letters") * math.log2(alphabet) + F.log2(F.col("longest") - F.col("shortest") + 1) * F.col(pieces)
        which = F.col("values") * F.log2(F.col("total") / F.col("values"))
        return inner + which + F.length(code) * math.log2(96) + runs(F.col(code)) * 2 * math.log2(64) + EXPRESSION_BITS

    sums = [F.sum(c).alias(c) for c in ("values", "digits", "letters", "word_pieces")] + [F.min("shortest").alias("shortest"), F.max("longest").alias("longest")]
    free = F.col("chars") * math.log2(96) + F.col("values") * (F.log2(F.col("longest") + 1) + 1)
    # One value is no pattern: alone it is free text.
    one = salted_lookup(shapes, totals, at, ["shape"], how="inner").withColumn("kept", (F.col("values") > 1) & (own("shape", 26, "pieces") < free)).withColumn("cost", F.when(F.col("kept"), own("shape", 26, "pieces")).otherwise(free))
    two = one.groupBy(*at, "words", "groups", "total").agg(*sums, F.sum("cost").alias("apart"))
    two = two.withColumn("own", own("words", 52, "word_pieces")).withColumn("kept", (F.col("values") > 1) & (F.col("own") < F.col("apart"))).withColumn("cost", F.when(F.col("kept"), F.col("own")).otherwise(F.col("apart")))
    repeats = F.col("values") * F.log2(F.col("longest") + 1)
    three = two.groupBy(*at, "groups", "total").agg(*sums, F.sum("cost").alias("apart")).filter(F.col("groups").contains(OPEN))
    three = three.filter((F.col("values") > 1) & (own("groups", 52, "word_pieces") + repeats < F.col("apart")))
    ends = lambda rows, name: rows.select(*at, *[c for c in ("words", "groups") if c in rows.columns and name == c], F.struct("shortest", "longest").alias(f"{name}_ends"))
    out = (
        sort_join(sort_join(one, ends(two.filter("kept"), "words"), [*at, "words"], "left"), ends(three, "groups"), [*at, "groups"], "left")
        .withColumn("code", F.when(F.col("groups_ends").isNotNull(), F.col("groups")).when(F.col("words_ends").isNotNull(), F.col("words")).when(F.col("kept"), F.col("shape")))
        .withColumn("ends", F.coalesce("groups_ends", "words_ends", F.struct("shortest", "longest")))
    )
    return out.filter("code is not null").select(*at, "shape", _expression(F.col("code"), F.col("ends.shortest").cast("string"), F.col("ends.longest").cast("string")).alias("expression"))


def expressions(values: DataFrame) -> DataFrame:
    """The expressions of all distinct texts of value counts."""
    return induce(values.filter("value is not null and data_type = 'string'").select("source", "column_name", "value").distinct())


def _once(values: DataFrame, counts: DataFrame) -> DataFrame:
    """Every value of a source's column once: how many loads have it (``seen``), whether it is compared by itself (``single``),
    and, for values of one load, that load and the rows.

    Only values with a share above EFFECT in some load (by more rows than chance gives) or usually can depart; they are single."""
    held = counts.select(*UNIT, (F.col("row_count") - F.col("null_count")).alias("held"))
    at = ["source", "column_name", "value"]
    share = salted_lookup(values.filter("value is not null"), held, UNIT, ["value"]).withColumn("high", F.col("n") / F.col("held") > EFFECT)
    each = share.groupBy(*at, "data_type").agg(
        F.count(F.lit(1)).alias("seen"), F.sum(F.col("high").cast("int")).alias("often"), F.max(F.col("high") & (F.col("n") >= LEAST_ROWS)).alias("clear"),
        F.min("load").alias("load"), F.min("n").alias("k"),
    )
    loads = held.filter("held > 0").groupBy("source", "column_name").agg(F.count(F.lit(1)).alias("loads"))
    single = F.col("clear") | (F.col("often") * 2 >= F.col("loads"))
    return stage(salted_lookup(each, loads, ["source", "column_name"], ["value"]).select(*at, "data_type", "seen", "load", "k", single.alias("single")))


def _shares(values: DataFrame, counts: DataFrame) -> DataFrame:
    """Shares to compare: source, load, column_name, kind, feature, k (rows), n (rows it is a share of)."""
    units = counts.select(*UNIT, "row_count", (F.col("row_count") - F.col("null_count")).alias("held"), "null_count", "distinct_count")
    nulls = units.select(*UNIT, F.lit("null").alias("kind"), F.lit("").alias("feature"), F.col("null_count").alias("k"), F.col("row_count").alias("n"))
    repeats = units.filter("held > 0").select(*UNIT, F.lit("repetition").alias("kind"), F.lit("").alias("feature"), (F.col("held") - F.col("distinct_count")).alias("k"), F.col("held").alias("n"))
    known = values.filter("value is not null")
    text = known.filter("data_type = 'string'")
    held = units.select(*UNIT, F.col("held").alias("n"))
    once = _once(values, counts)
    # Rows by the expression that their value fits.
    shaped = text.withColumn("shape", shape(F.col("value"))).groupBy(*UNIT, "shape").agg(F.sum("n").alias("k"))
    shaped = (
        salted_lookup(shaped, stage(induce(once.filter("data_type = 'string'"))), ["source", "column_name", "shape"], ["load"])
        .groupBy(*UNIT, F.coalesce("expression", F.lit("")).alias("feature")).agg(F.sum("k").alias("k"))
        .select(*UNIT, F.lit("shape").alias("kind"), "feature", "k")
    )
    # Single values one by one; the others of texts in pools (all texts less the single ones), and by the share that no other load has.
    alone = salted_lookup(known, stage(once.filter("single").select("source", "column_name", "value")), ["source", "column_name", "value"], ["load"], how="inner")
    pool = F.concat(F.lit("pool "), F.pmod(F.xxhash64("value"), F.lit(POOLS)).cast("string"))
    pooled = (
        text.select(*UNIT, pool.alias("feature"), "n").unionByName(alone.filter("data_type = 'string'").select(*UNIT, pool.alias("feature"), (-F.col("n")).alias("n")))
        .groupBy(*UNIT, "feature").agg(F.sum("n").alias("k")).filter("k > 0")
    )
    unseen = once.filter("seen = 1 and data_type = 'string'").groupBy(*UNIT).agg(F.sum("k").alias("k")).withColumn("feature", F.lit("unseen elsewhere"))
    single = alone.select(*UNIT, F.concat(F.lit("="), "value").alias("feature"), F.col("n").alias("k"))
    mixed = single.unionByName(pooled).unionByName(unseen).select(*UNIT, F.lit("mix").alias("kind"), "feature", "k")
    # Numeric distributions: cumulative shares at cut points of the source's distinct values.
    numeric = known.filter("number is not null and not isnan(number)")
    points = [i / CUTS for i in range(1, CUTS)]
    cuts = stage(numeric.groupBy("source", "column_name").agg(F.percentile_approx("number", F.array(*[F.lit(p) for p in points]), F.lit(1000)).alias("cuts")))
    below = (
        salted_lookup(numeric, cuts, ["source", "column_name"], ["value"])
        .groupBy(*UNIT, F.size(F.filter("cuts", lambda c: c < F.col("number"))).alias("bin")).agg(F.sum("n").alias("k"))
        .select(*UNIT, "k", F.explode(F.sequence(F.col("bin"), F.lit(CUTS - 1))).alias("cut"))
        .groupBy(*UNIT, F.col("cut").cast("string").alias("feature")).agg(F.sum("k").alias("k"))
        .select(*UNIT, F.lit("distribution").alias("kind"), "feature", "k")
    )
    rest = salted_lookup(shaped.unionByName(mixed).unionByName(below), held, UNIT, ["feature"])
    return nulls.unionByName(repeats).unionByName(rest)


def departures(values: DataFrame, counts: DataFrame, domains: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(source, load, column_name, reason, detail, score) of columns out of line with the source's other loads.

    ``values`` and ``counts`` are the staged tables of :func:`profile`; ``domains`` gives the range that the values of a column are
    meant to lie in. Reasons: null, repetition, shape, mix, distribution, range. Sources with fewer than MIN_LOADS loads have only
    range cases by domain. Each share is compared with the median over all loads of the source (a load without a
    value has share 0), its chance with the binomial error plus the spread between loads.
    """
    shares = stage(_shares(values, counts)).withColumn("share", F.col("k") / F.col("n"))
    loads = counts.select(*UNIT, (F.col("row_count") - F.col("null_count")).alias("held"), "row_count")
    enough = stage(loads.groupBy("source", "column_name").agg(F.count(F.lit(1)).alias("loads"), F.count_if(F.col("held") > 0).alias("filled")).filter(F.col("loads") >= MIN_LOADS))
    unit = ["source", "column_name", "kind", "feature"]
    shares = salted_lookup(shares.filter("n > 0"), enough, ["source", "column_name"], ["load", "feature"], how="inner").withColumn("of", F.when(F.col("kind") == "null", F.col("loads")).otherwise(F.col("filled")))
    # The loads without a feature are one row of their number: they all have share 0.
    present = shares.select(*unit, "of", "load", "n", "share", F.lit(1).cast("bigint").alias("weight"))
    none = [F.lit(None).cast(present.schema[c].dataType).alias(c) for c in ("load", "n")]
    absent = present.groupBy(*unit, "of").agg(F.count(F.lit(1)).alias("has")).filter("of > has").select(*unit, "of", *none, F.lit(0.0).alias("share"), (F.col("of") - F.col("has")).alias("weight"))
    upto = lambda order: F.sum("weight").over(Window.partitionBy(*unit).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) * 2 >= F.col("of")
    whole = Window.partitionBy(*unit)
    each = present.unionByName(absent).withColumn("reached", upto("share")).withColumn("usual", F.min(F.when(F.col("reached"), F.col("share"))).over(whole))
    each = each.withColumn("off", F.abs(F.col("share") - F.col("usual"))).withColumn("reached", upto("off"))
    each = each.withColumn("spread", 1.4826 * F.min(F.when(F.col("reached"), F.col("off"))).over(whole)).drop("reached", "off")
    each = stage(each)
    # A load without a feature departs only where the feature is usual; few features of a column can be.
    usual = each.filter("load is null").filter(F.col("usual") > EFFECT).select(*unit, "usual", "spread")
    size = F.when(F.col("kind") == "null", F.col("row_count")).otherwise(F.col("held"))
    missing = sort_join(usual, loads, ["source", "column_name"]).withColumn("n", size).filter("n > 0")
    without = sort_join(missing, each.filter("load is not null").select(*unit, "load"), [*unit, "load"], "left_anti").select(
        *unit, "load", "n", F.lit(0.0).alias("share"), "usual", "spread"
    )
    each = each.filter("load is not null").select(*unit, "load", "n", "share", "usual", "spread").unionByName(without)
    # One pseudo-row keeps the error of a share of 0 or 1 above 0.
    safe = (F.col("usual") * F.col("n") + 0.5) / (F.col("n") + 1)
    error = F.sqrt(safe * (1 - safe) / F.col("n") + F.col("spread") * F.col("spread"))
    gap = F.abs(F.col("share") - F.col("usual"))
    smooth = F.col("kind").isin("distribution", "repetition")
    least, chance = F.when(smooth, F.lit(SHIFT)).otherwise(F.lit(EFFECT)), F.when(smooth, F.lit(SHIFT_CHANCE)).otherwise(F.lit(CHANCE))
    # Repetition grows with the load where values are few anyway; the mix is compared there instead.
    fits = (F.col("kind") != "repetition") | (F.col("usual") < 0.5)
    shifted = each.filter((gap > chance * error) & (gap > least) & fits).select("source", "load", "column_name", F.col("kind").alias("reason"), F.col("feature").alias("detail"), (gap / error).alias("score"))
    ends = counts.filter("min_value is not null")
    usual = ends.groupBy("source", "column_name").agg(F.percentile("min_value", F.lit(0.5)).alias("low"), F.percentile("max_value", F.lit(0.5)).alias("high"), F.count(F.lit(1)).alias("loads"))
    width = F.col("high") - F.col("low")
    far = (F.col("loads") >= MIN_LOADS) & ((F.col("min_value") < F.col("low") - REACH * width) | (F.col("max_value") > F.col("high") + REACH * width))
    for c, (low, high) in (domains or {}).items():
        far = far | ((F.col("column_name") == c) & ((F.col("min_value") < low) | (F.col("max_value") > high)))
    ranged = sort_join(ends, usual, ["source", "column_name"]).filter(far).select(*UNIT, F.lit("range").alias("reason"), F.concat_ws("..", "min_value", "max_value").alias("detail"), F.lit(None).cast("double").alias("score"))
    return shifted.unionByName(ranged)


def reported_wrong(counts: DataFrame, reported: DataFrame) -> DataFrame:
    """Columns whose reported null_count or distinct_count differs from the rows; a missing report is no case, a
    null figure counts as different. ``reported``: source, load, column_name, null_count, distinct_count."""
    told = reported.select(*UNIT, F.col("null_count").alias("told_null"), F.col("distinct_count").alias("told_distinct"))
    same = F.col("null_count").eqNullSafe(F.col("told_null")) & F.col("distinct_count").eqNullSafe(F.col("told_distinct"))
    return sort_join(counts, told, UNIT).filter(~same).select(*UNIT, F.lit("report").alias("reason"), F.concat_ws(",", "told_null", "told_distinct").alias("detail"), F.lit(None).cast("double").alias("score"))


def profile(df: DataFrame, source: str, load: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(value counts, basic profile) of all columns of all loads, both written once."""
    values = stage(value_counts(df, source, load, columns))
    return values, stage(basics(values))


def conformity(values: DataFrame) -> DataFrame:
    """Per load and text column: rows that hold a value and rows that fit none of the induced expressions."""
    text = values.filter("value is not null and data_type = 'string'").withColumn("shape", shape(F.col("value")))
    fit = salted_lookup(text, stage(expressions(values)), ["source", "column_name", "shape"], ["value"])
    return fit.groupBy(*UNIT).agg(
        F.sum("n").alias("held"), F.coalesce(F.sum(F.when(F.col("expression").isNull(), F.col("n"))), F.lit(0)).alias("nonconforming"),
        F.array_join(F.array_sort(F.collect_set("expression")), " | ").alias("expressions"),
    )
