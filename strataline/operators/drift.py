"""Schemas that drift between files (problem 2).

Files are profiled in two passes. The first counts the JSON kinds of every field of every file; presence and kinds are compared by
joins. The second looks at removed and added fields only, in the files that have them, and sketches their values (tokens of
texts, logarithmic bins of numbers, shares of booleans, keys of objects). Removed and added fields of one file are matched by a
bipartite assignment on sketches, kinds and names, and pairs that are close enough are renames. All lines and all tokens of
these fields count; in every task they are reduced to counts per (feed, file, field) before anything is shuffled. Tokens
are compared by a join, so a field of any number of tokens is compared whole and no task holds it.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.common import salted_lookup, sort_join, stage

#: Counts held in a task before they are handed on; they are added up afterwards.
HELD_COUNTS = 500_000
#: Least score of a pair of fields to count as a rename.
RENAME_SCORE = 0.25

_KINDS = {str: "k:string", bool: "k:boolean", int: "k:number", float: "k:number", list: "k:array", dict: "k:object"}
_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def walk(record: dict) -> Iterator[tuple[str, object]]:
    """(dotted path, value) of every key of an object and the objects in it, however deep; arrays are not entered."""
    open_objects: list[tuple[str, Iterator]] = [("", iter(record.items()))]
    while open_objects:
        at, keys = open_objects[-1]
        for key, value in keys:
            path = at + key
            yield path, value
            if isinstance(value, dict):
                open_objects.append((f"{path}.", iter(value.items())))
                break
        else:
            open_objects.pop()


def read_object(payload: str | None, **options) -> dict | None:
    """The object of a line; None if the line holds none."""
    try:
        record = json.loads(payload, **options)
    except (TypeError, ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def features(value: object) -> list[str]:
    """What a sketch counts of one value. Texts that spell a number or boolean and single-element arrays also give
    what they contain, so a rename with a changed type can still be seen."""
    if isinstance(value, bool):
        return [f"b:{str(value).lower()}"]
    if isinstance(value, int | float):
        x = float(value) if abs(value) < 1e308 else math.inf
        return [f"n:{0 if not x or not math.isfinite(x) else round(math.copysign(2 * math.log2(1 + abs(x)), x))}"]
    if isinstance(value, str):
        text = value.strip()
        if _NUMBER.fullmatch(text):
            return features(float(text))
        if text.lower() in ("true", "false"):
            return [f"b:{text.lower()}"]
        return [f"t:{w.lower()}" for w in _WORD.findall(text)] or ["t:"]
    if isinstance(value, list):
        return [f for x in value if not isinstance(x, list | dict) for f in features(x)]
    if isinstance(value, dict):
        return [f"o:{k}" for k in value]
    return []


def _handed_on(counts: dict[tuple, int]) -> pd.DataFrame:
    """The counts held so far, which are then held no more."""
    out = pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["feed", "file_no", "path", "feature", "n"])
    counts.clear()
    return out


def _kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[tuple, int] = defaultdict(int)
    for pdf in batches:
        for feed, file_no, payload in zip(pdf["feed"], pdf["file_no"], pdf["payload"], strict=True):
            record = read_object(payload)
            counts[feed, file_no, "", "unreadable" if record is None else "objects"] += 1
            for path, value in walk(record or {}):
                counts[feed, file_no, path, _KINDS.get(type(value), "k:null")] += 1
            if len(counts) >= HELD_COUNTS:
                yield _handed_on(counts)
    if counts:
        yield _handed_on(counts)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sketches of the fields that each row names in ``paths``."""
    counts: dict[tuple, int] = defaultdict(int)
    for pdf in batches:
        for feed, file_no, payload, paths in zip(pdf["feed"], pdf["file_no"], pdf["payload"], pdf["paths"], strict=True):
            wanted = set(paths)
            for path, value in walk(read_object(payload) or {}):
                if path in wanted:
                    for f in features(value):
                        counts[feed, file_no, path, f] += 1
            if len(counts) >= HELD_COUNTS:
                yield _handed_on(counts)
    if counts:
        yield _handed_on(counts)


ENTRIES = "feed string, file_no int, path string, feature string, n bigint"


def _lines(lines: DataFrame) -> DataFrame:
    return lines.select("feed", F.col("file_no").cast("int").alias("file_no"), "payload").filter("feed is not null and file_no is not null")


def profile(lines: DataFrame) -> DataFrame:
    """Kinds (feed, file_no, path, feature, n) of the fields of files of JSON lines (feed, file_no, payload): feature is ``k:`` and
    a JSON kind or null.

    Lines that hold no object are counted under path '' as ``unreadable``. Files delivered twice under one
    number are one file. Rows without a feed or file number are left out.
    """
    return _lines(lines).mapInPandas(_kinds, ENTRIES).groupBy("feed", "file_no", "path", "feature").agg(F.sum("n").alias("n"))


def sketch(lines: DataFrame, fields: DataFrame) -> DataFrame:
    """Value sketches (feed, file_no, path, feature, n) of some fields (feed, file_no, path). Only files with such fields are parsed."""
    wanted = stage(fields.groupBy("feed", "file_no").agg(F.sort_array(F.collect_set("path")).alias("paths")))
    rows = salted_lookup(_lines(lines), wanted, ["feed", "file_no"], ["payload"], how="inner")
    return rows.mapInPandas(_sketch, ENTRIES).groupBy("feed", "file_no", "path", "feature").agg(F.sum("n").alias("n"))


def name_parts(path: str) -> list[str]:
    """Words of the last key of a path, camel case and separators split, plural s dropped."""
    words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", path.rpartition(".")[2])
    return [w.lower().rstrip("s") or w.lower() for w in words]


def name_similarity(a: str, b: str) -> float:
    x, y = name_parts(a), name_parts(b)
    if x == y:
        return 1.0
    shared = len(set(x) & set(y)) / max(1, min(len(set(x)), len(set(y))))
    p, q = "".join(x), "".join(y)
    grams = lambda s: Counter(s[i : i + 3] for i in range(max(1, len(s) - 2)))
    g, h = grams(p), grams(q)
    dice = 2 * sum((g & h).values()) / max(1, sum(g.values()) + sum(h.values()))
    return max(0.8 * shared, dice)


def _overlap(a: Counter, b: Counter) -> float:
    s, t = sum(a.values()), sum(b.values())
    return sum(min(a[k] / s, b[k] / t) for k in a if k in b) if s and t else 0.0


def _bins_overlap(a: Counter, b: Counter) -> float:
    """1 minus the earth mover's distance of two binned distributions over three doublings, at least 0."""
    lo, hi = min([*a, *b]), max([*a, *b])
    x = np.array([a[k] for k in range(lo, hi + 1)], float)
    y = np.array([b[k] for k in range(lo, hi + 1)], float)
    return max(0.0, 1 - np.abs(np.cumsum(x / x.sum()) - np.cumsum(y / y.sum())).sum() / 6)


def _plain(sketch: Counter) -> Counter:
    """A sketch whose numbers are all 0 or 1 read as booleans."""
    if any(f[:2] == "n:" and f not in ("n:0", "n:2") for f in sketch):
        return sketch
    out: Counter = Counter()
    for f, n in sketch.items():
        out[{"n:0": "b:false", "n:2": "b:true"}.get(f, f)] += n
    return out


def content_similarity(a: Counter, b: Counter, shared: float) -> float:
    """Likeness of two value sketches, 0 to 1: by the kind of content that most values of the first have. ``shared`` is
    the likeness of their tokens."""
    split = lambda s: {c: Counter({f[2:]: n for f, n in s.items() if f[:2] == c}) for c in ("t:", "n:", "b:", "o:")}
    x, y = split(a), split(b)
    kind = max(x, key=lambda c: sum(x[c].values()))
    if not sum(x[kind].values()) or kind != max(y, key=lambda c: sum(y[c].values())):
        return 0.0
    if kind == "n:":
        return _bins_overlap(Counter({int(k): n for k, n in x[kind].items()}), Counter({int(k): n for k, n in y[kind].items()}))
    if kind == "o:":
        p, q = {tuple(name_parts(k)) for k in x[kind]}, {tuple(name_parts(k)) for k in y[kind]}
        return len(p & q) / max(1, min(len(p), len(q)))
    return shared if kind == "t:" else _overlap(x[kind], y[kind])


def pair_score(old: str, a: Counter, new: str, b: Counter, shared: float) -> float:
    """How much a removed and an added field look like one field under two names.

    Texts and objects are recognised by what they hold; numbers and booleans, whose values say less, need
    a likeness of names or the same parent besides.
    """
    a, b = _plain(a), _plain(b)
    content, name = content_similarity(a, b, shared), name_similarity(old, new)
    top = Counter()
    for f, n in a.items():
        if f[:2] in ("t:", "n:", "b:", "o:"):
            top[f[:2]] += n
    kind = top.most_common(1)[0][0] if top else ""
    if not kind or not any(f[:2] in ("t:", "n:", "b:", "o:") for f in b):  # nothing but nulls: only the names speak
        return 0.6 * name if name >= 0.75 else 0.0
    if content <= 0.05:
        return 0.0
    if kind == "t:":
        return min(1.0, content * 1.3) * 0.8 + 0.2 * name if content >= 0.25 else 0.5 * content * (1 + name)
    if kind == "o:":
        return 0.8 * content + 0.2 * name if content >= 0.5 else 0.4 * content
    if kind == "b:":
        same_parent = old.rpartition(".")[0] == new.rpartition(".")[0]
        return content * (0.55 * content + 0.45 * max(name, 0.3 if same_parent else 0.0)) if content > 0.75 or name > 0.5 else 0.0
    return min(1.0, content * (0.3 + name))


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a maximum-weight bipartite matching (successive shortest augmenting paths with potentials)."""
    if not score.size:
        return []
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            slack = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][~used[1:]] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(j, i) if flip else (i, j) for i, j in pairs]


def _inside(path: str, roots: set[str]) -> bool:
    return any(path.startswith(f"{r}.") for r in roots)


def match_fields(removed: dict[str, Counter], added: dict[str, Counter], shared: dict[tuple[str, str], float]) -> list[tuple[str, str, float]]:
    """Renames among removed and added fields: whole subtrees first, then fields that left a removed object
    or went into an added one. ``shared``: likeness of the tokens of (removed, added) fields that have any in common."""
    found: list[tuple[str, str, float]] = []

    def take(olds: list[str], news: list[str]) -> None:
        score = np.array([[pair_score(o, removed[o], n, added[n], shared.get((o, n), 0.0)) for n in news] for o in olds]).reshape(len(olds), len(news))
        found.extend((olds[i], news[j], float(score[i, j])) for i, j in assign(np.where(score >= RENAME_SCORE, score, 0.0)) if score[i, j] >= RENAME_SCORE)

    top_old = [p for p in removed if not _inside(p, set(removed))]
    top_new = [p for p in added if not _inside(p, set(added))]
    take(sorted(top_old), sorted(top_new))
    done_old, done_new = {o for o, _, _ in found}, {n for _, n, _ in found}
    left_old = sorted(p for p in removed if p not in top_old and not _inside(p, done_old))
    left_new = sorted(p for p in added if p not in top_new and not _inside(p, done_new))
    take(left_old, sorted(set(top_new) - done_new))
    done_new = {n for _, n, _ in found}
    done_old = {o for o, _, _ in found}
    take(sorted(set(top_old) - done_old), [p for p in left_new if p not in done_new])
    return found


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    sides: dict[str, dict[str, Counter]] = {"removed": defaultdict(Counter), "added": defaultdict(Counter)}
    shared: dict[tuple[str, str], float] = {}
    for kind, path, feature, n, share in zip(pdf["change_kind"], pdf["field_path"], pdf["feature"], pdf["n"], pdf["share"], strict=True):
        if kind == "shared":
            shared[path, feature] = share
        else:
            sides[kind][path][feature] += n
    feed, file_no = pdf["feed"].iloc[0], pdf["file_no"].iloc[0]
    renames = match_fields(sides["removed"], sides["added"], shared)
    old, new = {o for o, _, _ in renames}, {n for _, n, _ in renames}
    rows = [(feed, file_no, "renamed", o, n, s) for o, n, s in renames]
    for kind, done in (("removed", old), ("added", new)):
        rows += [(feed, file_no, kind, p, "", None) for p in sides[kind] if p not in done and not _inside(p, set(sides[kind]) | done)]
    return pd.DataFrame(rows, columns=["feed", "file_no", "change_kind", "field_path", "new_path", "score"])


def _with_shared_tokens(detail: DataFrame) -> DataFrame:
    """Sketch entries of removed and added fields with each field's tokens as one entry ``t:``, and an entry of kind ``shared``
    (removed path, added path as feature, share) for each pair of fields with a token in common."""
    unit = ["feed", "file_no", "change_kind", "field_path"]
    is_token = F.col("feature").startswith("t:")
    tokens = detail.filter(is_token)
    totals = tokens.groupBy(*unit).agg(F.sum("n").alias("n"))
    parts = sort_join(tokens, totals.withColumnRenamed("n", "total"), unit).select(*unit, "feature", (F.col("n") / F.col("total")).alias("part"))
    old = parts.filter("change_kind = 'removed'").select("feed", "file_no", "feature", "field_path", F.col("part").alias("old"))
    new = parts.filter("change_kind = 'added'").select("feed", "file_no", "feature", F.col("field_path").alias("new_path"), F.col("part").alias("new"))
    # Rounded, so that the order of adding up changes nothing.
    pairs = sort_join(old, new, ["feed", "file_no", "feature"]).groupBy("feed", "file_no", "field_path", "new_path").agg(F.round(F.sum(F.least("old", "new")), 12).alias("share"))
    none = F.lit(None).cast("double").alias("share")
    return (
        detail.filter(~is_token).select(*unit, "feature", "n", none)
        .unionByName(totals.select(*unit, F.lit("t:").alias("feature"), "n", none))
        .unionByName(pairs.select("feed", "file_no", F.lit("shared").alias("change_kind"), "field_path", F.col("new_path").alias("feature"), F.lit(0).cast("bigint").alias("n"), "share"))
    )


CHANGES = "feed string, file_no int, change_kind string, field_path string, new_path string, score double"


def _outside(rows: DataFrame, covers: DataFrame) -> DataFrame:
    """Rows (feed, file_no, field_path) with no ancestor among ``covers`` (feed, file_no, path): every path is spread into its
    few ancestors and looked up, so fields and covers are never paired."""
    parts = F.split("field_path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    inner = rows.filter(F.size(parts) > 1).select("feed", "file_no", "field_path", F.explode(above).alias("path"))
    hit = sort_join(inner, covers.distinct(), ["feed", "file_no", "path"], "left_semi").select("feed", "file_no", "field_path").distinct()
    return sort_join(rows, hit, ["feed", "file_no", "field_path"], "left_anti")


def changes(lines: DataFrame, kinds: DataFrame) -> DataFrame:
    """Every change of a file against the file before it in its feed; ``kinds``: the staged :func:`profile` of the lines.

    ``change_kind`` is added, removed, renamed or type_changed; ``new_path`` is '' unless renamed; ``score`` is the
    likeness of a renamed pair. Kinds are compared with those of the last earlier file in which the
    field had a value that is not null. What lies inside a reported field is not reported again. A file
    without a predecessor gives no rows, nor does empty input.
    """
    fields = kinds.filter("path <> ''").groupBy("feed", "file_no", "path").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("feature").startswith("k:") & (F.col("feature") != "k:null"), F.col("feature")))), "|").alias("kinds")
    )
    files = kinds.select("feed", "file_no").distinct()
    fields = stage(fields)
    # All of these grow with the files, so none is broadcast.
    follows = sort_join(files.select("feed", (F.col("file_no") - 1).alias("file_no")), files, ["feed", "file_no"]).select("feed", (F.col("file_no") + 1).alias("file_no"))
    before = sort_join(fields.select("feed", (F.col("file_no") + 1).alias("file_no"), "path", F.lit(1).alias("old")), follows, ["feed", "file_no"])
    now = sort_join(fields.withColumn("new", F.lit(1)), follows, ["feed", "file_no"])
    moved = sort_join(before, now, ["feed", "file_no", "path"], "full").filter("old is null or new is null").select(
        "feed", "file_no", F.when(F.col("old").isNull(), "added").otherwise("removed").alias("change_kind"), F.col("path").alias("field_path")
    )
    w = Window.partitionBy("feed", "path").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    had = F.when(F.col("kinds") != "", F.col("kinds"))
    typed = (
        fields.withColumn("earlier", F.last(had, ignorenulls=True).over(w)).withColumn("last_no", F.max("file_no").over(w))
        .filter("kinds <> '' and earlier <> kinds and last_no = file_no - 1")
        .select("feed", "file_no", F.lit("type_changed").alias("change_kind"), F.col("path").alias("field_path"))
    )
    typed = stage(typed)
    # Fields under a field whose kinds changed belong to that report.
    moved = stage(_outside(moved, typed.select("feed", "file_no", F.col("field_path").alias("path"))))
    sides = moved.select(
        "feed", F.when(F.col("change_kind") == "removed", F.col("file_no") - 1).otherwise(F.col("file_no")).alias("at"), "file_no", "change_kind", "field_path"
    )
    wanted = sides.select("feed", F.col("at").alias("file_no"), F.col("field_path").alias("path"))
    # An entry without a feature keeps fields that hold nothing but nulls.
    entries = sketch(lines, wanted).unionByName(wanted.distinct().select("*", F.lit("k:").alias("feature"), F.lit(1).cast("bigint").alias("n")))
    detail = sort_join(sides, entries.select("feed", F.col("file_no").alias("at"), F.col("path").alias("field_path"), "feature", "n"), ["feed", "at", "field_path"]).drop("at")
    # Matching one file is little work; by a number of partitions of its own it is spread however small the table is.
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = _with_shared_tokens(stage(detail)).repartition(parts, "feed", "file_no")
    matched = stage(spread.groupBy("feed", "file_no").applyInPandas(_match, CHANGES))
    reported = matched.filter("change_kind <> 'type_changed'").select("feed", "file_no", F.explode(F.array("field_path", F.nullif("new_path", F.lit("")))).alias("path")).filter("path is not null")
    covers = reported.unionByName(typed.select("feed", "file_no", F.col("field_path").alias("path")))
    kept = _outside(typed, covers).select("feed", "file_no", "change_kind", "field_path", F.lit("").alias("new_path"), F.lit(None).cast("double").alias("score"))
    return matched.unionByName(kept)


def _origins(pdf: pd.DataFrame) -> pd.DataFrame:
    """Columns of the renamed fields of each file of one feed, following its changes through the files in order.

    A renamed field keeps the column of its first name. A field added under that name while the renamed one is still there is
    another field: its column is the name with the file's number.
    """
    feed = pdf["feed"].iloc[0]
    column: dict[str, str] = {}
    owner: dict[str, str] = {}
    rows = []
    for file_no, part in sorted(pdf.groupby("file_no"), key=lambda x: x[0]):
        of = {kind: sorted(zip(p["field_path"], p["new_path"], strict=True)) for kind, p in part.groupby("change_kind")}
        moved = []
        for old, new in of.get("renamed", []):
            under = {k for k in column if k == old or k.startswith(f"{old}.")} | {old}
            moved += [(new + k[len(old) :], resolve(k, column)) for k in under]
            for k in under:
                owner.pop(column.pop(k, ""), None)
        for path, origin in moved:
            column[path] = origin
            owner[origin] = path
        for path, _ in of.get("removed", []):
            for k in [k for k in column if k == path or k.startswith(f"{path}.")]:
                if owner.get(column[k]) == k:
                    del owner[column[k]]
        for path, _ in of.get("added", []):
            if owner.get(resolve(path, column), path) != path:
                column[path] = f"{path}@{file_no}"
            if path in column:
                owner[column[path]] = path
        rows.append((feed, int(file_no), json.dumps(column)))
    return pd.DataFrame(rows, columns=["feed", "file_no", "names"])


def resolve(path: str, column: dict[str, str]) -> str:
    """The column of a field: its own entry, or that of the nearest object around it, or its path."""
    head = path
    while head:
        if head in column:
            return column[head] + path[len(head) :]
        head = head.rpartition(".")[0]
    return path


class _Real(float):
    """A number with a point or exponent, as written."""

    text: str

    @classmethod
    def read(cls, text: str) -> "_Real":
        out = cls(text)
        out.text = text
        return out


def to_text(value: object) -> str:
    """JSON of a value, however deep."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        out: list[str] = []
        todo: list = [value]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                out.append(x[0])
            elif isinstance(x, dict):
                inner = [y for k, v in x.items() for y in ((", ",), (f"{json.dumps(k, ensure_ascii=False)}: ",), v)][1:]
                todo += [("}",), *reversed(inner), ("{",)]
            elif isinstance(x, list):
                todo += [("]",), *reversed([y for v in x for y in ((", ",), v)][1:]), ("[",)]
            else:
                out.append(json.dumps(x, ensure_ascii=False))
        return "".join(out)


def _cell(value: object) -> str:
    """A cell as text, its first letter telling its kind: integers (those that doubles hold exactly, other 64-bit ones, larger
    ones), other numbers, booleans, texts, arrays and empty objects."""
    if isinstance(value, bool):
        return f"b{str(value).lower()}"
    if isinstance(value, int):
        return f"{'i' if abs(value) <= 1 << 53 else 'l' if -(1 << 63) <= value < 1 << 63 else 'h'}{value}"
    if isinstance(value, _Real):
        return f"{'d' if math.isfinite(value) else 'h'}{value.text}"
    return f"s{value}" if isinstance(value, str) else f"j{to_text(value)}"


def column_type(kinds: set[str]) -> str:
    """The one type of a column that loses nothing of its cells."""
    if kinds <= {"i", "l"}:
        return "bigint"
    if kinds <= {"i", "d"}:
        return "double"
    return "boolean" if kinds == {"b"} else "string"


def column_names(paths: list[str], taken: list[str]) -> dict[str, str]:
    """Column names of paths: dots become ``__``; names that are taken, letter case aside, get a number."""
    used, names = {t.lower() for t in taken}, {}
    for path in sorted(paths):
        base = name = path.replace(".", "__")
        k = 2
        while name.lower() in used:
            name, k = f"{base}__{k}", k + 1
        used.add(name.lower())
        names[path] = name
    return names


def unify(lines: DataFrame, kinds: DataFrame, found: DataFrame) -> DataFrame:
    """One table with the same columns for all files: feed, file_no, line_no and a column for each field under its first
    name (dots become ``__``; names that clash get a number). ``kinds`` and ``found``: staged :func:`profile` and :func:`changes`.

    A column has the type that loses nothing of any file's values: bigint if all are integers of 64 bits, double if all are
    numbers that doubles hold, boolean, else text: numbers as written, texts as they are (so "007" stays), objects and arrays as
    JSON. Absent and null cells are null. Lines that hold no object give no row; lines delivered
    again under the same feed, file and line number with the same payload give one.
    """
    marks = found.select("feed", "file_no", "change_kind", "field_path", "new_path").unionByName(
        kinds.select("feed", "file_no").distinct().select("feed", "file_no", F.lit("file").alias("change_kind"), F.lit("").alias("field_path"), F.lit("").alias("new_path"))
    )
    names = stage(marks.groupBy("feed").applyInPandas(_origins, "feed string, file_no int, names string"))
    flat = salted_lookup(lines.select("feed", "file_no", "line_no", "payload").dropDuplicates(), names, ["feed", "file_no"], ["line_no"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            known: dict[str, tuple[dict, dict]] = {}
            for feed, file_no, line_no, payload, text in zip(pdf["feed"], pdf["file_no"], pdf["line_no"], pdf["payload"], pdf["names"], strict=True):
                record = read_object(payload, parse_float=_Real.read)
                if record is None:
                    continue
                column, seen = known.setdefault(text, (json.loads(text) if text else {}, {}))
                cells = {}
                for path, value in walk(record):
                    if value is None or isinstance(value, dict) and value:
                        continue
                    if path not in seen:
                        seen[path] = resolve(path, column)
                    cells[seen[path]] = _cell(value)
                out.append((feed, file_no, line_no, cells))
            yield pd.DataFrame(out, columns=["feed", "file_no", "line_no", "cells"])

    cells = stage(flat.mapInPandas(rows, "feed string, file_no int, line_no int, cells map<string,string>"))
    each = cells.select(F.explode("cells").alias("path", "value"))
    # The columns of the result: as many rows as the schema has fields.
    columns = {r["path"]: column_type(set(r["kinds"])) for r in each.groupBy("path").agg(F.collect_set(F.substring("value", 1, 1)).alias("kinds")).collect()}
    names_of = column_names(list(columns), ["feed", "file_no", "line_no"])
    return cells.select("feed", "file_no", "line_no", *[F.substring(F.col("cells")[p], 2, 1 << 30).cast(columns[p]).alias(n) for p, n in names_of.items()])
