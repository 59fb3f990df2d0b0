"""Deeply nested records to related flat tables (problem 1).

Every object gets a *shape* from a bottom-up tree automaton: the state of a node is computed from the
states of its children. Its alphabet and transitions are fixed by the schema:

* leaf: ``-`` if null, else a letter for its kind;
* object: ``-`` if null, else ``{`` + the states of its fields + ``}``;
* array: ``-`` if null, ``[]`` if empty, else ``[`` + the sorted distinct states of its elements + ``]``.

The automaton is compiled into Spark expressions, so classification is one JVM-side pass. Elements of
the state ``-`` are no objects and are routed nowhere; any other state names the variant of its level. Every object is
written to the subtype table of its variant, which has just the fields that its members have, beside the
supertype's key and parent links; the supertype table is the union of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.common import best_per_key, stage


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "s"
    if isinstance(t, T.BooleanType):
        return "b"
    if isinstance(t, T.NumericType):
        return "n"
    return "o"


def is_object_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType)


class TreeAutomaton:
    """Deterministic bottom-up automaton over the objects that a schema allows."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def state(self, node: Column, t: T.DataType | None = None, *, arrays: bool = True) -> Column:
        """The state of ``node``; with ``arrays=False`` arrays of objects are left out, which gives the
        shape of the flat part of an object (what one row of its table can hold)."""
        t = t or self.schema
        if isinstance(t, T.StructType):
            parts = [self.state(node[f.name], f.dataType, arrays=arrays) for f in t.fields if arrays or not is_object_array(f.dataType)]
            return F.when(node.isNull(), F.lit("-")).otherwise(F.concat(F.lit("{"), *parts, F.lit("}")))
        if isinstance(t, T.ArrayType):
            inner = F.array_sort(F.array_distinct(F.transform(node, lambda x: self.state(x, t.elementType, arrays=arrays))))
            return (
                F.when(node.isNull(), F.lit("-"))
                .when(F.size(node) == 0, F.lit("[]"))
                .otherwise(F.concat(F.lit("["), F.array_join(inner, "|"), F.lit("]")))
            )
        return F.when(node.isNull(), F.lit("-")).otherwise(F.lit(_kind(t)))

    @staticmethod
    def members(state: str, t: T.StructType) -> list[str]:
        """The top-level fields that are present in objects of this state (the automaton run backwards)."""
        found, at = [], 1
        for f in t.fields:
            if is_object_array(f.dataType):
                continue
            end = at + 1
            if state[at] in "{[":
                depth = 0
                for end in range(at, len(state)):
                    depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(state[end], 0)
                    if not depth:
                        break
                end += 1
            if state[at] != "-":
                found.append(f.name)
            at = end
        return found


@dataclass
class Level:
    """One kind of object: the record itself or the elements of an array of objects."""

    name: str
    path: tuple[str, ...]
    schema: T.StructType
    parent: "Level | None" = None
    natural_key: str | None = None
    full: tuple[str, ...] = ()
    columns: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _flat(t: T.StructType, at: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    out: list = []
    for f in t.fields:
        if isinstance(f.dataType, T.StructType):
            out += _flat(f.dataType, (*at, f.name))
        elif not is_object_array(f.dataType):
            out.append(((*at, f.name), f.dataType))
    return out


def short_names(paths: list[tuple[str, ...]], taken: set[str] = frozenset()) -> dict[str, tuple[str, ...]]:
    """Column names for nested leaves: the shortest tail of the path that no other leaf shares."""
    names: dict[str, tuple[str, ...]] = {}
    for p in paths:
        for k in range(1, len(p) + 1):
            name = "_".join(p[-k:])
            if name not in taken and sum("_".join(q[-k:]) == name for q in paths) == 1:
                break
        else:
            name = "__".join(("", *p))
        names[name] = p
    return names


class NestedTables:
    """Flat tables of a nested DataFrame.

    ``key`` names a record. Several rows of one key are deliveries of one record: the fullest one (arrays
    neither null nor empty), then the latest by ``version``, is taken. Without ``version`` the choice
    among equally full deliveries is by hash. ``names`` gives levels by array path their table name and
    natural key, e.g. ``{("tasks",): ("task", "task_key")}``.

    Rows with a null key are deliveries of one record without a key. Null elements of arrays are no objects and give no row. Null or empty arrays give no child rows. An
    object all of whose fields are null is a row. Positions (``task_pos``, from 0) link children to
    parents even where natural keys are null or repeated. Fields with clashing names are told apart by
    more of their path. An empty input gives empty tables.
    """

    def __init__(self, df: DataFrame, key: str, *, root: str = "record", version: str | None = None, names: dict[tuple[str, ...], tuple[str, str | None]] | None = None):
        self.df, self.key, self.version = df, key, version
        self.automaton = TreeAutomaton(df.schema)
        self.levels: dict[str, Level] = {}
        self._walk(Level(root, (), df.schema), names or {})

    def _walk(self, level: Level, names: dict) -> None:
        taken: set[str] = set()
        up = level.parent
        while up:
            taken |= {f"{up.name}_pos", up.natural_key or ""}
            up = up.parent
        if level.path:
            taken |= {self.key, f"{level.name}_pos", "shape"}
        level.columns = short_names([p for p, _ in _flat(level.schema)], taken)
        self.levels[level.name] = level
        for at, t in self._arrays(level.schema):
            full = (*level.full, *at)
            name, natural = names.get(full, ("_".join(full), None))
            self._walk(Level(name, at, t.elementType, level, natural, full), names)

    @staticmethod
    def _arrays(t: T.StructType, at: tuple[str, ...] = ()) -> list:
        out: list = []
        for f in t.fields:
            if isinstance(f.dataType, T.StructType):
                out += NestedTables._arrays(f.dataType, (*at, f.name))
            elif is_object_array(f.dataType):
                out.append(((*at, f.name), f.dataType))
        return out

    def _chain(self, level: Level) -> list[Level]:
        chain = []
        at: Level | None = level
        while at and at.parent:
            chain.insert(0, at)
            at = at.parent
        return chain

    def _rows(self, chain: list[Level], node: Column | None, keys: list[Column], wanted: list[str] | None) -> Column:
        """Expression: the array of flat rows that one record gives for the last level of the chain."""
        here, rest = chain[0], chain[1:]
        array = F.col(here.path[0]) if node is None else node[here.path[0]]
        for part in here.path[1:]:
            array = array[part]

        def row(x: Column, i: Column) -> Column:
            own = [*keys, i.alias(f"{here.name}_pos")]
            if rest:
                if here.natural_key:
                    own.append(x[here.natural_key].alias(here.natural_key))
                return self._rows(rest, x, own, wanted)
            leaves = []
            for name, path in here.columns.items():
                if wanted is None or name in wanted:
                    leaf = x
                    for part in path:
                        leaf = leaf[part]
                    leaves.append(leaf.alias(name))
            if wanted is not None and "shape" not in wanted:
                return F.when(x.isNotNull(), F.struct(*own, *leaves))
            # Null elements get the state ``-``; the routing drops them.
            return F.struct(*own, *leaves, self.automaton.state(x, here.schema, arrays=False).alias("shape"))

        found = F.filter(F.transform(array, row), lambda r: r.isNotNull())
        return F.flatten(found) if rest else found

    def _fullness(self) -> list[Column]:
        full = []
        for at, _ in self._arrays(self.df.schema):
            array = F.col(at[0])
            for part in at[1:]:
                array = array[part]
            full.append((F.coalesce(F.size(array), F.lit(0)) > 0).cast("int"))
        rank = [sum(full[1:], full[0])] if full else []
        return rank + ([F.col(self.version)] if self.version else [])

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """The supertype table of one level. ``columns`` prunes what is read and moved, leaving out
        ``shape`` spares its computation."""
        level = self.levels[name]
        if not level.parent:
            picked = {n: p for n, p in level.columns.items() if columns is None or n in columns or n == self.key}
            leaves = []
            for n, p in picked.items():
                leaf = F.col(p[0])
                for part in p[1:]:
                    leaf = leaf[part]
                leaves.append(leaf.alias(n))
            if columns is None or "shape" in columns:
                record = F.struct(*[F.col(f.name) for f in self.df.schema.fields if not is_object_array(f.dataType)])
                leaves.append(self.automaton.state(record, T.StructType([f for f in self.df.schema.fields if not is_object_array(f.dataType)]), arrays=False).alias("shape"))
            order = self._fullness()
            flat = self.df.select(*leaves, *[o.alias(f"__o{i}") for i, o in enumerate(order)])
            payload = [c for c in flat.columns if c != self.key and not c.startswith("__o")]
            best = best_per_key(flat, [self.key], payload or ["__o0"], [F.col(f"__o{i}") for i in range(len(order))])
            return best.select(*[c for c in flat.columns if not c.startswith("__o")])
        rows = self._rows(self._chain(level), None, [], columns)
        order = self._fullness()
        flat = self.df.select(self.key, rows.alias("__rows"), *[o.alias(f"__o{i}") for i, o in enumerate(order)])
        best = best_per_key(flat, [self.key], ["__rows"], [F.col(f"__o{i}") for i in range(len(order))])
        out = best.select(self.key, F.inline("__rows"))
        return out.filter("shape <> '-'") if "shape" in out.columns else out

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in self.levels}

    def route(self, name: str, columns: list[str] | None = None) -> "Subtypes":
        """Write every object of a level to the table of its variant, in one pass; ``columns`` prunes as in :meth:`table`."""
        wanted = None if columns is None else [*columns, "shape"]
        rows = self.table(name, wanted).withColumn("variant", F.md5("shape"))
        return Subtypes(self, self.levels[name], stage(rows, partition_by=["variant"]))

    def variants(self, name: str) -> DataFrame:
        """The shapes of a level with the number of objects of each."""
        return self.table(name, columns=["shape"]).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))

    def whole_variants(self) -> DataFrame:
        """The shapes of whole records, arrays and all that is in them included, with the number of records of each."""
        order = [o.alias(f"__o{i}") for i, o in enumerate(self._fullness())]
        flat = self.df.select(self.key, self.automaton.state(F.struct(*[F.col(f"`{c}`") for c in self.df.columns])).alias("shape"), *order)
        best = best_per_key(flat, [self.key], ["shape"], [F.col(f"__o{i}") for i in range(len(order))])
        return best.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))

    def subtype(self, name: str, shape: str) -> DataFrame:
        """The typed table of one variant: key and parent links, and only the fields its members have."""
        return self.route(name).table(shape)


@dataclass
class Subtypes:
    """The subtype tables of one level: a folder for each variant, which holds its objects and nothing else."""

    tables: NestedTables
    level: Level
    rows: DataFrame

    def shapes(self) -> list[str]:
        """The variants that have objects; as many as the schema's fields are absent in different ways."""
        return sorted(r["shape"] for r in self.rows.select("shape").distinct().collect())

    def table(self, shape: str) -> DataFrame:
        """The typed table of one variant: only its folder is read, and only the fields its members have."""
        level = self.level
        whole = T.StructType([f for f in level.schema.fields if level.parent or not is_object_array(f.dataType)])
        present = set(self.tables.automaton.members(shape, whole))
        absent = [n for n, p in level.columns.items() if p[0] not in present and n != self.tables.key]
        return self.rows.filter((F.col("variant") == F.md5(F.lit(shape))) & (F.col("shape") == shape)).drop(*absent, "shape", "variant")

    def union(self) -> DataFrame:
        """The supertype table: all variants, fields that a variant has not being null. One scan of all folders."""
        return self.rows.drop("shape", "variant")


def job_run_tables(df: DataFrame) -> NestedTables:
    """Run, task, attempt and error tables of job runs."""
    return NestedTables(
        df, "run_id", root="run", version="received_at",
        names={("tasks",): ("task", "task_key"), ("tasks", "attempts"): ("attempt", "attempt_no"), ("tasks", "attempts", "errors"): ("error", "code")},
    )
