"""The semantic model: sources, dimensions, measures, keys and joins.

These are plain declarations. They hold SQL expression text and names; the data stays
in DataFrames and ``semaspark.plans.query.run`` turns a question into one plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.functions.exact import exact_parts, exact_total


class ModelError(ValueError):
    """A declaration or a query that the model cannot answer."""


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Dimension:
    name: str
    expr: str


def dim(name: str, expr: str) -> Dimension:
    """A calculated dimension; ``expr`` is a Spark SQL expression."""
    return Dimension(name, expr)


def rename(name: str, column: str) -> Dimension:
    """A renamed column. Any identifier is accepted: it is quoted here."""
    return Dimension(name, quoted(column))


@dataclass(frozen=True)
class Measure:
    """An aggregate. ``scale`` makes ``sum``/``avg`` exact for values with that many decimals."""

    name: str
    op: str
    expr: str | None = None
    scale: int | None = None

    def __post_init__(self) -> None:
        if self.op not in ("count", "sum", "avg", "min", "max", "count_distinct"):
            raise ModelError(f"measure {self.name}: unknown aggregate {self.op}")
        if self.expr is None and self.op != "count":
            raise ModelError(f"measure {self.name}: {self.op} needs an expression")

    def input(self) -> Column:
        """The value that is aggregated; a row marker for ``count()``."""
        return F.lit(1) if self.expr is None else F.expr(self.expr)

    def aggregate(self, col: Column) -> Column:
        if self.op == "count_distinct":
            return F.count_distinct(col)
        return self.merge(self.partials(col))

    def partials(self, col: Column) -> dict[str, Column]:
        """Aggregates per key that ``combine`` can merge without loss."""
        if self.op == "count":
            return {"n": F.count(col)}
        if self.op == "min":
            return {"min": F.min(col)}
        if self.op == "max":
            return {"max": F.max(col)}
        parts = {"sum": F.sum(col)} if self.scale is None else exact_parts(col, self.scale)
        return parts if self.op == "sum" else {**parts, "n": F.count(col)}

    def merged(self, parts: dict[str, Column]) -> dict[str, Column]:
        """Partial results of several groups as those of all their rows."""
        again = {"n": lambda c: F.sum(F.coalesce(c, F.lit(0))), "min": F.min, "max": F.max}
        return {k: again.get(k, F.sum)(c) for k, c in parts.items()}

    def combine(self, parts: dict[str, Column]) -> Column:
        return self.merge(self.merged(parts))

    def merge(self, parts: dict[str, Column]) -> Column:
        if self.op in ("count", "min", "max"):
            return parts["n" if self.op == "count" else self.op]
        total = parts["sum"] if self.scale is None else exact_total(parts, self.scale)
        return total if self.op == "sum" else F.try_divide(total.cast("double"), parts["n"])


def row_count(name: str = "row_count") -> Measure:
    return Measure(name, "count")


def measure(op: str, column: str, name: str | None = None, scale: int | None = None) -> Measure:
    """``measure('sum', 'l_tax')`` is named ``total_l_tax``; other aggregates keep their own prefix."""
    prefix = "total" if op == "sum" else op
    return Measure(name or f"{prefix}_{column}", op, quoted(column), scale)


def sum_alias(column: str, scale: int | None = None) -> Measure:
    """The same sum under the ``sum_<column>`` convention."""
    return measure("sum", column, f"sum_{column}", scale)


def numeric_measures(column: str, scale: int | None = None) -> tuple[Measure, ...]:
    """The four standard measures of a numeric column."""
    return tuple(measure(op, column, scale=scale) for op in ("sum", "avg", "max", "min"))


@dataclass(frozen=True)
class Join:
    name: str
    target: str
    on: tuple[tuple[str, str], ...] = ()
    with_: str | None = None
    many: bool = False


def join_one(name: str, on: list[tuple[str, str]] | None = None, *, of: str | None = None,
             with_: str | None = None) -> Join:
    """Many-to-one. ``of`` names the target when ``name`` is an alias; ``with_`` joins a
    column of this source to the declared key of the target."""
    if (on is None) == (with_ is None):
        raise ModelError(f"join {name}: give either on= or with_=")
    return Join(name, of or name, tuple(on or ()), with_)


def join_many(name: str, on: list[tuple[str, str]], *, of: str | None = None) -> Join:
    return Join(name, of or name, tuple(on), None, True)


@dataclass(frozen=True)
class Source:
    name: str
    load: Callable[[], DataFrame] = field(compare=False, repr=False)
    dimensions: tuple[Dimension, ...] = ()
    measures: tuple[Measure, ...] = ()
    primary_key: tuple[str, ...] = ()
    joins: tuple[Join, ...] = ()

    @staticmethod
    def table(spark: SparkSession, name: str, path: str) -> Source:
        """A parquet path, or a table of the session catalog if ``path`` has no slash."""
        if "/" in path:
            return Source(name, _once(lambda: spark.read.parquet(path)))
        return Source(name, _once(lambda: spark.table(path)))

    @staticmethod
    def sql(spark: SparkSession, name: str, text: str) -> Source:
        return Source(name, _once(lambda: spark.sql(text)))

    @staticmethod
    def of(name: str, df: DataFrame) -> Source:
        """Any DataFrame, such as the answer of another query."""
        return Source(name, lambda: df)

    def extend(self, dimensions=(), measures=(), primary_key=(), joins=()) -> Source:
        key = (primary_key,) if isinstance(primary_key, str) else tuple(primary_key)
        return replace(
            self,
            dimensions=self.dimensions + tuple(dimensions),
            measures=self.measures + tuple(measures),
            primary_key=key or self.primary_key,
            joins=self.joins + tuple(joins),
        )

    def frame(self) -> DataFrame:
        return self.load()

    def field_names(self) -> list[str]:
        return self.frame().columns + [d.name for d in self.dimensions]

    def measure(self, name: str) -> Measure:
        for m in self.measures:
            if m.name == name:
                return m
        raise ModelError(f"source {self.name} has no measure {name}")

    def dimension(self, name: str) -> Dimension | None:
        return next((d for d in self.dimensions if d.name == name), None)

    def join(self, name: str) -> Join | None:
        return next((j for j in self.joins if j.name == name), None)

    def check(self) -> None:
        """Reject names Spark cannot tell apart: they would differ only by case."""
        seen: dict[str, str] = {}
        named = self.field_names() + [m.name for m in self.measures] + [j.name for j in self.joins]
        for name in named:
            other = seen.setdefault(name.lower(), name)
            if named.count(name) > 1 or other != name:
                raise ModelError(f"source {self.name}: {name} collides with {other}")


def _once(load: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    held: list[DataFrame] = []

    def get() -> DataFrame:
        if not held:
            held.append(load())
        return held[0]

    return get


@dataclass(frozen=True)
class Model:
    sources: dict[str, Source]

    @staticmethod
    def build(*sources: Source) -> Model:
        model = Model({s.name: s for s in sources})
        if len(model.sources) != len(sources):
            raise ModelError("two sources share a name")
        for s in sources:
            for j in s.joins:
                model.join_keys(s, j)
        return model

    def source(self, name: str) -> Source:
        if name not in self.sources:
            raise ModelError(f"no source {name}")
        return self.sources[name]

    def join_keys(self, source: Source, join: Join) -> tuple[tuple[str, str], ...]:
        """Pairs (field here, field of the target); resolves ``with_`` to the target's key."""
        target = self.source(join.target)
        if join.with_ is None:
            return join.on
        if len(target.primary_key) != 1:
            raise ModelError(f"join {source.name}.{join.name}: {target.name} needs one primary key column")
        return ((join.with_, target.primary_key[0]),)


# A string literal, a quoted identifier, or a dotted path outside both.
_TOKEN = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]+`(?:\.(?:\w+|`[^`]+`))*|[A-Za-z_]\w*(?:\.(?:\w+|`[^`]+`))+""")


def split_path(path: str) -> tuple[tuple[str, ...], str]:
    """``'a.b.c'`` -> (('a', 'b'), 'c')."""
    parts = [p.strip("`") for p in re.findall(r"`[^`]+`|[^.]+", path)]
    return tuple(parts[:-1]), parts[-1]


def mentioned(source: Source, expr: str) -> list[str]:
    """Dimensions of ``source`` that reach into joins and that ``expr`` names without a path."""
    bare = re.sub(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*\"""", "", expr)
    words = set(re.findall(r"(?<![\w.`])\w+(?![\w.`(])|(?<=`)[^`]+(?=`)", bare))
    return [d.name for d in source.dimensions if d.name in words and resolve_paths(source, d.expr)[1]]


def resolve_paths(source: Source, expr: str) -> tuple[str, set[tuple[str, ...]]]:
    """Replace join paths in ``expr`` by the flat column names of the joined frame, and
    list the paths. Text inside literals and dots that start with no join are left alone."""
    used: set[tuple[str, ...]] = set()

    def swap(match: re.Match) -> str:
        text = match.group(0)
        if text[0] in "'\"" or "." not in text:
            return text
        path, name = split_path(text)
        if not path or source.join(path[0]) is None:
            return text
        used.add((*path, name))
        return quoted(".".join((*path, name)))

    return _TOKEN.sub(swap, expr), used
