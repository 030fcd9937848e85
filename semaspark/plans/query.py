"""Turn a question over a model into one DataFrame plan.

Only the joins a question mentions are added. A one-to-many join never multiplies the
rows a measure above it sees: its side is reduced to one row per join key and grouped fields first, from the
deepest side upwards, so each side is shuffled once, after map-side combining, and sides next to each other meet as partial
results, not as rows. Measures of a source behind a many-to-one join count each of its rows once per group; all of one
path share a plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspark.plans.model import (Join, Measure, Model, ModelError, Source, mentioned, quoted, resolve_paths,
                                   split_path)


@dataclass
class _Need:
    """What a question asks of one source: fields, measure inputs and joins below it."""

    source: Source
    fields: set[str] = field(default_factory=set)
    measures: dict[str, Measure] = field(default_factory=dict)
    joins: dict[str, _Need] = field(default_factory=dict)


def _below(model: Model, need: _Need, path: tuple[str, ...]) -> _Need:
    for name in path:
        join = need.source.join(name)
        if join is None:
            raise ModelError(f"source {need.source.name} has no join {name}")
        if name not in need.joins:
            need.joins[name] = _Need(model.source(join.target))
        need = need.joins[name]
    return need


def _want(model: Model, root: _Need, path: tuple[str, ...], name: str) -> None:
    need = _below(model, root, path)
    if name not in need.source.field_names():
        raise ModelError(f"source {need.source.name} has no field {name}")
    need.fields.add(name)
    declared = need.source.dimension(name)
    if declared:
        _want_all(model, need, declared.expr)


def _want_all(model: Model, need: _Need, expr: str, over_many: bool = False) -> None:
    """Everything an expression of this source reads through joins."""
    for used in resolve_paths(need.source, expr)[1]:
        if not over_many and _many_level(model, need.source, used[:-1]):
            raise ModelError(f"source {need.source.name}: {expr} reaches through a one-to-many join")
        _want(model, need, used[:-1], used[-1])
    for name in mentioned(need.source, expr):
        if name not in need.fields:
            _want(model, need, (), name)


def _many_level(model: Model, source: Source, path: tuple[str, ...]) -> tuple[str, ...]:
    """The path up to its last one-to-many join; empty if there is none."""
    level: tuple[str, ...] = ()
    for i, name in enumerate(path, 1):
        join = source.join(name)
        if join is None:
            raise ModelError(f"source {source.name} has no join {name}")
        level = path[:i] if join.many else level
        source = model.source(join.target)
    return level


def _input_name(measure: Measure) -> str:
    return f"__in_{measure.name}"


def _local_fields(source: Source) -> DataFrame:
    df = source.frame()
    local = [d for d in source.dimensions if not resolve_paths(source, d.expr)[1]]
    if local:
        df = df.select("*", *[F.expr(d.expr).alias(d.name) for d in local])
    return df


def _prefixed(df: DataFrame, name: str) -> DataFrame:
    """Columns under the name of their join; partial results and carried fields keep theirs."""
    return df.toDF(*[c if c.startswith(("__p", "__up")) else f"{name}.{c}" for c in df.columns])


def _condition(pairs: Iterable[tuple[str, str]], prefix: str) -> Column:
    return reduce(lambda a, b: a & b,
                  [F.col(quoted(left)) == F.col(quoted(f"{prefix}.{right}")) for left, right in pairs])


def one_row_per_key(df: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """Hold a join target to its contract: ``dedupe`` keeps the smallest row of each key,
    ``error`` stops the job at a key with two rows."""
    whole = F.struct(*[F.col(quoted(c)) for c in df.columns])
    grouped = df.dropna(subset=[quoted(k) for k in keys]).groupBy(*[F.col(quoted(k)) for k in keys])
    if policy == "dedupe":
        kept = grouped.agg(F.min(whole).alias("__row"))
    else:
        text = F.concat_ws(" ", F.lit("two rows for key"), F.concat_ws(",", *[F.col(quoted(k)).cast("string") for k in keys]))
        kept = (grouped.agg(F.min(whole).alias("__row"), F.count("*").alias("__n"))
                .withColumn("__row", F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(text))))
    return kept.select("__row.*")


def _aliased(item) -> tuple[str, tuple[str, ...], str]:
    alias, path = item if isinstance(item, tuple) else (None, item)
    joins, name = split_path(path)
    return alias or name, joins, name


def _flat(path: tuple[str, ...], name: str) -> str:
    return ".".join((*path, name))


def _keeps_unmatched(df: DataFrame, condition: str) -> bool:
    nulls = df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return bool(nulls.select(F.expr(condition).alias("kept")).head()["kept"])


def _conjuncts(where) -> list[str]:
    if not where:
        return []
    return [where] if isinstance(where, str) else list(where)


def _inside(path: tuple[str, ...], top: tuple[str, ...]) -> bool:
    return path[:len(top)] == top


@dataclass
class _Plan:
    """What one plan takes up through its many sides: fields by their full names, partial results of measures, and whole
    rows if ``raw``. Up to ``head`` the partial results of a row are fields of it; above the sides below ``head`` they are merged."""

    fields: set[str] = field(default_factory=set)
    measures: list[tuple[int, tuple[str, ...], Measure]] = field(default_factory=list)
    head: tuple[str, ...] = ()
    raw: bool = False


class _Question:
    def __init__(self, model: Model, source: str, policy: str | None) -> None:
        if policy not in (None, "trust", "dedupe", "error"):
            raise ModelError("on_violation is trust, dedupe or error")
        self.model, self.policy = model, policy
        self.root = _Need(model.source(source))
        self.fields: list[tuple[str, tuple[str, ...], str]] = []
        self.measures: list[tuple[str, tuple[str, ...], Measure]] = []
        # Condition, the fields it names, and the path of the side whose rows it decides on.
        self.filters: list[tuple[str, set[tuple[str, ...]], tuple[str, ...]]] = []

    def add_field(self, item) -> None:
        alias, path, name = _aliased(item)
        _want(self.model, self.root, path, name)
        self.fields.append((alias, path, name))

    def add_measure(self, item) -> None:
        alias, path, name = _aliased(item)
        need = _below(self.model, self.root, path)
        found = need.source.measure(name)
        need.measures[name] = found
        if found.expr is not None:
            _want_all(self.model, need, found.expr)
        self.measures.append((alias, path, found))

    def add_filter(self, text: str) -> None:
        rewritten, used = resolve_paths(self.root.source, text)
        _want_all(self.model, self.root, text, over_many=True)
        levels = sorted({_many_level(self.model, self.root.source, p[:-1]) for p in used}, key=len)
        level = levels[-1] if levels else ()
        if not all(_inside(level, other) for other in levels):
            raise ModelError(f"give one condition per one-to-many join: {text}")
        # Names without a path are fields of the root.
        bare = {(name,) for name in self.root.source.field_names() if _names(rewritten, name)} if level else set()
        self.filters.append((rewritten, used | bare, level))

    def _decides(self, path: tuple[str, ...]) -> bool:
        return any(level and _inside(level, path) for _, _, level in self.filters)

    def _frame(self, need: _Need, path: tuple[str, ...], plan: _Plan, keys: list[str] = (), down: DataFrame | None = None) -> DataFrame:
        """The source at ``path`` with its dimensions and its joins as ``join.field`` columns. A joined source brings its own
        joins along, so dimension chains collapse before they meet the larger side. ``down`` has fields of the sources above
        that conditions here compare with, by the ``keys`` of the join."""
        source = need.source
        df = _local_fields(source)
        for name, below in need.joins.items():
            join = source.join(name)
            if not join.many:
                pairs = self.model.join_keys(source, join)
                child = self._frame(below, (*path, name), plan, [r for _, r in pairs])
                df = df.join(_prefixed(child, name), _condition(pairs, name), "inner" if self._decides((*path, name)) else "left")
        late = [d for d in source.dimensions if d.name in need.fields and resolve_paths(source, d.expr)[1]]
        if late:
            df = df.select("*", *[F.expr(resolve_paths(source, d.expr)[0]).alias(d.name) for d in late])
        if need.measures:
            df = df.select("*", *[(F.lit(1) if m.expr is None else F.expr(resolve_paths(source, m.expr)[0])).alias(_input_name(m))
                                  for m in need.measures.values()])
        many = bool(path) and self._join(path).many
        if path and not many:
            declared = set(keys) == set(source.primary_key)
            policy = self.policy or ("trust" if declared else "error")
            if policy != "trust":
                df = one_row_per_key(df, list(keys), policy)
        if down is not None:
            same = reduce(lambda a, b: a & b, [F.col(quoted(k)) == F.col(f"__k{i}") for i, k in enumerate(keys)])
            df = df.join(down, same).drop(*[f"__k{i}" for i in range(len(keys))])
        df = self._filtered(df, path, many)
        for name, below in need.joins.items():
            join = source.join(name)
            if join.many:
                df = self._with_side(df, join, below, (*path, name), plan)
        return df

    def _join(self, path: tuple[str, ...]) -> Join:
        source = self.root.source
        for name in path[:-1]:
            source = self.model.source(source.join(name).target)
        return source.join(path[-1])

    def _filtered(self, df: DataFrame, path: tuple[str, ...], many: bool) -> DataFrame:
        if path and not many:
            return df
        names = df.columns
        full = [c.removeprefix("__up:") if c.startswith("__up:") else _flat(path, c) for c in names]
        for text, _, level in self.filters:
            if level != path:
                continue
            if path and _keeps_unmatched(df.toDF(*full), text):
                raise ModelError(f"condition also holds without a match, use where_not_in: {text}")
            df = df.toDF(*full).filter(F.expr(text)).toDF(*names)
        return df

    def _with_side(self, df: DataFrame, join: Join, below: _Need, path: tuple[str, ...], plan: _Plan) -> DataFrame:
        """``df`` with its many side, reduced to one row per key and field that is needed above."""
        above = sorted({_flat(u[:-1], u[-1]) for _, used, level in self.filters if _inside(level, path) for u in used if not _inside(u[:-1], path)})
        carried = {}
        for name in above:
            mine = name.removeprefix(".".join(path[:-1]) + ".") if len(path) > 1 else name
            have = mine if mine in df.columns else f"__up:{name}"
            if have not in df.columns:
                raise ModelError(f"a condition on {'.'.join(path)} cannot reach {name}")
            carried[f"__up:{name}"] = F.col(quoted(have))
        left, right = [a for a, _ in join.on], [b for _, b in join.on]
        down = None
        if carried:
            down = df.select(*[F.col(quoted(k)).alias(f"__k{i}") for i, k in enumerate(left)], *[c.alias(n) for n, c in carried.items()]).distinct()
        side = self._frame(below, path, plan, right, down)
        if not plan.raw:
            side = self._reduced(side, [*right, *carried], path, plan)
        matched = _condition(join.on, path[-1])
        for i, (name, c) in enumerate(carried.items()):
            side = side.withColumnRenamed(name, f"__up{i}")
            matched &= c.eqNullSafe(F.col(f"__up{i}"))
        return df.join(_prefixed(side, path[-1]), matched, "inner" if self._decides(path) else "left").drop(*[f"__up{i}" for i in range(len(carried))])

    def _reduced(self, side: DataFrame, keys: list[str], path: tuple[str, ...], plan: _Plan) -> DataFrame:
        start = ".".join(path) + "."
        fields = [n.removeprefix(start) for n in sorted(plan.fields) if n.startswith(start)]
        mine = [(i, p, m) for i, p, m in plan.measures if _inside(p, path)]
        if plan.head and _inside(plan.head, path):
            fields += [c for i, _, m in mine for c in _part_names(i, m)]
            mine = []
        parts = []
        for i, p, m in mine:
            made = m.partials(F.col(quoted(_input_name(m)))) if p == path else m.merged({k: F.col(f"__p{i}_{k}") for k in m.partials(F.lit(None))})
            parts += [c.alias(f"__p{i}_{k}") for k, c in made.items()]
        grouped = side.groupBy(*[F.col(quoted(c)) for c in dict.fromkeys([*keys, *fields])])
        return grouped.agg(*parts) if parts else grouped.agg(F.lit(1).alias("__found")).drop("__found")

    def check_names(self) -> None:
        names = [a.lower() for a, _, _ in self.fields + self.measures]
        if len(set(names)) != len(names):
            raise ModelError(f"output names collide, give ('alias', 'path'): {names}")

    def groups(self) -> list[Column]:
        return [F.col(quoted(_flat(p, n))).alias(alias) for alias, p, n in self.fields]

    def rows(self) -> DataFrame:
        return self._frame(self.root, (), _Plan(raw=True)).select(*self.groups())

    def answer(self) -> DataFrame:
        """Measures of the root and of sides below one-to-many joins come from one plan; those behind a many-to-one
        join, and distinct counts of a many side, from one plan per path, merged per group."""
        asked = {_flat(p, n) for _, p, n in self.fields}
        main, others = [], {}
        for i, (alias, path, m) in enumerate(self.measures):
            head = self._head(path)
            if m.op == "count_distinct" and path:
                others.setdefault((path, True), []).append((i, alias, path, m))
            elif head:
                others.setdefault((head, False), []).append((i, alias, path, m))
            else:
                main.append((i, alias, path, m))
        frames = [self._branch(head, distinct, found, asked) for (head, distinct), found in others.items()]
        if main or not others:
            plan = _Plan(asked, [(i, p, m) for i, _, p, m in main if p])
            joined = self._frame(self.root, (), plan)
            made = [(m.combine(_parts(i, m)) if p else m.aggregate(F.col(quoted(_input_name(m))))).alias(alias) for i, alias, p, m in main]
            frames.insert(0, joined.groupBy(*self.groups()).agg(*made) if made else joined.select(*self.groups()).distinct())
        if len(frames) == 1:
            return frames[0]
        names = [alias for alias, _, _ in self.fields]
        merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        return (merged.groupBy(*[F.col(quoted(n)) for n in names])
                .agg(*[F.max(F.col(quoted(alias))).alias(alias) for alias, _, _ in self.measures]))

    def _head(self, path: tuple[str, ...]) -> tuple[str, ...]:
        """The path up to its last many-to-one join."""
        return next((path[:i] for i in range(len(path), 0, -1) if not self._join(path[:i]).many), ())

    def _branch(self, head: tuple[str, ...], distinct: bool, found: list, asked: set[str]) -> DataFrame:
        """All measures of one path. Distinct counts need their values; others each row of the source at ``head`` once per group,
        with its own values and the partial results of the many sides below it."""
        names = [F.col(quoted(a)) for a, _, _ in self.fields]
        values = {f"__v{i}": _flat(path, _input_name(m)) for i, _, path, m in found if distinct or path == head}
        if distinct:
            joined = self._frame(self.root, (), _Plan(asked | set(values.values()), head=head))
            rows = joined.select(*self.groups(), *[F.col(quoted(c)).alias(v) for v, c in values.items()])
            return rows.groupBy(*names).agg(*[m.aggregate(F.col(f"__v{i}")).alias(alias) for i, alias, _, m in found])
        keys = _below(self.model, self.root, head).source.primary_key
        if not keys:
            raise ModelError(f"measure {'.'.join(head)}.{found[0][3].name} needs a primary key to count each row once")
        idents = {f"__id{j}": _flat(head, k) for j, k in enumerate(keys)}
        below = [(i, path, m) for i, _, path, m in found if path != head]
        joined = self._frame(self.root, (), _Plan(asked | set(values.values()) | set(idents.values()), below, head))
        parts = [c for i, _, m in below for c in _part_names(i, m)]
        kept = [F.col(quoted(c)).alias(v) for v, c in {**idents, **values}.items()]
        rows = joined.select(*self.groups(), *kept, *parts).dropDuplicates([a for a, _, _ in self.fields] + list(idents))
        there = F.col("__id0").isNotNull()
        rows = rows.withColumns({c: F.when(there, F.col(c)) for c in [*values, *parts]})
        return rows.groupBy(*names).agg(*[(m.aggregate(F.col(f"__v{i}")) if path == head else m.combine(_parts(i, m))).alias(alias) for i, alias, path, m in found])


def _names(expr: str, name: str) -> bool:
    """Whether the expression has ``name`` as a word outside texts and paths."""
    bare = re.sub(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*\"""", "", expr)
    return re.search(rf"(?<![\w.`]){re.escape(name)}(?![\w.`(])|`{re.escape(name)}`", bare) is not None


def _part_names(i: int, m: Measure) -> list[str]:
    return [f"__p{i}_{k}" for k in m.partials(F.lit(None))]


def _parts(i: int, m: Measure) -> dict[str, Column]:
    return {k: F.col(f"__p{i}_{k}") for k in m.partials(F.lit(None))}


def _sort(df: DataFrame, order_by, nulls: str) -> DataFrame:
    keys = []
    for item in [order_by] if isinstance(order_by, str) else order_by:
        name = item.removeprefix("-")
        if name not in df.columns:
            raise ModelError(f"order_by {name}: not an output field")
        col = F.col(quoted(name))
        if item.startswith("-"):
            keys.append(col.desc_nulls_last() if nulls == "last" else col.desc_nulls_first())
        else:
            keys.append(col.asc_nulls_last() if nulls == "last" else col.asc_nulls_first())
    return df.orderBy(*keys)


def run(model: Model, source: str, *, select=None, group_by=(), aggregate=(), where=None, having: str | None = None,
        order_by=(), limit: int | None = None, distinct: bool = False, nulls: str = "last",
        on_violation: str | None = None) -> DataFrame:
    """Answer one question.

    Fields are ``'name'``, ``'join.path.name'`` or ``('alias', 'join.path.name')``.
    ``where`` is a condition or a list of conditions that all hold; ``having`` and
    ``order_by`` (``'-name'`` for descending) speak of output names. A condition may compare a side with the sources above it.
    ``on_violation`` says what a many-to-one join does with a second row for a key: ``trust``, ``dedupe`` or ``error``. By
    default the declared key of a target is trusted, and a join by other columns stops at a second row.
    """
    if (select is None) == (not group_by and not aggregate):
        raise ModelError("give select=, or group_by= and/or aggregate=")
    q = _Question(model, source, on_violation)
    q.root.source.check()
    for text in _conjuncts(where):
        q.add_filter(text)
    if select is not None:
        for item in q.root.source.field_names() if select == "*" else select:
            q.add_field((item, quoted(item)) if select == "*" else item)
        q.check_names()
        out = q.rows().distinct() if distinct else q.rows()
    else:
        for item in group_by:
            q.add_field(item)
        for item in aggregate:
            q.add_measure(item)
        q.check_names()
        out = q.answer()
    if having:
        out = out.filter(F.expr(having))
    if order_by:
        out = _sort(out, order_by, nulls)
    return out if limit is None else out.limit(limit)
