"""Which tables the aliases of a query text stand for, scope by scope.

One pass over the tokens of a text keeps a stack of parentheses. Every SELECT opens a scope at its depth; FROM, JOIN and the commas of a
FROM clause bind names in the scope they stand in. A name means the binding of the nearest enclosing scope, wherever in
that scope it stands, so aliases of subqueries, of the parts of a union and of comma joins do not mix. It all happens inside
the row of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that end a FROM clause or say how tables are joined, none of which is an alias.
ENDS = ("where", "group", "order", "having", "limit", "union", "intersect", "except", "set", "offset", "window")
HOW = ("left", "right", "inner", "outer", "full", "cross", "natural", "as", "lateral")

_TOKENS = r"""(?U)--[^\n]*+|/\*[\s\S]*?\*/|'(?:[^']|'')*+'|"[^"]*+"|\w+\s*\.\s*\w+|\w+|[(),]|[<>!=]+"""
_STATE = ("struct<stack: array<struct<scope: int, mode: string>>, n: int, pending: string, binds: array<struct<scope: int, name: string, table: string>>, "
          "refs: array<struct<path: array<int>, t1: string, c1: string, t2: string, c2: string>>, left: struct<a: string, b: string>, equal: boolean>")


def _kind(t: Column) -> Column:
    """What a token is. Its first character tells strings and comments from words, and of the words only pairs have a dot."""
    return (F.when(t == "(", "open").when(t == ")", "close").when(t == ",", "comma").when(t.isin("=", "=="), "equal").when(t == "select", "select")
            .when(t.isin("from", "join"), "from").when(t.isin("on", "using"), "on").when(t.isin(*ENDS), "end").when(t.isin(*HOW), "how")
            .when(F.left(t, F.lit(1)).isin("'", '"', "-", "/", "<", ">", "!", "="), "other").when(t.contains("."), "pair").otherwise("name"))


def _tokens(sql: Column) -> Column:
    # The kind in a step of its own: it is asked three times below.
    kinds = F.transform(F.regexp_extract_all(sql, F.lit(_TOKENS), 0), lambda t: F.struct(_kind(t).alias("kind"), t.alias("t")))

    def parts(x: Column) -> Column:
        pair = x["kind"] == "pair"
        return F.struct(x["kind"].alias("kind"), F.when(pair, F.regexp_extract(x["t"], r"(?U)\A\w+", 0)).otherwise(x["t"]).alias("a"),
                        F.when(pair, F.regexp_extract(x["t"], r"(?U)\w+\z", 0)).alias("b"))

    return F.transform(kinds, parts)


def _step(acc: Column, tok: Column) -> Column:
    kind, stack = tok["kind"], acc["stack"]
    top = F.element_at(stack, -1)
    mode, scope = top["mode"], top["scope"]
    below = F.slice(stack, F.lit(1), F.size(stack) - 1)
    outer = F.try_element_at(below, F.lit(-1))

    def level(s: Column, m: Column | str) -> Column:
        return F.struct(s.alias("scope"), (F.lit(m) if isinstance(m, str) else m).alias("mode"))

    def put(m: Column | str) -> Column:
        return F.array_append(below, level(scope, m))

    inside, expects, names = kind.isin("name", "pair"), mode == "expect", kind.isin("name", "pair") & (mode == "expect")
    alias = (kind == "name") & (mode == "have")
    closed = F.array_append(F.slice(below, F.lit(1), F.size(below) - 1), level(outer["scope"], F.when(outer["mode"] == "expect", "have").otherwise(outer["mode"])))
    after = (F.when(kind == "open", F.array_append(stack, level(scope, F.when(expects, "expect").otherwise(""))))
             .when(kind == "close", F.when(F.size(stack) > 1, closed).otherwise(stack))
             .when(kind == "select", F.array_append(below, level(acc["n"] + 1, "")))
             .when(kind == "from", put("expect"))
             .when(kind == "on", put("on"))
             .when(kind == "end", put(""))
             .when((kind == "comma") & mode.isin("have", "named", "on"), put("expect"))
             .when(names, put("have"))
             .when(alias, put("named"))
             .otherwise(stack))
    table = F.when(kind == "pair", tok["b"]).otherwise(tok["a"])
    bound = F.struct(scope.alias("scope"), F.when(names, table).otherwise(tok["a"]).alias("name"), F.when(names, table).otherwise(acc["pending"]).alias("table"))
    met = (kind == "pair") & acc["equal"] & acc["left"].isNotNull() & ~expects
    ref = F.struct(F.transform(stack, lambda x: x["scope"]).alias("path"), acc["left"]["a"].alias("t1"), acc["left"]["b"].alias("c1"), tok["a"].alias("t2"), tok["b"].alias("c2"))
    pending = F.when(names, table).when((kind == "close") & (outer["mode"] == "expect"), "").otherwise(acc["pending"])
    left = F.when(kind == "pair", F.struct(tok["a"].alias("a"), tok["b"].alias("b"))).when(kind == "equal", acc["left"])
    return F.struct(after.alias("stack"), (acc["n"] + (kind == "select").cast("int")).alias("n"), pending.alias("pending"),
                    F.when(names | alias, F.array_append(acc["binds"], bound)).otherwise(acc["binds"]).alias("binds"),
                    F.when(met, F.array_append(acc["refs"], ref)).otherwise(acc["refs"]).alias("refs"), left.alias("left"), (kind == "equal").alias("equal"))


def _finish(acc: Column) -> Column:
    def tables(path: Column, name: Column) -> Column:
        hits = F.filter(acc["binds"], lambda b: (b["name"] == name) & F.array_contains(path, b["scope"]))
        nearest = F.array_max(F.transform(hits, lambda b: F.array_position(path, b["scope"])))
        found = F.array_distinct(F.transform(F.filter(hits, lambda b: F.array_position(path, b["scope"]) == nearest), lambda b: b["table"]))
        return F.when(F.size(hits) == 0, F.array(name)).otherwise(found)

    return F.transform(acc["refs"], lambda r: F.struct(tables(r["path"], r["t1"]).alias("t1"), r["c1"].alias("c1"), tables(r["path"], r["t2"]).alias("t2"), r["c2"].alias("c2")))


def equalities(sql: Column) -> Column:
    """``array<struct<t1: array<string>, c1, t2: array<string>, c2>>``: the equalities of two qualified columns in a lower-case text, with the
    tables that the qualifiers stand for. A qualifier that nothing binds stands for itself, the alias of a derived table for none ('')."""
    start = F.from_json(F.lit('{"stack": [{"scope": 0, "mode": ""}], "n": 0, "pending": "", "binds": [], "refs": [], "equal": false}'), _STATE)
    return F.aggregate(_tokens(sql), start, _step, _finish)
