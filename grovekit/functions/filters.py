"""A small JSON filter language compiled to Columns.

Operators: all any none ! == != > >= < <= in has get literal coalesce case match to-number to-string concat + - * /
between. A null comparison is false for filters. An empty selection matches nothing, a full one is no filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    pass


def compile_value(e, columns: Sequence[str]) -> Column:
    """A JSON expression as a Column; a column that is not there is null."""
    if not isinstance(e, list):
        return F.lit(e)
    if not e or not isinstance(e[0], str):
        raise FilterError(f"not an expression: {e!r}")
    op, args = e[0], e[1:]
    v = lambda x: compile_value(x, columns)
    if op == "get":
        return F.col(f"`{args[0]}`") if args[0] in columns else F.lit(None)
    if op == "has":
        return F.col(f"`{args[0]}`").isNotNull() if args[0] in columns else F.lit(False)
    if op == "literal":
        return F.array(*[F.lit(x) for x in args[0]]) if isinstance(args[0], list) else F.lit(args[0])
    if op == "coalesce":
        return F.coalesce(*[v(x) for x in args])
    if op == "to-number":
        return v(args[0]).cast("string").try_cast("double")
    if op == "to-string":
        return v(args[0]).cast("string")
    if op == "concat":
        return F.concat(*[v(x).cast("string") for x in args])
    if op == "case":
        out = None
        for cond, val in zip(args[:-1:2], args[1::2]):
            out = F.when(compile_filter(cond, columns), v(val)) if out is None else out.when(compile_filter(cond, columns), v(val))
        return out.otherwise(v(args[-1]))
    if op == "match":
        x, out = v(args[0]), None
        for key, val in zip(args[1:-1:2], args[2:-1:2]):
            hit = x.isin(key if isinstance(key, list) else [key])
            out = F.when(hit, v(val)) if out is None else out.when(hit, v(val))
        return v(args[-1]) if out is None else out.otherwise(v(args[-1]))
    if op in ("+", "*"):
        return reduce(lambda a, b: a + b if op == "+" else a * b, [v(x) for x in args])
    if op == "-":
        return -v(args[0]) if len(args) == 1 else v(args[0]) - v(args[1])
    if op == "/":
        return v(args[0]) / F.nullif(v(args[1]).cast("double"), F.lit(0.0))
    return _predicate(op, args, columns)


def _predicate(op: str, args: list, columns: Sequence[str]) -> Column:
    v = lambda x: compile_value(x, columns)
    both = {"==": lambda a, b: a.eqNullSafe(b), "!=": lambda a, b: ~a.eqNullSafe(b), ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
    if op in both:
        return F.coalesce(both[op](v(args[0]), v(args[1])), F.lit(False))
    if op == "!":
        return ~compile_filter(args[0], columns)
    if op == "all":
        return reduce(lambda a, b: a & b, [compile_filter(x, columns) for x in args], F.lit(True))
    if op == "any":
        return reduce(lambda a, b: a | b, [compile_filter(x, columns) for x in args], F.lit(False))
    if op == "none":
        return ~_predicate("any", args, columns)
    if op == "in":
        where = args[1]
        if isinstance(where, list) and where[:1] == ["literal"] and isinstance(where[1], list):
            return F.coalesce(v(args[0]).isin(where[1]), F.lit(False)) if where[1] else F.lit(False)
        return F.coalesce(F.array_contains(v(where), v(args[0])) if isinstance(where, list) and where[:1] != ["get"] else v(where).contains(v(args[0])), F.lit(False))
    if op == "between":
        return F.coalesce(v(args[0]).between(v(args[1]), v(args[2])), F.lit(False))
    raise FilterError(f"unknown operator {op!r}")


def compile_filter(e, columns: Sequence[str]) -> Column:
    """A JSON expression as a condition; None is no filter."""
    if e is None:
        return F.lit(True)
    if isinstance(e, bool):
        return F.lit(e)
    return F.coalesce(compile_value(e, columns).cast("boolean"), F.lit(False))


def selection(field: str, chosen: Sequence, every: Sequence):
    """Filter for chosen values of a field: None if all are chosen, one that matches nothing if none is."""
    if set(chosen) >= set(every):
        return None
    return ["in", ["get", field], ["literal", sorted(chosen)]] if chosen else ["any"]
