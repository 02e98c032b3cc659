"""Lowers factor expressions to Catalyst columns.

A window function may not hold another, so operands of windowed calls become columns
of an earlier projection.  All expressions of one ``evaluate`` share these projections
and their common subexpressions: one shuffle by instrument serves every rolling
function, one by datetime every cross-section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions import library
from factorloom.plans.parser import Call, Const, ExpressionError, Field, Num, canonical, parse


class Compiler:
    def __init__(self, fields: list[str]):
        self.fields = {f.lower(): f for f in fields}
        self.levels: list[dict[str, Column]] = []
        self.names: dict[str, tuple[str, int]] = {}

    def _held(self, key: str, value: Column, level: int) -> tuple[Column, int]:
        """Make ``value`` a column of projection ``level``; it can be read from the next one on."""
        if key not in self.names:
            while len(self.levels) <= level:
                self.levels.append({})
            name = f"__x{len(self.names)}"
            self.names[key] = (name, level + 1)
            self.levels[level][name] = value
        name, at = self.names[key]
        return F.col(name), at

    def lower(self, node) -> tuple[Column, int]:
        if isinstance(node, Num):
            return F.lit(node.value), 0
        if isinstance(node, Const):
            return F.lit(node.value).cast("boolean" if node.value is not None else "double"), 0
        if isinstance(node, Field):
            if node.name.lower() not in self.fields:
                raise ExpressionError(f"unknown field {node.name}")
            return F.col(f"`{self.fields[node.name.lower()]}`"), 0
        known = self.names.get(canonical(node))
        if known:
            return F.col(known[0]), known[1]
        if node.name in library.SCALAR:
            parts = [self.lower(a) for a in node.args]
            return library.SCALAR[node.name](*(c for c, _ in parts)), max((n for _, n in parts), default=0)
        if node.name in library.COMPOSED:
            return self.lower(library.COMPOSED[node.name](*node.args))
        if node.name not in library.WINDOWED:
            raise ExpressionError(f"unknown function {node.name}")
        args, level = [], 0
        for a in node.args:
            if isinstance(a, Num):
                args.append(int(a.value) if a.value == int(a.value) else a.value)
                continue
            c, n = self.lower(a)
            if not isinstance(a, Field):
                c, n = self._held(canonical(a), c, n)
            args.append(c)
            level = max(level, n)
        return self._held(canonical(node), library.WINDOWED[node.name](*args), level)


def evaluate(panel: DataFrame, expressions: dict[str, str], keep: tuple[str, ...] = ("instrument", "datetime")) -> DataFrame:
    """``keep`` and one double per expression for every row of the panel."""
    compiler = Compiler(panel.columns)
    lowered = {name: compiler.lower(parse(text)) for name, text in expressions.items()}
    for level in compiler.levels:
        panel = panel.select("*", *(c.alias(n) for n, c in level.items()))
    return panel.select(*keep, *(c.cast("double").alias(n) for n, (c, _) in lowered.items()))
