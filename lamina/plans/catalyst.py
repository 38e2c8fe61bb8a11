"""What Catalyst's optimised plan filters each table by, in the predicates that parts are skipped by."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame

from lamina.plans.predicate import Both, ColumnRef, Compare, Either, Literal

COMPARES = {"EqualTo": "=", "EqualNullSafe": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
WHOLE = ("tinyint", "smallint", "int", "bigint")
#: Casts that keep a number as it is, or as a comparison with a double has it.
WIDER = {"float": ("double",)} | {t: ("int", "bigint", "double") for t in WHOLE}


def kind(node) -> str:
    return node.getClass().getSimpleName()


def each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def number(literal) -> Literal | None:
    t, text = literal.dataType().simpleString(), literal.toString()
    if literal.value() is None:
        return None
    if t in WHOLE or t.startswith("decimal"):
        return Literal(Decimal(text))
    if t in ("float", "double"):
        return Literal(float(np.float32(text)) if t == "float" else float(text))
    return None


def operand(e) -> object:
    """A column, a number, or None."""
    what = kind(e)
    if what == "AttributeReference":
        return ColumnRef(e.name())
    if what == "Literal":
        return number(e)
    if what == "Cast":
        source, target = e.child().dataType().simpleString(), e.dataType().simpleString()
        if target in WIDER.get(source, ()) or source in WHOLE and target.startswith("decimal"):
            inner = operand(e.child())
            return inner if isinstance(inner, ColumnRef) else None
    return None


def converted(e) -> object:
    """A condition as a predicate that is true wherever it is; None for what isn't understood, which is true anywhere."""
    what = kind(e)
    if what in ("And", "Or"):
        return (Both if what == "And" else Either)(converted(e.left()), converted(e.right()))
    if what in COMPARES:
        return Compare(operand(e.left()), COMPARES[what], operand(e.right()))
    if what == "Not" and kind(e.child()) == "EqualTo":
        return Compare(operand(e.child().left()), "!=", operand(e.child().right()))
    if what == "In":
        return reduce(Either, [Compare(operand(e.value()), "=", operand(x)) for x in each(e.list())])
    return None


def filters(df: DataFrame, places: dict[str, str]) -> dict[str, object]:
    """{table: predicate} for tables read from the folders `places` {folder name: table} in df's plan, subqueries too.

    A row for which the predicate isn't true is read by no scan of the table. Tables that some scan reads whole are
    missing.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    found: dict[str, list[object]] = {}

    def walk(node, condition: object) -> None:
        if kind(node) == "LogicalRelation":
            paths = [p.toString() for p in each(node.relation().location().rootPaths())]
            for path in paths:
                if (table := places.get(path.rstrip("/").rsplit("/", 2)[-2])) is not None:
                    found.setdefault(table, []).append(condition)
        for child in each(node.children()):
            walk(child, converted(node.condition()) if kind(node) == "Filter" else None)

    for root in [plan, *each(plan.subqueriesAll())]:
        walk(root, None)
    return {t: reduce(Either, c) for t, c in found.items() if all(x is not None for x in c)}
