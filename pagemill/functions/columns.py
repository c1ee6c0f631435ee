"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Expressions inside a lambda run once per element, and an expression used many times is otherwise copied into
    every use; anything costly is bound here first.
    """
    return F.get(F.transform(F.array(value), body), 0)


def count_below(ascending: Column, value: Column) -> Column:
    """How many elements of an ascending array are smaller than ``value``, by halving."""
    steps = F.ceil(F.log2(F.size(ascending) + F.lit(1))).cast("int")

    def halve(found: Column, _: Column) -> Column:
        middle = F.floor((found["low"] + found["high"]) / 2).cast("int")
        below = F.get(ascending, middle) < value
        narrowed = F.when(below, F.struct((middle + 1).alias("low"), found["high"].alias("high"))).otherwise(
            F.struct(found["low"].alias("low"), middle.alias("high"))
        )
        return F.when(found["low"] < found["high"], narrowed).otherwise(found)

    start = F.struct(F.lit(0).alias("low"), F.size(ascending).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), steps), start, halve, lambda found: found["low"])
