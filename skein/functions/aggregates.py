"""Aggregates, with the language's results over no rows and over nulls."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.plans.parser import GqlError


def percentile_disc(x: Column, p: Column) -> Column:
    """The member at place 1 + p(n - 1), rounded half to even."""
    ordered = F.array_sort(F.collect_list(x))
    place = F.bround(1 + checked(p) * (F.count(x) - 1), 0).cast("int")
    return F.when(F.count(x) > 0, F.try_element_at(ordered, place))


def checked(p: Column) -> Column:
    p = p.cast("double")
    return F.when(F.isnan(p) | (p < 0) | (p > 1), F.raise_error(F.lit("22003: a percentile lies between 0 and 1")).cast("double")).otherwise(p)


def aggregate(name: str, distinct: bool, args: list[Column], times: Column | None = None) -> Column:
    """times: how often each row counts."""
    if name == "COUNT" and times is not None and not (args and distinct):
        return F.coalesce(F.sum(F.when(args[0].isNotNull(), times) if args else times), F.lit(0).cast("long"))
    if name == "COUNT":
        return F.count(F.lit(1)) if not args else F.count_distinct(args[0]) if distinct else F.count(args[0])
    if not args:
        raise GqlError(f"{name} takes an argument")
    x = args[0]
    if name == "SUM":
        return F.coalesce(F.sum_distinct(x) if distinct else F.sum(x), F.lit(0))
    if name == "AVG":
        return F.call_function("avg", x) if not distinct else F.sum_distinct(x) / F.count_distinct(x)
    if name in ("MIN", "MAX"):
        return F.min(x) if name == "MIN" else F.max(x)
    if name == "COLLECT_LIST":
        # a struct around each member keeps nulls, which the built-in drops
        boxed = F.struct(x.alias("x"))
        return F.transform(F.collect_set(boxed) if distinct else F.collect_list(boxed), lambda s: s["x"])
    if name == "STDDEV_POP":
        return F.stddev_pop(x)
    if name == "STDDEV_SAMP":
        return F.when(F.count(x) > 1, F.stddev_samp(x))
    if name == "PERCENTILE_CONT":
        return F.percentile(x, args[1])
    if name == "PERCENTILE_DISC":
        return percentile_disc(x, args[1])
    raise GqlError(f"there is no aggregate {name}")


def when_empty(name: str) -> Any:
    """The result over no rows, if it is not null."""
    return {"COUNT": 0, "SUM": 0, "COLLECT_LIST": []}.get(name)
