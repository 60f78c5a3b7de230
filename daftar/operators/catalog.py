"""Filtered lists with exact totals and pages, searches, and reconciliation of key sets."""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def where_given(rows: DataFrame, **filters: object) -> DataFrame:
    """Equality on the given columns. None and empty text are no filters, False is one; a pair is a closed range; a list is membership."""
    conditions = []
    for name, value in filters.items():
        if value is None or value == "":
            continue
        c = F.col(name)
        conditions.append(c.between(*value) if isinstance(value, tuple) else c.isin(*value) if isinstance(value, list) else c == value)
    return rows.where(reduce(operator.and_, conditions)) if conditions else rows


def null_or_after(column: str, at: Column) -> Column:
    """Rows without an end, or whose end is still to come."""
    return F.col(column).isNull() | (F.col(column) > at)


def has_any(tags: Column, wanted: Sequence[str]) -> Column:
    """Whether an array, or JSON text of one, holds any of the wanted tags; every row without wanted ones."""
    return F.coalesce(F.arrays_overlap(tags, F.lit(list(wanted))), F.lit(False)) if wanted else F.lit(True)


def tags_of(json: Column) -> Column:
    """The tags of a JSON array of strings."""
    return F.from_json(json, "array<string>")


def limited_then_skipped(rows: DataFrame, order: Sequence[Column | str], skip: int, limit: int) -> DataFrame:
    """For callers that rely on it: the first `limit` rows, and of these all but the first `skip`."""
    return rows.orderBy(*order).limit(limit).offset(skip)


def labelled(rows: DataFrame, labels: DataFrame, on: Column, label: str, default: str = "Unknown") -> DataFrame:
    """rows with the label of what they refer to, or a default where that isn't there."""
    return rows.join(labels, on, "left").withColumn(label, F.coalesce(label, F.lit(default)))


def both_or_null(*parts: str, glue: str = " ") -> Column:
    """The parts joined; null unless all are there."""
    return F.when(reduce(operator.and_, (F.col(c).isNotNull() for c in parts)), F.concat_ws(glue, *parts))


def contains_any(columns: Sequence[str], term: str) -> Column:
    """Case-insensitive substring of any column; `%` and `_` in the term act as wildcards."""
    return reduce(operator.or_, (F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in columns))


def page(rows: DataFrame, order: Sequence[Column | str], number: int = 1, size: int = 20) -> DataFrame:
    """Page `number` (from 1) in a total order."""
    if number < 1 or size < 1:
        raise ValueError("page and size count from 1")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(total: int, size: int) -> int:
    return math.ceil(total / size)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def first(rows: DataFrame, condition: Column, *order: Column | str) -> DataFrame:
    """The first row in a total order for which a condition holds, or none."""
    return rows.where(condition).orderBy(*order).limit(1)


def iso(c: Column, kind: T.DataType) -> Column:
    """A date or time as ISO text: times without a fraction of a second if it is zero, else with six digits."""
    if isinstance(kind, T.DateType):
        return c.cast("string")
    fraction = F.date_format(c, "SSSSSS")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)))


def with_iso_dates(rows: DataFrame) -> DataFrame:
    """Whole rows as they go out: every column, dates and times as ISO text."""
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return rows.select(*(iso(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if isinstance(f.dataType, times) else F.col(f"`{f.name}`") for f in rows.schema.fields))


def filter_after_page(rows: DataFrame, order: Sequence[Column | str], number: int, size: int, condition: Column) -> DataFrame:
    """For callers that rely on it: the page is taken first, so it may come out short."""
    return page(rows, order, number, size).where(condition)


def children(parents: DataFrame, rows: DataFrame, key: str, order: str, name: str = "children") -> DataFrame:
    """parents with an array of their rows in order; empty if they have none."""
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in rows.columns if c not in (key, order))))).alias(name))
    return parents.join(held, key, "left").withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))


def reconciliation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are in a, in b, in both, in a only and in b only."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(1)), b.select(key).distinct().withColumn("in_b", F.lit(1))
    both = x.join(y, key, "full_outer")
    n = lambda c: F.count_if(c)
    has_a, has_b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return both.agg(n(has_a).alias("n_a"), n(has_b).alias("n_b"), n(has_a & has_b).alias("n_both"), n(has_a & ~has_b).alias("n_a_only"), n(~has_a & has_b).alias("n_b_only"))


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key), key, "left_anti")


def role_at_least(role: Column, required: str, levels: dict[str, int]) -> Column:
    """Whether a role's level reaches the required one; unknown roles don't."""
    level = F.create_map(*(F.lit(x) for kv in levels.items() for x in kv))
    return F.coalesce(F.try_element_at(level, role), F.lit(-1)) >= levels[required]
