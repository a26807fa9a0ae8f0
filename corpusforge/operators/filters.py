"""The payload filter language, compiled to one Column.

``{"field": value}`` and ``{"field": {"$op": value}}`` with $eq $ne $gt $gte $lt
$lte $in $nin $contains; ``$and``/``$or`` take lists, ``$not`` a filter. Keys of
one object are ANDed, an empty object is true, anything unknown raises. A field
is a column where there is one, else an attribute of the map column. A missing
field matches no condition, so ``$not`` of one holds. Ranges never match text
that isn't a number; arrays match by any of their elements.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions import text

RANGES = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


def _field(df: DataFrame, name: str, attributes: str) -> tuple[Column, T.DataType]:
    kinds = {f.name: f.dataType for f in df.schema}
    if name in kinds:
        return F.col(f"`{name}`"), kinds[name]
    if isinstance(kinds.get(attributes), T.MapType):
        return F.element_at(F.col(attributes), name), kinds[attributes].valueType
    raise ValueError(f"no field {name}")


def _one_of(c: Column, kind: T.DataType, values: list) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.exists(c, lambda x: _one_of(x, kind.elementType, values))
    if isinstance(kind, T.StringType):
        return c.isin([str(v).lower() if isinstance(v, bool) else str(v) for v in values])
    if isinstance(kind, T.BooleanType):
        return c.isin([v for v in values if isinstance(v, bool)])
    return reduce(or_, [c == F.lit(v).try_cast(kind) if not isinstance(v, str) else c == F.lit(v).try_cast(kind) for v in values], F.lit(False))


def _compare(c: Column, kind: T.DataType, op: str, value) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.exists(c, lambda x: _compare(x, kind.elementType, op, value))
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{op} takes a number")
    return RANGES[op](c.try_cast("double"), F.lit(float(value)))


def _condition(df: DataFrame, name: str, op: str, value, attributes: str) -> Column:
    c, kind = _field(df, name, attributes)
    if op == "$eq":
        return _one_of(c, kind, [value])
    if op in ("$ne", "$nin"):
        return c.isNotNull() & ~F.coalesce(_one_of(c, kind, list(value) if op == "$nin" else [value]), F.lit(False))
    if op == "$in":
        return _one_of(c, kind, list(value))
    if op in RANGES:
        return _compare(c, kind, op, value)
    if op == "$contains":
        return text.contains_all(c, value)
    raise ValueError(f"unknown operator {op}")


def compile_filter(df: DataFrame, tree: dict | None, attributes: str = "attributes") -> Column:
    """The predicate of a filter over the columns of ``df``.

    Null counts as false, which AND and OR keep and NOT is told, so that plain
    conditions stay in a form that reaches the scan.
    """
    parts = []
    for key, value in (tree or {}).items():
        if key in ("$and", "$or"):
            each = [compile_filter(df, v, attributes) for v in value]
            parts.append(reduce(and_ if key == "$and" else or_, each, F.lit(key == "$and")) if each else F.lit(True))
        elif key == "$not":
            parts.append(~F.coalesce(compile_filter(df, value, attributes), F.lit(False)))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(value, dict):
            parts += [_condition(df, key, op, v, attributes) for op, v in value.items()]
        else:
            parts.append(_condition(df, key, "$eq", value, attributes))
    return reduce(and_, parts) if parts else F.lit(True)


def scope(slugs: list[str] | None, column: str = "slug", mandatory: bool = False) -> Column:
    """Rows of these directories; all where none are given, unless scope is mandatory."""
    if not slugs:
        if mandatory:
            raise ValueError("a scope of at least one directory is required")
        return F.lit(True)
    return F.col(column).isin(slugs)


def keep_unless_empty(df: DataFrame, keep: Column, by: list[str] | None = None) -> DataFrame:
    """Rows that ``keep`` holds for; where it holds for none (of a query), all of them."""
    marked = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    if by:
        # counts per query are combined before they meet, so no query is gathered in one task
        found = marked.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.max("_keep").alias("_any"))
        on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
        kept = marked.join(found, on).filter(F.col("_keep") | ~F.col("_any"))
        return kept.drop("_keep", "_any", *[f"_by_{c}" for c in by])
    found = marked.agg(F.coalesce(F.max("_keep"), F.lit(False)).alias("_any"))  # one row
    return marked.join(F.broadcast(found)).filter(F.col("_keep") | ~F.col("_any")).drop("_keep", "_any")


def name_search(df: DataFrame, needle: str, column: str = "name", limit: int = 50, blank_is_all: bool = True) -> DataFrame:
    """Names that hold the needle, whatever the case; limit is clamped to 1..200."""
    wanted = needle.strip().lower()
    if not wanted and not blank_is_all:
        return df.limit(0)
    hit = F.contains(F.lower(F.col(column)), F.lit(wanted)) if wanted else F.lit(True)
    return df.filter(hit).orderBy(column).limit(min(max(limit, 1), 200))
