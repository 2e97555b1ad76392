"""Filters, joins, aggregates, sorting: the relational part."""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions.scalar import literal

def _never() -> Column:
    """A condition that is null: neither it nor its negation lets a row through."""
    return F.lit(None).cast("boolean")


_OPS = {
    "=": lambda c, v: c == v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v, "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
}


def predicate(df: DataFrame, attribute: str, operator: str, value=None) -> Column:
    """A comparison for a filter, under the record rules: a missing attribute, an unknown
    operator or a literal that is not of the column's type lets no row through.

    The column stays bare and the literal has its type, so that the comparison
    reaches the scan; of a missing value the result is null, which a filter drops.
    """
    if attribute not in df.columns:
        return _never()
    c = F.col(attribute)
    if operator in ("is_null", "is_not_null"):
        return c.isNull() if operator == "is_null" else c.isNotNull()
    kind = df.schema[attribute].dataType.simpleString()
    if operator == "like" and kind == "string":
        return c.like(value)
    if operator not in _OPS:
        return _never()
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        try:
            value = Decimal(str(value))
        except InvalidOperation:
            return _never()
        if not value.is_finite():
            return _never()
        whole = value == value.to_integral_value()
        if kind.endswith("int"):
            if abs(value) >= 1 << 62 or not whole and operator in ("=", "==", "!=", "<>"):
                return _OPS[operator](c.cast("double"), F.lit(float(value)))
            # between two whole numbers, the one on the side that the comparison looks to
            step = {"<": "<=", ">": ">="}.get(operator, operator) if not whole else operator
            return _OPS[step](c, F.lit(int(value.to_integral_value(ROUND_FLOOR if operator[0] == "<" else ROUND_CEILING))))
        if kind.startswith("decimal") and value.as_tuple().exponent >= -int(kind[:-1].split(",")[1]):
            return _OPS[operator](c, F.lit(str(value)).try_cast(kind))
        return _OPS[operator](c if kind == "double" else c.cast("double"), F.lit(float(value)))
    return _OPS[operator](c, F.lit(value).try_cast(kind))


def nest_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str, how: str = "inner") -> DataFrame:
    """Left rows with a match, each with the array of its matches, in value order.

    The right side is grouped on its key before the join, so a left row is never
    multiplied; rows without a key or a match are dropped.  With ``how`` "left" they
    stay, their array null; "right" and "full" also keep each array that no left row
    has, the left columns null; "semi" and "anti" return the left rows with and
    without a match as they are.
    """
    if how in ("semi", "anti"):
        keys = right.select(F.col(right_key).alias("_k"))
        return left.join(keys, left[left_key] == keys["_k"], f"left_{how}")
    rest = [c for c in right.columns if c != right_key]
    if how in ("inner", "left"):
        right = right.where(F.col(right_key).isNotNull())
    lists = right.groupBy(F.col(right_key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(*([right_key] + rest)))).alias(name))
    return left.join(lists, left[left_key] == lists["_k"], how).drop("_k")


def distinct_by_id(df: DataFrame, key: str) -> DataFrame:
    return df.dropDuplicates([key])


def intersect_by_id(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def aggregate(name: str, column: str = "*", distinct: bool = False) -> Column:
    """COUNT, SUM (0 if empty), AVG, MIN, MAX of numeric values, and APPROX_COUNT_DISTINCT; other names raise.

    With ``distinct``, COUNT and SUM take each value once (MIN and MAX are the same); AVG raises.
    """
    x = None if column == "*" else F.col(column).try_cast("double")
    if distinct and name.lower() in ("count", "sum"):
        return F.count_distinct(F.col(column)) if name.lower() == "count" else F.coalesce(F.sum_distinct(x), F.lit(0.0))
    if distinct and name.lower() == "avg":
        raise ValueError("AVG takes no DISTINCT")
    if name.lower() == "approx_count_distinct":
        return F.approx_count_distinct(column)
    found = {"count": lambda: F.count(F.lit(1)) if x is None else F.count(F.col(column)), "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)), "avg": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x)}
    if name.lower() not in found:
        raise ValueError(f"no aggregate {name}")
    return found[name.lower()]()


def nearest_rank(df: DataFrame, column: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Percentiles as sorted[min(floor(p * n), n - 1)], by a ranking instead of a collected list."""
    w = Window.partitionBy(*by).orderBy(column) if by else Window.orderBy(column)
    n = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = df.where(F.col(column).isNotNull()).withColumn("_r", F.row_number().over(w) - 1)
    ranked = ranked.join(F.broadcast(n), list(by)) if by else ranked.crossJoin(F.broadcast(n))
    at = lambda p: F.least(F.floor(F.lit(p) * F.col("_n")), F.col("_n") - 1)
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("_r") == at(p), F.col(column))).alias(name) for name, p in shares.items()])


def latency_bucket(ms: Column) -> Column:
    return F.when(ms <= 1, "le_1ms").when(ms <= 10, "le_10ms").when(ms <= 100, "le_100ms").when(ms <= 1000, "le_1s").otherwise("gt_1s")


def sort_by(df: DataFrame, column: str, key: str, descending: bool = False) -> DataFrame:
    """Missing values are least; ties by key."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), key)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def typed(text: str):
    return literal(text)
