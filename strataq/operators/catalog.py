"""Declared schemas: validation, computed fields, edits by DDL."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions.scalar import computed
from strataq.model import spark_type


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str = "text"
    nullable: bool = True
    dimensions: int | None = None


@dataclass(frozen=True)
class Collection:
    name: str
    attributes: tuple[Attribute, ...] = ()
    mode: str = "loose"
    computed: dict[str, tuple[str, str]] = field(default_factory=dict)
    version: int = 1

    def with_attribute(self, a: Attribute) -> Collection:
        return replace(self, attributes=(*[x for x in self.attributes if x.name != a.name], a), version=self.version + 1)

    def without_attribute(self, name: str) -> Collection:
        return replace(self, attributes=tuple(x for x in self.attributes if x.name != name), version=self.version + 1)

    def ddl(self) -> str:
        return ", ".join(f"`{a.name}` {spark_type(a.type)}" + ("" if a.nullable else " NOT NULL") for a in self.attributes)


def violations(df: DataFrame, schema: Collection, key: str) -> DataFrame:
    """``key, attribute, problem`` of rows that break the schema.

    Strict mode also reports columns that are not declared, once a row that has a
    value in them.  Loose and mixed modes check declared attributes only.
    """
    checks = []
    for a in schema.attributes:
        if a.name not in df.columns:
            if not a.nullable:
                checks.append((a.name, F.lit(True), "missing"))
            continue
        c, declared = F.col(a.name), df.schema[a.name].dataType.simpleString()
        if not a.nullable:
            checks.append((a.name, c.isNull(), "missing"))
        if a.dimensions is not None:
            checks.append((a.name, c.isNotNull() & (F.size(c) != a.dimensions), "dimensions"))
        elif declared == "string" and spark_type(a.type) != "string":
            checks.append((a.name, c.isNotNull() & c.try_cast(spark_type(a.type)).isNull(), "type"))
    if schema.mode == "strict":
        known = {a.name for a in schema.attributes} | {key}
        checks += [(c, F.col(f"`{c}`").isNotNull(), "unknown") for c in df.columns if c not in known]
    if not checks:
        return df.select(key, F.lit("").alias("attribute"), F.lit("").alias("problem")).limit(0)
    found = F.array(*[F.when(bad, F.struct(F.lit(n).alias("attribute"), F.lit(p).alias("problem"))) for n, bad, p in checks])
    return df.select(key, F.explode(F.array_compact(found)).alias("v")).select(key, "v.attribute", "v.problem")


def with_computed(df: DataFrame, schema: Collection) -> DataFrame:
    """Computed fields in the order of their names."""
    return reduce(lambda d, n: d.withColumn(n, computed(schema.computed[n][0], d.columns).try_cast(spark_type(schema.computed[n][1]))), sorted(schema.computed), df)
