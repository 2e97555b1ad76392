"""Trees to DataFrames.  Catalyst does the rest."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from strataq.functions.scalar import text_relevance
from strataq.functions.vectors import cosine
from strataq.operators import catalog, graph, kv, relational, text, vector
from strataq.plans.cost import explain
from strataq.plans.parser import parse
from strataq.plans.tree import Both, Definition, Either, Explain, Item, Mutation, Neither, Query, Show, Test

_WINDOWED = {
    "row_number": lambda a: F.row_number(), "rank": lambda a: F.rank(), "dense_rank": lambda a: F.dense_rank(), "lag": F.lag, "lead": F.lead, "ntile": lambda a: F.ntile(int(a)), "percent_rank": lambda a: F.percent_rank(), "cume_dist": lambda a: F.cume_dist(), "nth_value": F.nth_value,
    "first_value": F.first, "last_value": F.last, "sum": F.sum, "count": lambda a: F.count(F.lit(1) if a in ("*", "") else a), "avg": F.avg, "min": F.min, "max": F.max,
}
_AGGREGATES = ("count", "sum", "avg", "min", "max", "approx_count_distinct")


def _aggregated(i: Item) -> bool:
    return i.function in _AGGREGATES and not i.over


def _from_text(kind) -> bool:
    """Whether a statement's literal can become a value of the type."""
    return not isinstance(kind, (ArrayType, MapType, StructType))


class Engine:
    """Collections by name, and statements over them.

    ``collections`` map names to DataFrames; ``keys`` name their id columns
    (default ``id``); ``edges`` is the edge table of TRAVERSE; ``history`` maps
    names to version tables for AS OF (columns of the collection and ``seq``,
    ``ts_ms``, ``branch``).  Changes go to an append-only log of this engine, and
    every later statement reads a collection with its changes.
    """

    def __init__(self, spark: SparkSession, collections: dict[str, DataFrame], keys: dict[str, str] | None = None, edges: DataFrame | None = None, history: dict[str, DataFrame] | None = None):
        self.spark, self.collections, self.keys = spark, dict(collections), dict(keys or {})
        self.edges, self.history = edges, dict(history or {})
        self.schemas: dict[str, catalog.Collection] = {}
        self.branches: list[str] = []
        self.roles: list[str] = []
        self.sequence = 0
        self.log: list[tuple] = []

    def sql(self, statement: str, params: Any = None) -> DataFrame:
        return self.run(parse(statement, params))

    def run(self, tree: Any) -> DataFrame:
        if isinstance(tree, Query):
            return self.query(tree, self.named())
        if isinstance(tree, Explain):
            lines = explain(tree.query).splitlines()
            return self.spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line int, plan string")
        if isinstance(tree, Mutation):
            return self.change(tree)
        if isinstance(tree, Definition):
            return self.define(tree)
        if isinstance(tree, Show):
            names = {"COLLECTIONS": [*self.collections, *(n for n in self.schemas if n not in self.collections)], "BRANCHES": self.branches, "ROLES": self.roles}[tree.what]
            return self.spark.createDataFrame([(n,) for n in sorted(names)], "name string")
        raise TypeError(tree)

    def key(self, name: str | None, df: DataFrame) -> str:
        return self.keys.get(name or "", "id" if "id" in df.columns else df.columns[0])

    def condition(self, df: DataFrame, c: Any) -> Column:
        if isinstance(c, Test):
            return relational.predicate(df, c.attribute.split(".")[-1], c.operator, c.value)
        parts = [self.condition(df, p) for p in c.parts]
        if isinstance(c, Neither):
            return ~parts[0]
        return relational.all_of(*parts) if isinstance(c, Both) else relational.any_of(*parts) if isinstance(c, Either) else parts[0]

    @property
    def versions(self) -> DataFrame:
        """All changes: ``cf, key, seq, op, attributes``, one local relation however many there are."""
        return self.spark.createDataFrame(self.log, "cf string, key string, seq long, op string, attributes map<string,string>")

    def collection(self, name: str, df: DataFrame | None) -> DataFrame:
        """A collection after its changes.

        Inserts replace the record of their key, deletes remove it, updates overlay
        the attributes of a record that exists; values take the columns' types, and
        attributes that no column has are dropped.  A collection made by CREATE has
        its declared attributes behind ``id``.
        """
        if df is None:
            declared = self.schemas[name].ddl().replace(" NOT NULL", "")
            df = self.spark.createDataFrame([], ", ".join(filter(None, ("id string", declared))))
        if not any(cf == name for cf, *_ in self.log):
            return df
        key, kinds = self.key(name, df), {f.name: f.dataType for f in df.schema}
        rows = self.versions.where(F.col("cf") == name)
        base = F.max(F.when(F.col("op") != "UPDATE", F.col("seq"))).over(Window.partitionBy("key"))
        rows = rows.withColumn("_base", base).where(F.col("_base").isNull() | (F.col("seq") >= F.col("_base")))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.map_entries("attributes").alias("set")))), lambda x: F.coalesce(F.map_from_entries(x["set"]), F.create_map().cast("map<string,string>")))
        overlay = F.aggregate(parts, F.create_map().cast("map<string,string>"), lambda a, m: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(m, k)), m))
        changes = rows.groupBy(F.col("key").cast(kinds[key]).alias("_k")).agg(F.min_by("op", "seq").alias("_op"), overlay.alias("_set"))
        changes = changes.withColumnRenamed("_k", key)
        new = changes.where(F.col("_op") == "INSERT").select(*[F.col(key) if c == key else F.try_element_at("_set", F.lit(c)).try_cast(t).alias(c) if _from_text(t) else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
        kept = df.join(changes.where(F.col("_op") != "UPDATE"), key, "left_anti").join(changes.where(F.col("_op") == "UPDATE"), key, "left")
        value = lambda c, t: F.when(F.map_contains_key("_set", F.lit(c)), F.element_at("_set", F.lit(c)).try_cast(t)).otherwise(F.col(f"`{c}`")).alias(c)
        return kept.select(*[F.col(f"`{c}`") if c == key or not _from_text(t) else value(c, t) for c, t in kinds.items()]).unionByName(new)

    def named(self) -> dict[str, DataFrame]:
        """All collections, with their changes."""
        return {n: self.collection(n, self.collections.get(n)) for n in dict.fromkeys((*self.collections, *self.schemas))}

    def query(self, q: Query, known: dict[str, DataFrame]) -> DataFrame:
        known = dict(known)
        for name, inner in q.ctes:
            known[name] = self.fixpoint(name, inner, known) if q.recursive and inner.combined else self.query(inner, known)
        df = self.single(q, known)
        for operation, every, other in q.combined:
            right = self.single(other, known).toDF(*df.columns)
            if operation == "UNION":
                df = df.union(right) if every else df.union(right).distinct()
            elif operation == "INTERSECT":
                df = df.intersectAll(right) if every else df.intersect(right)
            else:
                df = df.exceptAll(right) if every else df.subtract(right)
        return df

    def fixpoint(self, name: str, q: Query, known: dict[str, DataFrame]) -> DataFrame:
        """``base UNION [ALL] step`` where the step reads the rows of the round before.

        Without ALL only rows not met before go on, so that cycles end; with ALL the
        rounds end when one gives no rows.  There is no bound of rounds.  Each round is
        checkpointed, and so are the rows of all rounds at every doubling, which keeps
        the plan short.
        """
        if any(operation != "UNION" for operation, _, _ in q.combined):
            raise ValueError("a recursive query is a UNION")
        every = all(a for _, a, _ in q.combined)
        unfold = lambda df: df if every else df.distinct()
        new = unfold(self.single(q, known)).checkpoint()
        found, rounds = new, 0
        while not new.isEmpty():
            steps = [self.single(other, known | {name: new}).toDF(*found.columns) for _, _, other in q.combined]
            new = reduce(DataFrame.union, steps)
            new = (new if every else new.subtract(found)).checkpoint()
            found, rounds = found.union(new), rounds + 1
            if rounds & (rounds - 1) == 0 or rounds % 16 == 0:
                found = found.checkpoint()
        return found

    def single(self, q: Query, known: dict[str, DataFrame]) -> DataFrame:
        if q.collection is None:
            df = self.spark.range(1).select()
            key = None
        else:
            if q.collection not in known:
                raise ValueError(f"no collection {q.collection}")
            df = self.as_of(q, known[q.collection])
            key = self.key(q.collection, df)
        if q.where is not None:
            df = df.where(self.condition(df, q.where))
        if q.match:
            field, words, top = q.match
            df = text.match(df, field, words)
            df = df if top is None else df.orderBy(key).limit(top)
        if q.similar:
            value, top, threshold = q.similar
            vec = next(f.name for f in known[q.collection].schema if f.dataType.simpleString().startswith("array<"))
            df = df.join(vector.similar_to(known[q.collection], value, top, threshold, key, vec).select(key), key, "left_semi")
        if q.traverse:
            start, hops, label = q.traverse
            df = graph.reachable(df, self.edges, start, hops, label, key)
        for other, left, right, how in q.joins:
            df = relational.nest_join(df, known[other], left, right, f"join.{other}", how)
        df = self.rank(df, q, key)
        grouped = bool(q.group_by) or any(_aggregated(i) for i in q.items)
        if q.order_by and not grouped:
            name, down = q.order_by
            df = relational.sort_by(df, name.split(".")[-1], key, down)
        df = self.project(df, q, grouped)
        if grouped and q.order_by:
            name, down = q.order_by
            df = df.orderBy(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first(), *[c for c in df.columns if c != name])
        if q.distinct:
            df = df.distinct()
        if q.offset is not None:
            df = df.offset(q.offset)
        return df if q.limit is None else df.limit(q.limit)

    def as_of(self, q: Query, df: DataFrame) -> DataFrame:
        if not q.as_of:
            return df
        kind, value = q.as_of
        rows = self.history.get(q.collection)
        if rows is None:
            raise ValueError(f"{q.collection} keeps no history")
        rows = {"COMMIT": lambda: rows.where(F.col("seq") <= int(value)), "TIMESTAMP": lambda: rows.where(F.col("ts_ms") <= int(value)), "BRANCH": lambda: rows.where(F.col("branch") == value)}[kind]()
        key = self.key(q.collection, df)
        last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "seq").alias("_v"))
        return last.select(key, *[F.col(f"_v.{c}").alias(c) for c in df.columns if c != key])

    def rank(self, df: DataFrame, q: Query, key: str | None) -> DataFrame:
        if not q.rank_by:
            return df
        by = q.rank_by.lower()
        texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
        arrays = [f.name for f in df.schema if f.dataType.simpleString().startswith("array<") and "struct" not in f.dataType.simpleString()]
        if any(w in by for w in ("text", "relevance", "bm25")):
            score = text_relevance(*[F.col(t) for t in texts])
        elif any(w in by for w in ("vector", "similarity")) and arrays:
            first = df.orderBy(key).select(arrays[0]).first()
            score = cosine(F.col(arrays[0]), F.array(*[F.lit(float(x)) for x in first[0]])) if first else F.lit(0.0)
        elif any(w in by for w in ("graph", "connectivity")) and self.edges is not None:
            degree = self.edges.groupBy(F.col("src").alias(key)).agg(F.count("*").alias("_degree"))
            return df.join(degree, key, "left").orderBy(F.coalesce("_degree", F.lit(0)).desc(), key).drop("_degree")
        else:
            score = F.col("updated_at") if "updated_at" in df.columns else F.col(key)
        return df.orderBy(score.desc(), key)

    def project(self, df: DataFrame, q: Query, grouped: bool) -> DataFrame:
        if q.kind != "SELECT" or (len(q.items) == 1 and q.items[0] == Item("*")):
            return df
        if not grouped:
            return df.select(*[c for i in q.items for c in self.columns(df, i)])
        aggregates = [i for i in q.items if i.function and not i.over]
        plain = [i for i in q.items if not i.function]
        for i in plain:
            if i.attribute not in q.group_by:
                raise ValueError(f"{i.attribute} is neither grouped nor aggregated")
        name = lambda i: i.alias or f"{i.function}_{i.attribute}".replace("*", "all")
        columns = [relational.aggregate(i.function, i.attribute or "*", i.distinct).alias(name(i)) for i in aggregates]
        out = getattr(df, q.grouping)(*q.group_by).agg(*columns) if q.group_by else df.agg(*columns)
        if q.having is not None:
            out = out.where(self.condition(out, q.having))
        return out.select(*[F.col(i.attribute).alias(i.alias or i.attribute) if not i.function else F.col(name(i)) for i in q.items])

    def columns(self, df: DataFrame, i: Item) -> list[Column]:
        if i.attribute == "*" and not i.function:
            return [F.col(f"`{c}`") for c in df.columns]
        if i.over:
            w = Window.partitionBy(*i.partition_by)
            if i.order_by:
                w = w.orderBy(*[F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_first() for n, d in i.order_by])
            if i.frame:
                unit, first, last = i.frame
                w = getattr(w, f"{unit.lower()}Between")(Window.unboundedPreceding if first is None else first, Window.unboundedFollowing if last is None else last)
            if i.function not in _WINDOWED:
                raise ValueError(f"no window function {i.function}")
            return [_WINDOWED[i.function](i.attribute, *i.arguments).over(w).alias(i.alias or i.function)]
        if i.function:  # any function of the session, its own or a registered one
            inner = [F.col(f"`{i.attribute}`")] if i.attribute else []
            return [F.call_function(i.function, *inner, *map(F.lit, i.arguments)).alias(i.alias or f"{i.function}_{i.attribute}")]
        name = i.attribute if i.attribute in df.columns else i.attribute.split(".")[-1]
        return [F.col(f"`{name}`").alias(i.alias or name)]

    def register(self, name: str, function: Any, kind: str | None = None) -> None:
        """Makes a function known to statements: a Pandas UDF, or plain Python with the type it returns."""
        self.spark.udf.register(name, function, *([] if kind is None else [kind]))

    # changes ------------------------------------------------------------
    def change(self, m: Mutation) -> DataFrame:
        """Appends a version row and returns it; attributes are text."""
        self.sequence += 1
        key = m.key or f"{self.sequence:016x}"
        self.log.append((m.collection, key, self.sequence, m.kind, {k: None if v is None else str(v) for k, v in m.values.items()}))
        return self.spark.createDataFrame(self.log[-1:], "cf string, key string, seq long, op string, attributes map<string,string>")

    def current(self, collection: str) -> DataFrame:
        """``key, attributes`` after all changes: an insert replaces, an update overlays, a delete removes."""
        rows = self.versions.where(F.col("cf") == collection)
        w = Window.partitionBy("key")
        base = F.max(F.when(F.col("op") != "UPDATE", F.col("seq"))).over(w)
        rows = rows.withColumn("_base", base).where(F.col("_base").isNull() | (F.col("seq") >= F.col("_base")))
        flat = rows.select("key", "seq", "op", F.explode_outer("attributes").alias("k", "v"))
        last = flat.groupBy("key", "k").agg(F.max_by("v", "seq").alias("v"))
        gone = rows.groupBy("key").agg(F.max_by("op", "seq").alias("last")).where(F.col("last") == "DELETE").select("key")
        pairs = F.map_from_entries(F.array_compact(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))))
        return last.join(gone, "key", "left_anti").groupBy("key").agg(pairs.alias("attributes"))

    def define(self, d: Definition) -> DataFrame:
        if d.object == "BRANCH":
            self.branches = [b for b in self.branches if b != d.name] + [d.name] * (d.kind == "CREATE")
        elif d.kind == "CREATE":
            self.schemas[d.name] = catalog.Collection(d.name, d.attributes)
        elif d.kind == "DROP":
            self.schemas.pop(d.name, None)
            self.collections.pop(d.name, None)
            self.log = [row for row in self.log if row[0] != d.name]
        else:
            if d.name not in self.schemas:
                raise ValueError(f"no collection {d.name}")
            step = catalog.Collection.with_attribute if d.kind == "ALTER ADD" else lambda s, a: s.without_attribute(a.name)
            self.schemas[d.name] = reduce(step, d.attributes, self.schemas[d.name])
        return self.run(Show("BRANCHES" if d.object == "BRANCH" else "COLLECTIONS"))


def graphql(text: str) -> str:
    """``{ c(where: "...", limit: n, offset: n) { a b } }`` as a SELECT statement."""
    import re

    m = re.fullmatch(r"\s*(?:query\s*)?\{\s*(\w+)\s*(?:\(([^)]*)\))?\s*\{([^}]*)\}\s*\}\s*", text)
    if not m:
        raise ValueError("not a query of one collection")
    args = dict(re.findall(r"(\w+)\s*:\s*(\"[^\"]*\"|\d+)", m[2] or ""))
    out = f"SELECT {', '.join(m[3].replace(',', ' ').split())} FROM {m[1]}"
    if "where" in args:
        out += f" WHERE {args['where'].strip(chr(34))}"
    return out + "".join(f" {k.upper()} {args[k]}" for k in ("limit", "offset") if k in args)


__all__ = ["Engine", "graphql", "kv"]
