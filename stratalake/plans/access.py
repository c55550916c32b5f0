"""Read-only SQL over governed views: no personal columns, allowed tables only."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalake.settings import GOLD_TABLES, PII_COLUMNS, TABLES
from stratalake.sources.dictionary import schema_listing

ALLOWED_TABLES = frozenset(TABLES + GOLD_TABLES)

# An empty database: a name that is not a governed view resolves to nothing.
EMPTY_DATABASE = "stratalake_governed"

# What a read may be made of: nodes of the parsed query, and functions. Anything else is refused.
READ_NODES = frozenset((
    "Aggregate", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join",
    "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedHint",
    "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Unpivot", "WithWindowDefinition",
))
# Hints on how to join or deal out rows; they change no result.
HINTS = frozenset((
    "broadcast", "broadcastjoin", "coalesce", "mapjoin", "merge", "mergejoin", "rebalance", "repartition", "repartition_by_range",
    "shuffle_hash", "shuffle_merge",
))
# Leaves of an analysed plan that read nothing.
CONSTANT_LEAVES = frozenset(("CTERelationRef", "LocalRelation", "OneRowRelation"))
FUNCTIONS = frozenset((
    "abs", "add_months", "any", "any_value", "approx_count_distinct", "array", "array_agg", "array_contains", "array_distinct",
    "array_join", "array_size", "avg", "between", "bigint", "bool_and", "bool_or", "boolean", "bround", "cardinality", "cast", "ceil",
    "ceiling", "char_length", "coalesce", "collect_list", "collect_set", "concat", "concat_ws", "contains", "corr", "count",
    "count_if", "cume_dist", "current_date", "current_timestamp", "date", "date_add", "date_diff", "date_format", "date_part",
    "date_sub", "date_trunc", "dateadd", "datediff", "day", "dayofmonth", "dayofweek", "dayofyear", "decimal", "dense_rank",
    "double", "endswith", "every", "exists", "exp", "explode", "extract", "filter", "first", "first_value", "float", "floor",
    "greatest", "hour", "if", "ifnull", "initcap", "instr", "int", "isnan", "isnotnull", "isnull", "lag", "last", "last_day",
    "last_value", "lcase", "lead", "least", "left", "length", "like", "ln", "locate", "log", "log10", "log2", "lower", "lpad",
    "ltrim", "make_date", "max", "max_by", "mean", "median", "min", "min_by", "minute", "mod", "mode", "month", "months_between",
    "now", "nth_value", "ntile", "nullif", "nvl", "nvl2", "percent_rank", "percentile", "percentile_approx", "percentile_cont",
    "position", "pow", "power", "quarter", "rank", "regexp_count", "regexp_extract", "regexp_like", "regexp_replace", "replace",
    "reverse", "right", "round", "row_number", "rpad", "rtrim", "second", "sign", "size", "some", "split", "split_part", "sqrt",
    "startswith", "std", "stddev", "stddev_pop", "stddev_samp", "string", "substr", "substring", "sum", "timestamp",
    "timestampdiff", "to_date", "to_timestamp", "trim", "trunc", "try_add", "try_cast", "try_divide", "try_sum", "ucase", "upper",
    "var_pop", "var_samp", "variance", "weekday", "weekofyear", "when", "year",
))


class QueryRefused(ValueError):
    """The query is not a plain read of governed tables."""


class _Jvm:
    """Tells the parts of a plan apart."""

    def __init__(self, spark: SparkSession):
        kind = spark._jvm.java.lang.Class.forName
        self.plan = kind("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
        self.expression = kind("org.apache.spark.sql.catalyst.expressions.Expression")
        self.many = kind("scala.collection.IterableOnce")
        self.product = kind("scala.Product")

    def inside(self, value) -> Iterator:
        """Plans and expressions in a value, however deep in sequences, maps, options and tuples they lie."""
        if not isinstance(value, JavaObject):
            return
        if self.plan.isInstance(value) or self.expression.isInstance(value):
            yield value
        elif self.many.isInstance(value):
            yield from self.each(value.iterator())
        elif self.product.isInstance(value):
            yield from self.each(value.productIterator())

    def each(self, iterator) -> Iterator:
        while iterator.hasNext():
            yield from self.inside(iterator.next())

    def fields(self, node) -> Iterator:
        """Plans and expressions in any field of a node: children, expressions, named windows, subqueries and all else."""
        return self.each(node.productIterator())


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def check_read_only(query: str, tables: Iterable[str] | None = None, spark: SparkSession | None = None) -> tuple[bool, str]:
    """Whether the text is a single read of the given tables (any plain names by default), and why not.

    The session's own parser reads the text; nothing is analyzed or run before the whole parsed query is
    known to consist of read nodes, governed names or its own common tables, and allowed functions.
    """
    spark = spark or SparkSession.active()
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(query.strip().rstrip(";"))
    except Exception as error:  # noqa: BLE001 - the parser's error arrives as a Java exception
        return False, f"only one SELECT statement is allowed ({str(error).strip().splitlines()[0][:120]})"
    reason = _refusal(parsed, None if tables is None else {t.lower() for t in tables}, _Jvm(spark))
    return reason is None, reason or "OK"


def _refusal(node, known: set[str] | None, jvm: _Jvm) -> str | None:
    """Why a node of a parsed query, or anything in it, is no plain read; None if it is one."""
    reason = _plan_refusal(node, known) if jvm.plan.isInstance(node) else _expression_refusal(node)
    if reason:
        return reason
    parts = jvm.fields(node)
    if node.getClass().getSimpleName() == "UnresolvedWith":
        # each common table sees the ones before it, the query sees all
        for relation in _items(node.cteRelations()):
            reason = _refusal(relation._2(), known, jvm)
            if reason:
                return reason
            known = None if known is None else known | {str(relation._1()).lower()}
        parts = [node.child()]
    return next((found for part in parts if (found := _refusal(part, known, jvm))), None)


def _plan_refusal(plan, known: set[str] | None) -> str | None:
    kind = plan.getClass().getSimpleName().strip("$")
    if kind not in READ_NODES:
        return f"'{kind}' is not allowed, only SELECT queries are"
    if kind == "UnresolvedRelation":
        name = [str(part) for part in _items(plan.multipartIdentifier())]
        if len(name) > 1 or known is not None and name[0].lower() not in known:
            return f"'{'.'.join(name)}' is not a governed table"
    if kind == "UnresolvedHint" and str(plan.name()).lower() not in HINTS:
        return f"hint '{plan.name()}' is not allowed"
    return None


def _expression_refusal(expression) -> str | None:
    kind = expression.getClass().getSimpleName()
    if "Identifier" in kind and kind.startswith(("Unresolved", "Expression")):
        return "identifier clauses are not allowed"
    if kind == "UnresolvedFunction":
        name = [str(part) for part in _items(expression.nameParts())]
        if len(name) > 1 or name[0].lower() not in FUNCTIONS:
            return f"function '{'.'.join(name).lower()}' is not allowed"
    return None


def ungoverned_leaf(analyzed, views: Mapping[str, object], jvm: _Jvm) -> str | None:
    """What an analysed plan reads besides the given views; None if nothing.

    ``views``: name to the view's own entry in the session's catalog. A view in the plan counts only if it carries that
    very entry, so neither another table of the same name nor anything reached in another way passes.
    """
    kind = analyzed.getClass().getSimpleName().strip("$")
    if kind == "View":
        name = str(analyzed.desc().identifier().table())
        known = views.get(name)
        return None if analyzed.isTempView() and known is not None and known.equals(analyzed.desc()) else name
    if jvm.plan.isInstance(analyzed) and analyzed.children().isEmpty() and kind not in CONSTANT_LEAVES:
        return str(analyzed.nodeName())
    return next((found for part in jvm.fields(analyzed) if (found := ungoverned_leaf(part, views, jvm))), None)


def without_personal(df: DataFrame, personal: Iterable[str] = PII_COLUMNS) -> DataFrame:
    """Drop the columns that carry a personal name, whatever its case."""
    hidden = {p.lower() for p in personal}
    return df.drop(*[c for c in df.columns if c.lower() in hidden])


def governed_view(df: DataFrame, personal: Iterable[str] = PII_COLUMNS) -> DataFrame:
    """The same columns, with the personal ones emptied.

    A query that names them still runs, but an alias, a filter or an expression over them has
    nothing to bring out.
    """
    hidden = {p.lower() for p in personal}
    return df.select(*[
        F.lit(None).cast(f.dataType).alias(f.name) if f.name.lower() in hidden else F.col(f.name)
        for f in df.schema.fields
    ])


@dataclass(frozen=True)
class Answer:
    """Result of a governed query, lazy and whole. With a ``cap`` the caller asks for a head of it in ``rows``."""

    result: DataFrame
    cap: int | None = None

    @property
    def rows(self) -> DataFrame:
        return self.result if self.cap is None else self.result.limit(self.cap)

    def total(self) -> int:
        return self.result.count()

    def text(self) -> str:
        """The rows as a table, with a note when a cap leaves some out."""
        head = self.rows.collect()
        if not head:
            return "no results"
        lines = [" | ".join(self.result.columns)]
        lines += [" | ".join("" if v is None else str(v) for v in row) for row in head]
        total = len(head) if self.cap is None or len(head) < self.cap else self.total()
        if total > len(head):
            lines.append(f"... ({len(head)} of {total} rows)")
        return "\n".join(lines)


class GovernedSql:
    """A session of its own in which only the governed views exist."""

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame], dictionary: DataFrame | None = None,
                 personal: Iterable[str] = PII_COLUMNS, cap: int | None = None, database: str = EMPTY_DATABASE):
        self.personal = tuple(personal)
        self.cap = cap
        self.frames = {n: governed_view(df, self.personal) for n, df in frames.items() if n in ALLOWED_TABLES}
        self.dictionary = dictionary
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        if [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]:
            raise ValueError(f"database {database} holds tables; governed SQL needs an empty one")
        self._names = {name: f"stratalake_{uuid.uuid4().hex}_{name}" for name in self.frames}
        for name, df in self.frames.items():
            df.createOrReplaceGlobalTempView(self._names[name])
        self.session = spark.newSession()
        for setting in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
            self.session.conf.set(setting, spark.conf.get(setting))
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        self.session.sql(f"USE {database}")
        for name in self.frames:
            self.session.table(f"global_temp.{self._names[name]}").createOrReplaceTempView(name)
        catalog = self.session._jsparkSession.sessionState().catalog()
        self._views = {name: catalog.getRawTempView(name).get().tableMeta() for name in self.frames}
        self._jvm = _Jvm(self.session)

    def tables(self) -> list[str]:
        return sorted(self.frames)

    def query(self, text: str) -> Answer:
        """Check, run and strip a query.

        The parsed text is checked before anything is looked up, and the analysed plan before anything runs: all it reads
        must be views of this instance.
        """
        safe, reason = check_read_only(text, self.frames, self.session)
        if not safe:
            raise QueryRefused(reason)
        result = self.session.sql(text.strip().rstrip(";"))
        other = ungoverned_leaf(result._jdf.queryExecution().analyzed(), self._views, self._jvm)
        if other:
            raise QueryRefused(f"'{other}' is not a governed table")
        return Answer(without_personal(result, self.personal), self.cap)

    def close(self) -> None:
        """Drop the views of this instance."""
        for name, own in self._names.items():
            self.session.catalog.dropTempView(name)
            self.session.catalog.dropGlobalTempView(own)

    def schema(self, table: str) -> DataFrame:
        """Columns of an allowed table: aggregate tables as built, source tables from the dictionary."""
        if table not in self.frames:
            raise QueryRefused(f"'{table}' is not a governed table")
        if table in GOLD_TABLES or self.dictionary is None:
            return schema_listing(self.dictionary, table, built=self.frames[table])
        return schema_listing(self.dictionary, table)


def quality_digest(rules: DataFrame, profiles: DataFrame, log: DataFrame) -> DataFrame:
    """Rule report, profile and repair log as one table of (source, table, item, value)."""
    return (
        rules.select(F.lit("rule").alias("source"), F.col("table"), F.col("rule_id").alias("item"),
                     F.col("violations").cast("bigint").alias("value"))
        .unionByName(profiles.select(F.lit("nulls").alias("source"), F.col("table"), F.col("column").alias("item"),
                                     F.col("nulls").cast("bigint").alias("value")))
        .unionByName(log.select(F.lit("repair").alias("source"), F.col("tabla").alias("table"),
                                F.col("campo").alias("item"), F.col("registros_afectados").cast("bigint").alias("value")))
    )
