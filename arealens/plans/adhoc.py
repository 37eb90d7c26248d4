"""Read-only SQL over one table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Leaves of a resolved plan that hold no data but what the query itself writes down.
OWN_LEAVES = ("OneRowRelation", "LocalRelation", "CTERelationRef", "ResolvedInlineTable")
# Built-in expressions live here; anything else is a function someone registered.
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
# Built-in expressions that leave SQL for the JVM's classes, the file system or the session.
FORBIDDEN = (
    "CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength",
    "CurrentUser", "CurrentDatabase", "CurrentCatalog", "SparkVersion",
)


def own_session(df: DataFrame, view: str) -> SparkSession:
    """A session that knows ``df`` as ``view`` and nothing else: no other temporary view or function, no files as tables."""
    spark = df.sparkSession
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(view)
    return own


def items(seq) -> Iterator:
    """Elements of a Scala sequence."""
    return (seq.apply(i) for i in range(seq.size()))


def kind(node) -> str:
    return node.getClass().getName()


def foreign_parts(plan, view: str) -> Iterator[str]:
    """What a resolved plan reads or calls besides ``view``, its own common tables and built-in functions; subqueries included."""
    name = kind(plan).rsplit(".", 1)[-1]
    if name == "View":
        table = plan.desc().identifier()
        if plan.isTempView() and table.database().isEmpty() and table.table().lower() == view.lower():
            return  # what the view itself reads is its owner's matter
        yield f"view {table.table()}"
    children = list(items(plan.children()))
    if not children and name not in OWN_LEAVES:
        yield f"relation {name}"
    open_ = list(items(plan.expressions()))
    while open_:
        expression = open_.pop()
        full = kind(expression)
        if not full.startswith(EXPRESSIONS) or full.rsplit(".", 1)[-1] in FORBIDDEN:
            yield f"function {expression.prettyName()}"
        open_ += items(expression.children())
    for child in [*children, *items(plan.subqueries())]:
        yield from foreign_parts(child, view)


def adhoc_select(
    df: DataFrame, sql: str, args: Mapping[str, Any] | None = None, view: str = "neighborhoods", rows: int | None = None
) -> DataFrame:
    """Runs one query against ``df`` under the name ``view``; all rows, or the first ``rows`` of them.

    The text becomes a derived table, where only a query is valid; it is never rewritten, and values are bound, never pasted. It is resolved
    in a session of its own, in which ``view`` is the only view, so a caller's view of that name is never touched. The resolved plan may read
    the view, its own common tables and literal rows, and call built-in functions that stay inside SQL; anything else is an
    error, however it was named.
    """
    own = own_session(df, view)
    query = sql.strip().rstrip(";")
    text = f"SELECT * FROM (\n{query}\n)" + ("" if rows is None else f" LIMIT {int(rows)}")
    out = own.sql(text, args=dict(args or {}))
    if foreign := sorted(set(foreign_parts(out._jdf.queryExecution().analyzed(), view))):
        raise ValueError(f"only {view} may be queried with built-in functions, not {foreign}")
    return out
