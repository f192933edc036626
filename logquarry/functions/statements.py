"""Structural guard of statements and conditions: what Spark's own parser makes of a text is held against lists.

Words cannot follow a grammar, so besides the word rules of ``guards`` a statement is parsed, without being analysed or
run.  Every node of its plan, of its subqueries and of the statement inside an EXPLAIN must be of a listed kind; relations must be
names of the catalog, not paths or data sources; and no function may reach the virtual machine or build names.  A
kind that is not listed is refused, so a clause of a later version of Spark is refused until it is listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Kinds of plan nodes that only read.
READING = frozenset(
    """
    Project Filter Aggregate Sort Distinct Deduplicate Union Intersect Except Join LateralJoin AsOfJoin SubqueryAlias
    UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith UnresolvedInlineTable LocalRelation OneRowRelation
    GlobalLimit LocalLimit Offset Sample WithWindowDefinition Window Generate UnresolvedHaving UnresolvedOrdering
    UnresolvedTableValuedFunction UnresolvedTVFAliases Pivot UnresolvedPivot Unpivot Expand UnresolvedHint
    RepartitionByExpression Repartition
    ExplainCommand DescribeRelation DescribeColumn DescribeTableCommand DescribeQueryCommand DescribeFunction
    DescribeNamespace ShowTables ShowTablesExtended ShowNamespaces ShowNamespacesCommand ShowColumns ShowColumnsCommand ShowFunctions ShowViews
    ShowPartitions ShowTableProperties ShowCreateTable ShowCurrentNamespaceCommand
    UnresolvedNamespace CurrentNamespace UnresolvedTableOrView UnresolvedFunctionName UnresolvedTable UnresolvedView
    """.split()
)
GENERATORS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
# Functions that call methods of the virtual machine, read files, or leave the engine.
REACHING = frozenset("java_method reflect try_reflect identifier input_file_name read_files load_extension".split())
_PATH = re.compile(r"[/\\:]")


def _items(seq) -> Iterator:
    """The elements of a Scala sequence."""
    steps = seq.iterator()
    while steps.hasNext():
        yield steps.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _is(node, name: str) -> bool:
    """Whether a JVM object is of a class of Catalyst, or of one below it."""
    return node.getClass().getClassLoader().loadClass(f"org.apache.spark.sql.catalyst.{name}").isInstance(node)


def _fault_of_relation(spark: SparkSession, parts: list[str]) -> str | None:
    """A name may have a catalog and databases before it; a data source or a class there means a path behind it."""
    if any(_PATH.search(p) for p in parts) or any("." in p for p in parts[:-1]):
        return f"the path {'.'.join(parts)}"
    if len(parts) == 2 and parts[0].lower() != "spark_catalog" and not spark.catalog.databaseExists(f"`{parts[0]}`"):
        return f"{parts[0]}, which is no database"
    return None


def _faults(spark: SparkSession, node) -> Iterator[str]:
    """What a tree of plans and expressions holds that only reading given tables needs not."""
    todo = [node]
    while todo:
        node = todo.pop()
        kind = _kind(node)
        if _is(node, "plans.logical.LogicalPlan"):
            if kind not in READING:
                yield f"a {kind}"
            if kind in ("UnresolvedRelation", "UnresolvedTableOrView", "UnresolvedTable", "UnresolvedView"):
                fault = _fault_of_relation(spark, list(_items(node.multipartIdentifier())))
                if fault:
                    yield fault
            if kind == "UnresolvedTableValuedFunction":
                name = list(_items(node.name()))
                if name[-1].lower() not in GENERATORS:
                    yield f"the table function {'.'.join(name)}"
            todo += _items(node.expressions())
            todo += _items(node.children())
            if kind == "UnresolvedWith":
                todo += [pair._2() for pair in _items(node.cteRelations())]
            if kind == "ExplainCommand":
                todo.append(node.logicalPlan())
            if kind == "DescribeQueryCommand":
                todo.append(node.plan())
        else:
            if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
                name = list(_items(node.nameParts())) if kind == "UnresolvedFunction" else [node.name().funcName()]
                if name[-1].lower() in REACHING:
                    yield f"the function {'.'.join(name)}"
            if "UnresolvedIdentifier" in kind or kind in ("CallMethodViaReflection", "TryReflect", "PythonUDF"):
                yield f"a {kind}"
            if _is(node, "expressions.PlanExpression"):
                todo.append(node.plan())
            todo += _items(node.children())


def _parser(spark: SparkSession):
    return spark._jsparkSession.sessionState().sqlParser()


def _refuse(spark: SparkSession, tree, text: str) -> None:
    if fault := next(_faults(spark, tree), None):
        raise ValueError(f"refused, reaches past the tables it was given by {fault}: {text.strip()}")


def check_statement(spark: SparkSession, query: str, tables=()) -> None:
    """Raise ValueError unless a statement only reads tables and views by name.  ``tables`` are the names that may stand
    in braces.  The parser's own error is raised for one that cannot be parsed."""
    named = re.sub(r"\{\s*(" + "|".join(map(re.escape, tables)) + r")\s*\}", r"`\1`", query) if tables else query
    _refuse(spark, _parser(spark).parsePlan(named), query)


def check_condition(spark: SparkSession, condition: str) -> None:
    """Raise ValueError unless a condition, with its subqueries, only reads tables and views by name."""
    _refuse(spark, _parser(spark).parseExpression(condition), condition)
