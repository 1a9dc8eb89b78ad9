"""Read-only SQL: only plans made of query nodes run."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_ALLOWED = frozenset(
    """Aggregate CTERelationDef CTERelationRef Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset
    OneRowRelation Pivot Project Range Sample Sort SubqueryAlias TableAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith UnresolvedOrderByAll UnresolvedGroupByAll Unpivot View Window
    WithCTE WithWindowDefinition ParameterizedQuery UnionLoop UnresolvedHint""".split()
)
_CALLS_OUT = re.compile(r"\b(java_method|reflect|try_reflect)\s*\(", re.I)


class NotReadOnly(ValueError):
    pass


def check(spark: SparkSession, sql: str, views: Iterable[str] = ()) -> None:
    """Raise unless the statement parses to query nodes alone, over the named
    views and its own common table expressions.  An allow-list: some statements
    that write are no ``Command`` in Spark's parser, and a table name may be a
    file (``text.`/a/path```)."""
    known = {v.lower() for v in views}
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    stack, used = [plan], []
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name.strip("'") == "UnresolvedRelation":
            used.append([node.multipartIdentifier().apply(i) for i in range(node.multipartIdentifier().size())])
        elif name.strip("'") == "UnresolvedWith":
            own = node.cteRelations()
            known |= {own.apply(i)._1().lower() for i in range(own.size())}
            stack += [own.apply(i)._2() for i in range(own.size())]
        if name.strip("'") not in _ALLOWED:
            raise NotReadOnly(f"{name} is not allowed in a read-only query")
        for many in (node.children(), node.innerChildren(), node.subqueries()):
            for i in range(many.size()):
                child = many.apply(i)
                if hasattr(child, "innerChildren"):
                    stack.append(child)
    for parts in used:
        if len(parts) != 1 or parts[0].lower() not in known:
            raise NotReadOnly(f"{'.'.join(parts)} is none of the views {sorted(known)}")
    if _CALLS_OUT.search(sql):
        raise NotReadOnly("calls into the JVM are not allowed")


def query(spark: SparkSession, sql: str, views: dict[str, DataFrame], limit: int = 50, args: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows up to the limit, all rows) of a read-only query over named views."""
    if not 1 <= limit <= 200:
        raise ValueError("limit is 1 to 200")
    check(spark, sql, views)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(sql, args=args or {})
    return out.limit(limit), out
