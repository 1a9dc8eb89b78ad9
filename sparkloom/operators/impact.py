"""What a change to a symbol reaches, and how risky it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.traverse import k_hop
from sparkloom.sources.shared import staged

CAPS, BUDGET = (10, 5, 3, 1), 80


def callers_of(edges: DataFrame, target: DataFrame, depth: int, tasks: int | None = None) -> DataFrame:
    """(node, distance) of trails that end at the target's id."""
    return k_hop(edges, target, depth, tasks=tasks).select("node", "distance").distinct()


def with_files(callers: DataFrame, files: DataFrame) -> DataFrame:
    """Callers with the facts of their file: is_test, is_core, community,
    pagerank; files are keyed by the caller's id or file."""
    return callers.join(files.withColumnRenamed("id", "node"), "node", "left")


def split(callers: DataFrame) -> DataFrame:
    """One row of counts: production and test, direct and transitive."""
    direct, test = F.col("distance") == 1, F.coalesce("is_test", F.lit(False))

    def n(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("int")), F.lit(0))

    return callers.agg(
        n(direct & ~test).alias("prod_direct"),
        n(~direct & ~test).alias("prod_indirect"),
        n(direct & test).alias("test_direct"),
        n(~direct & test).alias("test_indirect"),
        n(direct & ~test & F.coalesce("is_core", F.lit(False))).alias("spine_direct"),
    )


def other_communities(callers: DataFrame, target_community: Column) -> Column:
    return F.count_distinct(F.when(F.col("community") != target_community, F.col("community")))


def risk_score(counts: DataFrame) -> DataFrame:
    """Adds risk to counts (with other_communities, is_core, boundary)."""
    weights = {"prod_direct": 1.0, "prod_indirect": 0.3, "test_direct": 0.2, "test_indirect": 0.05, "spine_direct": 2.0, "other_communities": 1.5, "boundary": 0.5}
    total = F.when(F.coalesce("is_core", F.lit(False)), 10.0).otherwise(0.0)
    for column, weight in weights.items():
        total = total + F.coalesce(F.col(column), F.lit(0)) * F.lit(weight)
    return counts.withColumn("risk", total)


def verdict(counts: DataFrame) -> DataFrame:
    """Adds verdict: risky, focus or safe."""
    prod, spine, cross, core = F.col("prod_direct"), F.col("spine_direct"), F.col("other_communities"), F.coalesce("is_core", F.lit(False))
    risky = (prod > 20) | (spine >= 3) | (cross >= 4) | (core & (prod >= 5))
    focus = (prod > 5) | (spine >= 1) | (cross >= 2) | (core & (prod >= 1))
    return counts.withColumn("verdict", F.when(risky, "risky").when(focus, "focus").otherwise("safe"))


def truncation_cap(callers: DataFrame) -> DataFrame:
    """(cap,): the first cap a community of 10, 5, 3, 1 whose total fits 80."""
    sizes = callers.groupBy(F.coalesce("community", F.lit("-1")).alias("bucket")).agg(F.count("*").alias("n"))
    totals = sizes.agg(*[F.coalesce(F.sum(F.least("n", F.lit(c))), F.lit(0)).alias(f"c{c}") for c in CAPS])
    cap = F.lit(CAPS[-1])
    for c in reversed(CAPS[:-1]):
        cap = F.when(F.col(f"c{c}") <= BUDGET, c).otherwise(cap)
    return totals.select(cap.alias("cap"))


def truncated(callers: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` callers a community: spine first, then by pagerank, id."""
    order = [F.desc(F.coalesce("is_core", F.lit(False))), F.desc(F.coalesce("pagerank", F.lit(0.0))), F.col("node"), F.col("distance")]
    rank = F.row_number().over(Window.partitionBy(F.coalesce("community", F.lit("-1"))).orderBy(*order))
    return callers.withColumn("rn", rank).where(F.col("rn") <= cap).drop("rn")


def analyse(calls: DataFrame, facts: DataFrame, target: DataFrame, depth: int = 3, tasks: int | None = None) -> DataFrame:
    """One row for the target (id): counts, other communities, risk, verdict."""
    return assess(staged(with_files(callers_of(calls, target, depth, tasks), facts), "callers"), facts, target)


def assess(callers: DataFrame, facts: DataFrame, target: DataFrame) -> DataFrame:
    """``analyse`` of callers that are known, with the facts of their files."""
    own = facts.join(target.select("id"), "id", "left_semi").select(F.col("community").alias("own"), F.col("is_core").alias("core"), F.coalesce("boundary", F.lit(0)).alias("boundary"))
    counts = split(callers)
    here = own.agg(F.first("own").alias("own"), F.first("core").alias("is_core"), F.first("boundary").alias("boundary")).withColumn("one", F.lit(1))
    distinct = callers.where("community is not null").select("community").distinct().withColumn("one", F.lit(1))
    cross = here.join(distinct, "one", "left").groupBy("is_core", "boundary").agg(F.sum((F.col("community") != F.col("own")).cast("int")).alias("c"))
    cross = cross.select("is_core", "boundary", F.coalesce("c", F.lit(0)).alias("other_communities"), F.lit(1).alias("one"))
    return verdict(risk_score(counts.withColumn("one", F.lit(1)).join(cross, "one").drop("one")))
