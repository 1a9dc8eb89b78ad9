"""Aggregates behind the overview and the wiki."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_DAYS = 7


def first_paths(files: DataFrame, k: int, name: str, *order: Column) -> DataFrame:
    """(community, the first k paths in an order).  The rank is limited before
    the shuffle, so a large community sends k rows a task and is never gathered."""
    place = F.row_number().over(Window.partitionBy("community").orderBy(*order))
    few = files.select("community", "path", place.alias("place")).where(F.col("place") <= k)
    return few.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("few")).select("community", F.col("few.path").alias(name))


def capped(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each community in an order, with their place; limited
    before the shuffle."""
    place = F.row_number().over(Window.partitionBy("community").orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k).orderBy("community", "place")


def overview_communities(files: DataFrame, top: int = 12, spine: int = 6, sample: int = 3) -> DataFrame:
    """The largest communities: size, most central spine paths, sample paths."""
    sizes = files.groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community").limit(top)
    core = first_paths(files.where("is_core"), spine, "spine", F.desc("pagerank"), F.col("path"))
    some = first_paths(files, sample, "sample", F.col("path"))
    none = F.array().cast("array<string>")
    joined = sizes.join(core, "community", "left").join(some, "community", "left")
    return joined.select("community", "size", F.coalesce("spine", none).alias("spine"), F.coalesce("sample", none).alias("sample")).orderBy(F.desc("size"), "community")


def communities_with_spine(files: DataFrame) -> DataFrame:
    return files.groupBy("community").agg(F.count_distinct("id").alias("size"), F.array_sort(F.collect_set(F.when(F.col("is_core"), F.col("path")))).alias("spine")).orderBy(F.desc("size"), "community")


def callers_per(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols with their number of distinct callers."""
    counted = calls.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))
    return symbols.join(counted, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))


def top_functions(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(community, id, name, callers) with at least one caller."""
    return callers_per(symbols, calls).where("callers > 0").select("community", "id", "name", "callers").orderBy("community", F.desc("callers"), "id")


def glossary(symbols: DataFrame, calls: DataFrame, limit: int = 25) -> DataFrame:
    return callers_per(symbols, calls).where("callers > 0").orderBy(F.desc("callers"), "id").select("id", "name", "callers").limit(limit)


def cross_community(members: DataFrame, imports: DataFrame) -> DataFrame:
    """(src_community, dst_community, n) of imports between communities."""
    a, b = (members.select(F.col("id").alias(k), F.col("community").alias(f"{k}_community")) for k in ("src", "dst"))
    joined = imports.join(a, "src").join(b, "dst").where("src_community <> dst_community")
    return joined.groupBy("src_community", "dst_community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src_community", "dst_community")


def external_deps(members: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(community, symbol, n) of unresolved modules, the Java platform's apart."""
    joined = unresolved.join(members.select(F.col("id").alias("src"), "community"), "src")
    outside = joined.where(~F.col("symbol").startswith("java.") & ~F.col("symbol").startswith("javax."))
    return outside.groupBy("community", "symbol").agg(F.count_distinct("src").alias("n")).orderBy("community", F.desc("n"), "symbol")


def coverage(files: DataFrame) -> DataFrame:
    """One row: total, clustered and how many orphans."""
    return files.agg(F.count("*").alias("total"), F.count("community").alias("clustered"), F.count_if(F.col("community").isNull()).alias("orphans"))


def orphans(files: DataFrame) -> DataFrame:
    """Files without a community; rows, as there may be many."""
    return files.where("community is null").select("id", "path")


def routes(nodes: DataFrame) -> DataFrame:
    return nodes.where("http_method is not null").select("http_method", "route", "path", "name").orderBy("route", "http_method", "path", "name")


def tests(files: DataFrame) -> DataFrame:
    """Test files with their framework; one row a file."""
    return files.where("is_test").select("test_framework", "path").orderBy("test_framework", "path")


def test_frameworks(files: DataFrame) -> DataFrame:
    return files.where("is_test").groupBy("test_framework").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "test_framework")


def spine_drift(snapshots: DataFrame, current: DataFrame) -> DataFrame:
    """(community, added, dropped) between a label's snapshot and the spine now;
    both have (community, spine: array of paths)."""
    both = snapshots.select("community", F.col("spine").alias("was")).join(current.select("community", F.col("spine").alias("now")), "community", "left")
    now = F.coalesce("now", F.array().cast("array<string>"))
    return both.select("community", F.array_sort(F.array_except(now, "was")).alias("added"), F.array_sort(F.array_except("was", now)).alias("dropped"))


def freshness(labels: DataFrame, drift: DataFrame, now) -> DataFrame:
    """(community, age_days, stale): a week old, or the spine moved."""
    age = F.datediff(now, "labeled_at")
    joined = labels.join(drift, "community", "left")
    moved = (F.coalesce(F.size("added"), F.lit(0)) > 0) | (F.coalesce(F.size("dropped"), F.lit(0)) > 0)
    return joined.select("community", age.alias("age_days"), ((age >= STALE_DAYS) | moved).alias("stale"))
