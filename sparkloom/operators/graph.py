"""Building and maintaining the two tables of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import staged


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in order.  A grouped minimum of a struct, so it
    combines before the shuffle and no key's rows meet in one sort."""
    rest = [c for c in df.columns if c not in keys]
    front = [c for c in order if c not in keys]
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(front)], *[F.col(c) for c in rest])
    least = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return least.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """Rows with their place, from 0, in an order.  They are dealt by ranges and
    sorted there; a prefix sum over the sizes of the parts, one number a part,
    gives each part its first place, so no task sees all rows."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = staged(dealt, "numbered").withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    # As many rows as the range partitioning has parts.
    return rows.join(F.broadcast(base), "_part").select(*df.columns, (F.col("_base") + F.col("_in")).alias(name))


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """The first write of an id wins; ``seq`` orders writes."""
    return first_by(nodes, ["id"], ["seq"])


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Edges are a set by (src, dst, kind), exports also by exported name."""
    keys = ["src", "dst", "kind"] + (["exported_name"] if "exported_name" in edges.columns else [])
    return first_by(edges, keys, ["seq"])


def rekey_edges(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges whose (src, dst, kind) is in ``moves`` (with new_dst) go there; the
    later of edges that meet wins, and a resolved edge loses its symbol."""
    keys = ["src", "dst", "kind"]
    moved = edges.join(moves.select(*keys, "new_dst"), keys, "left")
    hit = F.col("new_dst").isNotNull()
    out = moved.withColumns({"dst": F.coalesce("new_dst", "dst"), "unresolved": F.when(~hit, F.col("unresolved"))}).drop("new_dst")
    return dedupe_edges(out.select(*edges.columns))


def unresolved_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Placeholder rows (id, name) for targets that no node has."""
    missing = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")
    return missing.groupBy(F.col("dst").alias("id")).agg(F.min(F.coalesce("unresolved", "dst")).alias("name"))


def without_unresolved(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("unresolved").isNull())


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key.  A new value replaces a stored one; a null in the
    new row leaves the stored value (a patch never unsets)."""
    rest = [c for c in stored.columns if c not in keys]
    s, n = stored.alias("s"), new.alias("n")
    both = s.join(n, keys, "full_outer")
    value = [F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}")).alias(c) if c in new.columns else F.col(f"s.{c}").alias(c) for c in rest]
    return both.select(*keys, *value).select(*stored.columns)


def upsert_edges(stored: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """New edges count only if both ends are stored nodes."""
    ids = nodes.select("id")
    held = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return upsert(stored, held.select(*new.columns), ["id"])


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes of the paths, members of classes included, and every edge that
    touches one."""
    gone = nodes.join(paths.select("path"), "path", "left_semi").select("id")
    kept = nodes.join(gone, "id", "left_anti").select(*nodes.columns)
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept, left.select(*edges.columns)


def kind_counts(nodes: DataFrame, column: str = "kind") -> DataFrame:
    return nodes.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def latest_labels(labels: DataFrame) -> DataFrame:
    """Of an append-only label table, the latest row a community."""
    rest = [c for c in labels.columns if c != "community"]
    latest = labels.groupBy("community").agg(F.max_by(F.struct(*rest), F.struct("labeled_at", "label")).alias("r"))
    return latest.select("community", *[F.col(f"r.{c}").alias(c) for c in rest])
