"""Keeping the graph current from deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_delta(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change_type) between stored and current (path, hash): added,
    changed or deleted.  A stored file without a hash counts as unknown."""
    was = stored.where("hash is not null").select("path", F.col("hash").alias("was"), F.lit(True).alias("had"))
    now = current.select("path", F.col("hash").alias("now"), F.lit(True).alias("has"))
    both = was.join(now, "path", "full_outer")
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select("path", change.alias("change_type")).where("change_type is not null")


def merge_deltas(*deltas: DataFrame) -> DataFrame:
    """One change a path: added beats changed, changed beats deleted."""
    rank = F.when(F.col("change_type") == "added", 0).when(F.col("change_type") == "changed", 1).otherwise(2)
    rows = deltas[0].select("path", "change_type")
    for d in deltas[1:]:
        rows = rows.unionByName(d.select("path", "change_type"))
    return rows.groupBy("path").agg(F.min_by("change_type", rank).alias("change_type"))


def indexable(delta: DataFrame, scan: DataFrame) -> DataFrame:
    """Changed and added paths must be in the scan; deleted ones need not."""
    kept = delta.where("change_type <> 'deleted'").join(scan.select("path"), "path", "left_semi")
    return kept.unionByName(delta.where("change_type = 'deleted'"))


def dependents(touched: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """Files (id) that import or call into the touched ones (id), one hop, the
    touched ones apart.  imports and calls are edges between files."""
    edges = imports.select("src", "dst").unionByName(calls.select("src", "dst"))
    hit = edges.join(touched.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return hit.join(touched.select("id"), "id", "left_anti")


def dirty_sets(delta: DataFrame, depend: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path) to extract and (path) to delete; depend holds paths."""
    extract = delta.where("change_type <> 'deleted'").select("path").unionByName(depend.select("path")).distinct()
    delete = delta.where("change_type <> 'added'").select("path").unionByName(depend.select("path")).distinct()
    return extract, delete


def stamp(stored: DataFrame, commit: str | None, url: str | None, now: str) -> DataFrame:
    """Repository rows with the run's commit and url, where it has them."""
    return stored.withColumns({
        "last_commit": F.coalesce(F.lit(commit), F.col("last_commit")),
        "source_url": F.coalesce(F.lit(url), F.col("source_url")),
        "last_indexed": F.lit(now),
    })
