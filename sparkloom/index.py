"""Indexing: from files to the stored graph, whole or incremental.

What files say on their own (raw symbols, edges with symbols for targets, import
specifiers) is stored beside the resolved graph.  An incremental run extracts
only what changed and then resolves all raw rows again by joins, so its graph is
that of a full run.  Each run writes a new version folder; the repository row,
written last, makes it the current one.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import incremental
from sparkloom.operators.extract import extract_symbols, failures, parts_of
from sparkloom.operators.graph import dedupe_edges, dedupe_nodes
from sparkloom.operators.resolve import resolve_calls, resolve_imports, resolve_types
from sparkloom.schema import EDGE, NODE
from sparkloom.sources import repo as source

_PER_FILE = 1 << 24
RAW = ("files", "raw_nodes", "raw_edges", "raw_imports", "raw_marks", "raw_failures")


@dataclass
class Raw:
    """What files say on their own."""

    files: DataFrame  # path, language, hash, last_indexed
    nodes: DataFrame
    edges: DataFrame
    imports: DataFrame  # src, spec
    marks: DataFrame  # file, framework
    failures: DataFrame  # file

    def tables(self) -> dict[str, DataFrame]:
        return dict(zip(RAW, (self.files, self.nodes, self.edges, self.imports, self.marks, self.failures), strict=True))


def extract(scan: DataFrame, now: str) -> Raw:
    """Raw rows of scanned files (path, language, hash, content, seq)."""
    from sparkloom.sources.shared import staged

    rows = staged(extract_symbols(scan), "symbols")
    nodes, edges, imports, marks = parts_of(rows)
    return Raw(scan.select("path", "language", "hash", F.lit(now).alias("last_indexed")), nodes, edges, imports, marks, failures(rows))


def changes(stored: Raw, scan: DataFrame) -> DataFrame:
    """(path, change_type) between what is stored and a scan, by hashes."""
    return incremental.hash_delta(stored.files.select("path", "hash"), scan.select("path", "hash"))


def replaced(stored: Raw, delta: DataFrame, scan: DataFrame, now: str) -> Raw:
    """Stored raw rows with those of changed files extracted again and those of
    deleted files gone."""
    fresh = extract(scan.join(delta.where("change_type <> 'deleted'").select("path"), "path", "left_semi"), now)
    gone = delta.select("path")
    of = gone.select(F.concat(F.lit("file:"), "path").alias("file"))
    kept = Raw(
        stored.files.join(gone, "path", "left_anti"),
        stored.nodes.join(gone, "path", "left_anti").select(*NODE.names),
        stored.edges.withColumn("file", F.substring_index("src", "#", 1)).join(of, "file", "left_anti").select(*EDGE.names),
        stored.imports.join(of.withColumnRenamed("file", "src"), "src", "left_anti"),
        stored.marks.join(of, "file", "left_anti"),
        stored.failures.join(of, "file", "left_anti"),
    )
    return Raw(*[a.unionByName(b) for a, b in zip(kept.tables().values(), fresh.tables().values(), strict=True)])


def _ordered(df: DataFrame, file: F.Column, order: DataFrame) -> DataFrame:
    """seq from the walk order of the row's file and its place in the file."""
    joined = df.withColumn("_path", file).join(order.select(F.col("path").alias("_path"), F.col("seq").alias("_walk")), "_path")
    return joined.withColumn("seq", F.col("_walk") * _PER_FILE + F.col("seq") % _PER_FILE).drop("_path", "_walk")


def resolve(raw: Raw, order: DataFrame, calls_by_name: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all files; order: (path, seq) in walk order."""
    nodes = dedupe_nodes(_ordered(raw.nodes, F.col("path"), order))
    in_file = F.substring_index("src", "#", 1)
    edges = dedupe_edges(_ordered(raw.edges, F.expr("substring(substring_index(src, '#', 1), 6)"), order))
    files = raw.files.join(order, "path").select(F.concat(F.lit("file:"), "path").alias("id"), "path", "language", "seq")
    pending = raw.imports.join(files.select(F.col("id").alias("src"), F.col("path").alias("src_path"), "language"), "src")
    found = resolve_imports(pending, files)
    imports = found.select("src", "dst", "unresolved").distinct()
    known = imports.where("unresolved is null").select("src", "dst")
    kinds = nodes.select(F.col("id").alias("target"), F.col("kind").alias("k"))
    exports = edges.where("kind = 'EXPORTS'").select(F.col("src").alias("file"), F.col("exported_name").alias("name"), F.col("dst").alias("target"), "seq")
    exports = exports.join(kinds, "target").select("file", "name", "target", F.col("k").alias("kind"), "seq")
    symbols = nodes.select("id", "name", F.concat(F.lit("file:"), "path").alias("file"), "kind", "seq")

    refs = edges.where("kind in ('EXTENDS', 'IMPLEMENTS')").select("src", in_file.alias("file"), "kind", F.col("unresolved").alias("symbol"))
    types = resolve_types(refs, symbols.where("kind in ('Class', 'Interface')"), known, exports)
    moved = types.select("src", "kind", F.col("symbol").alias("unresolved"), "target")
    if calls_by_name:
        calls = edges.where("kind = 'CALLS'").select("src", in_file.alias("file"), F.col("unresolved").alias("name"))
        called = resolve_calls(calls, symbols.where("kind in ('Function', 'Method')"), known, exports)
        moved = moved.unionByName(called.select("src", F.lit("CALLS").alias("kind"), F.col("name").alias("unresolved"), "target"))
    joined = edges.join(moved, ["src", "kind", "unresolved"], "left")
    hit = F.col("target").isNotNull()
    linked = joined.select(
        "kind", "src", F.coalesce("target", "dst").alias("dst"), F.when(~hit, F.col("unresolved")).alias("unresolved"), F.when(hit, F.col("unresolved")).alias("symbol"), "exported_name", "seq"
    )
    brought = imports.select(F.lit("IMPORTS").alias("kind"), "src", "dst", "unresolved", F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("exported_name"), F.lit(0).cast("long").alias("seq"))
    out = dedupe_edges(linked.unionByName(brought))
    edge_id = F.concat("kind", F.lit(":"), "src", F.lit("->"), "dst")
    return nodes, out.withColumn("id", edge_id)


def file_nodes(listed: DataFrame, root: str, raw: Raw, commit: str | None = None, url: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Repository, Folder and File nodes with test marks and hashes; CONTAINS."""
    rows, edges = source.containment(listed, root)
    facts = raw.files.select(F.concat(F.lit("file:"), "path").alias("id"), F.col("hash").alias("content_hash"), "last_indexed")
    marks = raw.marks.select(F.col("file").alias("id"), F.col("framework").alias("test_framework"), F.lit(True).alias("is_test"))
    full = rows.join(facts, "id", "left").join(marks, "id", "left")
    repo = F.col("kind") == "Repository"
    full = full.withColumns({"last_commit": F.when(repo, F.lit(commit)), "source_url": F.when(repo, F.lit(url))})
    missing = [f for f in NODE.fields if f.name not in full.columns]
    nodes = full.select(*full.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]).select(*NODE.names)
    return nodes, edges


class Store:
    """Versioned Parquet tables under one folder of any store Spark reaches."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def version(self) -> int:
        """The last finished version, 0 if there is none."""
        n = 0
        while self._exists(f"{self.place}/v{n + 1}/meta/_SUCCESS"):
            n += 1
        return n

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/v{version or self.version()}/{table}")

    def write(self, tables: dict[str, DataFrame], meta: dict[str, str | None]) -> int:
        """All tables of a new version, its meta row last.  Ids of nodes are
        unique; a version in which two rows share one is never finished."""
        n = self.version() + 1
        for name, df in tables.items():
            writer = df.write.mode("overwrite")
            (writer.partitionBy("kind") if name in ("nodes", "edges") else writer).parquet(f"{self.place}/v{n}/{name}")
        if "nodes" in tables:
            twice = self.read("nodes", n).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").orderBy("id").first()
            if twice:
                raise ValueError(f"{twice['n']} nodes have the id {twice['id']}")
        self._meta_row(meta).write.mode("overwrite").parquet(f"{self.place}/v{n}/meta")
        return n

    def _meta_row(self, meta: dict[str, str | None]) -> DataFrame:
        schema = T.StructType([T.StructField(k, T.StringType()) for k in meta])
        return self.spark.createDataFrame([tuple(meta.values())], schema)

    def meta(self) -> dict | None:
        """The repository row: as written with the version, or as last restamped."""
        n = self.version()
        if not n:
            return None
        stamps = f"{self.place}/v{n}/stamps"
        rows = self.spark.read.parquet(stamps).orderBy(F.desc("indexed_at")) if self._exists(stamps) else self.read("meta", n)
        return rows.first().asDict()

    def restamp(self, **changed: str | None) -> None:
        """Record a run that found nothing to index."""
        self._meta_row(self.meta() | changed).write.mode("append").parquet(f"{self.place}/v{self.version()}/stamps")

    def clear(self) -> None:
        """Delete every version and all that was derived from it."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.place)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def _write(root: str, store: Store, raw: Raw, listed: DataFrame, ordered: DataFrame, url: str | None, mode: str, now: str) -> int:
    from sparkloom.sources.shared import staged

    raw = Raw(*[staged(df, name) for name, df in raw.tables().items()])
    symbols, links = resolve(raw, ordered.select("path", "seq"))
    commit = source.head(root) if source.is_git(root) else None
    top, held = file_nodes(listed, root, raw, commit, url)
    nodes = top.unionByName(symbols.select(*NODE.names))
    none = [F.lit(None).cast("string").alias(c) for c in ("unresolved", "symbol", "exported_name")]
    columns = ["id", "kind", "src", "dst", "unresolved", "symbol", "exported_name"]
    edges = links.select(*columns).unionByName(held.select("id", "kind", "src", "dst", *none))
    meta = {"path": root, "last_commit": commit, "source_url": url, "indexed_at": now, "mode": mode, "failed": str(raw.failures.count())}
    return store.write({"nodes": nodes, "edges": edges, **raw.tables()}, meta)


def full(spark: SparkSession, root: str, store: Store, ignore: tuple[str, ...] = (), url: str | None = None, now: str | None = None) -> int:
    now = now or datetime.now(UTC).isoformat()
    listed, ordered = _listed(spark, root, ignore)
    return _write(root, store, extract(source.scan(ordered), now), listed, ordered, url, "full", now)


def _listed(spark: SparkSession, root: str, ignore: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """What lies below the root, listed once for a run, and its files in order."""
    from sparkloom.sources.shared import staged

    listed = source.listing(spark, root, ignore)
    return listed, staged(source.walk_order(listed), "walk")


def update(spark: SparkSession, root: str, store: Store, ignore: tuple[str, ...] = (), now: str | None = None) -> tuple[str, int]:
    """(mode, files extracted): ``current`` if nothing changed, else ``git`` or
    ``hash`` by where the delta came from; ``full`` without a stored version."""
    now, meta = now or datetime.now(UTC).isoformat(), store.meta()
    if meta is None:
        full(spark, root, store, ignore, None, now)
        return "full", store.read("files").count()
    since = meta["last_commit"]
    by_git = bool(since) and source.is_git(root) and source.is_ancestor(root, since)
    if by_git and source.head(root) == since and source.is_clean(root) and meta["mode"] != "dirty":
        return "current", 0
    listed, ordered = _listed(spark, root, ignore)
    scan = source.scan(ordered)
    stored = Raw(*[store.read(t) for t in RAW])
    # Hashes decide in either mode: git alone can't tell an edit from its undoing.
    delta = changes(stored, scan)
    if by_git:
        said = source.git_delta(spark, root, since)
        early = incremental.indexable(said, scan)
        delta = incremental.merge_deltas(delta, early.join(delta.select("path"), "path", "left_semi"))
    delta = delta.cache()
    try:
        touched = delta.where("change_type <> 'deleted'").select("path")
        n, any_change = touched.count(), not delta.isEmpty()
        if not any_change:
            dirty = by_git and not source.is_clean(root)
            store.restamp(last_commit=source.head(root) if source.is_git(root) else None, indexed_at=now, mode="dirty" if dirty else meta["mode"] if meta["mode"] != "dirty" else "git")
            return "current", 0
        joined = replaced(stored, delta, scan, now)
        dirty = by_git and not source.is_clean(root)
        _write(root, store, joined, listed, ordered, meta["source_url"], "dirty" if dirty else "git" if by_git else "hash", now)
    finally:
        delta.unpersist()
    return ("git" if by_git else "hash"), n
