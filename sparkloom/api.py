"""The tools over a stored graph: each returns DataFrames or rendered text."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import sql as readonly
from sparkloom.functions.text import first_line, relative_path
from sparkloom.index import Store
from sparkloom.operators import analytics, embed, graph, impact, overview, search, traverse
from sparkloom.operators.postings import SearchIndex
from sparkloom.sources.shared import staged

SYMBOLS = ("Function", "Method", "Class", "Interface", "TypeAlias", "Enum", "Variable")


def _between(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} is {low} to {high}")
    return value


class CodeGraph:
    """Reads the current version of a store."""

    def __init__(self, spark: SparkSession, place: str, model: embed.Model = embed.hashing_model):
        self.spark, self.store, self.model = spark, Store(spark, place), model
        meta = self.store.meta()
        self.root = meta["path"]
        stamped = F.when(F.col("kind") == "Repository", F.lit(meta["last_commit"])).otherwise(F.col("last_commit"))
        self.nodes, self.edges = self.store.read("nodes").withColumn("last_commit", stamped), self.store.read("edges")

    # Derived tables, written beside the version they belong to.

    def _extra(self, name: str) -> DataFrame | None:
        place = f"{self.store.place}/v{self.store.version()}/{name}"
        return self.spark.read.parquet(place) if self.store._exists(f"{place}/_SUCCESS") else None

    def _save(self, name: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
        place = f"{self.store.place}/v{self.store.version()}/{name}"
        df.write.mode(mode).parquet(place)
        return self.spark.read.parquet(place)

    def files(self) -> DataFrame:
        """Files with community, pagerank, boundary and is_core (null or false
        before clustering)."""
        files = self.nodes.where("kind = 'File'").select("id", "name", "path", "language", F.coalesce("is_test", F.lit(False)).alias("is_test"), "test_framework")
        scored = self._extra("scores")
        if scored is None:
            return files.withColumns({"community": F.lit(None).cast("long"), "pagerank": F.lit(0.0), "boundary": F.lit(0).cast("long"), "is_core": F.lit(False)})
        return files.join(scored, "id", "left")

    def calls(self) -> DataFrame:
        return self.edges.where("kind = 'CALLS'").select("src", "dst")

    def imports(self) -> DataFrame:
        return self.edges.where("kind = 'IMPORTS' and unresolved is null").select("src", "dst")

    def cluster(self, by_rank: int = 5, by_boundary: int = 3, least: int = 3) -> DataFrame:
        """Communities, PageRank, boundary and spine of the files; the report."""
        files = self.nodes.where("kind = 'File'").select("id", "path")
        links = analytics.undirected(self.imports(), files)
        members = analytics.leiden(files, links)
        scored = members.join(analytics.pagerank(files, links), "id").join(analytics.boundary_degree(members, links), "id")
        scored = self._save("scores", analytics.spine(scored, by_rank, by_boundary))
        named = analytics.communities(scored, least).join(analytics.heuristic_labels(scored.join(files, "id"), self.root), "community", "left")
        self._save("communities", named)
        return analytics.cluster_report(scored, least)

    def clear_clusters(self) -> None:
        for name in ("scores", "communities"):
            old = self._extra(name)
            if old is not None:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(f"{self.store.place}/v{self.store.version()}/{name}")
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def embed(self) -> dict[str, int]:
        """Embed what has no vector yet; counts of embedded and skipped."""
        stored = self._extra("vectors")
        wanted = embed.candidates(self.nodes, stored)
        made = self._save("vectors_new", embed.embed(wanted, self.model))
        good = made.where("embedding is not null")
        n = good.count()
        if n:
            self._save("vectors", good, "append")
        return {"embedded": n, "skipped": made.count() - n}

    def _searched(self) -> DataFrame:
        return self.nodes.where(F.col("kind").isin(*SYMBOLS, "File")).select("id", "kind", *search.FIELDS)

    def _index(self) -> SearchIndex | None:
        place = f"{self.store.place}/v{self.store.version()}/search"
        return SearchIndex(self.spark, place) if self.store._exists(f"{place}/stats/_SUCCESS") else None

    def index_text(self) -> None:
        """Store the full-text index of this version; searches then read it."""
        SearchIndex.build(self._searched(), f"{self.store.place}/v{self.store.version()}/search", search.FIELDS)

    # T1 to T10.

    def search_code(self, query: str, mode: str | None = None, kind: str | None = None, limit: int = 10) -> DataFrame:
        """Hits with their details; mode fts, vector or hybrid (the default once
        vectors are stored)."""
        _between("limit", limit, 1, 50)
        vectors = self._extra("vectors")
        mode = mode or ("hybrid" if vectors is not None else "fts")
        docs = self._searched()
        stored = self._index()

        def fts(n: int) -> DataFrame:
            return stored.search(query, n, kind) if stored else search.full_text(docs, query, n, search.FIELDS, kind)

        if mode == "fts":
            hits = fts(limit).withColumn("matched_by", F.array(F.lit("fts")))
        else:
            if vectors is None:
                raise ValueError("no vectors are stored; run embed first")
            asked = [float(x) for x in self.model([query])[0]]
            rows = docs.join(vectors, "id", "left")
            if mode == "vector":
                hits = search.vector(rows, asked, limit, kind).withColumn("matched_by", F.array(F.lit("vector")))
            else:
                hits, self.leg_state = search.hybrid(rows, query, asked, limit, kind, fts=fts)
        return search.with_details(hits, self.nodes)

    def get_definition(self, name: str, file: str | None = None, kind: str | None = None) -> DataFrame:
        rows = self.nodes.where((F.col("name") == name) & F.col("kind").isin(*SYMBOLS))
        if file:
            rows = rows.where(F.col("path").contains(file))
        if kind:
            rows = rows.where(F.col("kind") == kind)
        return rows.orderBy("path", "start_row", "id").limit(20).select("id", "kind", "name", "path", "start_row", "end_row", "signature", "body")

    def read_code(self, file: str, start: int = 1, end: int | None = None) -> str:
        """Numbered lines of an indexed file, at most 2,000; other files are an
        error.  The lines are counted and cut by an executor, so only what is shown
        reaches the driver."""
        if self.nodes.where((F.col("kind") == "File") & (F.col("path") == file)).isEmpty():
            raise ValueError(f"{file} is no indexed file")
        place = file if "://" in file else f"file://{file}"
        text = self.spark.read.format("binaryFile").load(place).select(F.decode("content", "UTF-8").alias("text"))
        lines = text.select(F.split("text", "\n", -1).alias("lines"))
        first = max(start, 1)
        last = F.least(F.size("lines"), F.lit(end if end else 1 << 30))
        shown = lines.select((last - first + 1).alias("n"), F.slice("lines", first, F.greatest(F.least(last - first + 1, F.lit(2000)), F.lit(0))).alias("lines")).first()
        if shown["n"] > 2000:
            raise ValueError("at most 2000 lines; give startLine and endLine")
        return "\n".join(f"{first + i:>5} {line}" for i, line in enumerate(shown["lines"]))

    def _hop(self, starts: DataFrame, depth: int, limit: int, reverse: bool) -> DataFrame:
        hops = traverse.k_hop(self.calls(), starts.select("id"), depth, reverse)
        named = self.nodes.select(F.col("id").alias("node"), "name", "kind", "path", "start_row")
        out = hops.select("node", "distance").distinct().join(named, "node", "left")
        shown = out.withColumn("name", F.coalesce("name", F.substring_index("node", ":", -1)))
        return shown.orderBy("distance", F.asc_nulls_last("path"), "node").limit(limit)

    def get_callers(self, symbol: str, depth: int = 1, limit: int = 20) -> DataFrame:
        """Callers of nodes of that name, and of the unresolved symbol."""
        _between("limit", limit, 1, 100)
        named = self.nodes.where(F.col("name") == symbol).select("id")
        bare = self.spark.createDataFrame([(f"unresolved:callable:{symbol}",)], "id string")
        return self._hop(named.unionByName(bare), depth, limit, True)

    def get_callees(self, symbol: str, file: str | None = None, depth: int = 1, limit: int = 30) -> DataFrame:
        _between("limit", limit, 1, 100)
        rows = self.nodes.where((F.col("name") == symbol) & F.col("kind").isin("Function", "Method"))
        if file:
            rows = rows.where(F.col("path").contains(file))
        return self._hop(rows.orderBy("id").limit(5), depth, limit, False)

    def impact_analysis(self, symbol: str, file: str | None = None, depth: int = 3) -> dict:
        """Counts, risk, verdict and the callers shown, capped to fit a report."""
        rows = self.nodes.where((F.col("name") == symbol) & F.col("kind").isin("Function", "Method", "Class", "Variable"))
        if file:
            rows = rows.where(F.col("path").contains(file))
        target = rows.orderBy("id").limit(1).select("id", "kind", "path")
        found = target.first()
        if found is None:
            return {"found": False}
        by_path = self.files().select("path", "community", "is_core", "is_test", "pagerank", "boundary")
        facts = self.nodes.where(F.col("kind").isin("Function", "Method", "Class", "Variable")).select("id", "path").join(by_path, "path").drop("path")
        facts = facts.withColumn("community", F.col("community").cast("string"))
        own = self.spark.createDataFrame([(found["id"],)], "id string")
        callers = staged(impact.with_files(impact.callers_of(self.calls(), own, depth), facts), "callers")
        row = impact.assess(callers, facts, own).first().asDict()
        home = target.join(by_path.select("path", "community"), "path", "left").first()["community"]
        labels = self.labels().select(F.col("community").cast("string").alias("community"), "label")
        named = self.nodes.select(F.col("id").alias("node"), "name", "path", "start_row")
        known = callers.join(named, "node", "left").join(labels, "community", "left")
        known = staged(known.withColumn("label", F.coalesce("label", F.concat(F.lit("community-"), F.coalesce("community", F.lit("-1"))))), "named-callers")
        direct, test = F.col("distance") == 1, F.coalesce("is_test", F.lit(False))
        production = known.where(direct & ~test)
        cap = impact.truncation_cap(production).first()["cap"]
        sizes = known.groupBy("community", "label").agg(F.count("*").alias("callers"), F.count_if(direct & ~test).alias("direct"))
        note = None if found["kind"] in ("Function", "Method") else "no call edges exist for this kind"
        return {
            "found": True,
            "id": found["id"],
            **row,
            "note": note,
            "cap": cap,
            "name": symbol,
            "path": found["path"],
            "depth": depth,
            "home": None if home is None else str(home),
            "callers": impact.truncated(callers, cap),
            "spine": production.where(F.coalesce("is_core", F.lit(False))).orderBy("path", "node"),
            "tests": known.where(direct & test).groupBy("path").agg(F.count("*").alias("calls")).orderBy("path"),
            "production": impact.truncated(production, cap),
            "communities": sizes.orderBy(F.desc("callers"), "community"),
        }

    def get_overview(self) -> dict[str, DataFrame]:
        files = self.files()
        return {
            "kinds": graph.kind_counts(self.nodes),
            "languages": graph.kind_counts(self.nodes.where("kind = 'File'"), "language"),
            "communities": overview.overview_communities(files.where("community is not null")),
            "labels": self.labels(),
            "freshness": self._freshness(),
        }

    def labels(self) -> DataFrame:
        log = self.spark.read.parquet(f"{self.store.place}/labels") if self.store._exists(f"{self.store.place}/labels") else None
        if log is None:
            return self.spark.createDataFrame([], "community long, label string, description string, labeled_at timestamp, spine array<string>")
        return graph.latest_labels(log).select("community", "label", "description", "labeled_at", "spine")

    def _spine(self) -> DataFrame:
        return self.files().where("is_core").groupBy("community").agg(F.array_sort(F.collect_list("path")).alias("spine"))

    def _freshness(self) -> DataFrame:
        labels = self.labels()
        return overview.freshness(labels, overview.spine_drift(labels.where("spine is not null"), self._spine()), F.current_date())

    def label_community(self, community: int, label: str, description: str | None = None) -> str:
        """Append a label; with a description also the spine as it is now."""
        _between("label length", len(label), 1, 60)
        _between("description length", len(description or ""), 0, 500)
        if self.files().where(F.col("community") == community).isEmpty():
            return f"no community {community}"
        row = self.spark.createDataFrame([(community, label, description, datetime.now(UTC))], "community long, label string, description string, labeled_at timestamp")
        spine = self._spine().where(F.col("community") == community) if description else self._spine().limit(0)
        row.join(spine, "community", "left").write.mode("append").parquet(f"{self.store.place}/labels")
        return f"community {community} is now {label}"

    def generate_wiki(self, max_communities: int = 15, glossary: int = 25) -> dict[str, DataFrame]:
        """The tables of the wiki; ``render.wiki`` writes them out."""
        _between("maxCommunities", max_communities, 1, 100)
        _between("glossaryLimit", glossary, 0, 100)
        files = self.files()
        clustered = files.where("community is not null")
        symbols = self.nodes.where("kind in ('Function', 'Method')").select("id", "name", "path", first_line(F.col("signature"), 100).alias("signature")).join(files.select("path", "community"), "path", "left")
        outside = self.edges.where("kind = 'IMPORTS' and unresolved is not null").select("src", F.col("unresolved").alias("symbol"))
        entries = traverse.entry_points(files, self.imports())
        shown = staged(overview.communities_with_spine(clustered).limit(max_communities).select("community", "size"), "wiki-communities")
        ids, relative = shown.select("community"), lambda c: relative_path(F.col(c), self.root).alias(c)
        heuristic = self._extra("communities")
        guess = heuristic.select("community", F.col("label").alias("guess")) if heuristic is not None else ids.withColumn("guess", F.lit(None).cast("string")).limit(0)
        titles = ids.join(self.labels().select("community", "label", "description"), "community", "left").join(guess, "community", "left").join(self._freshness(), "community", "left")
        called = overview.callers_per(symbols.where("community is not null"), self.calls()).where("callers > 0").join(ids, "community", "left_semi")
        outer = overview.external_deps(clustered, outside).join(ids, "community", "left_semi")
        return {
            "repository": self.nodes.where("kind = 'Repository'").limit(1),
            "kinds": graph.kind_counts(self.nodes),
            "languages": graph.kind_counts(self.nodes.where("kind = 'File'"), "language"),
            "communities": shown.join(titles, "community").orderBy(F.desc("size"), "community"),
            "spine": overview.capped(clustered.where("is_core").join(ids, "community", "left_semi"), 5, F.desc("pagerank"), F.col("id")).select("community", "place", "name", relative("path")),
            "functions": overview.capped(called, 5, F.desc("callers"), F.col("id")).select("community", "place", "name", "signature", relative("path"), "callers"),
            "cross": overview.cross_community(clustered, self.imports()).limit(15),
            "routes": overview.routes(self.nodes),
            "entries": entries.select("id", relative_path(F.col("path"), self.root).alias("path")).orderBy("path").limit(20),
            "test_frameworks": overview.test_frameworks(files),
            "tests": overview.tests(files),
            "glossary": overview.glossary(symbols, self.calls(), glossary) if glossary else overview.glossary(symbols, self.calls(), 1).limit(0),
            "externals": overview.capped(outer, 8, F.desc("n"), F.col("symbol")).select("community", "place", "symbol", "n"),
            "coverage": overview.coverage(files),
            "orphans": overview.orphans(files).orderBy("path"),
        }

    def query(self, sql: str, limit: int = 50, args: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """Read-only SQL over views nodes, edges and files."""
        return readonly.query(self.spark, sql, {"nodes": self.nodes, "edges": self.edges, "files": self.files()}, limit, args)
