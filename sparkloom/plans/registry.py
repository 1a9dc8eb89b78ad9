"""All queries of the engine by name, with their SQL.

Every query runs an operator over whole tables; the SQL next to it says the same
for an independent engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import analytics, graph, impact, incremental, overview, resolve, search, traverse
from sparkloom.operators.postings import SearchIndex
from sparkloom.plans import views as v
from sparkloom.plans.views import SQL, START, read
from sparkloom.sources.shared import new_place, staged

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    """Register a query under its function's name; ``sql`` may use the derived
    graph's tables if ``graph``."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = f"WITH RECURSIVE {SQL} {', ' + sql[4:].strip() if sql.lstrip().startswith('AND ') else sql}" if graph else sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from sparkloom.plans import code_queries

    return {**_QUERIES, **code_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    from sparkloom.plans import code_queries

    return {**_ORACLES, **code_queries.ORACLES}


# Scans and filters


@query(f"SELECT id, name, path, language, community FROM parts WHERE id = '{START}'")
def node_lookup(spark, d):
    return v.parts(spark, d).where(F.col("id") == START).select("id", "name", "path", "language", "community")


@query("SELECT id, name, path FROM parts WHERE name = 'red widget' AND strpos(path, '/ECONOMY/') > 0 ORDER BY path, id LIMIT 20")
def definition_by_name(spark, d):
    rows = v.parts(spark, d).where((F.col("name") == "red widget") & F.col("path").contains("/ECONOMY/"))
    return rows.orderBy("path", "id").limit(20).select("id", "name", "path")


@query("SELECT 'File' AS kind, count(*) AS n FROM parts UNION ALL SELECT 'IMPORTS', count(*) FROM edges UNION ALL SELECT 'Unresolved', count(DISTINCT symbol) FROM hrefs")
def kind_counts(spark, d):
    nodes = v.parts(spark, d).select("kind")
    links = v.edges(spark, d).select(F.lit("IMPORTS").alias("kind"))
    gone = v.hrefs(spark, d).select("symbol").distinct().select(F.lit("Unresolved").alias("kind"))
    return graph.kind_counts(nodes.unionByName(links).unionByName(gone))


@query("SELECT language, count(*) AS n FROM parts GROUP BY language")
def language_counts(spark, d):
    return graph.kind_counts(v.parts(spark, d), "language")


@query("SELECT id, path FROM parts WHERE path = '/repo/ECONOMY/Brand#1' OR starts_with(path, '/repo/ECONOMY/Brand#1/')")
def prefix_scan(spark, d):
    rows = v.parts(spark, d)
    return rows.where(tx.below(F.col("path"), "/repo/ECONOMY/Brand#1")).select("id", "path")


@query("SELECT id, path FROM parts WHERE strpos(path, 'widget_1') > 0")
def substring_filter(spark, d):
    return v.parts(spark, d).where(F.col("path").contains("widget_1")).select("id", "path")


# Text rules

_PATHS = "paths AS (SELECT k, replace(path, '#', '') || CASE k % 8 WHEN 0 THEN '.ts' WHEN 1 THEN '.TSX' WHEN 2 THEN '.js' WHEN 3 THEN '.java' WHEN 4 THEN '.test.ts' WHEN 5 THEN '.py' WHEN 6 THEN '/node_modules/x.mjs' ELSE '/__tests__/y.jsx' END AS p FROM parts)"


def _paths(spark, d):
    ends = [".ts", ".TSX", ".js", ".java", ".test.ts", ".py", "/node_modules/x.mjs", "/__tests__/y.jsx"]
    ending = F.element_at(F.array(*map(F.lit, ends)), (F.col("k") % 8 + 1).cast("int"))
    return v.parts(spark, d).select("k", F.concat(F.regexp_replace("path", "#", ""), ending).alias("p"))


@query(f"AND {_PATHS} SELECT k, CASE lower(regexp_extract(p, '[.]([A-Za-z0-9]+)$', 1)) WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'java' THEN 'java' END AS language FROM paths")
def language_detect(spark, d):
    return _paths(spark, d).select("k", tx.language(F.col("p")).alias("language"))


@query(f"AND {_PATHS} SELECT k, len(list_filter(string_split(p, '/'), lambda s: starts_with(s, '.') OR s IN ({', '.join(repr(x) for x in tx.IGNORED)}, 'ECONOMY'))) > 0 AS ignored FROM paths")
def ignore_filter(spark, d):
    return _paths(spark, d).select("k", tx.ignored(F.col("p"), ("ECONOMY",)).alias("ignored"))


@query(
    """SELECT page_id, url, CASE WHEN regexp_matches(url, '^[a-z]+://([^/]+)/(.+)$') THEN regexp_replace(regexp_extract(url, '^[a-z]+://([^/]+)/(.+)$', 1), '^.*@', '') ELSE 'unknown' END || '/' ||
    regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(url, '^[a-z]+://([^/]+)/(.+)$') THEN regexp_extract(url, '^[a-z]+://([^/]+)/(.+)$', 2) ELSE url END, '[.]git$', ''), '/+$', ''), '[^a-zA-Z0-9._/-]', '_', 'g') AS slug FROM pages""",
    graph=False,
)
def url_slug(spark, d):
    return read(spark, d, "pages").select("page_id", "url", tx.url_slug(F.col("url")).alias("slug"))


@query(f"AND {_PATHS} SELECT k, regexp_matches(lower(p), '[.](spec|test)[.][a-z]+$|/__tests?__/|/(spec|tests?)/|_test[.](py|go)$|test_[^/]+[.]py$') AS is_test FROM paths")
def test_path_flag(spark, d):
    return _paths(spark, d).select("k", tx.is_test_path(F.col("p")).alias("is_test"))


@query("AND refs AS (SELECT id, ' com.acme.' || replace(name, ' ', '.') || CASE WHEN k % 2 = 0 THEN '<T, List<X>>' ELSE ' ' END AS ref FROM parts) SELECT id, regexp_extract(trim(string_split(ref, '<')[1]), '[^.]*$') AS name FROM refs")
def normalize_type_ref(spark, d):
    ref = F.concat(F.lit(" com.acme."), F.regexp_replace("name", " ", "."), F.when(F.col("k") % 2 == 0, "<T, List<X>>").otherwise(" "))
    return v.parts(spark, d).select("id", tx.normalize_type(ref).alias("name"))


@query("SELECT doc_id, substring(text, 1, 280) AS snippet FROM documents", graph=False)
def snippet(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, substring(trim(string_split(text, chr(10))[1], ' '), 1, 100) AS line FROM documents", graph=False)
def signature_first_line(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.first_line(F.col("text"), 100).alias("line"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents", graph=False)
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT id, CASE WHEN starts_with(path, '/repo/ECONOMY/') THEN substring(path, 15) ELSE path END AS rel FROM parts")
def relative_path(spark, d):
    return v.parts(spark, d).select("id", tx.relative_path(F.col("path"), "/repo/ECONOMY").alias("rel"))


@query("SELECT doc_id, i AS line, lpad(cast(i AS varchar), 5, ' ') || ' ' || ls[i] AS shown FROM (SELECT doc_id, ls, unnest(range(2, least(len(ls), 6) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))", graph=False)
def read_lines(spark, d):
    """Lines 2 to 6 of each text, numbered."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "body"))
    at = F.col("pos") + 1
    return lines.where(at.between(2, 6)).select("doc_id", at.cast("long").alias("line"), F.concat(F.lpad(at.cast("string"), 5, " "), F.lit(" "), "body").alias("shown"))


# Building the graph


@query("SELECT 'part:' || l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY l_partkey")
def dedupe_nodes(spark, d):
    line = read(spark, d, "lineitem")
    nodes = line.select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.dedupe_nodes(nodes)


@query("SELECT l_orderkey AS src, l_partkey AS dst, 'DEFINES' AS kind, min(l_linenumber) AS seq FROM lineitem GROUP BY ALL", graph=False)
def dedupe_edges(spark, d):
    line = read(spark, d, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("DEFINES").alias("kind"), F.col("l_linenumber").alias("seq"))
    return graph.dedupe_edges(rows)


_REKEYED = "links AS (SELECT l_orderkey AS src, CASE WHEN l_partkey % 3 = 0 THEN 3 ELSE l_partkey END AS dst, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'p' || l_partkey END AS unresolved, min(l_linenumber) AS seq FROM lineitem GROUP BY ALL)"


@query(f"WITH {_REKEYED} SELECT src, dst, 'CALLS' AS kind, unresolved, seq FROM links", graph=False)
def rekey_edges(spark, d):
    """Edges to parts divisible by three move to part 3 and meet there."""
    line = read(spark, d, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("CALLS").alias("kind"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("unresolved"), F.col("l_linenumber").alias("seq"))
    moves = rows.where("dst % 3 = 0").select("src", "dst", "kind", F.lit(3).cast("long").alias("new_dst")).distinct()
    return graph.rekey_edges(rows, moves)


@query("SELECT src, dst FROM (SELECT src, 'x' AS dst, symbol AS unresolved FROM hrefs UNION ALL SELECT src, dst, NULL FROM edges) WHERE unresolved IS NULL")
def skip_unresolved(spark, d):
    links = v.hrefs(spark, d).select("src", F.lit("x").alias("dst"), F.col("symbol").alias("unresolved"))
    known = v.edges(spark, d).withColumn("unresolved", F.lit(None).cast("string"))
    return graph.without_unresolved(links.unionByName(known)).select("src", "dst")


@query("SELECT 'unresolved:module:' || symbol AS id, symbol AS name FROM hrefs WHERE symbol NOT IN (SELECT url FROM pages) GROUP BY symbol")
def unresolved_placeholders(spark, d):
    links = v.hrefs(spark, d).select("src", F.concat(F.lit("unresolved:module:"), "symbol").alias("dst"), F.col("symbol").alias("unresolved"))
    known = read(spark, d, "pages").select(F.concat(F.lit("unresolved:module:"), "url").alias("id"))
    return graph.unresolved_nodes(links, known)


_SPECS = """files AS (SELECT id, k, '/r/' || language || '/' || replace(community, '#', '') || '/m' || (k % 40) || CASE WHEN k % 3 = 0 THEN '.ts' WHEN k % 3 = 1 THEN '.js' ELSE '/index.ts' END AS path FROM parts),
uniq AS (SELECT path, min(k) AS k FROM files GROUP BY path),
specs AS (SELECT id AS src, regexp_replace(path, '/[^/]*$', '') AS dir, './m' || ((k * 7) % 50) || CASE WHEN k % 2 = 0 THEN '.js' ELSE '' END AS spec FROM files WHERE k % 3 <> 2)"""


def _spec_files(spark, d):
    p = v.parts(spark, d)
    end = F.when(F.col("k") % 3 == 0, ".ts").when(F.col("k") % 3 == 1, ".js").otherwise("/index.ts")
    path = F.concat(F.lit("/r/"), "language", F.lit("/"), F.regexp_replace("community", "#", ""), F.lit("/m"), (F.col("k") % 40).cast("string"), end)
    return p.select("id", "k", path.alias("path"))


@query(
    f"""AND {_SPECS},
cand AS (SELECT src, spec, pos, path FROM (SELECT src, spec, unnest(range(1, 15)) AS pos, dir || '/' || substring(spec, 3) AS base FROM specs),
  LATERAL (SELECT CASE WHEN pos = 1 THEN base WHEN pos IN (2, 3) AND ends_with(base, '.js') THEN substring(base, 1, length(base) - 3) || ['.ts', '.tsx'][pos - 1] WHEN pos > 3 THEN base || ['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', ''][pos - 3] END AS path)),
hit AS (SELECT src, spec, arg_min('part:' || u.k, pos) AS dst FROM cand JOIN uniq u USING (path) WHERE pos < 14 GROUP BY src, spec)
SELECT s.src, s.spec, coalesce(hit.dst, 'unresolved:module:' || s.spec) AS dst, CASE WHEN hit.dst IS NULL THEN s.spec END AS unresolved FROM specs s LEFT JOIN hit USING (src, spec)"""
)
def import_resolution(spark, d):
    files = _spec_files(spark, d)
    spec = F.concat(F.lit("./m"), (F.col("k") * 7 % 50).cast("string"), F.when(F.col("k") % 2 == 0, ".js").otherwise(""))
    imports = files.where("k % 3 <> 2").select(F.col("id").alias("src"), F.col("path").alias("src_path"), F.lit("typescript").alias("language"), spec.alias("spec"))
    known = files.groupBy("path").agg(F.min("k").alias("seq")).select(F.concat(F.lit("part:"), F.col("seq").cast("string")).alias("id"), "path", "seq")
    return resolve.resolve_imports(imports, known)


_SYMBOLS = """exports AS (SELECT id AS file, name, id || '#fn' AS target, CASE WHEN k % 4 = 0 THEN 'Class' WHEN k % 4 = 1 THEN 'Interface' ELSE 'Function' END AS kind, k AS seq FROM parts),
refs AS (SELECT p.id || '#c' AS src, p.id AS file, q.name FROM parts p JOIN parts q ON q.k = (p.k * 13 + 5) % (SELECT count(*) FROM parts)),
reach AS (SELECT DISTINCT r.src, r.file, r.name, e.target, e.kind FROM refs r JOIN edges i ON i.src = r.file JOIN exports e ON e.file = i.dst AND e.name = r.name)"""


def _symbols(spark, d):
    p = v.parts(spark, d)
    kind = F.when(F.col("k") % 4 == 0, "Class").when(F.col("k") % 4 == 1, "Interface").otherwise("Function")
    exports = p.select(F.col("id").alias("file"), "name", F.concat("id", F.lit("#fn")).alias("target"), kind.alias("kind"), F.col("k").alias("seq"))
    n = p.count()
    wanted = p.select(F.concat("id", F.lit("#c")).alias("src"), F.col("id").alias("file"), ((F.col("k") * 13 + 5) % n).alias("k"))
    return exports, wanted.join(p.select("k", "name"), "k").select("src", "file", "name")


@query(f"AND {_SYMBOLS} SELECT src, name, min(target) AS target FROM reach GROUP BY src, name HAVING count(DISTINCT target) = 1")
def export_lookup_unique(spark, d):
    exports, refs = _symbols(spark, d)
    return resolve.follow_imports(refs, v.edges(spark, d), exports)


@query(
    f"""AND {_SYMBOLS},
via AS (SELECT src, name, min(target) AS t FROM reach WHERE kind IN ('Function', 'Method') GROUP BY src, name HAVING count(DISTINCT target) = 1),
same AS (SELECT file, name, arg_min(target, seq) AS t FROM exports WHERE kind = 'Function' GROUP BY file, name),
anywhere AS (SELECT name, arg_min(target, seq) AS t FROM exports WHERE kind = 'Function' GROUP BY name)
SELECT r.src, r.name, coalesce(via.t, same.t, anywhere.t) AS target FROM refs r JOIN anywhere USING (name) LEFT JOIN same USING (file, name) LEFT JOIN via ON via.src = r.src AND via.name = r.name"""
)
def call_resolution(spark, d):
    exports, refs = _symbols(spark, d)
    callables = exports.where("kind = 'Function'").select(F.col("target").alias("id"), "name", "file", "seq")
    return resolve.resolve_calls(refs, callables, v.edges(spark, d), exports)


@query(
    f"""AND {_SYMBOLS},
pool AS (SELECT *, 'Interface' AS want FROM refs),
via AS (SELECT src, name, min(target) AS t FROM reach WHERE kind = 'Interface' GROUP BY src, name HAVING count(DISTINCT target) = 1),
cand AS (SELECT name, min(target) AS t, count(*) AS n FROM exports WHERE kind = 'Interface' GROUP BY name),
near AS (SELECT r.src, r.name, arg_min(e.target, e.seq) AS t FROM refs r JOIN edges i ON i.src = r.file JOIN exports e ON e.file = i.dst AND e.name = r.name AND e.kind = 'Interface' GROUP BY r.src, r.name)
SELECT src, 'IMPLEMENTS' AS kind, name || '<T>' AS symbol, target FROM (SELECT p.src, p.name, coalesce(via.t, CASE WHEN cand.n > 1 THEN near.t WHEN cand.n = 1 THEN cand.t END) AS target FROM pool p LEFT JOIN via USING (src, name) LEFT JOIN cand USING (name) LEFT JOIN near USING (src, name)) WHERE target IS NOT NULL"""
)
def type_resolution(spark, d):
    exports, refs = _symbols(spark, d)
    types = exports.select(F.col("target").alias("id"), "name", "file", "kind", "seq")
    wanted = refs.select("src", "file", F.lit("IMPLEMENTS").alias("kind"), F.concat("name", F.lit("<T>")).alias("symbol"))
    return resolve.resolve_types(wanted, types, v.edges(spark, d), exports)


@query("SELECT src, symbol FROM hrefs")
def html_link_extract(spark, d):
    return v.hrefs(spark, d)


# Traversal


def _trails(depth: int, reverse: bool) -> str:
    near, far = ("dst", "src") if reverse else ("src", "dst")
    return f"""AND walk AS (SELECT {far} AS node, 1 AS distance, [src || '>' || dst] AS used FROM edges WHERE {near} = '{START}'
UNION ALL SELECT e.{far}, w.distance + 1, list_append(w.used, e.src || '>' || e.dst) FROM walk w JOIN edges e ON e.{near} = w.node WHERE w.distance < {depth} AND NOT list_contains(w.used, e.src || '>' || e.dst))
SELECT DISTINCT node, distance FROM walk"""


def _hops(depth: int, reverse: bool) -> Query:
    return lambda spark, d: traverse.k_hop(v.edges(spark, d), v.start(spark), depth, reverse, v.lines_dealt(spark, d)).select("node", "distance")


for _name, _depth, _reverse in (("callers_d1", 1, True), ("callers_d3", 3, True), ("callees_d1", 1, False), ("callees_d3", 3, False)):
    _f = _hops(_depth, _reverse)
    _f.__name__ = _name
    query(_trails(_depth, _reverse))(_f)


_TREE = """tree AS (SELECT 'r:' || r_regionkey AS src, 'n:' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
UNION SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer UNION SELECT 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier)"""


@query(f"AND {_TREE}, reach AS (SELECT src AS start, dst AS node FROM tree WHERE starts_with(src, 'r:') UNION SELECT start, dst FROM reach JOIN tree ON src = node) SELECT start, node FROM reach")
def containment_closure(spark, d):
    def edge(name, a, ka, b, kb):
        label = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        return read(spark, d, name).select(label(a, ka).alias("src"), label(b, kb).alias("dst"))

    tree = edge("nation", "r:", "n_regionkey", "n:", "n_nationkey").unionByName(edge("customer", "n:", "c_nationkey", "c:", "c_custkey")).unionByName(edge("supplier", "n:", "s_nationkey", "s:", "s_suppkey"))
    roots = read(spark, d, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("id"))
    return traverse.closure(tree, roots)


@query("SELECT id, path FROM (SELECT id, path FROM parts UNION ALL SELECT 'page:' || page_id, url FROM pages) WHERE id NOT IN (SELECT dst FROM edges)")
def entry_points(spark, d):
    """Over parts, nearly all of which an edge leads to, and pages, none of which."""
    pages = read(spark, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("path"))
    return traverse.entry_points(v.parts(spark, d).select("id", "path").unionByName(pages), v.edges(spark, d)).select("id", "path")


# Analytics

_LINKS = "links AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"
_BOUNDARY = f"{_LINKS}, bound AS (SELECT p.id, count(DISTINCT CASE WHEN q.community <> p.community THEN q.id END) AS boundary FROM parts p LEFT JOIN links ON src = p.id LEFT JOIN parts q ON q.id = dst GROUP BY p.id)"


def _links(spark, d):
    return analytics.undirected(v.edges(spark, d), v.parts(spark, d))


def _boundary(spark, d):
    return analytics.boundary_degree(v.parts(spark, d), _links(spark, d), v.lines_dealt(spark, d))


@query(f"AND {_BOUNDARY} SELECT id, boundary FROM bound")
def boundary_degree(spark, d):
    return _boundary(spark, d)


@query("SELECT community, id, rank FROM (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY pagerank DESC, id) AS rank FROM parts) WHERE rank <= 5")
def spine_pagerank_topk(spark, d):
    return analytics.top_per_community(v.parts(spark, d), "pagerank", 5).select("community", "id", "rank")


@query(f"AND {_BOUNDARY} SELECT community, id, rank FROM (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY boundary DESC, id) AS rank FROM parts JOIN bound USING (id) WHERE boundary > 0) WHERE rank <= 3")
def spine_boundary_topk(spark, d):
    scored = v.parts(spark, d).join(_boundary(spark, d), "id")
    return analytics.top_per_community(scored, "boundary", 3, True).select("community", "id", "rank")


def _pagerank_sql(rounds: int) -> str:
    steps = [f"{_LINKS}, deg AS (SELECT src, count(*) AS n FROM links GROUP BY src), r0 AS (SELECT id, 0.15::double AS pr FROM parts)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS (SELECT p.id, 0.15::double + 0.85::double * coalesce(s, 0) AS pr FROM parts p LEFT JOIN (SELECT dst, sum(pr / n) AS s FROM links JOIN deg USING (src) JOIN r{i - 1} ON id = src GROUP BY dst) ON dst = p.id)")
    return f"AND {', '.join(steps)} SELECT id, round(pr, 6) AS pagerank FROM r{rounds}"


@query(_pagerank_sql(5))
def pagerank_5(spark, d):
    ranks = analytics.pagerank(v.parts(spark, d), _links(spark, d), iterations=5, tasks=v.lines_dealt(spark, d))
    return ranks.select("id", F.round("pagerank", 6).alias("pagerank"))


@query("SELECT community, count(*) AS size, 'community-' || community AS name FROM parts GROUP BY community HAVING count(*) >= 3")
def community_sizes(spark, d):
    return analytics.communities(v.parts(spark, d))


@query(
    f"""AND segs AS (SELECT community, unnest(string_split(substring(path, 7), '/')) AS seg FROM parts),
n AS (SELECT community, seg, count(*) AS n FROM segs WHERE length(seg) > 1 AND strpos(seg, '.') = 0 AND seg NOT IN ({', '.join(repr(s) for s in tx.STOP_SEGMENTS)}) GROUP BY community, seg)
SELECT community, seg AS label FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, seg) AS rn FROM n) WHERE rn = 1"""
)
def heuristic_label(spark, d):
    return analytics.heuristic_labels(v.parts(spark, d), v.ROOT)


@query("SELECT count(*) AS files, count(DISTINCT community) AS communities, (SELECT count(*) FROM (SELECT community FROM parts GROUP BY community HAVING count(*) >= 3)) AS materialised, sum(is_core::int) AS spine FROM parts")
def cluster_report(spark, d):
    return analytics.cluster_report(v.parts(spark, d))


def _propagation_sql(rounds: int) -> str:
    steps = [f"{_LINKS}, l0 AS (SELECT id, id AS c FROM parts)"]
    for i in range(1, rounds + 1):
        steps.append(f"v{i} AS (SELECT dst, c, count(*) AS n FROM links JOIN l{i - 1} ON id = src GROUP BY dst, c), l{i} AS (SELECT l.id, coalesce(b.c, l.c) AS c FROM l{i - 1} l LEFT JOIN (SELECT dst, c, row_number() OVER (PARTITION BY dst ORDER BY n DESC, c) AS rn FROM v{i}) b ON b.dst = l.id AND rn = 1)")
    return f"AND {', '.join(steps)} SELECT id, c AS community FROM l{rounds}"


@query(_propagation_sql(3))
def label_propagation_3(spark, d):
    return analytics.label_propagation(v.parts(spark, d), staged(_links(spark, d), "links"), 3, v.lines_dealt(spark, d))


def _given_modularity(spark, d):
    return analytics.modularity(v.parts(spark, d), _links(spark, d), v.lines_dealt(spark, d))


@query(f"""AND {_LINKS}, m AS (SELECT a.community AS a, count(*)::double AS d, sum((a.community = b.community)::int) AS inside FROM links JOIN parts a ON a.id = src JOIN parts b ON b.id = dst GROUP BY a.community)
SELECT round(sum(inside) / sum(d) - sum(d * d) / (sum(d) * sum(d)), 9) AS modularity FROM m""")
def modularity(spark, d):
    return _given_modularity(spark, d).select(F.round("modularity", 9).alias("modularity"))


# Search

_BM25 = """docs AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS toks FROM documents),
stats AS (SELECT count(*)::double AS n, avg(len(toks)) AS avgdl FROM docs)"""


def _bm25_sql(clauses: list[str], where: str, limit: str) -> str:
    """clauses: SQL for the hits of each clause in ``toks``."""
    hits = ", ".join(f"{c} AS h{i}" for i, c in enumerate(clauses))
    dfs = ", ".join(f"sum((h{i} > 0)::int)::double AS df{i}" for i in range(len(clauses)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * h{i} * 2.2 / (h{i} + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))" for i in range(len(clauses)))
    return f"WITH {_BM25}, hits AS (SELECT id, toks, {hits} FROM docs), df AS (SELECT {dfs} FROM hits) SELECT id, round({score}, 6) AS score FROM hits, stats, df WHERE {where} ORDER BY {score} DESC, id {limit}"


def _term(w: str) -> str:
    return f"len(list_filter(toks, lambda t: t = '{w}'))::double"


def _full(spark, d, text, limit=20):
    return search.full_text(v.documents(spark, d), text, limit).select("id", F.round("score", 6).alias("score"))


@query(_bm25_sql([_term("the"), _term("onthe"), _term("des")], "h0 + h1 + h2 > 0", "LIMIT 20"), graph=False)
def bm25_topk(spark, d):
    return _full(spark, d, "the onthe des")


@query(_bm25_sql([_term("that"), _term("with")], "h1 > 0 AND h0 > 0", "LIMIT 20"), graph=False)
def bm25_required_terms(spark, d):
    return _full(spark, d, "+that +with")


@query(_bm25_sql(["len(list_filter(toks, lambda t: starts_with(t, 'thing')))::double"], "h0 > 0", ""), graph=False)
def prefix_term(spark, d):
    return _full(spark, d, "thing*", None)


@query(_bm25_sql(["len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'of' AND toks[i + 1] = 'the'))::double"], "h0 > 0", ""), graph=False)
def phrase_match(spark, d):
    return _full(spark, d, '"of the"', None)


@query(_bm25_sql(["len(list_filter(toks, lambda t: abs(length(t) - 6) <= 1 AND levenshtein(t, 'idiots') <= 1))::double"], "h0 > 0", ""), graph=False)
def fuzzy_term(spark, d):
    return _full(spark, d, "idiots~1", None)


def _posted(text: str, limit: int | None) -> Query:
    """The same searches over a stored index, which is built first."""

    def run(spark, d):
        index = SearchIndex.build(v.documents(spark, d), new_place(spark, "search"))
        return index.search(text, limit).select("id", F.round("score", 6).alias("score"))

    return run


_POSTED = {
    "postings_topk": (_bm25_sql([_term("the"), _term("onthe"), _term("des")], "h0 + h1 + h2 > 0", "LIMIT 20"), "the onthe des", 20),
    "postings_not": (_bm25_sql([_term("the")], f"h0 > 0 AND {_term('of')} = 0", ""), "the NOT of", None),
    "postings_phrase": (_bm25_sql(["len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'of' AND toks[i + 1] = 'the'))::double"], "h0 > 0", ""), '"of the"', None),
    "postings_prefix": (_bm25_sql(["len(list_filter(toks, lambda t: starts_with(t, 'thing')))::double"], "h0 > 0", ""), "thing*", None),
}
for _name, (_sql, _text, _limit) in _POSTED.items():
    _f = _posted(_text, _limit)
    _f.__name__ = _name
    query(_sql, graph=False)(_f)


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in read(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


_COSINE = "(1 + list_cosine_similarity(e.embedding::double[], q.embedding::double[])) / 2"


@query(f"SELECT e.vec_id AS id, round({_COSINE}, 5) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q ORDER BY {_COSINE} DESC, id LIMIT 20", graph=False)
def vector_topk(spark, d):
    rows = read(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return search.vector(rows, _query_vector(spark, d), 20).select("id", F.round("score", 5).alias("score"))


@query(f"SELECT e.vec_id AS id, round({_COSINE}, 5) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY {_COSINE} DESC, id LIMIT 10", graph=False)
def vector_topk_by_kind(spark, d):
    rows = read(spark, d, "embeddings").withColumnsRenamed({"vec_id": "id", "label": "kind"})
    return search.vector(rows, _query_vector(spark, d), 10, 3).select("id", F.round("score", 5).alias("score"))


@query(
    f"""WITH fts AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT id, score AS s FROM ({_bm25_sql([_term('that'), _term('des')], 'h0 + h1 > 0', 'LIMIT 30')}))),
vec AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT e.vec_id AS id, {_COSINE} AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q ORDER BY s DESC, id LIMIT 30)),
legs AS (SELECT id, 1.0::double / (60 + r) AS s, 'fts' AS leg FROM fts UNION ALL SELECT id, 1.0::double / (60 + r), 'vector' FROM vec)
SELECT id, round(sum(s), 6) AS score, array_to_string(list_sort(list(leg)), ',') AS matched_by FROM legs GROUP BY id ORDER BY sum(s) DESC, id LIMIT 10""",
    graph=False,
)
def hybrid_rrf(spark, d):
    fts = search.full_text(v.documents(spark, d), "that des", 30).withColumn("score", F.round("score", 6))
    vec = search.vector(read(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), _query_vector(spark, d), 30)
    fused = search.fuse({"fts": fts, "vector": vec}, 10)
    return fused.select("id", F.round("score", 6).alias("score"), F.array_join("matched_by", ",").alias("matched_by"))


# Impact

_IMPACT = f"""{_trails(3, True)[4:].split('SELECT DISTINCT')[0]}, {_BOUNDARY}, callers AS (SELECT DISTINCT node, distance FROM walk),
facts AS (SELECT node, distance, is_core, is_test, community, pagerank FROM callers JOIN parts ON id = node),
counts AS (SELECT coalesce(sum((distance = 1 AND NOT is_test)::int), 0) AS prod_direct, coalesce(sum((distance > 1 AND NOT is_test)::int), 0) AS prod_indirect, coalesce(sum((distance = 1 AND is_test)::int), 0) AS test_direct,
  coalesce(sum((distance > 1 AND is_test)::int), 0) AS test_indirect, coalesce(sum((distance = 1 AND is_core AND NOT is_test)::int), 0) AS spine_direct FROM facts),
own AS (SELECT community AS own, is_core, boundary FROM parts JOIN bound USING (id) WHERE id = '{START}'),
crossed AS (SELECT count(DISTINCT community) AS other_communities FROM facts, own WHERE community <> own)"""


def _facts(spark, d):
    return v.parts(spark, d).join(_boundary(spark, d), "id").select("id", "is_core", "is_test", "community", "pagerank", "boundary")


def _callers(spark, d):
    return impact.with_files(impact.callers_of(v.edges(spark, d), v.start(spark), 3, v.lines_dealt(spark, d)), _facts(spark, d))


@query(f"AND {_IMPACT} SELECT node, distance, is_core, is_test, community FROM facts")
def impact_callers(spark, d):
    return _callers(spark, d).select("node", "distance", "is_core", "is_test", "community")


@query(f"AND {_IMPACT} SELECT * FROM counts")
def impact_split(spark, d):
    return impact.split(_callers(spark, d))


def _analysed(spark, d):
    return impact.analyse(v.edges(spark, d), _facts(spark, d), v.start(spark), tasks=v.lines_dealt(spark, d))


@query(f"AND {_IMPACT} SELECT round(prod_direct + 0.3 * prod_indirect + 0.2 * test_direct + 0.05 * test_indirect + 2 * spine_direct + 1.5 * other_communities + CASE WHEN is_core THEN 10 ELSE 0 END + 0.5 * boundary, 4)::double AS risk FROM counts, own, crossed")
def impact_risk_score(spark, d):
    return _analysed(spark, d).select(F.round("risk", 4).alias("risk"))


@query(f"AND {_IMPACT} SELECT other_communities, CASE WHEN prod_direct > 20 OR spine_direct >= 3 OR other_communities >= 4 OR (is_core AND prod_direct >= 5) THEN 'risky' WHEN prod_direct > 5 OR spine_direct >= 1 OR other_communities >= 2 OR (is_core AND prod_direct >= 1) THEN 'focus' ELSE 'safe' END AS verdict FROM counts, own, crossed")
def impact_verdict(spark, d):
    return _analysed(spark, d).select("other_communities", "verdict")


@query(f"AND {_IMPACT}, b AS (SELECT community, count(*) AS n FROM facts GROUP BY community) SELECT CASE WHEN sum(least(n, 10)) <= 80 THEN 10 WHEN sum(least(n, 5)) <= 80 THEN 5 WHEN sum(least(n, 3)) <= 80 THEN 3 ELSE 1 END AS cap FROM b")
def impact_truncation_cap(spark, d):
    return impact.truncation_cap(_callers(spark, d))


# Overview and wiki


@query("SELECT community, count(*) AS size, array_to_string(list_transform(list_sort(list({'r': -pagerank, 'path': path}) FILTER (is_core))[1:6], lambda x: x.path), '|') AS spine, array_to_string(list_sort(list(path))[1:3], '|') AS sample FROM parts GROUP BY community ORDER BY size DESC, community LIMIT 12")
def overview_communities(spark, d):
    top = overview.overview_communities(v.parts(spark, d))
    return top.select("community", "size", F.when(F.size("spine") > 0, F.array_join("spine", "|")).alias("spine"), F.array_join("sample", "|").alias("sample"))


@query("SELECT community, id, name, callers FROM parts JOIN (SELECT dst AS id, count(DISTINCT src) AS callers FROM edges GROUP BY dst) USING (id)")
def top_functions(spark, d):
    return overview.top_functions(v.parts(spark, d), v.edges(spark, d))


@query("SELECT a.community AS src_community, b.community AS dst_community, count(*) AS n FROM edges JOIN parts a ON a.id = src JOIN parts b ON b.id = dst WHERE a.community <> b.community GROUP BY ALL")
def cross_community_edges(spark, d):
    return overview.cross_community(v.parts(spark, d), v.edges(spark, d))


@query("SELECT id, name, callers FROM parts JOIN (SELECT dst AS id, count(DISTINCT src) AS callers FROM edges GROUP BY dst) USING (id) ORDER BY callers DESC, id LIMIT 25")
def glossary(spark, d):
    return overview.glossary(v.parts(spark, d), v.edges(spark, d))


@query("SELECT regexp_extract(url, '://([^/]*)', 1) AS community, symbol, count(DISTINCT src) AS n FROM hrefs JOIN pages ON 'page:' || page_id = src WHERE NOT starts_with(symbol, 'java.') AND NOT starts_with(symbol, 'javax.') GROUP BY ALL")
def external_deps(spark, d):
    hosts = read(spark, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.regexp_extract("url", "://([^/]*)", 1).alias("community"))
    return overview.external_deps(hosts, v.hrefs(spark, d))


def _covered(spark, d):
    """Files of which the tests are in no community."""
    return v.parts(spark, d).withColumn("community", F.when(~F.col("is_test"), F.col("community")))


@query("SELECT count(*) AS total, count(CASE WHEN NOT is_test THEN 1 END) AS clustered, count(CASE WHEN is_test THEN 1 END) AS orphans FROM parts")
def coverage(spark, d):
    return overview.coverage(_covered(spark, d))


@query("SELECT id, path FROM parts WHERE is_test")
def coverage_orphans(spark, d):
    return overview.orphans(_covered(spark, d))


@query("SELECT ['GET', 'POST', 'PUT'][(k % 3 + 1)::int] AS http_method, '/' || lower(language) || '/' || k AS route, path, name FROM parts WHERE is_core")
def route_table(spark, d):
    method = F.element_at(F.array(F.lit("GET"), F.lit("POST"), F.lit("PUT")), (F.col("k") % 3 + 1).cast("int"))
    nodes = v.parts(spark, d).withColumns({"http_method": F.when(F.col("is_core"), method), "route": F.concat(F.lit("/"), F.lower("language"), F.lit("/"), F.col("k").cast("string"))})
    return overview.routes(nodes)


def _tested(spark, d):
    return v.parts(spark, d).withColumn("test_framework", F.when(F.col("k") % 2 == 0, "jest").otherwise("vitest"))


@query("SELECT CASE WHEN k % 2 = 0 THEN 'jest' ELSE 'vitest' END AS test_framework, path FROM parts WHERE is_test")
def test_inventory(spark, d):
    return overview.tests(_tested(spark, d))


@query("SELECT CASE WHEN k % 2 = 0 THEN 'jest' ELSE 'vitest' END AS test_framework, count(*) AS n FROM parts WHERE is_test GROUP BY 1")
def test_frameworks(spark, d):
    return overview.test_frameworks(_tested(spark, d))


@query("SELECT community, count(*) AS size, array_to_string(list_sort(list(path) FILTER (is_core)), '|') AS spine FROM parts GROUP BY community")
def communities_with_spine(spark, d):
    found = overview.communities_with_spine(v.parts(spark, d))
    return found.select("community", "size", F.when(F.size("spine") > 0, F.array_join("spine", "|")).alias("spine"))


@query("SELECT id, path, pagerank FROM parts WHERE is_core ORDER BY pagerank DESC, id")
def spine_files(spark, d):
    return v.parts(spark, d).where("is_core").orderBy(F.desc("pagerank"), "id").select("id", "path", "pagerank")


_SNAPSHOTS = "was AS (SELECT community, list(path) AS spine FROM parts WHERE is_core OR k % 50 = 0 GROUP BY community), cur AS (SELECT community, list(path) AS spine FROM parts WHERE is_core AND k % 3 <> 0 OR k % 77 = 0 GROUP BY community)"


def _snapshots(spark, d):
    p = v.parts(spark, d)
    was = p.where("is_core or k % 50 = 0").groupBy("community").agg(F.collect_list("path").alias("spine"))
    now = p.where("is_core and k % 3 <> 0 or k % 77 = 0").groupBy("community").agg(F.collect_list("path").alias("spine"))
    return was, now


@query(f"AND {_SNAPSHOTS} SELECT community, array_to_string(list_sort(list_filter(coalesce(cur.spine, []), lambda x: NOT list_contains(was.spine, x))), '|') AS added, array_to_string(list_sort(list_filter(was.spine, lambda x: NOT list_contains(coalesce(cur.spine, []), x))), '|') AS dropped FROM was LEFT JOIN cur USING (community)")
def spine_drift(spark, d):
    drift = overview.spine_drift(*_snapshots(spark, d))
    return drift.select("community", F.array_join("added", "|").alias("added"), F.array_join("dropped", "|").alias("dropped"))


_LABELS = "labels0 AS (SELECT 'Brand#' || (o_custkey % 25 + 1) AS community, o_orderdate AS labeled_at, o_orderpriority || o_orderkey AS label FROM orders), latest AS (SELECT community, max(labeled_at) AS labeled_at FROM labels0 GROUP BY community)"


def _label_log(spark, d):
    return read(spark, d, "orders").select(
        F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("community"),
        F.col("o_orderdate").alias("labeled_at"),
        F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("label"),
    )


@query(f"AND {_LABELS} SELECT community, datediff('day', labeled_at::date, DATE '2002-01-01') AS age_days, datediff('day', labeled_at::date, DATE '2002-01-01') >= 7 AS stale FROM latest")
def freshness(spark, d):
    labels = graph.latest_labels(_label_log(spark, d))
    none = spark.createDataFrame([], "community string, added array<string>, dropped array<string>")
    return overview.freshness(labels, none, F.lit("2002-01-01").cast("date"))


# Incremental maintenance

_STATES = "stored AS (SELECT 'f' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 1), now AS (SELECT 'f' || doc_id AS path, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 2)"


def _states(spark, d):
    """What is stored lacks some documents, and what there is now lacks others
    and has some changed: the two sides of a delta."""
    docs = read(spark, d, "documents")
    path, last = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id") % 10
    stored = docs.where(last != 1).select(path, F.sha2("text", 256).alias("hash"))
    now = docs.where(last != 2).select(path, F.sha2(F.when(last == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return stored, now


_DELTA = "delta AS (SELECT path, CASE WHEN s.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'deleted' WHEN s.hash <> n.hash THEN 'changed' END AS change_type FROM stored s FULL JOIN now n USING (path))"


@query(f"WITH {_STATES}, {_DELTA} SELECT path, change_type FROM delta WHERE change_type IS NOT NULL", graph=False)
def hash_delta(spark, d):
    return incremental.hash_delta(*_states(spark, d))


_LOG = "log AS (SELECT 'f' || user_id || '@' || ts::date AS path, CASE event_type WHEN 'click' THEN 'added' WHEN 'view' THEN 'changed' ELSE 'deleted' END AS change_type FROM events)"


@query(f"WITH {_LOG} SELECT path, CASE min(CASE change_type WHEN 'added' THEN 0 WHEN 'changed' THEN 1 ELSE 2 END) WHEN 0 THEN 'added' WHEN 1 THEN 'changed' ELSE 'deleted' END AS change_type FROM log GROUP BY path", graph=False)
def merge_deltas(spark, d):
    kind = F.when(F.col("event_type") == "click", "added").when(F.col("event_type") == "view", "changed").otherwise("deleted")
    path = F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit("@"), F.to_date("ts").cast("string"))
    log = read(spark, d, "events").select(path.alias("path"), kind.alias("change_type"))
    return incremental.merge_deltas(log.where("change_type = 'deleted'"), log.where("change_type <> 'deleted'"))


@query(f"WITH {_STATES}, {_LOG} SELECT path, change_type FROM (SELECT DISTINCT 'f' || user_id AS path, CASE event_type WHEN 'click' THEN 'added' WHEN 'view' THEN 'changed' ELSE 'deleted' END AS change_type FROM events) WHERE change_type = 'deleted' OR path IN (SELECT path FROM now)", graph=False)
def indexable_changes(spark, d):
    kind = F.when(F.col("event_type") == "click", "added").when(F.col("event_type") == "view", "changed").otherwise("deleted")
    delta = read(spark, d, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), kind.alias("change_type")).distinct()
    return incremental.indexable(delta, _states(spark, d)[1])


_DIRTY = f"{_STATES}, {_DELTA}, dep AS (SELECT 'f' || doc_id AS path FROM documents WHERE doc_id % 10 = 4)"


@query(f"WITH {_DIRTY} SELECT DISTINCT 'extract' AS what, path FROM (SELECT path FROM delta WHERE change_type IN ('added', 'changed') UNION ALL SELECT path FROM dep) UNION ALL SELECT DISTINCT 'delete', path FROM (SELECT path FROM delta WHERE change_type IN ('deleted', 'changed') UNION ALL SELECT path FROM dep)", graph=False)
def dirty_sets(spark, d):
    docs = read(spark, d, "documents")
    depend = docs.where("doc_id % 10 = 4").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"))
    out, gone = incremental.dirty_sets(incremental.hash_delta(*_states(spark, d)), depend)
    return out.select(F.lit("extract").alias("what"), "path").unionByName(gone.select(F.lit("delete").alias("what"), "path"))


@query("SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'abc' ELSE 'def' END AS last_commit, CASE WHEN r_regionkey % 2 = 1 THEN 'u' END AS source_url, 'now' AS last_indexed FROM region", graph=False)
def stamp_repositories(spark, d):
    rows = read(spark, d, "region")
    odd = F.col("r_regionkey") % 2 == 1
    stored = rows.select(F.col("r_name").alias("name"), F.when(odd, "def").alias("last_commit"), F.when(odd, "u").alias("source_url"), F.lit("before").alias("last_indexed"))
    known = incremental.stamp(stored.where("last_commit is not null"), None, None, "now")
    return known.unionByName(incremental.stamp(stored.where("last_commit is null"), "abc", None, "now"))


@query("AND t AS (SELECT id FROM parts WHERE is_core) SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM t) AND src NOT IN (SELECT id FROM t)")
def dependents_cascade(spark, d):
    e = v.edges(spark, d)
    return incremental.dependents(v.parts(spark, d).where("is_core").select("id"), e, e)


@query("AND gone AS (SELECT id FROM parts WHERE is_core) SELECT 'node' AS what, id FROM parts WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'edge', src || '>' || dst FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def scoped_delete(spark, d):
    p = v.parts(spark, d)
    nodes, links = graph.delete_files(p, v.edges(spark, d), p.where("is_core").select("path"))
    return nodes.select(F.lit("node").alias("what"), "id").unionByName(links.select(F.lit("edge").alias("what"), F.concat_ws(">", "src", "dst").alias("id")))


@query("AND new AS (SELECT id, CASE WHEN k % 2 = 0 THEN upper(name) END AS name, 'v2' AS path FROM parts WHERE k % 3 = 0 UNION ALL SELECT 'new:' || k, name, 'v2' FROM parts WHERE is_core), old AS (SELECT id, name, path FROM parts WHERE k % 5 <> 0) SELECT id, coalesce(n.name, o.name) AS name, coalesce(n.path, o.path) AS path FROM old o FULL JOIN new n USING (id)")
def node_upsert(spark, d):
    p = v.parts(spark, d)
    new = p.where("k % 3 = 0").select("id", F.when(F.col("k") % 2 == 0, F.upper("name")).alias("name"), F.lit("v2").alias("path"))
    new = new.unionByName(p.where("is_core").select(F.concat(F.lit("new:"), F.col("k").cast("string")).alias("id"), "name", F.lit("v2").alias("path")))
    return graph.upsert(p.where("k % 5 <> 0").select("id", "name", "path"), new, ["id"])


@query("AND held AS (SELECT id FROM parts WHERE k % 7 <> 0), old AS (SELECT src || '>' || dst AS id, src, dst, 1 AS weight FROM edges WHERE src < dst), new AS (SELECT src || '>' || dst AS id, src, dst, 2 AS weight FROM edges WHERE src IN (SELECT id FROM held) AND dst IN (SELECT id FROM held)) SELECT id, coalesce(n.src, o.src) AS src, coalesce(n.dst, o.dst) AS dst, coalesce(n.weight, o.weight) AS weight FROM old o FULL JOIN new n USING (id)")
def edge_upsert(spark, d):
    e = v.edges(spark, d).select(F.concat_ws(">", "src", "dst").alias("id"), "src", "dst")
    stored, new = e.where("src < dst").withColumn("weight", F.lit(1)), e.withColumn("weight", F.lit(2))
    return graph.upsert_edges(stored, new, v.parts(spark, d).where("k % 7 <> 0"))


@query(f"AND {_LABELS} SELECT community, labeled_at, label FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY labeled_at DESC, label DESC) AS rn FROM labels0) WHERE rn = 1")
def label_upsert_latest(spark, d):
    return graph.latest_labels(_label_log(spark, d)).select("community", "labeled_at", "label")
