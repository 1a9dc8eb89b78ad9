"""Rules that no SQL states: extraction, resolution, communities, search, deltas."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import analytics, embed, graph, incremental, resolve, search, traverse
from sparkloom.operators.extract import extract_file
from sparkloom.parse import rows
from sparkloom.sources import repo


def found(text, path="/r/a.ts", language="typescript"):
    rows = extract_file(path, language, text)
    nodes = {(n["kind"], n["name"]) for n in rows.nodes.values()}
    edges = {(e["kind"], e["src"].rpartition("#")[2], e["dst"].rpartition("#")[2]) for e in rows.edges.values()}
    return nodes, edges, rows


# Extraction


@pytest.mark.parametrize(
    "text, nodes",
    [
        ("interface I { a: string }\ntype T = { b: number };\nenum E { A, B }\n", {("Interface", "I"), ("TypeAlias", "T"), ("Enum", "E")}),
        ("const a = () => 1, b = function () { return 2; };\n", {("Function", "a"), ("Function", "b")}),
        ("const q = new Queue(1);\nconst n = 3;\n", {("Variable", "q")}),
        ("abstract class A<T> extends B<T> { x = 1; get y() { return 1; } }\n", {("Class", "A"), ("Property", "x"), ("Method", "y")}),
        ("// function no() {}\nconst s = `function no() {}`;\nconst r = /function no\\(\\)/;\n", set()),
        ("", set()),
    ],
)
def test_declarations(text, nodes):
    assert found(text)[0] == nodes


def test_calls_imports_and_exports():
    nodes, edges, rows = found(
        'import x, { y } from "./x";\nexport * from "./z";\nasync function f() { const m = await import("./lazy"); this.db.query(1); g(); [1].map((v) => h(v)); }\nfunction g() {}\nexport { g as renamed, f };\n'
    )
    assert rows.imports == ["./x", "./z", "./lazy"]
    calls = {dst for kind, _, dst in edges if kind == "CALLS"}
    assert {"unresolved:callable:query", "unresolved:callable:g", "unresolved:callable:map"} <= calls
    assert "unresolved:callable:import" not in calls
    assert {e["exported_name"] for e in rows.edges.values() if e["kind"] == "EXPORTS"} == {"renamed", "f"}


def test_handlers_carry_their_route():
    _, _, rows = found('router.post(`/a/${x}`, auth, async (req, res) => { save(req); });\nserver.use((r) => log(r));\n', "/r/a.js", "javascript")
    http = {(n["http_method"], n["router_object"]) for n in rows.nodes.values() if n.get("http_method")}
    assert http == {("POST", "router"), ("USE", "server")}


@pytest.mark.parametrize(
    "path, text, framework",
    [
        ("/r/a.ts", 'import { it } from "vitest";\n', "vitest"),
        ("/r/a.ts", "describe('x', () => { it('y', () => {}); });\n", "jest"),
        ("/r/__tests__/a.ts", "const a = 1;\n", "unknown"),
        ("/r/a.ts", "const a = 1;\n", None),
    ],
)
def test_test_files(path, text, framework):
    assert found(text, path)[2].framework == framework


def test_long_bodies_are_cut_at_a_line():
    text = "function f() {\n" + "  call();\n" * 6000 + "}\n"
    node = next(iter(found(text)[2].nodes.values()))
    assert node["body_truncated"] and len(node["body"]) <= 50_000 and node["body"].endswith("call();") and node["end_row"] == 6001


def test_java():
    nodes, edges, rows = found(
        "package a.b;\nimport static c.D.e;\nimport f.*;\npublic class A extends B<C> implements I, J {\n  int x, y = 2;\n  A() { init(); }\n  @Override public String go(int n) { return new Z().run(n); }\n  class Inner { void in() {} }\n}\ninterface I { void m(); }\n",
        "/r/A.java",
        "java",
    )
    assert {("Class", "A"), ("Property", "x"), ("Property", "y"), ("Method", "go"), ("Class", "Inner"), ("Interface", "I")} <= nodes
    assert {"unresolved:class:B<C>"} == {d for k, _, d in edges if k == "EXTENDS"}
    assert {"unresolved:interface:I", "unresolved:interface:J"} == {d for k, _, d in edges if k == "IMPLEMENTS"}
    assert {"unresolved:callable:Z", "unresolved:callable:run"} <= {d for k, _, d in edges if k == "CALLS"}


def test_unclosed_type_arguments_take_time_in_proportion():
    began = time.process_time()
    extract_file("/r/a.ts", "typescript", "a <" * 20_000)
    extract_file("/r/a.ts", "typescript", "f(a < b, c < d);\n" * 3000)
    assert time.process_time() - began < 6


@pytest.mark.parametrize("path, test", [("/r/a.test.ts", True), ("C:\\r\\tests\\a.ts", True), ("C:\\r\\__tests__\\a.ts", True), ("/r/spec/a.js", True), ("/r/__test__/a.js", True), ("x_test.go", True), ("/r/test_a.py", True), ("/r/testing/a.ts", False), ("/r/contest.ts", False)])
def test_test_paths(spark, path, test):
    assert rows.is_test_path(path) == test == spark.range(1).select(text.is_test_path(F.lit(path))).first()[0]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab(){}[]<>=;:,.'\"`/*\\\n $classfunctionimport", max_size=80))
def test_no_text_breaks_the_extractors(text):
    for language in ("javascript", "typescript", "tsx", "java"):
        rows = extract_file("/r/x", language, text)
        ids = set(rows.nodes)
        assert all(e["src"] in ids or e["src"] == rows.file for e in rows.edges.values())


# Resolution


def test_import_candidates(spark):
    files = spark.createDataFrame([(f"file:{p}", p, i) for i, p in enumerate(["/r/a.ts", "/r/a.js", "/r/d/index.tsx", "/r/x/foo/Bar.java", "/r/z.mts"])], "id string, path string, seq long")
    asked = [("/r/m.ts", "typescript", s) for s in ("./a", "./a.js", "./d", "../r/d/", "./none", "react")] + [("/r/M.java", "java", s) for s in ("foo.Bar", "foo.Baz", "oo.Bar")]
    imports = spark.createDataFrame([(f"file:{p}", p, lang, s) for p, lang, s in asked], "src string, src_path string, language string, spec string")
    got = {r.spec: r.dst for r in resolve.resolve_imports(imports, files).collect()}
    assert got == {
        "./a": "file:/r/a.ts",
        "./a.js": "file:/r/a.js",
        "./d": "file:/r/d/index.tsx",
        "../r/d/": "file:/r/d/index.tsx",
        "./none": "unresolved:module:./none",
        "react": "unresolved:module:react",
        "foo.Bar": "file:/r/x/foo/Bar.java",
        "foo.Baz": "unresolved:module:foo.Baz",
        "oo.Bar": "file:/r/x/foo/Bar.java",
    }


def test_call_preferences(spark):
    callables = spark.createDataFrame([("a#f", "f", "a", 0), ("b#f", "f", "b", 1), ("c#f", "f", "c", 2), ("b#g", "g", "b", 3)], "id string, name string, file string, seq long")
    exports = spark.createDataFrame([("c", "f", "c#f", "Function", 2)], "file string, name string, target string, kind string, seq long")
    imports = spark.createDataFrame([("d", "c")], "src string, dst string")
    calls = spark.createDataFrame([("d#x", "d", "f"), ("b#x", "b", "f"), ("e#x", "e", "f"), ("e#x", "e", "g"), ("e#x", "e", "nowhere")], "src string, file string, name string")
    got = {(r.src, r["name"]): r.target for r in resolve.resolve_calls(calls, callables, imports, exports).collect()}
    assert got == {("d#x", "f"): "c#f", ("b#x", "f"): "b#f", ("e#x", "f"): "a#f", ("e#x", "g"): "b#g"}


# Traversal


def test_trails_repeat_no_edge(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "src string, dst string")
    start = spark.createDataFrame([("b",)], "id string")
    got = {(r.node, r.distance) for r in traverse.k_hop(edges, start, 3).collect()}
    assert got == {("a", 1), ("b", 2), ("c", 2)}  # a walk would also reach a at 3
    with pytest.raises(ValueError):
        traverse.k_hop(edges, start, 6)


# Analytics


def planted(groups, size, seed=1):
    g, links = random.Random(seed), set()
    for k in range(groups):
        own = [f"n{k:02}_{i:03}" for i in range(size)]
        links |= {tuple(sorted(g.sample(own, 2))) for _ in range(size * 6)}
        links.add(tuple(sorted((own[0], f"n{(k + 1) % groups:02}_000"))))
    return links


def modularity(links, of):
    total, inside, degree = 2 * len(links), 0, {}
    for a, b in links:
        inside += 2 * (of[a] == of[b])
        for n in (a, b):
            degree[of[n]] = degree.get(of[n], 0) + 1
    return inside / total - sum((d / total) ** 2 for d in degree.values())


def test_leiden_finds_planted_groups(spark):
    links = planted(6, 30)
    edges = spark.createDataFrame(sorted(links), "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in sorted({n for e in links for n in e})] + [("alone",)], "id string")
    both = analytics.undirected(edges, nodes)
    runs = [{r.id: r.community for r in analytics.leiden(nodes, both).collect()} for _ in range(2)]
    assert runs[0] == runs[1] and "alone" in runs[0]
    for k in range(6):
        assert len({c for n, c in runs[0].items() if n.startswith(f"n{k:02}_")}) == 1
    spread = {r.id: r.community for r in analytics.label_propagation(nodes, both).collect()}
    assert modularity(links, runs[0]) >= modularity(links, spread) - 1e-9
    large = {r.id: r.community for r in analytics.leiden(nodes, both, limit=10).collect()}
    assert set(large.values()) == set(range(len(set(large.values()))))


def test_pagerank_keeps_parallel_edges_and_the_sum(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    both = analytics.undirected(edges, nodes)
    assert both.count() == 6
    got = {r.id: r.pagerank for r in analytics.pagerank(nodes, both).collect()}
    # The sum starts at 0.45 and nears 3 by the factor 0.85 a round, 20 rounds.
    assert sum(got.values()) == pytest.approx(3 - 2.55 * 0.85**20) and got["b"] > got["a"] > got["c"]


def test_numbering_is_dense(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 as k")
    got = graph.numbered(rows, rows["k"].desc(), rows["id"]).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1000))
    assert [(r.k, r.id) for r in got] == sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))


def test_labels_move_to_the_community_they_overlap(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, community long")
    new = spark.createDataFrame([("a", 7), ("b", 7), ("c", 8), ("d", 8), ("e", 8)], "id string, community long")
    labels = spark.createDataFrame([(1, "one"), (2, "two")], "community long, label string")
    assert [tuple(r) for r in analytics.migrate_labels(old, new, labels).select("community", "label").collect()] == [(7, "one")]


# Search


def test_query_syntax():
    got = [(c.words, c.kind, c.required, c.excluded, c.field) for c in search.parse_query('+must -not "two words" pre* fuzzy~1 name:x or').clauses]
    assert got == [
        (["must"], "term", True, False, None),
        (["not"], "term", False, True, None),
        (["two", "words"], "phrase", False, False, None),
        (["pre"], "prefix", False, False, None),
        (["fuzzy"], "fuzzy", False, False, None),
        (["x"], "term", False, False, "name"),
    ]


def test_capital_operators():
    def parsed(text):
        return [(c.words[0], c.required, c.excluded) for c in search.parse_query(text).clauses]

    assert parsed("a NOT b") == [("a", False, False), ("b", False, True)]
    assert parsed("a AND b OR c") == [("a", True, False), ("b", True, False), ("c", False, False)]
    assert parsed("a AND NOT b") == [("a", True, False), ("b", False, True)]
    assert parsed("-not +or name:not -NOT") == [("not", False, True), ("or", True, False), ("not", False, False), ("NOT", False, True)]


def test_not_excludes_and_legs_fail_alone(spark):
    docs = spark.createDataFrame([(1, "a b", [1.0, 0.0]), (2, "a", [0.0, 1.0])], "id long, text string, embedding array<double>")
    assert [r.id for r in search.full_text(docs, "a NOT b").collect()] == [2]
    broken = docs.withColumn("embedding", F.transform("embedding", lambda x: F.raise_error(F.lit("no vector")).cast("double")))
    hits, state = search.hybrid(broken, "a", [1.0, 0.0], fields=("text",))
    assert state["fts"] == "ok" and state["vector"].startswith("failed") and {r.id for r in hits.collect()} == {1, 2}


def test_ranks_fuse_alike_from_either_side(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 7.0)], "id long, score double")
    b = spark.createDataFrame([(3, 0.9), (4, 0.8)], "id long, score double")
    one = [(r.id, round(r.score, 9)) for r in search.fuse({"fts": a, "vector": b}, 10).collect()]
    two = [(r.id, round(r.score, 9)) for r in search.fuse({"vector": b, "fts": a}, 10).collect()]
    assert one == two and one[0] == (3, round(1 / 63 + 1 / 61, 9))


def test_empty_searches(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    assert search.full_text(docs, "").count() == 0
    assert search.full_text(docs.limit(0), "a").count() == 0
    assert [r.id for r in search.full_text(docs, "a -c").collect()] == [1]


# Embedding


def test_a_failing_batch_is_skipped(spark):
    rows = spark.createDataFrame([("a", "f", "x"), ("b", None, "y")], "id string, signature string, body string")

    def broken(texts):
        raise RuntimeError("no")

    assert embed.embed(rows, broken).where("embedding is null").count() == 2
    assert embed.embed(rows).where("size(embedding) = 256").count() == 2
    assert [r.id for r in embed.candidates(rows.selectExpr("*", "'Function' as kind"), embed.embed(rows).where("id = 'a'")).collect()] == ["b"]


# Deltas


def test_git_output():
    assert repo.parse_name_status("M\0a\0A\0b\0D\0c\0R100\0d\0e\0") == [("a", "changed"), ("b", "added"), ("c", "deleted"), ("d", "deleted"), ("e", "added")]
    assert repo.parse_status("?? a\0 M b\0D  c\0R  new\0old\0A  d\0") == [("a", "added"), ("b", "changed"), ("c", "deleted"), ("new", "added"), ("old", "deleted"), ("d", "added")]


def test_delta_then_undo_is_nothing(spark):
    was = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4")], "path string, hash string")
    assert {(r.path, r.change_type) for r in incremental.hash_delta(was, now).collect()} == {("b", "changed"), ("d", "added")}
    assert incremental.hash_delta(now, now).count() == 0


def test_deleting_a_file_takes_its_members(spark):
    nodes = spark.createDataFrame([("f", "a.ts"), ("f#C", "a.ts"), ("f#C.m", "a.ts"), ("g", "b.ts")], "id string, path string")
    edges = spark.createDataFrame([("f", "f#C"), ("g", "f"), ("g", "g")], "src string, dst string")
    kept, left = graph.delete_files(nodes, edges, spark.createDataFrame([("a.ts",)], "path string"))
    assert [r.id for r in kept.collect()] == ["g"] and [tuple(r) for r in left.collect()] == [("g", "g")]


def test_leiden_above_the_limit_keeps_modularity(spark):
    """A ring of small cliques: contraction and Leiden must come near what Leiden
    reaches alone, and a hub's leaves must not all join it blindly."""
    pairs = [(f"n{k:02}{a}", f"n{k:02}{b}") for k in range(40) for a in range(5) for b in range(a)]
    pairs += [(f"n{k:02}0", f"n{(k + 1) % 40:02}1") for k in range(40)] + [("hub", f"n{k:02}2") for k in range(40)]
    ids = sorted({x for p in pairs for x in p}) + ["alone"]
    both = [*pairs, *((b, a) for a, b in pairs)]

    def modularity(of):
        mass, inside = {}, 0
        for a, b in both:
            mass[of[a]] = mass.get(of[a], 0) + 1
            inside += of[a] == of[b]
        return inside / len(both) - sum((m / len(both)) ** 2 for m in mass.values())

    nodes, links = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(both, "src string, dst string")
    alone = modularity({r.id: r.community for r in analytics.leiden(nodes, links).collect()})
    spread = modularity({r.id: r.community for r in analytics.label_propagation(nodes, links).collect()})
    for limit in (150, 500):
        large = {r.id: r.community for r in analytics.leiden(nodes, links, limit=limit).collect()}
        print(limit, modularity(large), alone, spread)
        assert set(large) == set(ids) and modularity(large) > 0.97 * alone > spread
        assert [c for c in large.values()].count(large["alone"]) == 1
