"""What a task does must not grow with the tables: how plans deal out their work."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.operators import analytics, postings
from sparkloom.parse import lexer
from sparkloom.plans import code_queries, views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt_by(df):
    """The part counts that a plan's exchanges were asked for."""
    return [int(n) for n in re.findall(r"partitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", plan(df))]


@pytest.mark.parametrize("name", [q for q in code_queries.QUERIES if q.startswith("extract_")])
def test_extraction_deals_files_out_and_reads_each_once(spark, monkeypatch, name):
    monkeypatch.setattr(code_queries, "FILES_A_TASK", 7)
    found = entry.queries()[name](spark, SF)
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    assert dealt_by(found) == [max(spark.sparkContext.defaultParallelism, -(-parts // 7))]
    assert len(re.findall(r"MapIn(?:Arrow|Pandas)", plan(found))) == 1


def test_filled_text_has_every_key(spark):
    template = "{n}a{k}{k}\nb{n}{n}c{k}"
    row = spark.range(9, 10).select(code_queries.filled(template, F.col("id")).alias("t")).first()
    assert row["t"] == "10a99\nb1010c9"


def test_long_texts_keep_their_lines_and_tokens():
    text = "const t = `" + "a line $ of text \\` \n" * 3000 + "${f(`x`)} é`;\nconst s = '" + "\\'q" * 3000 + "';\ng();\n"
    source = lexer.Source(text, "javascript")
    lines = [0] + [m.end() for m in re.finditer("\n", text)]
    assert source._lines == lines
    kinds = [(t.kind, t.text[:1]) for t in source.tokens]
    assert ("name", "f") in kinds and ("name", "g") in kinds and kinds.count(("template", "`")) == 2


@pytest.mark.parametrize("name", ["boundary_degree", "spine_boundary_topk", "pagerank_5", "impact_risk_score", "impact_verdict", "callers_d3", "modularity"])
def test_joins_over_all_edges_are_dealt_by_the_number_of_lines(spark, monkeypatch, name):
    asked = []

    def of(session, rows, rows_a_task):
        asked.append(rows)
        return 23

    monkeypatch.setattr(views, "tasks_for", of)
    text = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert asked and set(asked) == {lines}
    # Nothing that holds edges is dealt to a number of parts that does not grow.
    wide = re.findall(r"Exchange hashpartitioning\((?:src|dst|l_partkey|l_orderkey|node|next)#.*?, (\d+)\)", text)
    assert set(wide) <= {"23"}


def test_contraction_takes_few_rounds(spark, monkeypatch):
    """A round halves the groups at least, as far as each finds a centre."""
    rng = random.Random(1)
    pairs = {tuple(sorted(rng.sample(range(600), 2))) for _ in range(6000)}
    both = [(f"n{a}", f"n{b}") for a, b in pairs] + [(f"n{b}", f"n{a}") for a, b in pairs]
    nodes, links = spark.createDataFrame([(f"n{i}",) for i in range(600)], "id string"), spark.createDataFrame(both, "src string, dst string")
    kept, names = analytics.staged, []
    monkeypatch.setattr(analytics, "staged", lambda df, name: names.append(name) or kept(df, name))
    member, weighted = analytics.contracted(nodes, links, 2000)
    assert names.count("members") - 1 <= 4
    rows, of = weighted.collect(), {r.id: r.grp for r in member.collect()}
    found, true = {(r.src, r.dst): r.w for r in rows}, Counter((of[a], of[b]) for a, b in both)
    assert found == true and sum(a != b for a, b in found) <= 2000


def test_postings_are_grouped_by_document_and_dealt_by_their_number(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab a b the of x é".split()) for _ in range(rng.choice((0, 1, 60)))) for _ in range(90)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    monkeypatch.setattr(postings, "TOKENS_A_TASK", 100)
    monkeypatch.setattr(postings, "_DOCS", 7)
    monkeypatch.setattr(postings, "_ROWS", 5)
    index = postings.SearchIndex.build(docs, f"file://{tmp_path}/index")
    rows = index.postings.collect()
    found = {(r.term, r.id): r.positions for r in rows}
    true = {}
    for i, text in enumerate(texts):
        for at, word in enumerate((text or "").split()):
            true.setdefault((word, i), []).append(at)
    assert found == true and len(rows) == len(true) and all(r.tf == len(r.positions) and r.field == "text" for r in rows)
    assert len(index.postings.inputFiles()) > 8
