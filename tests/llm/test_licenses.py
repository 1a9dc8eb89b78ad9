import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import licenses
from sparkloom.llm.common import staged
from sparkloom.llm.licenses import TEMPLATES, read_templates, scan, scan_sql, scan_table

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"


@pytest.fixture
def tree(spark):
    rows = [
        ("LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("lib/COPYING", MIT + "\n" + "filler words here " * 40),
        ("lib/deep/er/code.py", "print(1)"),
        ("lib/own.py", "# Released under the MIT License.\n" + "x = 1\n" * 50),
        ("top.py", "nothing"),
        ("lib2/a.py", ""),
        ("lib2/b.py", None),
        (None, "no path"),
    ]
    return spark.createDataFrame(rows, "path string, text string")


def test_inheritance(tree):
    got = {r.path: (r.licence, r.method, r.licence_path) for r in scan(tree).collect()}
    assert got["LICENSE"] == ("Apache-2.0", "file", "LICENSE")
    assert got["lib/COPYING"] == ("MIT", "file", "lib/COPYING")
    assert got["lib/deep/er/code.py"] == ("MIT", "inherited", "lib/COPYING")
    assert got["lib/own.py"] == ("MIT", "header", None)
    assert got["top.py"] == got["lib2/a.py"] == got["lib2/b.py"] == ("Apache-2.0", "inherited", "LICENSE")
    assert got[None] == (None, "none", None)


def test_templates_are_found_as_themselves(spark):
    rows = [(f"d/{i}.c", f"int a;\n{text}\n" + "int b; // filler\n" * 60) for i, (_, text) in enumerate(TEMPLATES)]
    got = {r.path: r for r in scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for i, (name, _) in enumerate(TEMPLATES):
        assert got[f"d/{i}.c"].licence == name and got[f"d/{i}.c"].score > 0.9, name


def test_odd_rows_and_sql(odd, spark):
    out = scan_table(odd)
    assert out.count() == 7 and scan_table(odd.limit(0)).count() == 0
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()] + [(9, "Released under the MIT License.\nx", None), (10, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.execute(f"SELECT doc_id, path, licence, method, score, licence_path FROM ({scan_sql()})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, scan_table(docs).collect()), key=key) == sorted(want, key=key)


def test_plans_are_native(spark, monkeypatch):
    docs, plans = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(licenses, "staged", seen)
    plans.append(scan_table(docs)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 4 and not any("Python" in p or "Arrow" in p for p in plans)


TEXTS = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
PLACE = "/usr/share/common-licenses"


@pytest.mark.skipif(not all(os.path.exists(f"{PLACE}/{n}") for n in TEXTS), reason="no licence texts on this machine")
def test_whole_licence_files_are_told_apart(spark):
    rows = [(f"{n}/LICENSE", open(f"{PLACE}/{n}").read()) for n in TEXTS]
    rows.append(("AGPL-3/LICENSE", rows[3][1].replace("GENERAL PUBLIC", "AFFERO GENERAL PUBLIC").replace("General Public", "Affero General Public").replace("29 June", "19 November")))
    rows += [(f"{n}/src/a.py", "x = 1") for n in [*TEXTS, "AGPL-3"]]
    got = {r.path: (r.licence, r.method) for r in scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for n, name in {**TEXTS, "AGPL-3": "AGPL-3.0"}.items():
        assert got[f"{n}/LICENSE"] == (name, "file") and got[f"{n}/src/a.py"] == (name, "inherited"), n


def test_whole_texts_as_templates(spark):
    g = random.Random(3)
    words = [a + b for a in "bcdfgh" for b in ("an", "el", "or", "ut")]
    texts = {f"Own-{k}": "\n".join(" ".join(g.choices(words, k=8)) for _ in range(60)) + "\nlicence of ours" for k in range(2)}
    templates = read_templates(spark.createDataFrame(list(texts.items()), "licence string, text string"))
    assert templates[: len(TEMPLATES)] == TEMPLATES
    rows = [(f"{n}/LICENSE", t) for n, t in texts.items()]
    got = {r.path: r for r in scan(spark.createDataFrame(rows, "path string, text string"), templates=templates).collect()}
    assert all(got[f"{n}/LICENSE"].licence == n and got[f"{n}/LICENSE"].score > 0.999 for n in texts)


def test_clashing_names_stay(tree):
    own = {c: F.lit(c) for c in ("_dir", "_best", "_own", "_near", "_size", "up", "dir", "b", "from", "depth")}
    out = scan(tree.withColumns(own))
    assert all(r[c] == c for r in out.collect() for c in own)
    assert sorted(map(str, out.select("path", "licence", "method", "licence_path").collect())) == sorted(map(str, scan(tree).select("path", "licence", "method", "licence_path").collect()))
