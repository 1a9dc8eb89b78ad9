import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm.nearcopies import bands, keep_one, shingles

from .test_simhash import brute_fingerprint, groups

pipeline = pytest.importorskip("corpus_pipeline")


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def least_of_groups(rows):
    sets = {i: brute_set(t) for i, t in rows}
    of = groups(list(sets), lambda a, b: near(sets[a], sets[b]))
    return sorted(min(i for i in of if of[i] == r) for r in set(of.values()))


def edited(g, words, share):
    return [g.choice("stuvw") * g.randint(1, 9) if g.random() < share else w for w in words]


def test_stage_against_brute_force(make_docs, spark):
    g = random.Random(3)
    rows = []
    for k in range(25):
        words = [g.choice("abcdefgh") * g.randint(1, 6) for _ in range(g.choice([3, 6, 40, 200, 400]))]
        for c in range(6):
            rows.append((100 * c + k, " ".join(edited(g, words, c * 0.008))))
    sets, prints = {i: brute_set(t) for i, t in rows}, {i: brute_fingerprint(t) for i, t in rows}
    apart = [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b]) and (prints[a] ^ prints[b]).bit_count() > 3]
    assert apart  # near-copies beyond three bits are what the stage must find
    got = pipeline.drop_near_duplicates(spark, make_docs(rows), "")
    assert sorted(r.doc_id for r in got.collect()) == least_of_groups(rows)


def test_chains_through_one_bucket(make_docs):
    """Texts near their neighbours alone are one component."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 150])) for k in range(12)]
    assert not near(brute_set(rows[0][1]), brute_set(rows[4][1])) and least_of_groups(rows) == [0]
    assert [r.doc_id for r in keep_one(make_docs(rows)).collect()] == [0]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = least_of_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == want


def test_prefixes_miss_no_link(make_docs, spark):
    """Rows with roots of their own against all pairs by brute force, at the edge
    of the threshold and with sets of different sizes."""
    from sparkloom.llm import nearcopies

    g = random.Random(11)
    rows = []
    for k in range(6):
        words = [f"w{k}x{i}" for i in range(g.choice([9, 24, 30, 90]))]
        for _ in range(14):
            v = words[: len(words) - g.randint(0, max(1, len(words) // 6))]
            for _ in range(g.randint(0, 3)):
                v[g.randrange(len(v))] = f"e{g.random()}"
            rows.append((len(rows), " ".join(v)))
    marked = make_docs(rows).withColumn("_row", F.col("doc_id"))
    sets = {i: brute_set(t) for i, t in rows}
    left = spark.createDataFrame([(i, len(s), i) for i, s in sets.items()], "row long, n int, root long")
    got = {(r.a, r.b) for r in nearcopies._prefixed(marked, left, "_row", "text").collect()}
    want = {(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])}
    assert want and want <= got and len(got) < 3 * len(want)
    alone = left.withColumn("root", F.lit(1).cast("long"))
    assert nearcopies._prefixed(marked, alone, "_row", "text").count() == 0


def test_bands_miss_hardly_any_pair():
    """At a similarity of 0.8, and few at 0.4."""
    g = random.Random(4)

    def meet(share, of=100):
        both = [g.getrandbits(64) for _ in range(round(of * share))]
        rest = [g.getrandbits(64) for _ in range(of - len(both))]
        a, b = (np.array(both + part, dtype="<u8") for part in (rest[::2], rest[1::2]))
        return bool(set(bands(a)) & set(bands(b)))

    assert all(meet(0.8) for _ in range(2000)) and sum(meet(0.4) for _ in range(300)) < 150


def test_odd_rows(odd):
    assert keep_one(odd).select("doc_id").distinct().count() == 4 and keep_one(odd).columns == odd.columns
    assert keep_one(odd.limit(0)).count() == 0
    assert len(shingles("x y")) == 1 and len(shingles(" ")) == 0 and len(bands(shingles(None))) == 0
