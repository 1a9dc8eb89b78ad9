import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm.simhash import components, fingerprint, keep_one, links, near_duplicates, spanning_links


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("text", [None, "", " ", "one", "One TWO", "a b c", "a b c d a b c d", "É É x \x85y z", "x " * 9000 + "end\x1cmark"])
def test_fingerprint(text):
    assert fingerprint(text) % 2**64 == brute_fingerprint(text)


def groups(values, near):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if near(a, b):
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_all_links_are_found(spark):
    g = random.Random(2)
    values = set()
    for _ in range(40):
        base = g.getrandbits(64)
        for _ in range(8):
            values.add(base ^ sum(1 << b for b in g.sample(range(64), g.randint(0, 4))))
    signed = [v - 2**64 if v >= 2**63 else v for v in values] + ([] if 0 in values else [0, -1])
    got = {(r.a, r.b) for r in links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and len(want) > 100
    few = [(r.a, r.b) for r in spanning_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    assert set(few) <= want and len(few) < len(want)
    apart = lambda pairs: {frozenset(x for x in of if of[x] == r) for of in [groups(signed, lambda a, b: (min(a, b), max(a, b)) in pairs)] for r in of.values()}
    assert apart(set(few)) == apart(want)


def test_components_of_a_path_and_a_star(spark):
    g = random.Random(1)
    names = g.sample(range(10**6), 60)
    edges = list(zip(names[:30], names[1:30], strict=False)) + [(names[30], n) for n in names[31:]]
    got = {r.vertex: r.root for r in components(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")).collect()}
    assert len({got[n] for n in names[:30]}) == 1 == len({got[n] for n in names[30:]}) and len(set(got.values())) == 2


def test_documents(odd, make_docs):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(odd).collect()}
    assert (0, "0" * 16, 0) in got and (1, "0" * 16, 0) in got and (5, "0" * 16, 0) in got
    assert near_duplicates(odd).count() == 7 and near_duplicates(odd.limit(0)).count() == 0
    g = random.Random(5)
    rows = []
    for k in range(12):
        w = [g.choice("abcdefgh") * g.randint(1, 5) for _ in range(300)]
        for c in range(4):
            v = list(w)
            if c > 1:
                v[g.randrange(300)] = "edit"
            rows.append((100 * c + k, " ".join(v)))
    prints = {i: brute_fingerprint(t) for i, t in rows}
    of = groups(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {r: min(i for i in of if of[i] == r) for r in set(of.values())}
    out = near_duplicates(make_docs(rows)).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: least[of[i]] for i in of}
    kept = keep_one(make_docs(rows).withColumn("_x", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values()) and "_x" in kept.columns
    assert keep_one(odd).select("doc_id").distinct().count() == 4
