import random

import numpy as np
import pytest

from sparkloom.llm.decontaminate import MIN_SCORE, Block, align, find_leaks, mark_leaks, words_of

VOCABULARY = [a + b for a in "bcdfgklmnprst" for b in "a e i o u an el in or ut".split()]


def brute_align(item, text):
    h = np.zeros((len(item) + 1, len(text) + 1))
    for i in range(len(item)):
        for j in range(len(text)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if item[i] == text[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max() / (2 * len(item))


@pytest.mark.parametrize("seed", range(20))
def test_alignment_is_smith_waterman(seed):
    g = random.Random(seed)
    item, text = (np.array([g.randrange(5) for _ in range(g.randint(1, 12))]) for _ in range(2))
    score, a, b = align(item, text)
    assert score == pytest.approx(brute_align(item, text))
    assert score == 0 or brute_align(item, text[a:b]) == pytest.approx(score)


def prose(g, n):
    return g.choices(VOCABULARY, k=n)


@pytest.fixture(scope="module")
def case():
    g = random.Random(4)
    items = [(i, " ".join(prose(g, 25)).capitalize() + ".") for i in range(12)]
    docs = []
    for i in range(60):
        w = prose(g, 120)
        if i % 3 == 0:  # a third of the documents hold the same item, edited
            copy = items[0][1].lower().rstrip(".").split()
            for k in range(i % 5):
                copy[5 * k + 2] = "changed"
            w[40:40] = copy
        docs.append((i, " ".join(w)))
    return items, docs


def test_finds_copies_and_nothing_else(case, make_docs, spark):
    items, docs = case
    bench = spark.createDataFrame([*items, (98, None), (99, ""), (None, "x y z")], "item_id long, text string")
    got = find_leaks(make_docs(docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, 0) for i in range(0, 60, 3)}
    text = dict(docs)
    for r in got:
        assert len(words_of(text[r.doc_id])[r.start : r.end]) >= 20
    blocks = mark_leaks(make_docs(docs), bench, block_chars=200).where("size(leaks) > 0")
    assert {r.doc_id for r in blocks.collect()} == {r.doc_id for r in got}


def test_odd_rows(odd, spark, case):
    bench = spark.createDataFrame(case[0], "item_id long, text string")
    assert find_leaks(odd, bench).count() == 0
    assert find_leaks(odd.limit(0), bench).count() == find_leaks(odd, bench.limit(0)).count() == 0
    short = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert sorted(r.doc_id for r in find_leaks(odd, short).collect()) == [3, 3]


def test_every_third_word_changed_still_holds_a_seed():
    g = random.Random(9)
    items = [(i, " ".join(f"w{g.randrange(400)}" for _ in range(30))) for i in range(30)]
    block = Block(items)
    block.choose_seeds(np.full(len(block.vocabulary), 500), 1_000_000, 10_000)  # bigrams are rare enough
    for i, text in items:
        words = text.split()
        words[2::3] = ["changed"] * len(words[2::3])
        assert i in {h[0] for h in block.hits(" ".join(words), MIN_SCORE)}


def test_query_against_brute_force(spark):
    """Every document aligned whole to every item, without seeds; documents far
    beyond chance hold an item, others score what common words give."""
    from sparkloom.llm.queries import op4_decontaminate

    sf = "/root/testdata/sf0.001"
    items = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    numbers = {w: i for i, w in enumerate(sorted({w for ws in items.values() for w in ws}))}
    coded = {k: np.array([numbers[w] for w in ws]) for k, ws in items.items()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([numbers.get(w, -1) for w in words_of(r.text)], dtype=np.int64)
        for k, item in coded.items():
            score = align(item, ids)[0]
            if score >= MIN_SCORE:
                want[r.doc_id, k] = score
    got = {(r.doc_id, r.item_id): r.score for r in op4_decontaminate(spark, sf).collect()}
    assert got == pytest.approx(want) and want


def test_large_benchmarks_are_counted_by_a_join(case, make_docs, spark, monkeypatch):
    from sparkloom.llm import decontaminate

    items, docs = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(find_leaks(make_docs(docs), bench).collect())
    monkeypatch.setattr(decontaminate, "SENT_WORDS", 3)
    assert sorted(find_leaks(make_docs(docs), bench).collect()) == want


def test_clashing_names_stay(odd, spark, case):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    out = mark_leaks(odd, bench)
    assert out.columns == [*odd.columns, "_leaks"] and {r.leaks for r in out.collect()} == {"x"}
    assert sorted(str(r.doc_id) for r in out.where("size(_leaks) > 0").collect()) == ["3", "3"]
