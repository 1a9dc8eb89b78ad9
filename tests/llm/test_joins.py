"""Near-duplicate joins whose sides grow with the data send neither side out whole."""

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, nearcopies, simhash


@pytest.fixture
def plans(monkeypatch):
    """Physical plans of all written tables, by a function that also adds a result's."""
    seen = []

    def note(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (simhash, nearcopies):
        monkeypatch.setattr(module, "staged", lambda df, name, f=module.staged: f(note(df), name))
    return lambda df: (note(df), seen)[1]


def copies(make_docs):
    words = [f"w{i}" for i in range(120)]
    return make_docs([(k, " ".join([*words[: 119 - k % 3], f"x{k % 5}"])) for k in range(30)])


def test_simhash_sends_no_side_out(make_docs, plans):
    for of in (simhash.near_duplicates, simhash.keep_one):
        seen = plans(of(copies(make_docs)))
        assert any("SortMergeJoin" in p for p in seen) and not any("Broadcast" in p for p in seen)
    fps = copies(make_docs).select(simhash.fingerprints("text").alias("fp")).distinct()
    assert not any("Broadcast" in p for p in plans(simhash.links(fps)))


def test_near_copies_send_no_side_out(make_docs, plans):
    """Bits of row numbers, whose number is bounded, may be sent out."""
    seen = plans(nearcopies.keep_one(copies(make_docs)))
    sent = [line for p in seen for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert any("SortMergeJoin" in p for p in seen) and all("_word#" in line for line in sent)


def test_texts_stay_where_they_are(make_docs, plans):
    """But for the few that prefixes join, no text is dealt out; neither are sketches."""
    seen = plans(nearcopies.keep_one(copies(make_docs)))
    joined = [line for p in seen for line in p.splitlines() if "SortMergeJoin" in line and "_row#" in line]
    assert len(joined) <= 1


@pytest.mark.parametrize("most", [common.MOST_WORDS, 0])
def test_rows_picked_by_bits(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_WORDS", most)
    rows = [0, 1, 62, 63, 64, 127, 128, 1 << 33, (1 << 33) + 63, (5 << 33) + 64]
    df = spark.createDataFrame([(n, f"t{n}", "w") for n in rows], "n long, text string, _word string")
    chosen = [63, 63, 64, 2, 1 << 33, (5 << 33) + 64]
    got = common.picked(df, "n", spark.createDataFrame([(n,) for n in chosen], "n long"))
    assert sorted(tuple(r) for r in got.collect()) == [(n, f"t{n}", "w") for n in rows if n in chosen]
    assert common.picked(df, "n", df.select("n").limit(0)).count() == 0
    assert common.picked(df, "n", df.select("n")).count() == len(rows)
