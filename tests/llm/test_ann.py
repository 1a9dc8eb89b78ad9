import numpy as np
import pytest

from sparkloom.llm.ann import fit, search, search_table

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in vectors], SCHEMA).repartition(3)


def brute(vectors, queries, k):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], np.float32).astype(np.float64)
    out = {}
    for q in queries:
        s = np.einsum("ij,j->i", x, x[list(ids).index(q)])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sample", [12_000, 150])
def test_recall_and_scores(spark, sample):
    g = np.random.default_rng(1)
    x = g.normal(size=(1500, 24))
    x[:500] = x[0] + 0.05 * x[:500]  # a dense cluster
    x *= g.uniform(0.5, 2, (1500, 1))  # lengths matter for inner products
    vectors = [(i, v.astype(np.float32)) for i, v in enumerate(x)]
    df = frame(spark, vectors)
    got = by_query(search(df, df.where("vec_id % 20 = 0"), 20, sample))
    want = brute(vectors, range(0, 1500, 20), 20)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.97
    for q in want:
        scores = dict(want[q])
        assert all(abs(s - scores[i]) < 1e-12 for i, s in got[q] if i in scores) and len(got[q]) == 20


def test_parallel_error_is_punished():
    g = np.random.default_rng(0)
    x = g.normal(size=(3000, 16)).astype(np.float32)
    model = fit(x, 10)
    assert model.eta > 0.6
    model.eta = 4.0
    pick = np.arange(8)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def along(code):
        e = (x.reshape(-1, 8, 2) - model.centres[pick, code]).reshape(len(x), -1)
        return np.abs((e * unit).sum(axis=1)).mean()

    assert along(model.codes(x, 2)) < along(model.codes(x, 0))


def test_ties_copies_and_blocks(spark):
    vectors = [(i, [1.0, 0.0, 0.0]) for i in range(60)] + [(100, [0.0, 1.0, 0.0]), (101, [0.9, 0.1, 0.0])]
    df = frame(spark, vectors)
    got = by_query(search(df, df.where("vec_id in (0, 40, 100)"), 5, block=2))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[40]] == [0, 1, 2, 3, 4]
    assert got[100][0][0] == 101


def test_odd_rows(spark):
    rows = [(0, [1, 2]), (20, [2, 1]), (40, None), (60, [0, 0]), (80, [float("nan"), 1]), (100, [float("inf"), 1]), (120, [None, 1]), (140, []), (160, [1, 2, 3]), (None, [1, 1]), (7, [1, 1]), (7, [1, 1])]
    got = by_query(search_table(frame(spark, rows)))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [20, 7, 7], 20: [0, 7, 7]}
    assert search_table(frame(spark, rows).limit(0)).count() == 0
    assert search_table(frame(spark, [(40, None), (60, [0, 0])])).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_against_brute_force(spark, sf):
    """Recall, exact scores and whole results on the given embeddings."""
    from sparkloom.llm.queries import op9_ann

    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    vectors = [(r.vec_id, r.embedding) for r in rows]
    want = brute(vectors, [i for i, _ in vectors if i % 20 == 0], 20)
    got = by_query(op9_ann(spark, f"/root/testdata/{sf}"))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) > 0.99 and min(hits) >= 0.9
    for q, found in got.items():
        scores = dict(want[q])
        assert all(abs(s - scores[i]) < 1e-12 for i, s in found if i in scores)


def test_a_query_that_comes_short_is_scanned_again(spark, monkeypatch):
    from sparkloom.llm import ann

    g = np.random.default_rng(2)
    vectors = [(i, v) for i, v in enumerate(g.normal(size=(400, 8)).astype(np.float32))]
    monkeypatch.setattr(ann, "bounds", lambda q, *a: np.full(len(q), 1e9))  # nothing passes the first scan
    df = frame(spark, vectors)
    got = by_query(search(df, df.where("vec_id % 100 = 0"), 20))
    want = brute(vectors, range(0, 400, 100), 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_doubles_are_scored_as_doubles(spark):
    g = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(g.normal(size=(300, 6)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    for r in search(df, df.where("vec_id % 50 = 0"), 5).collect():
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-13
