import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import toxicity as x

WORDS = [a + b for a in "ba ke lo mi nu ra".split() for b in "tan dor vel sin mop kul ges".split()]


def corpus(n, seed=0):
    """Clean prose, and prose with an insult: a word, or a stem with an ending."""
    g, out = random.Random(seed), []
    for i in range(n):
        w = g.choices(WORDS, k=g.randint(5, 150))
        y = int(i % 4 == 0)
        if y:
            for _ in range(3):
                w.insert(g.randrange(len(w)), g.choice(["grobian", "zoquet" + g.choice(WORDS)]))
        out.append((i, " ".join(w), y))
    return out


@pytest.fixture(scope="module")
def net():
    rows = corpus(240)
    return x.train([t for _, t, _ in rows], [y for *_, y in rows], rounds=2)


def test_gradients_match_differences():
    net, vocab = x.Network(3), x.Vocabulary()
    net.p["word"][:] = np.random.default_rng(1).normal(0, 0.3, net.p["word"].shape)
    rows = x._windows(vocab.encode("one two three two four five".split()))
    y = np.array([1.0], np.float32)

    def loss():
        projected = net.project(vocab.word, vocab.grams)
        return float(np.logaddexp(0, -net.forward(projected[rows], rows > 0)[0]))

    got = net.gradients(rows, y, vocab)
    for k in ("in", "uf", "ub", "att", "att_out", "out"):
        flat = net.p[k].reshape(-1)
        for i in (0, flat.size // 2, flat.size - 1):
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - got[k].reshape(-1)[i]) < 2e-3


def test_held_out_accuracy(net):
    rows = corpus(200, seed=9)
    got = x.Scorer(net.p, net.calibration).score([t for _, t, _ in rows])
    right = [(s >= 0.5) == bool(y) for (s, _), (*_, y) in zip(got, rows, strict=True)]
    assert sum(right) / len(right) > 0.95


def test_whole_text_is_scored(net):
    clean = " ".join(random.Random(1).choices(WORDS, k=20_000))
    late = clean + " grobian zoquettan grobian " + " ".join(WORDS)
    (a, _), (b, at) = x.Scorer(net.p, net.calibration).score([clean, late])
    assert a < 0.5 < b and at > 19_900


@pytest.mark.parametrize("n", [0, 1, 23, 24, 25, 36, 37, 1000])
def test_windows_cover_all_words(n):
    starts = x.window_starts(n)
    assert {i for s in starts for i in range(s, min(s + x.WINDOW, n))} == set(range(n))


def test_table_and_odd_rows(odd, make_docs, spark):
    docs = make_docs([(i, t) for i, t, _ in corpus(300)])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in corpus(300)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = x.score_table(docs, labels).collect()
    assert {r.doc_id for r in got if r.held_out} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    truth = {i: y for i, _, y in corpus(300)}
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out]) > 0.9
    out = x.score_table(odd, labels.where("toxic = 0")).collect()  # one class only
    assert len(out) == 7 and all(r.predicted == 0 for r in out)
    assert all(r.score == 0 and r.window == -1 for r in out if r.doc_id in (0, 1, 5))
    assert x.score_table(odd.limit(0), labels.limit(0)).count() == 0


def test_every_part_of_a_long_word_is_read():
    head, tail = "a" * 64, "grobian_" * 20
    assert "".join(x.words_of(head + tail)) == head + tail
    rows = [{x.features(w)[0] for w in x.words_of(head + end)} for end in (tail, "tandor_" * 20)]
    assert rows[0] != rows[1] and x.words_of("b" * 64) == ["b" * 64]


def brute_score(net, text):
    """Every window word by word, in double precision and without any batching."""
    p, k = {n: v.astype(float) for n, v in net.p.items()}, x.HIDDEN
    words = x.words_of(text)
    if not words:
        return 0.0
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def enter(word):
        a, grams = x.features(word)
        return (p["word"][a] + sum(p["gram"][g] for g in grams) / np.sqrt(len(grams))) @ p["in"] + p["in_bias"]

    def unit(inputs, u):
        h, out = np.zeros(k), []
        for v in inputs:
            z, r = sigmoid(v[:k] + h @ u[:, :k]), sigmoid(v[k : 2 * k] + h @ u[:, k : 2 * k])
            h = (1 - z) * h + z * np.tanh(v[2 * k :] + (r * h) @ u[:, 2 * k :])
            out.append(h)
        return out

    best = -np.inf
    for start in sorted({*range(0, max(len(words) - x.WINDOW, 0) + 1, x.STRIDE), max(len(words) - x.WINDOW, 0)}):
        v = [enter(w) for w in words[start : start + x.WINDOW]]
        forward, backward = unit([a[: 3 * k] for a in v], p["uf"]), unit([a[3 * k :] for a in v][::-1], p["ub"])[::-1]
        states = [np.concatenate(s) for s in zip(forward, backward, strict=True)]
        weight = np.exp([np.tanh(s @ p["att"]) @ p["att_out"] for s in states])
        pooled = sum(w * s for w, s in zip(weight / weight.sum(), states, strict=True))
        best = max(best, pooled @ p["out"] + p["out_bias"][0])
    a, b = net.calibration
    return sigmoid(a * best + b)


def test_query_against_brute_force(spark):
    """The query's own fit, then each document of the table scored by brute force."""
    from sparkloom.llm.common import held_out, table
    from sparkloom.llm.queries import op3_toxicity

    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    net = x.fit(docs.where(~held_out()), labels.where(~held_out()))
    got = {r.doc_id: r for r in op3_toxicity(spark, sf).collect()}
    rows = sorted(docs.collect(), key=lambda r: len(r.text or ""))
    assert len(got) == len(rows)
    for r in rows[:150]:
        assert abs(got[r.doc_id].score - brute_score(net, r.text)) < 1e-3
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def test_long_documents_train_whole(make_docs, spark):
    """A label of long documents alone is learned; draws keep to their bounds."""
    g = random.Random(8)
    long = [(i, " ".join(g.choices(WORDS, k=3000)) + (" grobian zoquet grobian" if i % 2 else "") + " tan bar", i % 2) for i in range(40)]
    docs = make_docs([(i, t) for i, t, _ in long])
    labels = spark.createDataFrame([(i, y) for i, _, y in long], "doc_id long, toxic int")
    net = x.fit(docs, labels)
    scored = x.Scorer(net.p, net.calibration).score([t for _, t, _ in long])
    assert np.mean([(s >= 0.5) == bool(y) for (s, _), (*_, y) in zip(scored, long, strict=True)]) > 0.9
    drawn = []
    old, x.train = x.train, lambda texts, ys: drawn.extend(texts)
    try:
        x.fit(docs, labels, chars=100_000)
        few = len(drawn)
        x.fit(docs.union(docs).union(docs), labels, sample={0: 10, 1: 10})
    finally:
        x.train = old
    assert few < 30 and len(drawn) - few < 40


def test_clashing_names_stay(odd, net):
    out = x.score(odd, net)
    assert out.columns == [*odd.columns, "_toxicity"] and {r.toxicity for r in out.collect()} == {"x"}
