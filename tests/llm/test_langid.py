import math
import random
import re
import zlib
from collections import Counter

from sparkloom.llm.langid import fit, identify, predict_table, words_of

STEMS = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "ung", "ber", "ach"], "zz": ["eau", "oir", "ent", "ille"]}


def corpus(n, seed=0):
    g, out = random.Random(seed), []
    for i in range(n):
        lang = g.choice(list(STEMS))
        out.append((i, " ".join("".join(g.choices(STEMS[lang], k=g.randint(1, 5))) for _ in range(g.randint(3, 40))), lang))
    return out


def brute(model, text):
    """The rules word by word, without arrays over whole texts or kept rows."""
    total = [0.0] * len(model.langs)
    for w in words_of(text):
        row = model.table[model.words[w]] if w in model.words else model.unseen(w)
        total = [a + b for a, b in zip(total, row, strict=True)]
    return model.langs[total.index(max(total))]


def test_held_out_accuracy_and_brute_force(make_docs):
    rows = corpus(300)
    got = predict_table(make_docs(rows)).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    model = fit(make_docs(rows))
    texts = {i: t for i, t, _ in corpus(60, seed=3)}
    out = identify(make_docs([(i, t) for i, t in texts.items()]), model).select("doc_id", "language.*").collect()
    assert all(r.lang_pred == brute(model, texts[r.doc_id]) for r in out)
    assert all(0 <= r.score <= 1 for r in out)


def test_unseen_words_back_off(make_docs):
    model = fit(make_docs(corpus(300)))
    assert "schungberachungschber" not in model.words
    assert model.predict("schungberachungschber Schungachbersch!")[0] == "yy"


def test_odd_rows(odd, make_docs, spark):
    got = predict_table(odd).collect()
    assert len(got) == 7
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (0, 1, 5))
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert predict_table(odd.limit(0)).count() == 0
    unlabelled = make_docs([(1, "some text", None), (2, "123 456", None)])
    assert {r.lang_pred for r in predict_table(unlabelled).collect()} == {"und"}
    both = make_docs([(i, "same words", lang) for i in range(40) for lang in ("aa", "bb")])
    assert {r.lang_pred for r in predict_table(both).collect()} == {"aa"}  # a tie: the first in order


def brute_query(rows):
    """Counting, backoff and totals from the rules alone, in plain loops."""
    split = lambda t: [w for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
    learned = [r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 5]
    langs = sorted({r[2] for r in learned})
    words, grams = {k: Counter() for k in langs}, {k: Counter() for k in langs}
    for _, text, lang in learned:
        for w in split(text):
            words[lang][w] += 1
            for n in range(1, 6):
                for i in range(len(w) + 3 - n):
                    grams[lang][f"<{w}>"[i : i + n]] += 1
    known = {w for c in words.values() for w in c}
    known = {w for w in known if sum(c[w] for c in words.values()) >= 2}
    units = {g for c in grams.values() for g in c}
    assert len(known) < 150_000 and len(units) < 150_000
    size_w = {k: sum(words[k][w] for w in known) + 0.1 * len(known) for k in langs}
    size_g = {k: sum(grams[k].values()) + 0.1 * len(units) for k in langs}

    def score(w, k):
        if w in known:
            return math.log((words[k][w] + 0.1) / size_w[k])
        marked, at, total, steps = f"<{w}>", 0, 0.0, 0
        while at < len(marked):
            n = next((n for n in range(5, 0, -1) if marked[at : at + n] in units and at + n <= len(marked)), 0)
            if n:
                total += math.log((grams[k][marked[at : at + n]] + 0.1) / size_g[k])
                steps += 1
            at += max(1, n - 1)
        return total / max(steps, 1)

    out = {}
    for i, text, _ in rows:
        of = {k: sum(score(w, k) for w in split(text)) for k in langs}
        out[i] = (max(of, key=of.get), sorted(of.values())[-1] - sorted(of.values())[-2]) if split(text) else ("und", 1.0)
    return out


def test_query_against_brute_force(spark):
    from sparkloom.llm.queries import op7_langid

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = brute_query(rows)
    got = {r.doc_id: r.lang_pred for r in op7_langid(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == lang for i, (lang, lead) in want.items() if lead > 1e-6)


def test_long_words_are_learned_and_read_whole(make_docs):
    rows = [(i, ("ab" * 50 if i % 2 else "cd" * 50) + ("xy" * 50 if i % 2 else "zw" * 50), "pp" if i % 2 else "qq") for i in range(20)]
    model = fit(make_docs(rows))
    assert model.predict("xy" * 5000)[0] == "pp" and model.predict("zw" * 5000)[0] == "qq"
    assert model.predict("ab" * 40 + "zw" * 4000)[0] == "qq"  # what comes late counts
    assert not any(len(w) > 200 for w in model._rows)


def test_clashing_names_stay(odd, make_docs):
    out = identify(odd, fit(make_docs(corpus(30))))
    assert out.columns == [*odd.columns, "_language"] and {r.language for r in out.collect()} == {"x"}
