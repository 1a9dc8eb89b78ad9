"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters the network as the sum of its own (hashed) embedding and the mean
of the embeddings of its character n-grams.  One gated recurrent unit reads a
window of ``WINDOW`` words forwards, one backwards; attention pools the states;
a logistic unit scores the window.  Windows overlap by half and cover the whole
text; the highest window decides, through a two-number calibration.

Labels belong to documents, so training picks windows: those with the most
telling features first, then, after each round, those that the network itself
ranks highest in toxic and (as hard counterexamples) in clean documents.  It
is written in numpy and runs on the driver over a bounded sample of labelled
documents: about ``SAMPLE_DOCS`` a class and ``SAMPLE_CHARS`` characters a class,
drawn by a hash of the id.  A document of any length may be drawn, and is then
read whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import free_name, give_back, held_out, staged

SAMPLE_DOCS = {1: 1200, 0: 1800}
SAMPLE_CHARS = 12_000_000
WINDOW, STRIDE = 24, 12
BUCKETS, WIDTH, HIDDEN, ATTEND = 1 << 18, 10, 8, 8
#: Features of fewer training documents stay without an embedding.
LEAST_SEEN = 3
GRAMS = (4, 5)
#: Longer runs are read as consecutive pieces of 64 characters.
_WORD = re.compile(r"\w{1,64}")
_CACHED_WORDS = 120_000
_BLOCK_WORDS = 80_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> tuple[int, array]:
    """Bucket of the word and those of its n-grams (over UTF-8, marked ends);
    a compact array, as training holds one for each different word."""
    raw = b"<%b>" % word.encode("utf-8", "replace")
    mask, crc = BUCKETS - 1, zlib.crc32
    grams = [crc(raw[i : i + n]) & mask for n in GRAMS for i in range(len(raw) - n + 1)] or [crc(raw) & mask]
    return crc(raw) & mask, array("I", grams)


class Vocabulary:
    """Rows for words: 0 pads; word and n-gram buckets of each row."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.word: list[int] = [0]
        self.grams: list[array] = [array("I", [0])]

    def encode(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        try:
            return np.array([rows[w] for w in words], dtype=np.int32)
        except KeyError:
            for w in words:
                if w not in rows:
                    rows[w] = len(self.word)
                    a, b = features(w)
                    self.word.append(a)
                    self.grams.append(b)
            return np.array([rows[w] for w in words], dtype=np.int32)


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows over n words: every STRIDE, the last one at the end."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    starts = np.arange(0, n - WINDOW + 1, STRIDE)
    return starts if starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


def _summed(at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    return rows, np.add.reduceat(d[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, the forward pass and its gradients."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)

        def init(*shape, scale):
            return g.normal(0, scale, shape).astype(np.float32)

        h = HIDDEN
        self.p = {
            "word": np.zeros((BUCKETS, WIDTH), np.float32),
            "gram": np.zeros((BUCKETS, WIDTH), np.float32),
            "in": init(WIDTH, 6 * h, scale=WIDTH**-0.5),
            "in_bias": np.zeros(6 * h, np.float32),
            "uf": init(h, 3 * h, scale=h**-0.5),
            "ub": init(h, 3 * h, scale=h**-0.5),
            "att": init(2 * h, ATTEND, scale=(2 * h) ** -0.5),
            "att_out": init(ATTEND, scale=1.0),
            "out": init(2 * h, scale=(2 * h) ** -0.5),
            "out_bias": np.zeros(1, np.float32),
        }
        self.calibration = (1.0, 0.0)

    def inputs(self, word: list[int], grams: list[array]) -> np.ndarray:
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        flat = np.concatenate([np.asarray(x, np.int64) for x in grams]) if grams else np.zeros(0, np.int64)
        total = np.add.reduceat(self.p["gram"][flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        return self.p["word"][np.asarray(word)] + total / np.sqrt(sizes[:, None]).astype(np.float32)

    def project(self, word: list[int], grams: list[array]) -> np.ndarray:
        """Input of both units for each word; words repeat, so this is kept."""
        return self.inputs(word, grams) @ self.p["in"] + self.p["in_bias"]

    @staticmethod
    def _run(x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, back: bool, keep: list | None) -> np.ndarray:
        n, steps, _ = x.shape
        k = HIDDEN
        h, out = np.zeros((n, k), np.float32), np.empty((n, steps, k), np.float32)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            zr = 1 / (1 + np.exp(-(x[:, t, : 2 * k] + h @ u[:, : 2 * k])))
            z, r = zr[:, :k], zr[:, k:]
            q = np.tanh(x[:, t, 2 * k :] + (r * h) @ u[:, 2 * k :])
            new = h + z * (q - h)
            if mask is not None:
                new = np.where(mask[:, t, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, q))
            h = out[:, t] = new
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; x is (windows, words, both units' inputs)."""
        k, p = 3 * HIDDEN, self.p
        kept = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self._run(x[:, :, :k], p["uf"], mask, False, kept[0]), self._run(x[:, :, k:], p["ub"], mask, True, kept[1])], axis=2)
        s = np.tanh(states @ p["att"])
        e = s @ p["att_out"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.matmul(a[:, None, :], states)[:, 0]
        if keep is not None:
            keep.update(kept=kept, states=states, s=s, a=a, pooled=pooled)
        return pooled @ p["out"] + p["out_bias"][0]

    @staticmethod
    def _run_back(d: np.ndarray, u: np.ndarray, mask: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        k = HIDDEN
        dx, du, dh = np.empty((*d.shape[:2], 3 * k), np.float32), np.zeros_like(u), np.zeros(d[:, 0].shape, np.float32)
        for t, h, z, r, q in reversed(kept):
            dh = dh + d[:, t]
            m = mask[:, t, None]
            new, dh = dh * m, dh * (1 - m)
            dz, dq = new * (q - h) * z * (1 - z), new * z * (1 - q * q)
            drh = dq @ u[:, 2 * k :].T
            dr = drh * h * r * (1 - r)
            dx[:, t] = np.concatenate([dz, dr, dq], axis=1)
            du[:, : 2 * k] += h.T @ dx[:, t, : 2 * k]
            du[:, 2 * k :] += (r * h).T @ dq
            dh = dh + new * (1 - z) + drh * r + dx[:, t, : 2 * k] @ u[:, : 2 * k].T
        return dx, du

    def gradients(self, rows: np.ndarray, y: np.ndarray, vocab: Vocabulary) -> dict:
        """Of the mean logistic loss of windows (rows of the vocabulary, 0 pads)."""
        p, h = self.p, HIDDEN
        used, at = np.unique(rows, return_inverse=True)
        at = at.reshape(rows.shape)
        word, grams = [vocab.word[i] for i in used], [vocab.grams[i] for i in used]
        base = self.inputs(word, grams)
        x = (base @ p["in"] + p["in_bias"])[at]
        mask, keep = (rows > 0).astype(np.float32), {}
        logit = self.forward(x, mask > 0, keep)
        dlogit = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        states, s, a, pooled = (keep[k] for k in ("states", "s", "a", "pooled"))
        g = {"out": pooled.T @ dlogit, "out_bias": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * p["out"]
        da = np.einsum("nd,nld->nl", dpool, states)
        de = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["att_out"] = np.einsum("nl,nlk->k", de, s)
        ds = de[:, :, None] * p["att_out"] * (1 - s * s)
        g["att"] = np.einsum("nld,nlk->dk", states, ds)
        dstates = a[:, :, None] * dpool[:, None] + ds @ p["att"].T
        dxf, g["uf"] = self._run_back(dstates[:, :, :h], p["uf"], mask, keep["kept"][0])
        dxb, g["ub"] = self._run_back(dstates[:, :, h:], p["ub"], mask, keep["kept"][1])
        dx = np.concatenate([dxf, dxb], axis=2) * mask[:, :, None]
        g["in_bias"] = dx.sum(axis=(0, 1))
        per_word = np.zeros((len(used), dx.shape[2]), np.float32)
        np.add.at(per_word, at.ravel(), dx.reshape(-1, dx.shape[2]))
        g["in"] = base.T @ per_word
        dbase = per_word @ p["in"].T
        sizes = np.array([len(x) for x in grams])
        flat = np.concatenate([np.asarray(x, np.int64) for x in grams])
        # Of embeddings only the rows met: (rows, gradient).
        g["word"] = _summed(np.asarray(word, np.int64), dbase)
        g["gram"] = _summed(flat, np.repeat(dbase / np.sqrt(sizes[:, None]), sizes, axis=0).astype(np.float32))
        return g

    def logits(self, rows: np.ndarray, projected: np.ndarray) -> np.ndarray:
        """Logits of windows of row numbers; only short windows are masked."""
        out = np.empty(len(rows), np.float32)
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            mask = part > 0
            out[i : i + 4096] = self.forward(projected[part], None if mask.all() else mask)
        return out


def _windows(rows: np.ndarray) -> np.ndarray:
    starts = window_starts(len(rows))
    padded = np.zeros(max(len(rows), WINDOW), np.int32)
    padded[: len(rows)] = rows
    return padded[starts[:, None] + np.arange(WINDOW)]


def train(texts: list[str], labels: list[int], seed: int = 7, rounds: int = 4, epochs: int = 2, batch: int = 192, rate: float = 0.02) -> Network:
    """Fit a network to documents' labels (1: toxic)."""
    net, vocab, rng = Network(seed), Vocabulary(), np.random.default_rng(seed)
    docs = [(_windows(vocab.encode(w)), y) for t, y in zip(texts, labels, strict=True) if (w := words_of(t))]
    y_docs = np.array([y for _, y in docs])
    if not docs or y_docs.min() == y_docs.max():
        net.calibration = (0.0, 20.0 if len(y_docs) and y_docs[0] else -20.0)
        return net
    telling, seen = _telling(docs, y_docs, vocab)
    kinds = {"word": slice(0, BUCKETS), "gram": slice(BUCKETS, None)}
    for kind, of in kinds.items():
        # Embeddings begin with the log odds in one component, noise in the rest.
        known = np.flatnonzero(seen[of] >= LEAST_SEEN)
        net.p[kind][known] = rng.normal(0, 0.05, (len(known), WIDTH)).astype(np.float32)
        net.p[kind][known, 0] = 0.3 * telling[of][known]
    score_of = np.array([max(telling[vocab.word[r]], max((telling[BUCKETS + g] for g in vocab.grams[r]), default=0)) for r in range(len(vocab.word))])
    score_of[0] = 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in kinds}
    moments |= {k: np.full(BUCKETS, 1e-8, np.float32) for k in kinds}
    step = 0
    for turn in range(rounds):
        projected = None if turn == 0 else net.project(vocab.word, vocab.grams)
        rows, ys = [], []
        for w, y in docs:
            s = score_of[w].max(axis=1) if projected is None else net.logits(w, projected)
            top = np.argsort(-s, kind="stable")[: 2 if y else 3]
            if y:
                top = top[s[top] >= min(s[top[0]], 0.5)]
            else:
                top = np.unique(np.append(top, rng.integers(0, len(w), 3)))
            rows.append(w[top])
            ys.append(np.full(len(top), y, np.float32))
        rows, ys = np.concatenate(rows), np.concatenate(ys)
        ones = np.flatnonzero(ys == 1)
        extra = max(1, int((ys == 0).sum() / max(len(ones), 1) / 2))
        order = np.concatenate([np.flatnonzero(ys == 0), *[ones] * extra])
        for _ in range(epochs if len(order) > 6000 else 2 * epochs):
            rng.shuffle(order)
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                step += 1
                pace = rate * 0.7**turn
                for k, g in net.gradients(rows[part], ys[part], vocab).items():
                    if k in kinds:
                        at, d = g
                        trained = seen[kinds[k]][at] >= LEAST_SEEN
                        at, d = at[trained], d[trained]
                        moments[k][at] += (d * d).mean(axis=1)
                        net.p[k][at] -= pace * d / np.sqrt(moments[k][at])[:, None]
                        continue
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.p[k] -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    projected = net.project(vocab.word, vocab.grams)
    best = np.array([net.logits(w, projected).max() for w, _ in docs])
    net.calibration = _calibrate(best, y_docs)
    return net


def _telling(docs: list, y_docs: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For each feature: log odds of its document counts, drawn to 0 where few
    toxic documents have it (and never below 0), and its document count."""
    counts = np.zeros((2, 2 * BUCKETS), np.float32)
    for (w, _), y in zip(docs, y_docs, strict=True):
        own = [np.append(np.asarray(vocab.grams[r], np.int64) + BUCKETS, vocab.word[r]) for r in np.unique(w) if r]
        counts[y, np.unique(np.concatenate(own))] += 1
    n = np.bincount(y_docs, minlength=2)
    odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    return np.maximum(odds, 0) * counts[1] / (counts[1] + 4), counts.sum(axis=0)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through 0.5 between the classes: two
    thirds of the way from the high clean documents to the low toxic ones, as a
    longer text has more windows to be wrong about; halfway if they overlap."""
    clean, toxic = np.quantile(x[y == 0], 0.995), np.quantile(x[y == 1], 0.02)
    if toxic <= clean:
        return 1.0, -float(np.median(x[y == 0]) + np.median(x[y == 1])) / 2
    middle = clean + (toxic - clean) * 2 / 3
    slope = float(np.clip(6 / (toxic - clean), 0.5, 4))
    return slope, -slope * float(middle)


class Scorer:
    """A worker's network with the kept inputs of words it has met."""

    def __init__(self, params: dict, calibration: tuple[float, float]):
        self.net = Network.__new__(Network)
        self.net.p, self.net.calibration = params, calibration
        self._clear()

    def _clear(self) -> None:
        self.vocab, self.kept = Vocabulary(), np.zeros((0, 6 * HIDDEN), np.float32)

    def score(self, texts: list[str | None]) -> list[tuple[float, int]]:
        """(score, first word of the deciding window) of each whole text; texts
        without words score 0 with window -1."""
        out: list[tuple[float, int]] = []
        block, size = [], 0
        for t in texts:
            w = words_of(t)
            block.append(w)
            size += len(w)
            if size >= _BLOCK_WORDS:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def _block(self, docs: list[list[str]]) -> list[tuple[float, int]]:
        if len(self.vocab.word) > _CACHED_WORDS:
            self._clear()
        rows = [self.vocab.encode(w) for w in docs]
        if len(self.vocab.word) > len(self.kept):
            new = slice(len(self.kept), None)
            self.kept = np.concatenate([self.kept, self.net.project(self.vocab.word[new], self.vocab.grams[new])])
            self.vocab.grams[1:] = [None] * (len(self.vocab.grams) - 1)
        windows = [_windows(r) for r in rows if len(r)]
        if not windows:
            return [(0.0, -1)] * len(docs)
        sizes = [len(w) for w in windows]
        logit = self.net.logits(np.concatenate(windows), self.kept)
        (a, b), parts = self.net.calibration, iter(np.split(logit, np.cumsum(sizes)[:-1]))
        out = []
        for r in rows:
            if not len(r):
                out.append((0.0, -1))
                continue
            part = next(parts)
            i = int(part.argmax())
            out.append((float(_sigmoid(a * float(part[i]) + b)), int(window_starts(len(r))[i])))
        return out


_SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("window", T.LongType())])


def _share(sizes: dict[int, int], most: dict[int, int]) -> Column:
    """Of a row's class: the part that ``most`` allows."""
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("toxic") == y, F.lit(min(1.0, most[y] / max(n, 1)))).otherwise(share)
    return share


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, chars: int = SAMPLE_CHARS) -> Network:
    """Learn from the labelled rows given.  A document labelled twice counts as
    toxic if either row says so; null ids, texts and labels are left out; of the
    texts of a repeated id the least is read.  Ids are drawn down to ``sample`` a
    class on average, joined by broadcast so that texts are not shuffled, and
    drawn again if their texts hold more than ``chars`` characters a class."""
    sample = sample or SAMPLE_DOCS
    drawn_first, drawn_next = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) for seed in (1, 2))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max(F.when(F.col("toxic") == 1, 1).otherwise(0))).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = known.where(drawn_first < _share(sizes, sample) * (1 << 20))
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    rows = staged(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")
    held = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()}
    rows = rows.where(drawn_next < _share(held, dict.fromkeys((0, 1), chars)) * (1 << 20)).orderBy("doc_id").collect()
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, net: Network, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with struct column ``out``: score (0 to 1) and window (first word
    of the deciding window, -1 without words).  Rows and columns are kept; where
    a column has that name, the new one has underscores before it."""
    sent = docs.sparkSession.sparkContext.broadcast((net.p, net.calibration))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*sent.value)
        for texts in batches:
            yield pd.DataFrame(scorer.score(list(texts)), columns=_SCORED.names)
        del scorer
        give_back()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn(free_name(docs, out), F.pandas_udf(run, _SCORED)(F.col(text_col)))


def score_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled documents that are not held out; score all.

    One row per row of ``docs``: doc_id, held_out, score, predicted, window.
    Null and empty texts score 0; without any labels of one class every text
    gets that of the other.  Of windows with equal scores the first decides.
    Columns other than doc_id and text are not read.  An empty table gives an
    empty result.
    """
    net = fit(docs.where(~held_out()), labels.where(~held_out()))
    scored = score(docs.select("doc_id", "text"), net)
    s = F.col("toxicity.score")
    return scored.select("doc_id", held_out().alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"), "toxicity.window")
