"""Largest inner products by score-aware quantisation and exact reranking.

Vectors are cut into pairs of components, each pair coded by one of 16 centres:
four bits.  Centres and codes are fitted to the loss |e|^2 + (eta - 1) (e.x/|x|)^2
of the residual e, which punishes error along the vector, the one that disturbs
large inner products (eta = (d - 1) T^2 / (1 - T^2)).  Codes are chosen by
coordinate descent, as error along the vector adds up over the pairs.

A query turns into a table of 16 partial scores a pair; two pairs share a byte,
so a scan sums one lookup a byte.  What comes within ``margin`` of the query's
bound is scored exactly, in double precision, on the original vectors.  The
bound starts as the query's exact k-th best score over the fitting sample, hence
never above the true one, and rises to the k-th best that the task has found;
the margin is the ``SAFETY`` quantile of the scan's error on the sample's true
neighbours.  No number of candidates is fixed anywhere.  A query that finds fewer
than k rows that way is scanned again without a margin.

The sample is bounded (``SAMPLE`` vectors, one an id); every valid row is indexed.
Queries get their bounds on the executors and are taken in blocks of at most
``BLOCK_QUERIES``, each sent to all executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import staged

SAMPLE = 12_000
BLOCK_QUERIES = 20_000
THRESHOLD = 0.2
CENTRES = 16
SWEEPS = 6
SAFETY = 0.998
_ROWS = 16_384
_MANY = 64


def valid(embedding: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


@dataclass
class Quantiser:
    """Centres of each pair of components: (pairs, 16, 2)."""

    centres: np.ndarray
    dim: int
    eta: float
    margin: float = 0.0

    def _padded(self, x: np.ndarray) -> np.ndarray:
        pairs = len(self.centres)
        out = np.zeros((len(x), 2 * pairs), np.float32)
        out[:, : self.dim] = x
        return out.reshape(len(x), pairs, 2)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Centre numbers (rows, pairs), by coordinate descent on the loss."""
        p = self._padded(x)
        unit = p / np.maximum(np.linalg.norm(p.reshape(len(p), -1), axis=1), 1e-30)[:, None, None]
        code = np.empty(p.shape[:2], np.uint8)
        along = np.zeros(len(p), np.float32)
        square, dots = [], []
        for s, centres in enumerate(self.centres):
            e = p[:, s, None, :] - centres
            square.append((e * e).sum(axis=2))
            dots.append((e * unit[:, s, None, :]).sum(axis=2))
            code[:, s] = square[s].argmin(axis=1)
            along += np.take_along_axis(dots[s], code[:, s, None].astype(np.int64), 1)[:, 0]
        for _ in range(sweeps):
            for s in range(len(self.centres)):
                along -= np.take_along_axis(dots[s], code[:, s, None].astype(np.int64), 1)[:, 0]
                loss = square[s] + (self.eta - 1) * (along[:, None] + dots[s]) ** 2
                code[:, s] = loss.argmin(axis=1)
                along += np.take_along_axis(dots[s], code[:, s, None].astype(np.int64), 1)[:, 0]
        return code

    def refit(self, x: np.ndarray, code: np.ndarray) -> None:
        """Centres of least loss for given codes, pair after pair."""
        p = self._padded(x)
        unit = p / np.maximum(np.linalg.norm(p.reshape(len(p), -1), axis=1), 1e-30)[:, None, None]
        pick = np.arange(len(self.centres))
        along = ((p - self.centres[pick, code]) * unit).sum(axis=(1, 2))
        for s in pick:
            u, c = unit[:, s], code[:, s]
            rest = along - ((p[:, s] - self.centres[s, c]) * u).sum(axis=1)
            target = p[:, s] + (self.eta - 1) * (rest + (p[:, s] * u).sum(axis=1))[:, None] * u
            outer = np.eye(2, dtype=np.float32) + (self.eta - 1) * u[:, :, None] * u[:, None, :]
            for k in range(CENTRES):
                own = c == k
                if own.any():
                    self.centres[s, k] = np.linalg.solve(outer[own].sum(axis=0) + 1e-6 * np.eye(2), target[own].sum(axis=0))
            along = rest + ((p[:, s] - self.centres[s, c]) * u).sum(axis=1)

    def packed(self, code: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        if code.shape[1] % 2:
            code = np.concatenate([code, np.zeros((len(code), 1), np.uint8)], axis=1)
        return code[:, 0::2] | code[:, 1::2] << 4

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Partial scores (queries, bytes, 256) of each byte of a code."""
        t = np.einsum("npd,pkd->npk", self._padded(q), self.centres)
        if t.shape[1] % 2:
            t = np.concatenate([t, np.zeros((len(t), 1, CENTRES), t.dtype)], axis=1)
        both = t[:, 1::2, :, None] + t[:, 0::2, None, :]
        return np.ascontiguousarray(both.reshape(len(q), -1, 256), dtype=np.float32)

    def scan(self, q: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, rows)."""
        tables, out = self.tables(q), np.zeros((len(q), len(packed)), np.float32)
        for j in range(packed.shape[1]):
            out += np.take(tables[:, j], packed[:, j], axis=1)
        return out


def exact(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, equal for equal rows."""
    return np.einsum("ij,j->i", rows.astype(np.float64), q.astype(np.float64))


def fit(x: np.ndarray, k: int, seed: int = 5) -> Quantiser:
    """Fit centres to a sample and measure the margin for k neighbours."""
    n, dim = x.shape
    pairs = (dim + 1) // 2
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    rng = np.random.default_rng(seed)
    model = Quantiser(np.zeros((pairs, CENTRES, 2), np.float32), dim, eta)
    p = model._padded(x)
    model.centres = np.stack([p[rng.choice(n, CENTRES, replace=n < CENTRES), s] for s in range(pairs)])
    for turn in range(SWEEPS):
        plain = turn < SWEEPS // 2
        model.eta = 1.0 if plain else eta
        model.refit(x, model.codes(x, 0 if plain else 1))
    packed, errors = model.packed(model.codes(x)), []
    some = rng.choice(n, min(n, 256), replace=False)
    approximate = model.scan(x[some], packed)
    true = x[some].astype(np.float64) @ x.astype(np.float64).T
    for i in range(len(some)):
        top = np.argsort(-true[i], kind="stable")[: k + 1]
        errors.append((true[i, top] - approximate[i, top]) / max(np.linalg.norm(x[some[i]]), 1e-30))
    model.margin = max(float(np.quantile(np.concatenate(errors), SAFETY)), 0.0) + 1e-6
    return model


def bounds(queries: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """For each query its k-th best exact score over the sample (its own id
    apart), or minus infinity if the sample has fewer."""
    out = np.full(len(queries), -np.inf)
    s64 = sample.astype(np.float64)
    for i in range(0, len(queries), 256):
        scores = queries[i : i + 256].astype(np.float64) @ s64.T
        scores[ids[i : i + 256, None] == sample_ids[None, :]] = -np.inf
        if scores.shape[1] >= k:
            kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            out[i : i + 256] = kth - 1e-9 * np.maximum(np.abs(kth), 1)
    return out


def _best_of_equal(ids: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Rows without those that ``keep`` equal vectors of smaller id precede: they
    can't be among the nearest of any query."""
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1])))[:, 0]
    _, group = np.unique(keys, return_inverse=True)
    order = np.lexsort((ids, group))
    sorted_group = group[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]]))
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return np.sort(order[place < keep])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, block: int = BLOCK_QUERIES) -> DataFrame:
    """The k nearest rows of ``vectors`` (vec_id, embedding) for each query row
    of the same columns: query_id, rank (from 1), vec_id, score; nearest first,
    ties to the smaller id, all candidates if there are fewer.

    Rows of a query's own id are no candidates for it.  Vectors that are null,
    zero or hold null or non-finite components take no part, nor do null ids and
    vectors whose length isn't the most frequent one: inner products need one
    length.  Scores are those of the original components, floats or doubles, in
    double precision.  A repeated row counts as
    often as it occurs; of queries with one id the least vector is taken.  Other
    columns aren't read; an empty side gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.where(valid(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    rows = rows.where(F.size("embedding") == dim)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < min(1.0, sample / n) * (1 << 20))
    drawn = drawn.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toPandas().sort_values("vec_id")
    if not len(drawn):
        drawn = rows.limit(sample).toPandas()
    real = rows.schema["embedding"].dataType.elementType.simpleString()
    kind = np.float32 if real == "float" else np.float64
    sample_x, sample_ids = np.array(drawn["embedding"].tolist(), kind), drawn["vec_id"].to_numpy()
    sent = spark.sparkContext.broadcast(fit(sample_x.astype(np.float32), k))
    drawn_sent = spark.sparkContext.broadcast((sample_x, sample_ids))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            for i in range(0, len(batch), _ROWS):
                part = batch.iloc[i : i + _ROWS]
                code = model.packed(model.codes(np.array(part["embedding"].tolist(), np.float32)))
                yield part.assign(code=[c.tobytes() for c in code])

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, ids = drawn_sent.value
        for batch in batches:
            q = np.array(batch["embedding"].tolist(), kind).reshape(len(batch), -1)
            yield batch.assign(low=bounds(q, batch["vec_id"].to_numpy(), x, ids, k))

    index = staged(rows.mapInPandas(encode, f"vec_id long, embedding array<{real}>, code binary"), "ann-index")
    asked = queries.where(valid(F.col("embedding")) & F.col("vec_id").isNotNull() & (F.size("embedding") == dim))
    asked = asked.groupBy("vec_id").agg(F.min(F.col("embedding").cast(f"array<{real}>")).alias("embedding"))
    asked = staged(asked.mapInPandas(bounded, f"vec_id long, embedding array<{real}>, low double"), "ann-queries")
    found = staged(_in_blocks(index, sent, asked, k, block, kind, schema), "ann-found")
    # Candidates of a query: all rows but those of its own id.
    own = index.join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("own"))
    had = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("had"))
    few = F.coalesce("had", F.lit(0)) < F.least(F.lit(k), F.lit(n) - F.coalesce("own", F.lit(0)))
    short = staged(asked.join(had, "vec_id", "left").join(own, "vec_id", "left").where(few).select("vec_id", "embedding", F.lit(float("-inf")).alias("low")), "ann-short")
    again = _in_blocks(index, sent, short, k, block, kind, schema, whole=True)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again).select("query_id", "rank", "vec_id", "score")


def _in_blocks(index: DataFrame, model_sent, asked: DataFrame, k: int, block: int, kind: type, schema: str, whole: bool = False) -> DataFrame:
    """Ranked neighbours of the queries (vec_id, embedding, low), block by block."""
    n = asked.count()
    blocks = -(-n // max(block // 2, 1)) if n > block else 1
    found = []
    for b in range(blocks if n else 0):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas().sort_values("vec_id")
        if len(mine):
            q = np.array(mine["embedding"].tolist(), kind)
            found.append(_scan(index, model_sent, q, mine["vec_id"].to_numpy(), mine["low"].to_numpy(), k, whole))
    if not found:
        return index.sparkSession.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(index: DataFrame, model_sent, q: np.ndarray, q_ids: np.ndarray, low: np.ndarray, k: int, whole: bool) -> DataFrame:
    """The k best rows of each task for each query, exactly scored; ``whole``
    scores every row and scans none."""
    sent = index.sparkSession.sparkContext.broadcast((q, q_ids, low))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, (queries, ids, bound) = model_sent.value, sent.value
        slack = np.full(len(queries), np.inf) if whole else model.margin * np.linalg.norm(queries.astype(np.float64), axis=1)
        least = bound.copy()
        none = (np.zeros(0), np.zeros(0, np.int64))
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in _joined(batches):
            vec_ids, x = batch["vec_id"].to_numpy(), np.array(batch["embedding"].tolist(), queries.dtype)
            packed = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(len(x), -1)
            kept = _best_of_equal(vec_ids, x, k + 1)
            vec_ids, x, packed = vec_ids[kept], x[kept], packed[kept]
            for i in range(0, len(queries), _MANY):
                near = None if whole else model.scan(queries[i : i + _MANY], packed)
                for at in range(i, min(i + _MANY, len(queries))):
                    others = vec_ids != ids[at]
                    if not whole and least[at] == -np.inf and len(x) > 2 * k:
                        # No bound yet: the exact k-th best of this batch's likeliest.
                        likely = np.argpartition(-near[at - i], 2 * k)[: 2 * k]
                        scores = exact(x[likely[others[likely]]], queries[at])
                        least[at] = np.sort(scores)[-k] if len(scores) >= k else -np.inf
                    close = np.flatnonzero(others if whole else (near[at - i] >= least[at] - slack[at]) & others)
                    if not len(close):
                        continue
                    scores = exact(x[close], queries[at])
                    good = scores >= least[at]
                    had = best.get(at, none)
                    scores, names = np.concatenate([had[0], scores[good]]), np.concatenate([had[1], vec_ids[close[good]]])
                    top = np.lexsort((names, -scores))[:k]
                    best[at] = scores[top], names[top]
                    if len(top) == k:
                        least[at] = max(least[at], scores[top[-1]])
        done = sorted(best)
        for i in range(0, len(done), 1000):
            part = done[i : i + 1000]
            sizes = [len(best[at][0]) for at in part]
            yield pd.DataFrame({"query_id": np.repeat(ids[part], sizes), "vec_id": np.concatenate([best[at][1] for at in part]), "score": np.concatenate([best[at][0] for at in part])})

    return index.mapInPandas(run, "query_id long, vec_id long, score double")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches joined to about ``_ROWS`` rows, so that each scan is long."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= _ROWS:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def search_table(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by ``every``."""
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)
