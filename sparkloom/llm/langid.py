"""Language identification by words first, then shorter and shorter n-grams.

A word seen in training scores by its log frequency in each language.  A word
never seen is read from its start by the longest known character n-gram (of 5
letters down to 1, with marks at both ends of the word); each step adds that
n-gram's log frequencies.  A text's totals decide.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_DOCS`` a
language on average, drawn by a hash of the id) and holds at most ``VOCABULARY``
words and as many n-grams, so it can be sent to every executor.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import free_name, give_back, held_out

SAMPLE_DOCS = 1500
VOCABULARY = 150_000
LONGEST = 5
#: A word seen once is read by its n-grams, as unseen words are.
LEAST_SEEN = 2
#: Counts and letters that a counting task or a kept row may hold.
_HELD_COUNTS, _KEPT_LETTERS = 400_000, 64
UNDETERMINED = "und"
SMOOTHING = 0.1
_WORDS = re.compile(r"[^\W\d_]+")
_CACHED_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters of the whole text, lower-cased."""
    return _WORDS.findall(text.lower()) if text else []


@dataclass
class Model:
    """Log frequencies: ``table[index[unit]]`` has one number a language."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    _rows: dict[str, int] = field(default_factory=dict)
    _extra: list[np.ndarray] = field(default_factory=list)

    def unseen(self, word: str) -> np.ndarray:
        """Backoff for a word without a row of its own."""
        marked, at, total = f"<{word}>", 0, np.zeros(len(self.langs))
        steps = 0
        while at < len(marked):
            for n in range(min(LONGEST, len(marked) - at), 0, -1):
                row = self.grams.get(marked[at : at + n])
                if row is not None:
                    total += self.table[row]
                    at, steps = at + max(1, n - 1), steps + 1
                    break
            else:
                at += 1
        return total / max(steps, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and confidence; ``und`` with 0 for null or letterless texts,
        or if nothing was learned."""
        words = words_of(text)
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        rows, base = self._rows, len(self.table)
        if not rows or len(rows) > _CACHED_WORDS:
            rows.clear()
            rows.update(self.words)
            self._extra = []
        try:
            at = [rows[w] for w in words]
        except KeyError:
            long: dict[str, int] = {}
            for w in words:
                if w not in rows and w not in long:
                    (rows if len(w) <= _KEPT_LETTERS else long)[w] = base + len(self._extra)
                    self._extra.append(self.unseen(w))
            at = [rows[w] if w in rows else long[w] for w in words]
        at = np.array(at)
        known = at < base
        total = self.table[at[known]].sum(axis=0)
        if not known.all():
            total = total + np.array([self._extra[i - base] for i in at[~known]]).sum(axis=0)
        spread = (total - total.max()) / np.sqrt(len(words))
        p = np.exp(spread)
        best = int(np.argmax(total))  # ties: the first language in order
        return self.langs[best], float(p[best] / p.sum())


_COUNTS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("n", T.LongType())])


def grams_of(word: str) -> Iterator[str]:
    marked = f"<{word}>"
    return (marked[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(marked) - n + 1))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(kind: str, counts: Counter) -> pd.DataFrame:
        return pd.DataFrame([(kind, lang, u, n) for (lang, u), n in counts.items()], columns=_COUNTS.names)

    for batch in batches:
        words, grams = Counter(), Counter()
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            words.update((lang, w) for w in words_of(text))
        for (lang, w), n in words.items():
            for g in grams_of(w):
                grams[lang, g] += n
            if len(grams) > _HELD_COUNTS:
                yield rows("g", grams)
                grams.clear()
        yield rows("w", words)
        yield rows("g", grams)
    give_back()


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY) -> Model:
    """Learn from rows (doc_id, text, lang); rows with a null text or lang are
    left out.  Counting runs on the executors; the model's rows, bounded by
    ``vocabulary``, come to the driver."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], {}, {}, np.zeros((0, 0)))
    spark = labelled.sparkSession
    share = spark.createDataFrame([(k, min(1.0, sample_docs / n)) for k, n in sorted(sizes.items())], "lang string, share double")
    drawn = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    counts = drawn.select("lang", "text").mapInPandas(_count, _COUNTS).groupBy("kind", "unit", "lang").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    by_lang = [F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, k in enumerate(langs)]
    units = counts.groupBy("kind", "unit").agg(F.sum("n").alias("total"), *by_lang)
    index: dict[str, dict[str, int]] = {"w": {}, "g": {}}
    tables, offset = [], 0
    for kind in "wg":
        least = LEAST_SEEN if kind == "w" else 1
        own = units.where((F.col("kind") == kind) & (F.col("total") >= least)).orderBy(F.desc("total"), "unit").limit(vocabulary).drop("kind").toArrow()
        n = np.stack([np.asarray(own[f"n{i}"], dtype=np.float64) for i in range(len(langs))], axis=1)
        index[kind] = {u: offset + i for i, u in enumerate(own["unit"].to_pylist())}
        offset += len(n)
        tables.append(np.log((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * max(len(n), 1))))
    return Model(langs, index["w"], index["g"], np.concatenate(tables))


_PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with struct column ``out`` (lang_pred, score); every other column
    and row is kept; where a column has that name, the new one has underscores
    before it.  Only the text is read to predict.  Of languages with equal totals
    the first in order is predicted."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams, model.table))

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        here = Model(*sent.value)
        for texts in batches:
            yield pd.DataFrame([here.predict(t) for t in texts], columns=_PREDICTED.names)
        del here
        give_back()

    # Annotations must be objects here, as pandas_udf reads them.
    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn(free_name(docs, out), F.pandas_udf(predict, _PREDICTED)(F.col(text_col)))


def predict_table(docs: DataFrame) -> DataFrame:
    """Fit on the rows of ``docs`` that are not held out and predict all rows.

    One row per row of ``docs`` (repeated ones too): doc_id, held_out (crc32 of
    the id as text, mod 5, is 0; false for a null id), lang_pred, score.  A null
    lang is not learned from; an empty table gives an empty result.
    """
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
