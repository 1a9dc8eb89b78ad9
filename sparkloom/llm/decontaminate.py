"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A first pass counts, over all documents, the words that the benchmark uses; a
join of these counts with the benchmark's words gives each word's rarity.  At
each place of a test item the shortest n-gram (2 to 7 words) that is unlikely to
stand in a document by chance, going by those counts, is a seed; copies of an
item do not make its seeds common, as only single words are counted.  A second
pass finds the seeds in every document, and the stretch of text around them is
aligned to the item, word by word (match +2, mismatch -1, gap -1).  The score is
that of the best local alignment over that of a full copy, so edited and
paraphrased copies are found as well as verbatim ones.

Seeds join passages to items by a hash join whose table, the seeds and words of
at most ``BLOCK_CHARS`` characters of the benchmark, goes to every executor.  A
larger benchmark is joined block after block: each block's hits are written
before the next block is read, so one block is held at a time.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import free_name, give_back, staged

MIN_SCORE = 0.4
SHORTEST, LONGEST = 2, 7
#: Seeds that a document may hold by chance, on average, over the whole benchmark.
CHANCE = 0.05
BLOCK_CHARS = 20_000_000
SENT_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, 1, 1
_SPACES = bytes(32 if c < 128 and chr(c) in string.punctuation or c < 32 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of the whole text, ASCII punctuation taken as space."""
    return text.lower().encode("utf-8", "replace").translate(_SPACES).split() if text else []


class Block:
    """Items of one block as word numbers, and their seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if ids:
                self.items.append((item_id, np.array(ids, dtype=np.int64)))
        self.seeds: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words_of(text)], dtype=np.int64)

    @staticmethod
    def keys(ids: np.ndarray, n: int) -> np.ndarray:
        """A 64-bit key for the n-gram at each place; hits are checked by alignment."""
        key = np.zeros(max(len(ids) - n + 1, 0), dtype=np.uint64)
        for i in range(n):
            key = (key ^ (ids[i : len(ids) - n + 1 + i] + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key

    def choose_seeds(self, counts: np.ndarray, words: int, docs: int) -> None:
        """Pick the seeds, given the count of each word of the vocabulary over
        ``words`` words in ``docs`` documents."""
        share = np.log(np.maximum(counts, 1) / max(words, 1))
        places = sum(len(ids) for _, ids in self.items)
        limit = np.log(CHANCE / max(places, 1)) - np.log(max(words, 1) / max(docs, 1))
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, ids) in enumerate(self.items):
            lengths = [n for n in range(SHORTEST, LONGEST + 1) if n <= len(ids)] or [len(ids)]
            keys = {n: self.keys(ids, n) for n in lengths}
            any_seed = False
            for at in range(len(ids)):
                for n in lengths:
                    if at + n <= len(ids) and share[ids[at : at + n]].sum() <= limit:
                        found[n][int(keys[n][at])].append((k, at))
                        any_seed = True
                        break
            if not any_seed:  # common words only: its longest n-grams, all of them
                n = lengths[-1]
                for at in range(len(ids) - n + 1):
                    found[n][int(keys[n][at])].append((k, at))
        for n, by_key in found.items():
            order = sorted(by_key)
            self.seeds[n] = (np.array(order, dtype=np.uint64), [by_key[x] for x in order])

    def hits(self, text: str | None, least: float) -> list[tuple[int | None, float, int, int]]:
        """(item_id, score, first word, word after the last) of the items that
        the text holds, one each."""
        ids = self.numbers(text)
        near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        known = ids >= 0
        for n, (keys, places) in self.seeds.items():
            if len(ids) < n:
                continue
            full = known[: len(ids) - n + 1].copy()
            for i in range(1, n):
                full &= known[i : len(ids) - n + 1 + i]
            at = np.flatnonzero(full)
            if not len(at):
                continue
            mine = np.zeros(len(at), dtype=np.uint64)
            for i in range(n):
                mine = (mine ^ (ids[at + i] + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                mine ^= mine >> np.uint64(29)
            i = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            for hit in np.flatnonzero(keys[i] == mine):
                for k, place in places[i[hit]]:
                    m = len(self.items[k][1])
                    start = int(at[hit]) - place
                    near[k].append((start - m // 2 - 2, start + m + m // 2 + 2))
        out = []
        for k, spans in sorted(near.items()):
            item_id, item = self.items[k]
            best = (0.0, 0, 0)
            for low, high in _merged(spans, len(ids)):
                score, a, b = align(item, ids[low:high])
                if score > best[0]:
                    best = (score, low + a, low + b)
            if best[0] >= least:
                out.append((item_id, *best))
        return out


def _merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        low, high = max(low, 0), min(high, n)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score (1 for a full copy) and its span in the text.

    Rows are item words; within a row gaps are a running maximum, so each row
    takes a few array operations.  Starts travel with the scores: a cell is
    score * 2^32 + (2^32 - 1 - start), and the larger one wins.
    """
    n, unit = len(text), 1 << 32
    if not n or not len(item):
        return 0.0, 0, 0
    fresh = np.arange(n, -1, -1, dtype=np.int64) + (unit - 1 - n)  # score 0, starting here
    steps = np.arange(n + 1, dtype=np.int64) * (GAP * unit)
    above, best = fresh.copy(), (0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(text == word, MATCH * unit, -MISMATCH * unit)
        row = np.maximum(above - GAP * unit, fresh)
        row[1:] = np.maximum(row[1:], diagonal)
        row = np.maximum.accumulate(row + steps) - steps
        above = np.maximum(row, fresh)
        end = int(above.argmax())
        value = int(above[end])
        if value // unit > best[0]:
            best = (value // unit, unit - 1 - value % unit, end)
    return best[0] / (MATCH * len(item)), best[1], best[2]


_HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_COUNTS = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])


def _texts(batch: pd.DataFrame, column: str) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in batch[column]]


def count_words(docs: DataFrame, items: DataFrame, text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(word, n) over all documents for the words of the items; the number of all
    words; of documents.  Up to ``SENT_WORDS`` words are sent to the tasks, which
    then count no others; of a larger benchmark the tasks count every word of a
    batch, and the join picks."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = {w for t in _texts(batch, "text") for w in words_of(t)}
            yield pd.DataFrame({"word": list(words)})

    used = staged(items.select("text").mapInPandas(split, "word binary").distinct(), "benchmark-words")
    few = used.limit(SENT_WORDS + 1).count() <= SENT_WORDS
    sent = docs.sparkSession.sparkContext.broadcast({bytes(r["word"]) for r in used.collect()} if few else None)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            counts, total = Counter(), 0
            for text in _texts(batch, "text"):
                words = words_of(text)
                total += len(words)
                counts.update(words if known is None else [w for w in words if w in known])
            # The empty word and a space stand for all words and for documents.
            yield pd.DataFrame({"word": [*counts, b"", b" "], "n": [*counts.values(), total, len(batch)]})

    found = staged(docs.select(F.col(text_col).alias("text")).mapInPandas(count, _COUNTS).groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    sums = {bytes(r["word"]): r["n"] for r in found.where(F.hex("word").isin("", "20")).collect()}
    return found.join(used, "word", "left_semi"), sums.get(b"", 0), sums.get(b" ", 0)


def blocks_of(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, text_col: str = "text") -> Iterator[tuple[Block, bool]]:
    """(block with its seeds, whether it is the only one): the benchmark in blocks
    of bounded size, by a hash of the item's id."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if not chars:
        return
    n = max(1, -(-chars // max(block_chars // 2, 1))) if chars > block_chars else 1
    counts, words, rows = count_words(docs, items, text_col)
    for i in range(n):
        block = Block(sorted(tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()))
        if block.items:
            own = docs.sparkSession.createDataFrame([(bytearray(w),) for w in block.vocabulary], "word binary")
            by = {bytes(r["word"]): r["n"] for r in counts.join(own, "word", "left_semi").collect()}  # at most the block's words
            block.choose_seeds(np.array([by.get(w, 0) for w in block.vocabulary], dtype=np.int64), words, rows)
            yield block, n == 1


def _hits(docs: DataFrame, key: str, text_col: str, block: Block, least: float) -> DataFrame:
    """(key, item_id, score, start, end) of each item of a block in each text."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = sent.value
        for batch in batches:
            found = [(i, *h) for i, t in enumerate(_texts(batch, "text")) for h in here.hits(t, least)]
            out = pd.DataFrame([f[1:] for f in found], columns=_HIT.names)
            out.insert(0, "key", batch["key"].iloc[[f[0] for f in found]].to_numpy())
            yield out
        give_back()

    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _HIT)
    return docs.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInPandas(run, f"key {kind}, {rest}")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str, text_col: str = "text", least: float = MIN_SCORE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item_id, score, start, end), in words, for each row of ``docs`` and
    item that aligns to its text with a score of ``least`` or more."""
    found = []
    for block, only in blocks_of(docs, benchmark, block_chars, text_col):
        hits = _hits(docs, key, text_col, block, least)
        found.append(hits if only else staged(hits, "leaks"))
    kind = docs.schema[key].dataType.simpleString()
    empty = docs.sparkSession.createDataFrame([], f"key {kind}, item_id long, score double, start long, end long")
    return reduce(DataFrame.unionByName, found) if found else empty


def mark_leaks(docs: DataFrame, benchmark: DataFrame, least: float = MIN_SCORE, block_chars: int = BLOCK_CHARS, out: str = "leaks") -> DataFrame:
    """``docs`` with array column ``out`` of (item_id, score, start, end), in
    words, for each item that aligns to the text with a score of ``least`` or
    more.  Rows and columns are kept (where a column has that name, the new one
    has underscores before it); null or empty texts and items, and items with a
    null id, match nothing.

    Rows are numbered in a written table; only those that hold an item come with
    their number to the join.
    """
    row, out = free_name(docs, "_row"), free_name(docs, out)
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    by_row = leaks(numbered, benchmark, row, "text", least, block_chars).groupBy(F.col("key").alias(row)).agg(F.sort_array(F.collect_list(F.struct(*_HIT.names))).alias(out))
    return numbered.join(by_row, row, "left").withColumn(out, F.coalesce(out, F.array().cast(T.ArrayType(_HIT)))).select(*docs.columns, out)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """One row per document row and item that it holds: doc_id, item_id, score,
    start, end.  Ties between places of an item go to the first; an empty table
    on either side gives an empty result; columns other than doc_id and text are
    not read."""
    return leaks(docs.select("doc_id", "text"), benchmark, "doc_id", "text", least).withColumnRenamed("key", "doc_id")
