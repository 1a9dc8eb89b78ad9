"""Packing by shortest-pack-first over the length histogram.

Each document is encoded once, whole, and cut into pieces of the sequence length
and a rest.  The encoding tasks also count their pieces: a piece knows its task
and its rank among that task's pieces of equal length, so its rank over all is
that plus a prefix sum over (length, task) counts; no window ever sees the rows
of a length.  Only the histogram, at most 1,024 numbers whatever the corpus,
reaches the driver.  Patterns are made there: lengths are placed longest first,
each into the pack with most room that fits it, several packs at a time.  A join
by length and rank range brings the patterns back to the pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import give_back, staged
from sparkloom.llm.tokens import TOKENIZER_FILE, encoder

SEQUENCE_TOKENS = 1024
END_ID = 0
SENT_SLOTS = 500_000

_PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "task_rank")]
    + [T.StructField("ids", T.BinaryType())]
)


def cut_pieces(docs: DataFrame, tokenizer: str = TOKENIZER_FILE, end_id: int = END_ID, size: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of the whole encoded texts: every id, the end id included, is in
    exactly one.  ``ids`` (little-endian unsigned 32-bit) is null unless asked for.
    """
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, ranks = TaskContext.get().partitionId(), Counter()
        encode = encoder(tokenizer).encode_many
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch["doc_id"], encode([t if isinstance(t, str) else None for t in batch["text"]]), strict=True):
                raw += end
                total = len(raw) // 4
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                for start in range(0, total, size):
                    ids = raw[4 * start : 4 * (start + size)]
                    length = len(ids) // 4
                    rows.append((doc_id, start, length, zlib.crc32(ids), total, task, ranks[length], ids if with_ids else None))
                    ranks[length] += 1
            out = pd.DataFrame(rows, columns=_PIECES.names)
            yield out.astype({"doc_id": "Int64"})
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(cut, _PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE_TOKENS) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) patterns that place every length of the histogram.

    Lengths go longest first into the open pattern with most room, if they fit,
    else into new packs, which take more of the same length while it fits (a
    new pack has most room then).  Placing n of a length into a pattern of c
    packs splits off min(n, c) of them, so the work depends on the number of
    different lengths and not on their counts.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"lengths are 1 to {size}, not {length}")
        while left:
            room = max((r for r, packs in open_packs.items() if packs), default=-1)
            if room < length:
                # New packs, each with as many of this length as it holds.
                fit = size // length
                for packs, pieces in ((left // fit, fit), (1, left % fit)):
                    if packs and pieces:
                        open_packs[size - pieces * length].append((packs, (length,) * pieces))
                break
            count, lengths = open_packs[room].pop()
            taken = min(count, left)
            open_packs[room - length].append((taken, (*lengths, length)))
            if count > taken:
                open_packs[room].append((count - taken, lengths))
            left -= taken
    return [pack for room in sorted(open_packs) for pack in open_packs[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) for each place of each
    pattern: the pieces of that length with those ranks stand there, one in each
    of the pattern's sequences."""
    ranks, out, sequence = Counter(), [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            out.append((length, ranks[length], count, sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str = TOKENIZER_FILE, end_id: int = END_ID, size: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pack the whole table into sequences of at most ``size`` tokens.

    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id
    and offset (and ids).  A null or empty text is its end id alone; repeated
    rows are packed as often as they occur, with null ids kept; an empty table
    gives an empty result.  Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    pieces = staged(cut_pieces(docs, tokenizer, end_id, size, with_ids), "pieces")
    counts = staged(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("length", "task", before.alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("task_rank"))
    found = slots(shortest_pack_first(histogram, size))
    places = spark.createDataFrame(found, "of long, low long, n long, first long, offset long")
    # Slots grow with the different lengths, not with the documents; up to a bound they are sent out.
    places = F.broadcast(places) if len(found) <= SENT_SLOTS else places
    placed = ranked.join(places, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("n")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"]
    return placed.select(*columns, *(["ids"] if with_ids else []))
