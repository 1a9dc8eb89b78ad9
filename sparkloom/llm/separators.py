"""Token counts of documents in flat, unindexed token files.

A flat file is nothing but 16-bit big-endian ids, with an end-of-document id
after each document.  The end id's two bytes spell one character in UTF-8, so
Spark's own text writer makes the files (the character is its line separator)
and its text reader parts them, at any size and in any store, into splits that
begin and end with a whole pair of these bytes.

What a task reads is joined to blocks again and searched by one vectorised
comparison a block.  A pair found may be no separator but the halves of two ids:
that depends on whether the block begins at an even byte of the file, which no
task knows.  So a block reports its pairs by parity, with the last one of each
parity, and a prefix scan over one row a block settles the rest: a running sum of
lengths gives each block's first byte and so its parity, a running maximum of
the last separators tells where the document began that a block's first
separator ends, and running sums number the documents.  The ids of the documents
go to twin files in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import give_back, new_place, staged
from sparkloom.llm.tokens import TOKENIZER_FILE, encoder

#: 0xC580, the bytes of one character in UTF-8, and above every id of the file.
END_ID = 50560
BLOCK_IDS = 1 << 20
_SLICE_BYTES = 4_000_000


def _separator(end_id: int) -> str:
    """The character that an end id spells: ids from 0xC280 to 0xDFBF whose low
    byte is one of 0x80 to 0xBF.  Others can't end documents of flat files."""
    try:
        mark = end_id.to_bytes(2, "big").decode("utf-8")
    except (OverflowError, UnicodeDecodeError):
        mark = ""
    if len(mark) != 1:
        raise ValueError("the end id's two bytes must be one character in UTF-8")
    return mark


def write_flat(docs: DataFrame, place: str, tokenizer: str = TOKENIZER_FILE) -> None:
    """Encode whole texts and write ``place``/kind=tokens (flat files) and
    ``place``/kind=ids (the doc_id of each document, in the same order).  Null
    texts are empty documents.  Nothing is shuffled."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, many = 0, encoder(tokenizer).encode_many

        def out(names: list[bytes], ids: list[bytes]) -> Iterator[pd.DataFrame]:
            places = range(place - len(names), place)
            yield pd.DataFrame({"kind": "ids", "place": places, "value": names})
            yield pd.DataFrame({"kind": "tokens", "place": places, "value": ids})

        for batch in batches:
            names, ids, held = [], [], 0
            for d, raw in zip(batch["doc_id"], many([t if isinstance(t, str) else None for t in batch["text"]]), strict=True):
                own = np.frombuffer(raw, "<u4")
                if len(own) and own.max() >= END_ID:
                    raise ValueError("an id of the tokenizer does not fit below the end id")
                names.append(b"" if pd.isna(d) else str(int(d)).encode())
                ids.append(own.astype(">u2").tobytes())
                held += len(ids[-1])
                place += 1
                if held >= _SLICE_BYTES:
                    yield from out(names, ids)
                    names, ids, held = [], [], 0
            if names:
                yield from out(names, ids)
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = rows.mapInPandas(encode, "kind string, place long, value binary").sortWithinPartitions("kind", "place")
    coded.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("lineSep", _separator(END_ID)).text(place)


def _pieces(spark: SparkSession, place: str, end_id: int) -> DataFrame:
    """What stands between the pairs of bytes, in order within each split."""
    lines = spark.read.option("lineSep", _separator(end_id)).text(place)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"))


def _splits(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[tuple, int, list[bytes]]]:
    """((file, split, size), block number, values): a split's values in blocks of
    about ``most`` bytes."""
    key, block, held, size = None, 0, [], 0
    for batch in batches:
        new = (batch["file"] != batch["file"].shift()) | (batch["split"] != batch["split"].shift())
        at = [*np.flatnonzero(new.to_numpy()).tolist(), len(batch)]
        values = batch["value"].tolist()
        for low, high in zip(at, at[1:], strict=False):
            here = (batch["file"].iloc[low], int(batch["split"].iloc[low]), int(batch["size"].iloc[low]))
            if here != key:
                if held:
                    yield key, block, held
                key, block, held, size = here, 0, [], 0
            for value in values[low:high]:
                held.append(value)
                size += len(value) + 2
                if size >= most:
                    yield key, block, held
                    block, held, size = block + 1, [], 0
    if held:
        yield key, block, held


_BLOCK = T.StructType(
    [T.StructField("file", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("split", "size", "block", "bytes", "last0", "last1", "n0", "n1", "parity", "k", "end", "start")]
)


def scan_flat(spark: SparkSession, place: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Documents of the flat files under ``place``: file (its name), place (from
    0, in the file), start (ids before it in the file) and n_tokens (without the
    end id).  Ids after a file's last separator are a last document.  Files may
    have any size; empty files hold none, and a half id at a file's end is an
    error.
    """
    mark = _separator(end_id).encode()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, split, size), block, values in _splits(batches, 2 * block_ids):
            raw = np.frombuffer(mark.join([*values, b""]), np.uint8)
            pairs = np.flatnonzero((raw[:-1] == mark[0]) & (raw[1:] == mark[1]))
            same = {"file": file, "split": split, "size": size, "block": block, "bytes": len(raw)}
            rows, last = [], []
            for parity in (0, 1):
                at = pairs[pairs % 2 == parity]
                last.append((int(at[-1]) if len(at) else -1, len(at)))
                if len(at):
                    starts = pd.array([None, *(at[:-1] + 2)], dtype="Int64")
                    rows.append(pd.DataFrame(same | {"parity": parity, "k": range(len(at)), "end": at, "start": starts}))
            same |= {"last0": last[0][0], "last1": last[1][0], "n0": last[0][1], "n1": last[1][1]}
            rows = [r.assign(last0=-1, last1=-1, n0=0, n1=0) for r in rows]
            yield pd.concat([pd.DataFrame([same | {"parity": -1, "k": -1, "end": -1}]).assign(start=pd.array([None], dtype="Int64")), *rows])

    found = staged(_pieces(spark, place, end_id).mapInPandas(search, _BLOCK), "separators")
    order = Window.partitionBy("file").orderBy("split", "block")
    earlier, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    # The reader leaves out a byte order mark at a file's start, 3 bytes that
    # hold no separator: files then come out shorter than they are.
    skipped = F.when(F.sum("bytes").over(whole) < F.col("size"), 3).otherwise(0)
    checked = F.when(F.col("size") % 2 == 0, F.coalesce(F.sum("bytes").over(earlier), F.lit(0)) + skipped).otherwise(F.raise_error(F.lit("half an id at the end of a flat file")).cast("long"))
    based = found.where("k = -1").withColumn("base", checked).withColumn("even", F.col("base") % 2)
    last, n = (F.when(F.col("even") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")) for c in ("last", "n"))
    based = based.withColumns({"n": n, "stop": F.when(last >= 0, F.col("base") + last)})
    carry = based.select(
        "file",
        "split",
        "block",
        "base",
        "even",
        F.coalesce(F.max("stop").over(earlier) + 2, F.lit(0)).alias("open"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
    )
    docs = found.where("k >= 0").join(carry, ["file", "split", "block"]).where("parity = even")
    start = F.coalesce(F.col("base") + F.col("start"), "open")
    return docs.select("file", (F.col("before") + F.col("k")).alias("place"), (start / 2).cast("long").alias("start"), ((F.col("base") + F.col("end") - start) / 2).cast("long").alias("n_tokens"))


def document_names(spark: SparkSession, place: str) -> DataFrame:
    """file, place and doc_id from the twin files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, split, _), block, names in _splits(batches, 2 * BLOCK_IDS):
            ids = pd.array([int(n) if n else None for n in names], dtype="Int64")
            yield pd.DataFrame({"file": file, "split": split, "block": block, "k": range(len(names)), "doc_id": ids})

    found = staged(_pieces(spark, place, END_ID).mapInPandas(read, "file string, split long, block long, k long, doc_id long"), "names")
    sizes = found.groupBy("file", "split", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("split", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", "split", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return found.join(bases, ["file", "split", "block"]).select("file", (F.col("base") + F.col("k")).alias("place"), "doc_id")


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """Write the table as flat files, search them, and return per document:
    doc_id, n_tokens (without the end id), file and start (ids before it there).

    One row per row of ``docs``, repeated ones too; null ids stay null; null or
    empty texts have 0 tokens; an empty table gives an empty result.  Columns
    other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    place = new_place(spark, "flat")
    write_flat(docs, place, tokenizer)
    if docs.select("doc_id").isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long, file string, start long")
    counts = scan_flat(spark, f"{place}/kind=tokens")
    names = document_names(spark, f"{place}/kind=ids")
    return counts.join(names, ["file", "place"]).select("doc_id", "n_tokens", "file", "start")
