"""Token ids as wavelet matrices: one compressed, queryable file per shard.

A shard holds the ids of consecutive documents.  Its different ids are numbered
in order (the alphabet), and each bit of these numbers, highest first, becomes a
plane: the bits of all tokens, after the tokens have been parted stably by the
plane above (zeros first).  A plane is stored in chunks of ``CHUNK`` bits, each a
zstd frame of its own, with the count of ones before each chunk.  So ``rank``
opens one chunk, ``select`` finds its chunk by binary search, and access, counting
and locating an id take one step per plane and never unpack the shard.

Layout, all little-endian: magic, then sections, each a 64-bit length and its
bytes: header (tokens, documents, alphabet size, planes), and as zstd frames
document ids, null marks, document lengths, alphabet, zeros per plane, ones
before each chunk and places of the chunks; then the chunks, plane after plane.

Files are rows of a Parquet dataset, written and read by Spark alone: any store
will do, and a lost executor leaves no half-written file behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import give_back, new_place
from sparkloom.llm.tokens import TOKENIZER_FILE, encoder

MAGIC = b"WVM2"
END_ID = 2
SHARD_TOKENS = 1 << 20
CHUNK = 1 << 15


class Plane:
    """Bits in chunks, opened one at a time, and the ones before each chunk."""

    def __init__(self, bits: np.ndarray | None, ones: np.ndarray, frames: list[memoryview] | None = None):
        self._bits, self.ones, self._frames = bits, ones, frames
        self._held: tuple[int, np.ndarray] | None = None

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        counts = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), CHUNK // 8), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        return cls(bits, np.concatenate([[0], np.cumsum(counts)]))

    def chunk(self, i: int) -> np.ndarray:
        if self._frames is None:
            return self._bits[i * CHUNK // 8 : (i + 1) * CHUNK // 8]
        if self._held is None or self._held[0] != i:
            self._held = (i, np.frombuffer(zstandard.ZstdDecompressor().decompress(self._frames[i]), np.uint8))
        return self._held[1]

    def whole(self) -> np.ndarray:
        chunks = [self.chunk(i) for i in range(len(self.ones) - 1)]
        return np.concatenate(chunks) if chunks else np.zeros(0, np.uint8)

    def bit(self, i: int) -> int:
        return int(self.chunk(i // CHUNK)[i % CHUNK // 8]) >> i % 8 & 1

    def rank1(self, i: int) -> int:
        """Ones among the first i bits."""
        at, rest = divmod(i, CHUNK)
        if not rest:
            return int(self.ones[at])
        part = self.chunk(at)
        count = int(self.ones[at]) + int(np.bitwise_count(part[: rest // 8]).sum(dtype=np.int64))
        return count + ((int(part[rest // 8]) & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else 0)

    def ranks1(self, at: np.ndarray) -> np.ndarray:
        """``rank1`` of many places."""
        bits = np.append(self.whole(), np.uint8(0))
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
        byte = at // 8
        return before[byte] + np.bitwise_count(bits[byte] & ((1 << at % 8) - 1).astype(np.uint8))

    def select(self, one: bool, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0, rising) ones or zeros; opens the chunks
        that hold them."""
        before = self.ones if one else np.arange(len(self.ones)) * CHUNK - self.ones
        chunk = np.searchsorted(before, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        opened, first = np.unique(chunk, return_index=True)
        for c, low, high in zip(opened.tolist(), first, np.append(first[1:], len(k)), strict=True):
            bits = np.unpackbits(self.chunk(c), bitorder="little")
            out[low:high] = c * CHUNK + np.flatnonzero(bits == one)[k[low:high] - before[c]]
        return out


class WaveletMatrix:
    """Succinct sequence of ids with access, rank, select, count and locate."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: np.ndarray, planes: list[Plane]):
        self.n, self.alphabet, self.zeros, self.planes = n, alphabet, zeros, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        if len(ids):
            present = np.zeros(int(ids.max()) + 1, dtype=bool)
            present[ids] = True
            alphabet = np.flatnonzero(present).astype("<u4")
            number = np.cumsum(present, dtype=np.int64) - 1
            row = number[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        else:
            alphabet, row = np.zeros(0, "<u4"), np.zeros(0, np.uint16)
        depth = max(len(alphabet) - 1, 0).bit_length()
        zeros, planes = [], []
        for shift in range(depth - 1, -1, -1):
            ones = (row >> shift) & 1 == 1
            planes.append(Plane.of(np.packbits(ones, bitorder="little")))
            # Places, then take: several times as fast as indexing by a mask.
            below = row.take(np.flatnonzero(~ones))
            zeros.append(len(below))
            row = np.concatenate([below, row.take(np.flatnonzero(ones))])
        return cls(len(ids), alphabet, np.array(zeros, "<i8"), planes)

    def decode(self) -> np.ndarray:
        """All ids in order, undoing one parting after the other."""
        row = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for shift, (z, plane) in enumerate(zip(self.zeros[::-1], self.planes[::-1], strict=True)):
            ones = np.unpackbits(plane.whole(), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(row)
            up[np.flatnonzero(~ones)] = row[:z]
            up[np.flatnonzero(ones)] = row[z:] | row.dtype.type(1 << shift)
            row = up
        return self.alphabet[row] if self.n else np.zeros(0, "<u4")

    def _number(self, token: int) -> int | None:
        i = int(np.searchsorted(self.alphabet, token))
        return i if i < len(self.alphabet) and self.alphabet[i] == token else None

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        number = 0
        for zeros, plane in zip(self.zeros.tolist(), self.planes, strict=True):
            ones, bit = plane.rank1(i), plane.bit(i)
            number = number << 1 | bit
            i = zeros + ones if bit else i - ones
        return int(self.alphabet[number])

    def rank(self, token: int, i: int) -> int:
        """Occurrences of an id among the first i places."""
        low, high = self._range(token, i)
        return high - low

    def _range(self, token: int, i: int) -> tuple[int, int]:
        number, low, high = self._number(token), 0, min(max(i, 0), self.n)
        if number is None:
            return 0, 0
        for level, plane in enumerate(self.planes):
            a, b, zeros = plane.rank1(low), plane.rank1(high), int(self.zeros[level])
            if number >> (len(self.planes) - 1 - level) & 1:
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def ranks(self, token: int, at: np.ndarray) -> np.ndarray:
        """``rank`` of many places at once."""
        number = self._number(token)
        if number is None:
            return np.zeros(len(at), np.int64)
        at = np.append(np.asarray(at, np.int64), 0)  # the last follows the range's start
        for level, plane in enumerate(self.planes):
            ones = plane.ranks1(at)
            at = int(self.zeros[level]) + ones if number >> (len(self.planes) - 1 - level) & 1 else at - ones
        return at[:-1] - at[-1]

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id in the places low to high - 1."""
        return self.rank(token, self.n if high is None else high) - self.rank(token, low)

    def _places(self, token: int, first: int, after: int) -> np.ndarray:
        """Places of the first-th (from 0) to the (after - 1)-th occurrence."""
        low, _ = self._range(token, self.n)
        i, number = np.arange(low + first, low + after), self._number(token)
        for level in range(len(self.planes) - 1, -1, -1):
            one = bool(number >> (len(self.planes) - 1 - level) & 1)
            i = self.planes[level].select(one, i - int(self.zeros[level]) if one else i)
        return i

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        return int(self._places(token, k, k + 1)[0])

    def locate(self, token: int) -> list[int]:
        """All places of an id, in order."""
        n = self.count(token)
        return self._places(token, 0, n).tolist() if n else []


class Shard:
    """Documents of one file: ids (None for null), lengths and their matrix."""

    def __init__(self, doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.lengths, self.matrix = doc_ids, lengths, matrix

    @classmethod
    def build(cls, doc_ids: list[int | None], ids: list[bytes]) -> Shard:
        lengths = np.array([len(x) // 4 for x in ids], dtype="<i8")
        return cls(doc_ids, lengths, WaveletMatrix.build(np.frombuffer(b"".join(ids), dtype="<u4")))

    def to_bytes(self) -> bytes:
        m, press = self.matrix, zstandard.ZstdCompressor(level=1)
        null = np.array([d is None for d in self.doc_ids], dtype=bool)
        chunks = [press.compress(p.chunk(i)) for p in m.planes for i in range(len(p.ones) - 1)]
        parts = [
            np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(),
            np.packbits(null, bitorder="little").tobytes(),
            self.lengths.tobytes(),
            m.alphabet.astype("<u4").tobytes(),
            m.zeros.astype("<i8").tobytes(),
            b"".join(p.ones.astype("<u4").tobytes() for p in m.planes),
            np.cumsum(list(map(len, chunks)), dtype="<u8").tobytes(),
        ]
        header = struct.pack("<4q", m.n, len(self.doc_ids), len(m.alphabet), len(m.planes))
        sections = [header, *map(press.compress, parts), b"".join(chunks)]
        return MAGIC + b"".join(struct.pack("<q", len(x)) + x for x in sections)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        """Open a file: the chunks of the planes stay compressed."""
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        view, parts, at, press = memoryview(data), [], 4, zstandard.ZstdDecompressor()
        while at < len(data):
            (size,) = struct.unpack_from("<q", data, at)
            parts.append(view[at + 8 : at + 8 + size])
            at += 8 + size
        n, docs, _, depth = struct.unpack("<4q", parts[0])
        ids, null, lengths, alphabet, zeros, ones, ends = (press.decompress(p) for p in parts[1:8])
        null = np.unpackbits(np.frombuffer(null, np.uint8), count=docs, bitorder="little").astype(bool)
        chunks = -(-n // CHUNK)
        ones = np.frombuffer(ones, "<u4").astype(np.int64).reshape(depth, chunks + 1)
        ends = [0, *np.frombuffer(ends, "<u8").tolist()]
        frames = [parts[8][a:b] for a, b in zip(ends, ends[1:], strict=False)]
        planes = [Plane(None, ones[k], frames[k * chunks : (k + 1) * chunks]) for k in range(depth)]
        matrix = WaveletMatrix(n, np.frombuffer(alphabet, "<u4"), np.frombuffer(zeros, "<i8"), planes)
        ids = np.frombuffer(ids, "<i8").tolist()
        return cls([None if z else d for d, z in zip(ids, null, strict=True)], np.frombuffer(lengths, "<i8"), matrix)


_FILES = "part long, seq long, n_docs long, n_tokens long, data binary"
_DOCS = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "seq", "place", "doc_id", "local_start", "n_tokens", "ids_crc32", "n_end_ids")])


def write_shards(docs: DataFrame, place: str, tokenizer: str = TOKENIZER_FILE, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode the whole table and write its shards to ``place``.

    Documents are dealt by ranges of doc_id and sorted (null ids first), so
    (part, seq) orders the shards as the documents.  Rows of one id are dealt by
    the partition they come from, too, so a much repeated id fills no single
    task; their order is otherwise by text.  A document is never parted: a shard
    closes with the document that fills it.
    """
    end = end_id.to_bytes(4, "little")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, names, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pd.DataFrame:
            shard = Shard.build(names, held)
            row = (part, seq, len(names), shard.matrix.n, shard.to_bytes())
            return pd.DataFrame([row], columns=["part", "seq", "n_docs", "n_tokens", "data"])

        encode = encoder(tokenizer).encode_many
        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"], encode([t if isinstance(t, str) else None for t in batch["text"]]), strict=True):
                names.append(None if pd.isna(doc_id) else int(doc_id))
                held.append(raw + end)
                size += len(raw) // 4 + 1
                if size >= shard_tokens:
                    yield close()
                    seq, names, held, size = seq + 1, [], [], 0
        if names:
            yield close()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("source"))
    rows = rows.repartitionByRange("doc_id", "source").sortWithinPartitions("doc_id", "source", "text")
    rows.select("doc_id", "text").mapInPandas(build, _FILES).write.parquet(place)


def shard_starts(files: DataFrame) -> DataFrame:
    """(part, seq, base): tokens before each shard.  The prefix sum runs over
    the parts, one number each, and inside each part."""
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("part_base"))
    seqs = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("seq_base"))
    return seqs.join(parts, "part").select("part", "seq", (F.col("part_base") + F.col("seq_base")).alias("base"))


def read_documents(spark: SparkSession, place: str, end_id: int = END_ID) -> DataFrame:
    """Per document of the shards at ``place``: doc_id, start, n_tokens,
    ids_crc32 of its ids as decoded from the planes, n_end_ids (how often the id
    that ends documents stands among them, by rank), and its shard."""
    files = spark.read.schema(_FILES).parquet(place)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, seq, data in zip(batch["part"], batch["seq"], batch["data"], strict=True):
                shard = Shard.from_bytes(data)
                ids, ends = shard.matrix.decode().astype("<u4").tobytes(), np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                out = {"part": part, "seq": seq, "place": range(len(crc)), "doc_id": pd.array(shard.doc_ids, dtype="Int64"), "local_start": starts, "n_tokens": shard.lengths, "ids_crc32": crc}
                ranks = shard.matrix.ranks(end_id, np.append(starts, shard.matrix.n))
                out["n_end_ids"] = np.diff(ranks)
                yield pd.DataFrame(out)

    docs = files.select("part", "seq", "data").mapInPandas(read, _DOCS)
    return docs.join(shard_starts(files), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "n_end_ids", "part", "seq")


def count_ids(spark: SparkSession, place: str, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each asked id in all shards, by rank alone;
    asked twice counts once, and an id that never occurs has 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                matrix = Shard.from_bytes(data).matrix
                yield pd.DataFrame({"token": asked, "n": [matrix.count(t) for t in asked]})

    asked = sorted(set(tokens))
    found = spark.read.schema(_FILES).parquet(place).select("data").mapInPandas(count, "token long, n long")
    zeros = spark.createDataFrame([(t, 0) for t in asked], "token long, n long")
    return found.unionByName(zeros).groupBy("token").agg(F.sum("n").alias("n"))


def locate_ids(spark: SparkSession, place: str, tokens: list[int]) -> DataFrame:
    """(token, doc_id, place): every occurrence of each asked id, with its place
    in the document, by select; only the chunks that lead to one are opened."""

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                shard = Shard.from_bytes(data)
                starts, names = np.cumsum(shard.lengths) - shard.lengths, pd.array(shard.doc_ids, dtype="Int64")
                for t in asked:
                    places = np.array(shard.matrix.locate(t), np.int64)
                    doc = np.searchsorted(starts, places, side="right") - 1
                    yield pd.DataFrame({"token": t, "doc_id": names[doc], "place": places - starts[doc]})

    asked = sorted(set(tokens))
    return spark.read.schema(_FILES).parquet(place).select("data").mapInPandas(locate, "token long, doc_id long, place long")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER_FILE, end_id: int = END_ID) -> DataFrame:
    """Write the shards of a table to the shared folder and read them back.

    One row per row of ``docs``; null or empty texts have the end id alone, an
    empty table gives none; columns other than doc_id and text are not read.
    """
    place = new_place(docs.sparkSession, "wavelet")
    write_shards(docs, place, tokenizer, end_id)
    return read_documents(docs.sparkSession, place, end_id)
