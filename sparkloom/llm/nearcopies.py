"""Near-copies of a similarity of 0.8 or more, by fingerprints and MinHash.

Two texts are near-copies if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more.  Candidates come from two searches: the anchor-point
covering of ``simhash`` over the fingerprints of the sets, and MinHash, as three
of 64 bits reach nearly equal texts only (at a similarity of 0.8 a bit differs
with probability 0.15, so 10 of 64 on average).  MinHash candidates are texts
whose ``BANDS`` by ``ROWS`` values agree in all rows of a band; a pair of
similarity 0.8 is missed with probability (1 - 0.8^5)^40, 1.3e-7, and the more
alike the less.  Every candidate is then decided by its whole sets, so no pair
below 0.8 is linked.

Texts of equal sets are merged first.  Then each bucket's members are compared
with its head, the member that meets most others, and the links found are
contracted.  Members of buckets that are still in different components are joined
by the prefixes of their sets, which misses no link between them.  A large group
of near-copies thus costs about its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest, xxh128_digest

from sparkloom.llm.common import dealt, free_name, picked, staged
from sparkloom.llm.simhash import components, firsts, head_links

SHINGLE_WORDS = 5
LEAST_PERCENT = 80
BANDS, ROWS = 40, 5
SEED = 42
_BLOCK = 1024
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_OFFSETS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted different hashes of the runs of five words of a whole text, with
    words as in ``simhash.fingerprint``; a shorter text is one run, and null or
    no words have none."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    n = max(1, len(w) - SHINGLE_WORDS + 1) if w else 0
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(w[i : i + SHINGLE_WORDS]), SEED) for i in range(n)), dtype="<u8", count=n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; sets without shingles have no bands."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    low = np.full(BANDS * ROWS, (1 << 32) - 1, dtype=np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), _BLOCK):
        np.minimum(low, (short[at : at + _BLOCK, None] * _FACTORS + _OFFSETS).min(axis=0), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles as a signed long; of none: zero."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


_SKETCH = T.StructType([T.StructField("same", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


@F.pandas_udf(_SKETCH)
def _sketch(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in texts]
    return pd.DataFrame({"same": [xxh128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets], "fp": [fingerprint(s) for s in sets], "bands": [bands(s) for s in sets]})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts])


def _sizes_allow(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * LEAST_PERCENT


def _verified(pairs: DataFrame, marked: DataFrame, row: str, text_col: str) -> DataFrame:
    """Those of the pairs (a, b) of row numbers whose sets are similar."""
    ends = pairs.select(F.col("a").alias(row)).unionByName(pairs.select(F.col("b").alias(row)))
    sets = staged(picked(marked.select(row, text_col), row, ends).select(row, _shingles(F.col(text_col)).alias("set")), "sets")
    both = pairs.join(dealt(sets.toDF("a", "x")), "a").join(dealt(sets.toDF("b", "y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("shared", shared).where(F.col("shared") * 100 >= (F.size("x") + F.size("y") - F.col("shared")) * LEAST_PERCENT).select("a", "b")


def _links(marked: DataFrame, sets: DataFrame, row: str, text_col: str) -> DataFrame:
    """Pairs (a, b) of row numbers that span the components of near-copies;
    ``sets`` has (row, n, fp, bands), one row a different set."""
    buckets = staged(sets.select("row", "n", F.explode("bands").alias("bucket")), "buckets")
    # Written tables on both sides of a join: Spark splits a hot key's rows.
    sizes = staged(buckets.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1"), "sizes")
    shared = staged(buckets.join(dealt(sizes), "bucket"), "shared")
    # A bucket's head is its member that meets most others: of copies of one text, that text.
    met = staged(shared.groupBy("row").agg(F.sum("held").alias("met")), "met")
    heads = shared.join(dealt(met), "row").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("row")).alias("order"), "n")).alias("h"))
    heads = staged(heads.select("bucket", (-F.col("h.order")).alias("a"), F.col("h.n").alias("na")), "heads")
    first = shared.join(dealt(heads), "bucket").where((F.col("row") != F.col("a")) & _sizes_allow(F.col("n"), F.col("na")))
    first = first.select(F.least("a", "row").alias("a"), F.greatest("a", "row").alias("b"))
    # Of sets with one fingerprint the first is compared with the others and, for
    # them all, with the heads of the anchors that it meets.
    alike = staged(sets.groupBy("fp").agg(F.min(F.struct("row", "n")).alias("name")), "alike")
    same = sets.join(dealt(alike), "fp").where((F.col("row") > F.col("name.row")) & _sizes_allow(F.col("n"), F.col("name.n")))
    near = head_links(alike, name="name").where(_sizes_allow(F.col("a.n"), F.col("b.n")))
    prints = same.select(F.col("name.row").alias("a"), F.col("row").alias("b")).unionByName(near.select("a.row", "b.row").toDF("a", "b"))
    first = staged(first.unionByName(prints).distinct(), "pairs")
    found = staged(_verified(first, marked, row, text_col), "links")
    named = staged(shared.join(dealt(components(found)), F.col("row") == F.col("vertex"), "left").select("row", "n", "bucket", F.coalesce("root", "row").alias("root")), "named")
    mixed = staged(named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket"), "mixed")
    left = staged(named.join(dealt(mixed), "bucket", "left_semi").select("row", "n", "root").distinct(), "left")
    rest = staged(_prefixed(marked, left, row, text_col).join(dealt(first), ["a", "b"], "left_anti"), "pairs")
    return found.unionByName(_verified(rest, marked, row, text_col))


def _prefixed(marked: DataFrame, left: DataFrame, row: str, text_col: str) -> DataFrame:
    """Candidate pairs (a, b) among the rows ``left`` (row, n, root) whose roots
    differ; no pair of similar sets with different roots is missing.

    Each set is put in one order for all, rare shingles first.  Two similar sets
    of n and m shingles share at least 4 / 9 (n + m), so their first shared one
    stands among the first n / 5 + 1 of the larger and n / 9 + 1 of the smaller,
    and after it enough must be left in both.  An edit brings shingles that no
    other text has, and these come first: edited copies drop out by themselves.
    """
    left = left.select(F.col("row").alias(row), "n", "root")
    own = picked(marked.select(row, text_col), row, left.select(row)).join(dealt(left), row).select(F.col(row).alias("row"), "n", "root", F.explode(_shingles(F.col(text_col))).alias("token"))
    own = staged(own, "tokens")
    seen = staged(own.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "seen")
    ranked = own.join(dealt(seen), "token", "left").withColumn("at", F.row_number().over(Window.partitionBy("row").orderBy(F.coalesce("df", F.lit(1)), "token")))
    reach = F.floor(F.col("n") / 5) + 1
    heads = staged(ranked.where(F.col("df").isNotNull() & (F.col("at") <= reach)).select("row", "n", "root", "token", "at"), "prefixes")
    x = heads.select(*[F.col(c).alias(f"{c}_x") for c in ("row", "n", "root", "at")], "token")
    y = heads.where(F.col("at") <= F.floor(F.col("n") / 9) + 1).select(*[F.col(c).alias(f"{c}_y") for c in ("row", "n", "root", "at")], "token")
    larger = F.struct("n_x", "row_x") > F.struct(F.col("n_y").alias("n_x"), F.col("row_y").alias("row_x"))
    enough = (1 + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))) * 9 >= (F.col("n_x") + F.col("n_y")) * 4
    met = x.join(dealt(y), "token").where((F.col("root_x") != F.col("root_y")) & larger & enough & _sizes_allow(F.col("n_x"), F.col("n_y")))
    return met.select(F.least("row_x", "row_y").alias("a"), F.greatest("row_x", "row_y").alias("b")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near-copies: that of the least
    id (null ids first), of repeated ids any one.  Columns are kept.

    Texts without words (null ones too) equal each other.  An empty table stays
    empty.  Rows are numbered and sketched once, in a written table.
    """
    sketch, row = free_name(docs, "_sketch"), free_name(docs, "_row")
    marked = staged(docs.withColumns({sketch: _sketch(F.col(text_col)), row: F.monotonically_increasing_id()}), "marked")
    least = F.min(F.struct(F.col(id_col).alias("id"), F.col(row).alias("row"))).alias("name")
    groups = staged(marked.groupBy(F.col(sketch)["same"].alias("same")).agg(least), "groups")
    numbered = groups.select("name", F.col("name.row").alias("row"))
    sets = marked.select(F.col(row).alias("row"), *(F.col(sketch)[c].alias(c) for c in ("n", "fp", "bands")))
    sets = picked(sets, "row", numbered.select("row"))
    found = staged(_links(marked, staged(sets, "different"), row, text_col), "links")
    # Links by name, so that the least id of a component is its root.
    by_name = found.join(dealt(numbered.toDF("x", "a")), "a").join(dealt(numbered.toDF("y", "b")), "b")
    stay = firsts(numbered, components(by_name.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))))
    return picked(marked, row, stay.withColumnRenamed("row", row)).select(*docs.columns)
