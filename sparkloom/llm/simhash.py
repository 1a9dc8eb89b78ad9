"""Near-duplicates by SimHash and anchor-point covering.

Fingerprints of 64 bits within three differing bits are linked.  By the
pigeonhole principle one of the two halves of a linked pair differs in at most
one bit.  The anchors of a half are the 2^26 code words of the perfect [31, 26]
Hamming code over its low 31 bits (covering radius 1; the top bit is free, so a
half is covered with radius 1 and a distance of at most 1).  A fingerprint has
one *home* anchor per half, the code word within radius 1, and is replicated to
every anchor within radius + distance = 2 of it (at most 16).  A home meets all
replicas of its anchor, hence every linked pair meets; exact comparison of all
64 bits decides.  To find components, all that meet at an anchor are compared with
the least of them first, and only what that leaves apart pair by pair.

Equal fingerprints are merged before anything is replicated, so groups of exact
copies cost one fingerprint, and the rows compared grow with the number of
different fingerprints.  Links name the groups by their least row, in an order
in which the least member of a component is its result: nothing is ever dealt by
component.  Components are found by hooking each vertex to its least neighbour
and contracting the (few) links between what is left; every round is a written
table.  No join sends a side to the driver: all of them grow with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from sparkloom.llm.common import dealt, free_name, staged

MAX_DISTANCE = 3
SHINGLE_WORDS = 3
SEED = 42
_BLOCK = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of a whole text as a signed long; null or no words: zero.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` parts at the six ASCII
    white-space characters, as the definition asks.  Hashes are summed up in
    blocks, so a long text needs no more memory than its words.
    """
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        part = range(at, min(at + _BLOCK, n))
        h = np.fromiter((xxh64_intdigest(b" ".join(w[i : i + shingle]), SEED) for i in part), dtype="<u8", count=len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _bit(i: Column) -> Column:
    """The bit at place ``i`` of 1 to 31; none for 0."""
    return F.when(i == 0, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1), i - 1))


def _syndrome(half: Column) -> Column:
    """Hamming syndrome of the low 31 bits: the place (1 to 31) to flip for the
    next code word, or 0 for a code word."""
    masks = [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]
    places = [F.bit_count(half.bitwiseAND(F.lit(m))) % 2 * (1 << j) for j, m in enumerate(masks)]
    return sum(places[1:], places[0]).cast("int")


def _halves(fp: str) -> Column:
    low = F.lit((1 << 31) - 1)
    whole = F.col(fp)
    return F.array(
        F.struct(F.lit(0).alias("half"), whole.bitwiseAND(low).cast("int").alias("code")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned(whole, 32).bitwiseAND(low).cast("int").alias("code")),
    )


def _anchored(fps: DataFrame, distance: int, *names: str) -> DataFrame:
    """(bits, names, half, anchor, home): each fingerprint at every anchor within
    radius + distance of its halves; ``home`` marks the one within the radius.

    ``fps`` has one row per different fingerprint, in column ``fp``.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the anchors cover distances of 0 to 3")
    coded = fps.select(F.col("fp").alias("bits"), *names, F.inline(_halves("fp"))).withColumn("s", _syndrome(F.col("code")))
    # Code words within 2 of a half: flip i and i xor s, where place 0 flips nothing.
    flips = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: i < i.bitwiseXOR(F.col("s")))
    around = F.when(F.col("s") == 0, F.array(F.col("code"))).otherwise(
        F.transform(flips, lambda i: F.col("code").bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(F.col("s")))))
    )
    home = F.col("code").bitwiseXOR(_bit(F.col("s")))
    return coded.select("bits", *names, "half", home.alias("own"), F.explode(around).alias("anchor")).withColumn("home", F.col("anchor") == F.col("own")).drop("own")


def _near(x: str, y: str, distance: int) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= distance


def links(fps: DataFrame, distance: int = MAX_DISTANCE, name: str = "fp") -> DataFrame:
    """All pairs (a < b) of different fingerprints within ``distance`` (at most
    3), given by their values in column ``name``, one for each fingerprint."""
    named = fps.select("fp", F.col(name).alias("name"))
    at = _anchored(named, distance, "name")
    home = at.where("home").select(F.col("bits").alias("x"), F.col("name").alias("a"), "half", "anchor")
    replicas = at.select(F.col("bits").alias("y"), F.col("name").alias("b"), "half", "anchor")
    return home.join(dealt(replicas), ["half", "anchor"]).where((F.col("a") < F.col("b")) & _near("x", "y", distance)).select("a", "b").distinct()


def head_links(fps: DataFrame, distance: int = MAX_DISTANCE, name: str = "fp") -> DataFrame:
    """The pairs (a < b) of ``links`` in which a is the least of all that meet at
    an anchor: one comparison a replica, however large the group."""
    at = _anchored(fps.select("fp", F.col(name).alias("name")), distance, "name")
    heads = at.groupBy("half", "anchor").agg(F.min(F.struct("name", "bits")).alias("head"), F.count("*").alias("met")).where("met > 1")
    heads = staged(heads.select("half", "anchor", F.col("head.name").alias("a"), F.col("head.bits").alias("x")), "heads")
    return at.join(dealt(heads), ["half", "anchor"]).where((F.col("a") < F.col("name")) & _near("x", "bits", distance)).select("a", F.col("name").alias("b")).distinct()


def spanning_links(fps: DataFrame, distance: int = MAX_DISTANCE, name: str = "fp") -> DataFrame:
    """Pairs of ``links`` that lead to the same components: those with heads, and
    of the others only pairs whose ends the heads have left apart.  So a group of
    near copies gives about as many pairs as it has members, and not their square.
    """
    found = staged(head_links(fps, distance, name), "links")
    roots = components(found)
    named = fps.select("fp", F.col(name).alias("name")).join(dealt(roots), F.col("name") == F.col("vertex"), "left").select("fp", "name", F.coalesce("root", "name").alias("root"))
    at = _anchored(staged(named, "rooted"), distance, "name", "root")
    home = at.where("home").select(F.col("bits").alias("x"), F.col("name").alias("a"), F.col("root").alias("ra"), "half", "anchor")
    replicas = at.select(F.col("bits").alias("y"), F.col("name").alias("b"), F.col("root").alias("rb"), "half", "anchor")
    apart = home.join(dealt(replicas), ["half", "anchor"]).where((F.col("ra") != F.col("rb")) & _near("x", "y", distance))
    rest = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (a, b); root is the same for
    all vertices of a component and for no others.

    Each round hooks every vertex to its least neighbour, follows the hooks
    twice, and contracts the links; every round is written to the shared folder.
    Vertices without links left drop out of a round.
    """
    edges = staged(edges.select("a", "b"), "links")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.col("vertex"), F.min("b")).alias("up"))
        hooks = staged(hooks, "hooks")
        above = hooks.select(F.col("vertex").alias("up"), F.col("up").alias("top"))
        hooks = hooks.join(dealt(above), "up").select("vertex", F.col("top").alias("up"))
        hooks = staged(hooks, "hooks")
        if labels is None:
            labels = hooks.select("vertex", F.col("up").alias("root"))
        else:
            moved = hooks.select(F.col("vertex").alias("root"), "up")
            labels = labels.join(dealt(moved), "root", "left").select("vertex", F.coalesce("up", "root").alias("root"))
        labels = staged(labels, "labels")
        a, b = (hooks.select(F.col("vertex").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        edges = (
            edges.join(dealt(a), "a")
            .join(dealt(b), "b")
            .where(F.col("a_up") != F.col("b_up"))
            .select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
            .distinct()
        )
        edges = staged(edges, "links")
        if edges.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 lowercase hex digits) and
    component_id, the least id reachable over links (the row's own included).

    Null or blank texts have fingerprint zero and are linked like any other.
    Repeated rows stay repeated; a null id keeps its row and takes no part in
    the least ids (a component of null ids alone has a null component_id).  An
    empty table gives an empty result.  Other columns are neither read nor kept.
    """
    marked = docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col)).alias("fp"))
    marked = staged(marked, "fingerprints")
    groups = marked.groupBy("fp").agg(F.min("id").alias("least"))
    # In order: known least ids first, then groups of null ids alone.
    groups = staged(groups.select("fp", F.struct(F.col("least").isNull().alias("none"), "least", "fp").alias("name")), "groups")
    roots = components(spanning_links(groups, distance, "name"))
    named = groups.join(dealt(roots), groups.name == roots.vertex, "left").select("fp", F.coalesce("root", "name").getField("least").alias("component_id"))
    return marked.join(dealt(named), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the least
    id (null ids first), of repeated ids any one.  Columns are kept.

    Rows are numbered and fingerprinted once, in a written table, so the rows
    that stay are found by number and only they meet their texts again.
    """
    fp, row = free_name(docs, "_fp"), free_name(docs, "_row")
    marked = staged(docs.withColumns({fp: fingerprints(F.col(text_col)), row: F.monotonically_increasing_id()}), "marked")
    least = F.min(F.struct(F.col(id_col).alias("id"), F.col(row).alias("row"))).alias("name")
    groups = staged(marked.groupBy(F.col(fp).alias("fp")).agg(least), "groups")
    stay = firsts(groups, components(spanning_links(groups, distance, "name")))
    return marked.join(dealt(stay.withColumnRenamed("row", row)), row, "left_semi").select(*docs.columns)


def firsts(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (``name.row``) of the groups that are in no component or its root."""
    linked = groups.join(dealt(roots), groups.name == roots.vertex, "left")
    return linked.where("root is null or root = name").select("name.row")
