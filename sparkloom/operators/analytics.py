"""Communities, PageRank, boundary degree and spine files."""

from __future__ import annotations

import random
from collections import defaultdict, deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import label_segments
from sparkloom.operators.graph import numbered
from sparkloom.sources.shared import staged, tasks_for

#: Above this many edges a graph is contracted, distributed, before Leiden runs.
LOCAL_EDGES = 1_000_000
#: Links of a large graph that one task joins or groups.
LINKS_A_TASK = 2_000_000


def _counted(links: DataFrame, tasks: int | None) -> tuple[DataFrame, int]:
    """Links, and the parts to deal them to; where none are given they are written
    and counted."""
    if tasks is None:
        links = staged(links, "links")
        tasks = tasks_for(links.sparkSession, links.count(), LINKS_A_TASK)
    return links, tasks


def undirected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge between nodes, in both directions; parallel edges stay."""
    ids = nodes.select("id")
    held = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    return held.unionByName(held.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def pagerank(nodes: DataFrame, links: DataFrame, iterations: int = 20, damping: float = 0.85, tolerance: float = 1e-7, every: int = 5, tasks: int | None = None) -> DataFrame:
    """(id, pagerank) by (1 - d) + d * sum(rank / degree), unnormalised, over
    directed ``links``.  Every few rounds the ranks are written, which cuts the
    lineage and tests for convergence.  Links and ranks are dealt to ``tasks`` parts
    (see ``boundary_degree``), links once for all rounds that follow each other."""
    links, tasks = _counted(links, tasks)
    ids = nodes.select("id").repartition(tasks, "id").distinct()
    links = links.select("src", "dst").repartition(tasks, "src")
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    weighted = staged(links.join(degree, "src").groupBy("src", "dst").agg((F.count("*") / F.first("degree")).alias("w")), "links").repartition(tasks, "src")
    ranks = ids.withColumn("pagerank", F.lit(1.0 - damping))
    mark = None
    for i in range(1, iterations + 1):
        given = weighted.join(ranks.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("pagerank") * F.col("w")).alias("s"))
        sums = given.repartition(tasks, "id").groupBy("id").agg(F.sum("s").alias("s"))
        ranks = ids.join(sums, "id", "left").select("id", (F.lit(1.0 - damping) + damping * F.coalesce("s", F.lit(0.0))).alias("pagerank"))
        if i % every == 0 and i < iterations:
            ranks = staged(ranks, "ranks")
            if mark is not None:
                moved = ranks.join(mark.withColumnRenamed("pagerank", "old"), "id").agg(F.max(F.abs(F.col("pagerank") - F.col("old")))).first()[0]
                if moved is None or moved < tolerance:
                    break
            mark = ranks
    return ranks


def label_propagation(nodes: DataFrame, links: DataFrame, rounds: int = 10, tasks: int | None = None) -> DataFrame:
    """(id, community): each round a node takes the label most frequent among its
    neighbours, ties to the least; nodes without neighbours keep their own."""
    labels = nodes.select("id", F.col("id").alias("community")).distinct()
    links, n = _counted(links, tasks)
    dealt = links.select("src", "dst").repartition(n, "src")
    for i in range(rounds):
        # Dealt by the node that votes are for: both groupings run where they are.
        votes = dealt.join(labels.withColumnRenamed("id", "src"), "src").select("dst", "community").repartition(n, "dst").groupBy("dst", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("dst").agg(F.min(F.struct((-F.col("n")).alias("m"), "community")).alias("b"))
        labels = labels.select("id", F.col("community").alias("old")).join(best.select(F.col("dst").alias("id"), "b.community"), "id", "left").select("id", F.coalesce("community", "old").alias("community"))
        if i % 3 == 2:
            labels = staged(labels, "labels")
    return labels


def components(nodes: DataFrame, links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(id, component): the least id that links in both directions lead to; each
    round takes the least of the neighbours' and is a written table."""
    links, tasks = _counted(links, tasks)
    links = links.repartition(tasks, "src")
    found = staged(nodes.select("id", F.col("id").alias("component")).distinct(), "components")
    while True:
        near = links.join(found.toDF("src", "component"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("near"))
        next_ = staged(found.join(near, "id", "left").select("id", F.least("component", "near").alias("component")), "components")
        if next_.join(found.toDF("id", "was"), "id").where("component <> was").isEmpty():
            return next_
        found = next_


def modularity(members: DataFrame, links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(modularity,) of communities (id, community) over links in both directions:
    the share of links inside communities less what their degrees let expect."""
    links, tasks = _counted(links, tasks)
    of = members.select("id", "community")
    both = links.repartition(tasks, "src").join(of.toDF("src", "a"), "src").select("dst", "a").repartition(tasks, "dst").join(of.toDF("dst", "b"), "dst")
    mass = both.groupBy("a").agg(F.count("*").alias("d"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("inside"))
    whole = mass.agg(F.sum("d").cast("double").alias("m"), F.sum("inside").alias("inside"), F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    return whole.select((F.col("inside") / F.col("m") - F.col("squares") / (F.col("m") * F.col("m"))).alias("modularity"))


def leiden(nodes: DataFrame, links: DataFrame, seed: int = 42, limit: int = LOCAL_EDGES) -> DataFrame:
    """(id, community number) by Leiden: local moving, refinement, aggregation.

    File graphs are small: up to ``limit`` links one executor task runs it.  A
    larger graph is first contracted (see ``contracted``) until its links fit; the
    task runs Leiden on that weighted graph, whose communities are mapped back.
    """
    ids = nodes.select("id").distinct()
    if links.limit(limit + 1).count() > limit:
        member, weighted = contracted(ids, links, limit)
        total = weighted.agg(F.sum("w")).first()[0]
        apart = weighted.where("src <> dst")
        if apart.limit(limit + 1).count() > limit:  # no two groups gain by joining
            found = member.withColumnRenamed("grp", "community")
        else:
            rows = weighted.join(apart.select("src").distinct(), "src", "left_semi")
            top = _leiden_in_one_task(rows, seed, total).select(F.col("id").alias("grp"), "community")
            # Groups without links out of them are communities; "=" keeps their names apart.
            found = member.join(top, "grp", "left").select("id", F.coalesce("community", F.concat(F.lit("="), "grp")).alias("community"))
    else:
        rows = links.select("src", "dst", F.lit(1.0).alias("w")).unionByName(nodes.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("w")))
        found = _leiden_in_one_task(rows, seed)
    firsts = found.groupBy("community").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    return found.join(numbered(firsts, F.desc("size"), F.col("first")), "community").select("id", F.col("number").alias("community"))


def _leiden_in_one_task(rows: DataFrame, seed: int, total: float | None = None) -> DataFrame:
    """(id, community) from rows (src, dst, w); a null dst only names a node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = pdf.dropna().sort_values(["src", "dst", "w"])  # in one order, whatever the shuffle gave
        member = leiden_local(sorted(set(pdf["src"])), list(zip(pairs["src"], pairs["dst"], pairs["w"], strict=True)), seed, total=total)
        return pd.DataFrame({"id": list(member), "community": [str(c) for c in member.values()]})

    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "id string, community string")


def contracted(ids: DataFrame, links: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """((id, grp), (src, dst, w)): groups of nodes, and the links between and (as
    loops) inside them, at most ``limit`` between unless no join of two groups
    raises modularity any more.

    Groups start as single nodes.  In each round groups are dealt as centres (one of
    two in the first round, then one of four) or joiners; a joiner joins the centre
    among its neighbours that it gains most by, best first, as long as each raises
    modularity over all that came before it.  So groups are connected, and
    modularity rises with every round.  A round without a join looks at all pairs.
    Only links from a joiner to a centre meet the groups' degrees; each link is one
    row of two numbers, and the degrees of groups are summed from those of their
    members.  Rounds are written tables.
    """
    spark = ids.sparkSession
    names = _as_numbers(ids)
    name = lambda c: F.xxhash64(c, F.lit(names.salt))
    numbers = staged(links.select(name("src").alias("a"), name("dst").alias("b")).where("a <= b").groupBy("a", "b").agg(F.count("*").cast("double").alias("w")), "links")
    ends = numbers.select(F.col("a").alias("grp"), "w").unionByName(numbers.where("a <> b").select(F.col("b").alias("grp"), "w"))
    none = names.table.select("grp", F.lit(0.0).alias("w"))
    degree = staged(ends.unionByName(none).groupBy("grp").agg(F.sum("w").alias("d")), "degrees")
    total = degree.agg(F.sum("d")).first()[0]
    member, far = names.table, numbers.where("a <> b")
    level = 0
    while (rows := far.count()) * 2 > limit:
        n = tasks_for(spark, rows, LINKS_A_TASK)
        share = 2 if level == 0 else 4
        centre = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(share)) == 0  # noqa: B023, E731
        joins = _joins(far, degree, total, n, lambda pairs: pairs.where(~centre("src") & centre("dst")))  # noqa: B023
        if joins.isEmpty():
            # The pair of the highest gain counts as dealt right: no round is idle.
            top = _gains(far, degree, total, n).orderBy(F.desc("gain"), F.least("src", "dst")).first()
            if top is None:
                break
            dealt = lambda c: centre(c) & (F.col(c) != top["src"]) | (F.col(c) == top["dst"])  # noqa: B023, E731
            joins = _joins(far, degree, total, n, lambda pairs: pairs.where(~dealt("src") & dealt("dst")))  # noqa: B023
        to = joins.toDF("old", "to")
        for end in ("a", "b"):
            far = far.repartition(n, end).join(to.withColumnRenamed("old", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        far = far.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
        far = staged(far.groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
        moved = lambda df: df.join(to.withColumnRenamed("old", "grp"), "grp", "left").withColumn("grp", F.coalesce("to", "grp")).drop("to")  # noqa: B023, E731
        degree = staged(moved(degree).groupBy("grp").agg(F.sum("d").alias("d")), "degrees")
        member = staged(moved(member).select("id", "grp"), "members")
        level += 1
    between = far.toDF("src", "dst", "w").unionByName(far.toDF("dst", "src", "w"))
    out = between.groupBy(F.col("src").alias("grp")).agg(F.sum("w").alias("out"))
    loops = degree.join(out, "grp", "left").select(F.col("grp").alias("src"), F.col("grp").alias("dst"), (F.col("d") - F.coalesce("out", F.lit(0.0))).alias("w"))
    text = lambda df, *cs: df.withColumns({c: F.col(c).cast("string") for c in cs})
    return text(member.select("id", "grp"), "grp"), text(between.unionByName(loops.where("w > 0")), "src", "dst")


@dataclass
class _Numbers:
    """Nodes (id, grp) by a hash of their id that no two share."""

    table: DataFrame
    salt: int


def _as_numbers(ids: DataFrame) -> _Numbers:
    salt = 0
    while True:
        table = staged(ids.select("id", F.xxhash64("id", F.lit(salt)).alias("grp")), "members")
        if table.groupBy("grp").count().where("count > 1").isEmpty():
            return _Numbers(table, salt)
        salt += 1


def _gains(far: DataFrame, degree: DataFrame, total: float, n: int, of=lambda pairs: pairs) -> DataFrame:
    """(src, dst, w, da, db, gain) of the pairs ``of`` keeps that raise modularity."""
    pairs = of(far.toDF("src", "dst", "w").unionByName(far.toDF("dst", "src", "w")))
    known = pairs.repartition(n, "dst").join(degree.toDF("dst", "db"), "dst").repartition(n, "src").join(degree.toDF("src", "da"), "src")
    return known.withColumn("gain", F.col("w") - F.col("da") * F.col("db") / total).where(F.col("gain") > 1e-12)


def _joins(far: DataFrame, degree: DataFrame, total: float, n: int, of) -> DataFrame:
    """(src, dst): each joiner's best centre, where it still raises modularity after
    the joiners of that centre that gain more."""
    best = _gains(far, degree, total, n, of).groupBy("src").agg(F.min(F.struct((-F.col("gain")).alias("m"), "dst", "w", "da", "db")).alias("b")).select("src", "b.*")
    before = F.sum("da").over(Window.partitionBy("dst").orderBy("m", "src").rowsBetween(Window.unboundedPreceding, -1))
    joins = best.withColumn("before", F.coalesce(before, F.lit(0.0))).where(F.col("w") - F.col("da") * (F.col("db") + F.col("before")) / total > 0)
    return staged(joins.select("src", "dst"), "joins")


def leiden_local(ids: list[str], links: list[tuple], seed: int = 42, rounds: int = 10, total: float | None = None) -> dict[str, int]:
    """Leiden by modularity on one machine; links (a, b) or (a, b, weight) hold
    both directions.  ``total`` is the weight of a graph these are part of."""
    rng = random.Random(seed)
    weights: dict[str, dict] = {i: defaultdict(float) for i in ids}
    for a, b, *w in links:
        weights[a][b] += w[0] if w else 1.0
    total = total or sum(w for near in weights.values() for w in near.values()) or 1
    groups = {i: [i] for i in ids}
    graph = {i: dict(w) for i, w in weights.items()}
    degree = {i: sum(w.values()) for i, w in graph.items()}
    start = None
    for _ in range(rounds):
        part = _move(graph, degree, total, rng, start)
        if len(set(part.values())) == len(graph):
            break
        fine = _refine(graph, degree, total, part, rng)
        merged: dict = defaultdict(list)
        for n, c in fine.items():
            merged[c] += groups[n]
        coarse: dict = {c: defaultdict(float) for c in merged}
        for n, near in graph.items():
            for m, w in near.items():
                coarse[fine[n]][fine[m]] += w
        of = {fine[n]: part[n] for n in graph}
        if len(coarse) == len(graph):
            groups = {c: [x for n in graph if part[n] == c for x in groups[n]] for c in set(part.values())}
            break
        groups, graph = dict(merged), {c: dict(w) for c, w in coarse.items()}
        degree = {c: sum(w.values()) for c, w in graph.items()}
        start = of
    else:
        of = None
    if start is not None and len(groups) == len(graph) and set(groups) == set(graph):
        final: dict = defaultdict(list)
        last = _move(graph, degree, total, rng, start)
        for n, members in groups.items():
            final[last[n]] += members
        groups = dict(final)
    order = sorted(groups.values(), key=lambda m: (-len(m), min(m)))
    return {i: k for k, m in enumerate(order) for i in sorted(m)}


def _move(graph, degree, total, rng, start=None) -> dict:
    part = dict(start) if start else {n: n for n in graph}
    mass: dict = defaultdict(float)
    for n, c in part.items():
        mass[c] += degree[n]
    order = sorted(graph)
    rng.shuffle(order)
    queue, waiting = deque(order), set(order)
    while queue:
        n = queue.popleft()
        waiting.discard(n)
        own, near = part[n], defaultdict(float)
        for m, w in graph[n].items():
            if m != n:
                near[part[m]] += w
        mass[own] -= degree[n]
        best, gain = own, near.get(own, 0.0) - degree[n] * mass[own] / total
        for c, w in near.items():
            g = w - degree[n] * mass[c] / total
            if g > gain + 1e-12:
                best, gain = c, g
        mass[best] += degree[n]
        if best != own:
            part[n] = best
            for m in graph[n]:
                if part[m] != best and m not in waiting:
                    queue.append(m)
                    waiting.add(m)
    return part


def _refine(graph, degree, total, part, rng) -> dict:
    """Inside each community, single nodes join neighbours again, so that every
    refined community is connected."""
    fine = {n: n for n in graph}
    mass = {n: degree[n] for n in graph}
    alone = set(graph)
    order = sorted(graph)
    rng.shuffle(order)
    for n in order:
        if n not in alone:
            continue
        near = defaultdict(float)
        for m, w in graph[n].items():
            if m != n and part[m] == part[n]:
                near[fine[m]] += w
        best, gain = None, 1e-12
        for c, w in near.items():
            g = w - degree[n] * mass[c] / total
            if c != n and g > gain:
                best, gain = c, g
        if best is not None:
            fine[n] = best
            mass[best] += degree[n]
            alone.discard(n)
            alone.discard(best)
    return fine


def boundary_degree(members: DataFrame, links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(id, boundary): distinct neighbours in other communities, 0 if none.  Links
    are dealt to ``tasks`` parts, by default as many as their number asks for; by
    src last, so that they are counted where they were joined."""
    links, tasks = _counted(links, tasks)
    ids = members.select("id", "community")
    other = links.repartition(tasks, "dst").join(ids.toDF("dst", "b"), "dst")
    ends = other.repartition(tasks, "src").join(ids.toDF("src", "a"), "src").where("a <> b")
    counted = ends.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("boundary"))
    return ids.join(counted, "id", "left").select("id", F.coalesce("boundary", F.lit(0)).alias("boundary"))


def top_per_community(scored: DataFrame, score: str, k: int, positive: bool = False) -> DataFrame:
    """The k highest of each community, ties by id."""
    rows = scored.where(F.col(score) > 0) if positive else scored
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc(score), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def spine(scored: DataFrame, by_rank: int = 5, by_boundary: int = 3) -> DataFrame:
    """``scored`` (id, community, pagerank, boundary) with is_core: among the top
    of its community by either measure."""
    core = top_per_community(scored, "pagerank", by_rank).select("id").unionByName(top_per_community(scored, "boundary", by_boundary, True).select("id")).distinct()
    return scored.join(core.withColumn("is_core", F.lit(True)), "id", "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)))


def communities(members: DataFrame, least: int = 3) -> DataFrame:
    """(community, size, name) of those with enough members."""
    sized = members.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return sized.withColumn("name", F.concat(F.lit("community-"), F.col("community").cast("string")))


def heuristic_labels(members: DataFrame, root: str) -> DataFrame:
    """(community, label): its most frequent telling path segment, ties by name."""
    segments = members.select("community", F.explode(label_segments(F.col("path"), root)).alias("segment"))
    counted = segments.groupBy("community", "segment").agg(F.count("*").alias("n"))
    best = counted.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("m"), "segment")).alias("b"))
    return best.select("community", F.col("b.segment").alias("label"))


def cluster_report(scored: DataFrame, least: int = 3) -> DataFrame:
    sizes = scored.groupBy("community").agg(F.count("*").alias("size"), F.sum(F.col("is_core").cast("int")).alias("core"))
    return sizes.agg(
        F.sum("size").alias("files"),
        F.count("*").alias("communities"),
        F.sum((F.col("size") >= least).cast("int")).alias("materialised"),
        F.sum("core").alias("spine"),
    )


def migrate_labels(old: DataFrame, new: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Labels of old communities for the new ones they overlap most, by Jaccard."""
    shared = old.toDF("id", "old").join(new.toDF("id", "new"), "id").groupBy("old", "new").agg(F.count("*").alias("both"))
    sizes = shared.join(old.toDF("id", "old").groupBy("old").agg(F.count("*").alias("a")), "old").join(new.toDF("id", "new").groupBy("new").agg(F.count("*").alias("b")), "new")
    overlap = sizes.withColumn("jaccard", F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).where(F.col("jaccard") >= least)
    best = overlap.groupBy("new").agg(F.max_by("old", F.struct("jaccard", "old")).alias("community"))
    return best.join(labels, "community").drop("community").withColumnRenamed("new", "community")
