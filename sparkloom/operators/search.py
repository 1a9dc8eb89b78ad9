"""Keyword, vector and hybrid search over node or document tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
FIELDS = ("name", "signature", "body", "path")
SNIPPET = 280


def tokens(text: Column, code: bool = False) -> Column:
    """White-space tokens, case kept; ``code`` also splits at punctuation and
    capitals and lower-cases, for identifiers."""
    if code:
        parted = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
        return F.filter(F.split(F.lower(parted), " "), lambda t: t != "")
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


@dataclass
class Clause:
    """One part of a query: words (several: a phrase), how they match, where."""

    words: list[str]
    kind: str = "term"  # term, phrase, prefix or fuzzy
    edits: int = 2
    field: str | None = None
    required: bool = False
    excluded: bool = False


@dataclass
class Query:
    clauses: list[Clause] = field(default_factory=list)


_OPERATORS = ("AND", "OR", "NOT")
_PART = re.compile(r'([+-]?)(?:([A-Za-z_]\w*):)?(?:"([^"]*)"|(\S+))')


def parse_query(text: str) -> Query:
    """Words are alternatives; ``+word`` must, ``-word`` must not match;
    ``"a phrase"``, ``pre*``, ``fuzzy~1`` and ``field:word`` do what they say.
    In capitals AND makes both its sides required and NOT excludes what follows;
    OR is what holds anyway.  Small and, or, not without sign or field are stop
    words."""
    out: list[Clause] = []
    before = ""
    for sign, where, phrase, word in _PART.findall(text):
        if not phrase and not word:
            continue
        if not sign and not where and not phrase and word.upper() in _OPERATORS:
            if word in _OPERATORS:
                before = "NOT" if word == "NOT" else before if before == "NOT" else word
                if word == "AND" and out and not out[-1].excluded:
                    out[-1].required = True
            continue
        clause = Clause([], field=where or None, required=sign == "+", excluded=sign == "-")
        fuzzy = re.fullmatch(r"(.+)~([0-2]?)", word) if word else None
        if phrase:
            clause.words = phrase.split()
            clause.kind = "phrase" if len(clause.words) > 1 else "term"
        elif fuzzy:
            clause.words, clause.kind, clause.edits = [fuzzy[1]], "fuzzy", int(fuzzy[2] or 2)
        elif word.endswith("*") and len(word) > 1:
            clause.words, clause.kind = [word[:-1]], "prefix"
        else:
            clause.words = [word]
        if clause.words:
            clause.excluded = clause.excluded or before == "NOT" and not clause.required
            clause.required = clause.required or before == "AND" and not clause.excluded
            out.append(clause)
            before = ""
    return Query(out)


def _hits(clause: Clause, toks: Column) -> Column:
    """How often the clause occurs in the tokens."""
    first = clause.words[0]
    if clause.kind == "prefix":
        return F.size(F.filter(toks, lambda t: t.startswith(first)))
    if clause.kind == "fuzzy":
        return F.size(F.filter(toks, lambda t: (F.abs(F.length(t) - len(first)) <= clause.edits) & (F.levenshtein(t, F.lit(first)) <= clause.edits)))
    if clause.kind == "phrase":
        # Marked ends keep words whole; a match of no width lets phrases overlap.
        marked = F.concat(F.lit("\x01"), F.array_join(toks, "\x02\x01"), F.lit("\x02"))
        wanted = "".join(f"\x01{re.escape(w)}\x02" for w in clause.words)
        return F.regexp_count(marked, F.lit(f"(?={wanted})"))
    return F.size(F.filter(toks, lambda t: t == first))


def full_text(docs: DataFrame, query: str | Query, limit: int | None = 20, fields: tuple[str, ...] = ("text",), kind: str | None = None, code: bool = False, id_col: str = "id") -> DataFrame:
    """(id, score): BM25 summed over fields and clauses, best first, ties by id.

    One pass counts the clauses' hits per document and field (in the JVM, no
    postings are shuffled); document counts and mean lengths are one small
    aggregate over all documents, joined back as a single row.  A kind filters
    before the limit; statistics cover all documents.
    """
    query = parse_query(query) if isinstance(query, str) else query
    fields = tuple(f for f in fields if f in docs.columns)
    keep = [id_col] + (["kind"] if "kind" in docs.columns else [])
    parts = [(i, f) for i, c in enumerate(query.clauses) for f in fields if c.field in (None, f)]
    if not parts:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    toked = docs.select(*keep, *[tokens(F.coalesce(F.col(f), F.lit("")), code).alias(f"t_{f}") for f in fields])
    counted = toked.select(
        *keep,
        *[F.size(f"t_{f}").alias(f"n_{f}") for f in fields],
        *[_hits(query.clauses[i], F.col(f"t_{f}")).alias(f"h_{i}_{f}") for i, f in parts],
    )
    stats = counted.agg(
        F.count("*").alias("docs"),
        *[F.avg(f"n_{f}").alias(f"avg_{f}") for f in fields],
        *[F.sum((F.col(f"h_{i}_{f}") > 0).cast("int")).alias(f"df_{i}_{f}") for i, f in parts],
    ).first()
    if not stats["docs"]:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)

    def scored(i: int, f: str) -> Column:
        n, df = stats["docs"], stats[f"df_{i}_{f}"]
        tf, mean = F.col(f"h_{i}_{f}"), stats[f"avg_{f}"] or 1.0
        idf = F.log(F.lit(1.0) + (F.lit(float(n - df)) + 0.5) / (F.lit(float(df)) + 0.5))
        return idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col(f"n_{f}") / F.lit(float(mean))))

    any_of = {i: reduce(lambda a, b: a | b, [F.col(f"h_{j}_{f}") > 0 for j, f in parts if j == i]) for i in {i for i, _ in parts}}
    wanted = [i for i, c in enumerate(query.clauses) if not c.excluded]
    ok = reduce(lambda a, b: a | b, [any_of[i] for i in wanted if i in any_of], F.lit(False))
    for i, c in enumerate(query.clauses):
        if c.required:
            ok = ok & (any_of[i] if i in any_of else F.lit(False))
        if c.excluded and i in any_of:
            ok = ok & ~any_of[i]
    score = reduce(lambda a, b: a + b, [scored(i, f) for i, f in parts if not query.clauses[i].excluded], F.lit(0.0))
    rows = counted.where(ok)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    out = rows.select(F.col(id_col), score.alias("score")).orderBy(F.desc("score"), id_col)
    return out.limit(limit) if limit is not None else out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector(docs: DataFrame, query: list[float], limit: int = 20, kind=None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): (1 + cosine) / 2, exact, best first, ties by id."""
    rows = docs.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == len(query)))
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    asked = F.array(*[F.lit(float(x)) for x in query])
    score = (F.lit(1.0) + cosine(F.col(vector_col), asked)) / 2
    return rows.select(F.col(id_col), score.alias("score")).where(~F.isnan("score") & F.col("score").isNotNull()).orderBy(F.desc("score"), id_col).limit(limit)


def ranked(hits: DataFrame, id_col: str = "id") -> DataFrame:
    """Top-k hits, few by their limit, numbered from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def fuse(legs: dict[str, DataFrame], limit: int = 10, k: int = 60, id_col: str = "id") -> DataFrame:
    """Reciprocal rank fusion: score is the sum of 1 / (k + rank); matched_by
    names the legs.  Ties by id."""
    one = F.lit(1.0)
    parts = [ranked(h, id_col).select(id_col, (one / (F.lit(float(k)) + F.col("rank"))).alias("s"), F.lit(name).alias("leg")) for name, h in legs.items()]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(id_col).agg(F.sum("s").alias("score"), F.array_sort(F.collect_set("leg")).alias("matched_by")).orderBy(F.desc("score"), id_col).limit(limit)


def hybrid(docs: DataFrame, query: str, embedded: list[float] | None, limit: int = 10, kind: str | None = None, fields: tuple[str, ...] = FIELDS, fts: Callable[[int], DataFrame] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Fused hits and the state of each leg: ``ok`` or why it gave nothing.  Each
    leg runs here, to its bounded top hits, so that one that fails at run time is
    reported, too, and the other serves.  ``fts`` gives the keyword leg's top hits
    from a stored index."""
    spark = docs.sparkSession
    legs, state = {}, {}
    for name, make in (
        ("fts", lambda: fts(limit * 3) if fts else full_text(docs, query, limit * 3, fields, kind)),
        ("vector", lambda: vector(docs, embedded, limit * 3, kind)),
    ):
        try:
            if name == "vector" and embedded is None:
                raise ValueError("no query vector")
            hits = make()
            legs[name], state[name] = spark.createDataFrame(hits.collect(), hits.schema), "ok"
        except Exception as error:  # a leg that fails is reported, the other one serves
            state[name] = f"failed: {error}"
    if not legs:
        raise ValueError(f"both legs failed: {state}")
    return fuse(legs, limit), state


def with_details(hits: DataFrame, nodes: DataFrame, chars: int = SNIPPET) -> DataFrame:
    """Hits with what a caller shows: kind, name, place, signature, snippet."""
    shown = nodes.select("id", "kind", "name", "path", "language", "signature", F.substring("body", 1, chars).alias("snippet"), "start_row", "end_row")
    return hits.join(shown, "id").orderBy(F.desc("score"), "id")
