"""A corpus from documents to packed sequences, stage by stage.

Each stage is one operator of the llm subpackage whose decisions take effect on
what the stage before kept.  Between stages the documents are written as Parquet
and read again, so a lost executor never reaches back past a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, langid, nearcopies, packing, toxicity
from sparkloom.llm.common import bounded_batches, free_name, held_out, staged, table

#: A prediction below this is no language that the corpus knows.
LEAST_CONFIDENCE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below 0.5.  It learns from the labelled
    documents that are not held out."""
    bounded_batches(spark)
    net = toxicity.fit(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    out = free_name(docs, "toxicity")
    return toxicity.score(docs, net, out=out).where(F.col(out)["score"] < 0.5).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned; texts without letters and
    those between languages go."""
    model = langid.fit(docs.where(~held_out()))
    out = free_name(docs, "language")
    known = (F.col(out)["lang_pred"] != langid.UNDETERMINED) & (F.col(out)["score"] >= LEAST_CONFIDENCE)
    return langid.identify(docs, model, out=out).where(known).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8
    or more): the least doc_id.  The anchors of op 5 and MinHash find candidates,
    whole sets of shingles decide."""
    return nearcopies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or edited."""
    out = free_name(docs, "leaks")
    marked = decontaminate.mark_leaks(docs, table(spark, sf_dir, "benchmark"), out=out)
    return marked.where(F.size(out) == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of what is left."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages are trained models, fingerprints, alignments and a tokenizer, which
#: SQL can't express; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
