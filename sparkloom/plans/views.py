"""A property graph derived from relational tables, and the same as SQL.

Parts are files (type and brand are folders, brand the community); consecutive
lines of an order are the edges.  The operators run on these tables just
as on a graph extracted from source code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.shared import tasks_for

ROOT = "/repo"
#: Lines that one task joins.
LINES_A_TASK = 1_000_000
START = "part:28"

SQL = """
parts AS (SELECT 'part:' || p_partkey AS id, p_partkey AS k, p_name AS name, '/repo/' || p_type || '/' || p_brand || '/' || p_name || '_' || p_partkey AS path,
  p_type AS language, p_brand AS community, p_retailprice AS pagerank, p_size >= 48 AS is_core, p_size <= 5 AS is_test, 'File' AS kind FROM part),
edges AS (SELECT DISTINCT 'part:' || a.l_partkey AS src, 'part:' || b.l_partkey AS dst FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey),
hrefs AS (SELECT DISTINCT 'page:' || page_id AS src, symbol FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS symbol FROM pages))
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_partkey").alias("k"),
        F.col("p_name").alias("name"),
        F.concat_ws("/", F.lit(ROOT), "p_type", "p_brand", F.concat_ws("_", "p_name", F.col("p_partkey").cast("string"))).alias("path"),
        F.col("p_type").alias("language"),
        F.col("p_brand").alias("community"),
        F.col("p_retailprice").alias("pagerank"),
        (F.col("p_size") >= 48).alias("is_core"),
        (F.col("p_size") <= 5).alias("is_test"),
        F.lit("File").alias("kind"),
    )


def lines_dealt(spark: SparkSession, sf_dir: str) -> int:
    """Parts for joins over all lines, or over all edges: as many as keep a task's
    share whatever the number of lines."""
    return tasks_for(spark, read(spark, sf_dir, "lineitem").count(), LINES_A_TASK)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, keys = lines_dealt(spark, sf_dir), ["l_orderkey", "l_linenumber"]
    a = read(spark, sf_dir, "lineitem").select(*keys, "l_partkey")
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    pair = a.repartition(n, *keys).join(b.repartition(n, *keys), keys).where("l_partkey <> next").select("l_partkey", "next").repartition(n, "l_partkey", "next").distinct()
    name = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string"))
    return pair.select(name("l_partkey").alias("src"), name("next").alias("dst"))


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = read(spark, sf_dir, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("src"), F.explode(found).alias("symbol"))
    return rows.distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("kind"), F.col("source").alias("path"))


def start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(START,)], "id string")
