"""The given tables, and bibliographic tables projected from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of a paper for every order: three share a DOI, written in seven ways, some fields lack or are wrong."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.min("l_partkey").alias("part"))
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(table(spark, sf_dir, "part"), F.col("part") == F.col("p_partkey"), "left")
    return joined.selectExpr(
        "o_orderkey AS seq",
        "c_mktsegment AS category",
        """CASE o_orderkey % 7 WHEN 0 THEN concat('https://doi.org/10.1000/X', o_orderkey div 3) WHEN 1 THEN concat('DOI: 10.1000/x', o_orderkey div 3, '.')
           WHEN 2 THEN concat('10.1000/x', o_orderkey div 3) WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN concat('http://dx.doi.org/10.1000/X', o_orderkey div 3, '/')
           ELSE concat('10.1000/x', o_orderkey div 3, 'Abstract') END AS doi""",
        "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('Journal of ', c_mktsegment) END AS journal",
        """CASE WHEN o_orderkey % 11 = 0 THEN concat('Journal of ', c_mktsegment) WHEN o_orderkey % 11 = 1 THEN concat('Journal of ', c_mktsegment, ': ', coalesce(p_name, 'notes'))
           ELSE concat('Study of ', coalesce(p_name, 'notes'), ', part ', o_orderkey div 4) END AS title""",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 1700 ELSE year(o_orderdate) END AS year",
        "concat(year(o_orderdate), '_', CASE WHEN o_orderkey % 5 = 0 THEN 'Customer' ELSE 'customer' END, o_custkey, '_', replace(coalesce(p_name, 'notes'), ' ', '_'), '_', o_orderkey) AS paper_id",
        """CASE WHEN o_orderkey % 23 = 0 THEN array() WHEN o_orderkey % 3 = 0 THEN array(named_struct('full', concat('Anna', p_brand), 'forename', '', 'surname', ''))
           WHEN o_orderkey % 29 = 0 THEN array(named_struct('full', 'University of Tests', 'forename', '', 'surname', ''))
           ELSE array(named_struct('full', concat('Maria Customer', o_custkey), 'forename', 'Maria', 'surname', concat('customer', o_custkey))) END AS authors""",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat(p_type, ' of ', p_brand) END AS abstract",
        "coalesce(n_lines, 0) AS n_references",
        "CASE WHEN o_orderkey % 31 = 0 THEN 'unknown' ELSE CAST(coalesce(n_lines, 0) * (o_orderkey % 9) AS STRING) END AS cited_by",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'scopus' WHEN '2-HIGH' THEN 'manual' WHEN '3-MEDIUM' THEN 'adhoc' END AS source_type",
    )


PAPERS_SQL = """
papers AS (
SELECT o_orderkey AS seq, c_mktsegment AS category,
  CASE o_orderkey % 7 WHEN 0 THEN 'https://doi.org/10.1000/X' || (o_orderkey // 3) WHEN 1 THEN 'DOI: 10.1000/x' || (o_orderkey // 3) || '.'
    WHEN 2 THEN '10.1000/x' || (o_orderkey // 3) WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'http://dx.doi.org/10.1000/X' || (o_orderkey // 3) || '/'
    ELSE '10.1000/x' || (o_orderkey // 3) || 'Abstract' END AS doi,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Journal of ' || c_mktsegment END AS journal,
  CASE WHEN o_orderkey % 11 = 0 THEN 'Journal of ' || c_mktsegment WHEN o_orderkey % 11 = 1 THEN 'Journal of ' || c_mktsegment || ': ' || coalesce(p_name, 'notes')
    ELSE 'Study of ' || coalesce(p_name, 'notes') || ', part ' || (o_orderkey // 4) END AS title,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 1700 ELSE year(o_orderdate) END AS year,
  year(o_orderdate) || '_' || CASE WHEN o_orderkey % 5 = 0 THEN 'Customer' ELSE 'customer' END || o_custkey || '_' || replace(coalesce(p_name, 'notes'), ' ', '_') || '_' || o_orderkey AS paper_id,
  CASE WHEN o_orderkey % 23 = 0 THEN 'none' WHEN o_orderkey % 3 = 0 THEN 'glued' WHEN o_orderkey % 29 = 0 THEN 'place' ELSE 'full' END AS author_kind,
  o_custkey, p_brand,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE p_type || ' of ' || p_brand END AS abstract,
  coalesce(n_lines, 0) AS n_references,
  CASE WHEN o_orderkey % 31 = 0 THEN 'unknown' ELSE CAST(coalesce(n_lines, 0) * (o_orderkey % 9) AS VARCHAR) END AS cited_by,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'scopus' WHEN '2-HIGH' THEN 'manual' WHEN '3-MEDIUM' THEN 'adhoc' END AS source_type
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, min(l_partkey) AS part FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey
LEFT JOIN part ON part = p_partkey)
"""
