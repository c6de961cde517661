"""Connected components of links between 64-bit nodes, by alternating large and small stars.

Every round is two joins on the links that are left and a checkpoint in the shared folder; the
driver sees only a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return moved.select("e.u", "e.v").where("u != v").distinct()


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) for every linked node; root is the least node that it reaches.

    Links with a null end and links of a node to itself are ignored; without links there are no rows.
    """
    now = checkpointed(links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u != v").distinct())
    seen = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if sign == seen or not sign.n:
            break
        seen = sign
        now = checkpointed(_small_star(_large_star(now)))
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
