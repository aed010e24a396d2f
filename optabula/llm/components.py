"""Connected components of a link table, by alternating large-star and small-star steps.

Each step gives every node the least of its neighbours: a grouped minimum (combined before the
shuffle) and a join that Spark may split where a node has very many links. Every round is written
to the shared folder; the driver sees one count and one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links (u, v) with u > v -> links of a star step; `larger`: large-star, else small-star."""
    if larger:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        near = links.join(least, "u").where("v > m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        out = near.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected(links: DataFrame) -> DataFrame:
    """(u, v) pairs of longs -> (node, root): the least node that each linked node reaches.

    Links may repeat, run in both directions or join a node to itself; nodes without a link to
    another one are not returned; pairs with a null are no links.
    """
    now = written(links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        now = written(_star(_star(now, larger=True), larger=False), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.unionByName(ends.select(F.col("root").alias("node"), "root").distinct())
