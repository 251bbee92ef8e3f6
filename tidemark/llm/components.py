"""Connected components of a graph given by its links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

#: Parts that the rows of one key are dealt to, by what they hold.
SPREAD = 64


def with_least(df: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """Adds `low`, the least `value` of all rows of a key, without bringing these together.

    The rows of a key are dealt to SPREAD parts by a hash of `by`. The least of each part
    is found first, then that of the parts, which goes back to each of them. So a key that
    many rows have is in as many tasks, both where minima are made and where they are met.
    """
    dealt = df.withColumn("share", F.pmod(F.xxhash64(by), F.lit(SPREAD)))
    parts = dealt.groupBy(key, "share").agg(F.min(value).alias("low"))
    least = parts.groupBy(key).agg(F.min("low").alias("low"), F.collect_list("share").alias("shares"))
    least = least.select(key, "low", F.explode("shares").alias("share"))
    return dealt.join(least, [key, "share"]).drop("share")


def _summary(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", "root")).alias("digest")
    ).first()
    return row["n"], row["digest"]


def _to_least_neighbour(links: DataFrame) -> DataFrame:
    """Tie the larger neighbours of each node to the least of its neighbourhood."""
    both = links.unionByName(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
    tied = with_least(both, "node", "root", "root").where(F.col("root") > F.col("node"))
    return tied.select(F.col("root").alias("node"), F.least("low", "node").alias("root"))


def _to_least_smaller(links: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the least of them."""
    tied = with_least(links, "node", "root", "root")
    return tied.where(F.col("root") != F.col("low")).select(
        F.col("root").alias("node"), F.col("low").alias("root")
    ).unionByName(tied.select("node", F.col("low").alias("root")))


def components(links: DataFrame, one: str, other: str) -> DataFrame:
    """(node, root) for every node that has a link: the least node of its component.

    `links` has one row per link between different nodes; direction and repeats do
    not matter and null nodes are left out. Roots have no row of their own. Each
    round joins links with minima per node, in parts, so that the links of a node that
    has very many never meet in one task. The links of a round are written before the
    next one reads them.
    """
    linked = links.where(F.col(one) != F.col(other)).select(
        F.greatest(one, other).alias("node"), F.least(one, other).alias("root")
    )
    current = stage(linked.distinct(), "links")
    summary = _summary(current)
    while summary[0]:
        following = stage(_to_least_smaller(_to_least_neighbour(current)).distinct(), "links")
        before, summary, current = summary, _summary(following), following
        if summary == before:
            break
    return current
