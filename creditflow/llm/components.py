"""Connected components of a table of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from creditflow.llm.storage import stored


def _star(pairs: DataFrame, above: bool) -> DataFrame:
    """One contraction: neighbours of u (those above u, or u's lower ones) move to the least id around u."""
    if above:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, component): the least id reachable, for every id in a link.

    Large-star and small-star rounds alternate until the table of pairs is
    stable, which takes a logarithmic number of rounds. Each round is written to
    the shared folder. Self links and nulls are ignored; an empty table gives an
    empty table.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stored(pairs, "links")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = print_of(pairs)
    while seen[0]:
        pairs = stored(_star(_star(pairs, True), False), "links")
        now = print_of(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
