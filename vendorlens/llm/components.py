"""Connected components of a link table by alternating stars, one Spark job per round."""

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours the smallest node it knows."""
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("least"))
    return (links.select(F.col("low").alias("node"), F.col("high").alias("other"))
            .join(least.withColumnRenamed("high", "node"), "node")
            .select(F.col("other").alias("high"), F.col("least").alias("low")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    handed = links.join(least, "high")
    return (handed.select(F.col("low").alias("high"), F.col("least").alias("low"))
            .unionByName(least.select("high", F.col("least").alias("low")))
            .filter("high > low").distinct())


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node that has a link; the component is its smallest node.

    Links are an undirected table of two integer columns; repeats, both directions, loops and null ends
    are allowed (the latter two give nothing). Each round rewires all links towards smaller nodes and
    is written to the shared folder; the number of rounds grows with the logarithm of the longest chain.
    A hub with very many links is summed map-side first, and its join partner is split by AQE.
    """
    now = stored(links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
                 .filter(f"{a} IS NOT NULL AND {b} IS NOT NULL AND high > low").distinct(), "links")
    seen = None
    for _ in range(rounds):
        now = stored(_small_star(_large_star(now)), "links")
        # A table of stars that no longer changes is the result: one link per node, to its component.
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return (now.select(F.col("high").alias("node"), F.col("low").alias("component"))
            .unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()))
