"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftlens.llm.texts import write_small


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has a link, with the smallest node it is connected with.

    Each round gives every node the smallest root among its own and its neighbours', and then the root of that root, so that the
    distance covered about doubles. Minima combine before the shuffle and links are joined by node, so a node with many links
    is no more than a join key that Spark can split. Each round is written to the shared folder.
    """
    ways = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ((a, b), (b, a))])
    both = links.select(F.explode(ways).alias("link")).select("link.*")
    both = write_small(both.where("a is not null and b is not null and a <> b"))
    now = write_small(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        near = (
            both.join(now.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("low"))
        )
        low = now.join(near, "node").select("node", "root", F.least("root", "low").alias("low"))
        low = write_small(low)
        ahead = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        after = write_small(
            low.join(ahead, "low").select("node", F.least("low", "next").alias("root"), F.col("root").alias("was"))
        )
        if after.where("root <> was").isEmpty():
            return after.select("node", "root")
        now = after.select("node", "root")
