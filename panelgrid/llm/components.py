"""Connected components of a table of links, without collecting it.

Links are pointed from the larger to the smaller node and rewritten in turns: each node's other
links are handed to its smallest neighbour, then each link's smaller end is replaced by that end's
own smallest neighbour. Both are an aggregate (combined before its shuffle) and a join whose hot
keys AQE can split. When nothing changes, every node points to the smallest of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, settled, shuffle_partitions


def _forest(links: DataFrame) -> DataFrame:
    """Each partition's links reduced to a star for each of its own components."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent.get(x, root)
            return root

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        for k in range(0, len(nodes), 50_000):
            part = nodes[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["a", "b"])

    return links.mapInArrow(run, "a bigint, b bigint").where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """links: two bigint columns. Returns (node, component) of every node that has a link to another;
    component is the smallest node that it reaches. Links with a null, and of a node to itself, count for nothing."""
    x, y = (F.col(c) for c in links.columns[:2])
    links = links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b")
    links = settled(_forest(links).distinct())
    # links never get more: as many tasks as now hold them do for all that follows
    tasks = links.rdd.getNumPartitions()
    kept = (lambda df: checkpointed(df.coalesce(tasks))) if tasks < shuffle_partitions(links.sparkSession) else checkpointed
    parts = tasks
    while True:
        # dealt anew, so that the joins' sides are exchanges that AQE can split
        least = kept(links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        if least.where("n > 1").limit(1).count():
            handed = links.join(least.where("n > 1").select("a", "m").repartition(parts), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            links = kept(least.select("a", F.col("m").alias("b")).unionByName(handed).distinct())
            least = kept(links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        up = least.select(F.col("a").alias("node"), "m").repartition(parts)
        if not links.join(up, F.col("b") == F.col("node"), "left_semi").limit(1).count():
            if not least.where("n > 1").limit(1).count():
                return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
            continue
        links = kept(links.join(up, F.col("b") == F.col("node"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
