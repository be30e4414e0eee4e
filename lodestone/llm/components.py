"""Connected components by repeated contraction, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.session import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node it is connected with) for every node that has a link to another.

    Each round maps a node to the smallest node beside it and contracts the links; the number of
    nodes with links falls by half at least, so rounds grow with the logarithm of the nodes. Only
    a count comes to the driver. Null ends and self-links are left out; repeated links are harmless.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    links = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).select(F.col("a").alias("node"), "to"))
        # A node may point at one that itself moves on: follow two steps, so chains shorten twice as fast.
        on = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = checkpointed(step.join(on, "to").select("node", F.col("next").alias("to")))
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            moved = step.select(F.col("node").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = checkpointed(labels)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = links.join(left, "a").join(right, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        links = checkpointed(moved.distinct())
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def with_nodes(classes: DataFrame, rows: DataFrame, id_column: str, keys: list[str]) -> DataFrame:
    """``classes`` (``keys`` and ``doc``, the smallest id of its rows) with ``node``, a number of its own for each class.

    It is ``doc``, but for an id whose rows lie in several classes a hash of the class's keys.
    """
    own = F.xxhash64(*keys)
    several = rows.groupBy(id_column).agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low <> high").select(F.col(id_column).alias("_several"))
    return classes.join(several, classes["doc"] == several["_several"], "left").withColumn("node", F.when(F.col("_several").isNull(), F.col("doc")).otherwise(own)).drop("_several")


#: Tasks among which the nodes of one component are dealt where they meet its smallest id.
SALTS = 32


def smallest_ids(found: DataFrame, classes: DataFrame) -> DataFrame:
    """node, component_id: the smallest ``doc`` among the classes of each node's component. A large component is several tasks."""
    placed = found.join(classes.select("node", "doc"), "node")
    least = placed.groupBy("component").agg(F.min("doc").alias("component_id")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = placed.select("node", "component", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("_salt"))
    return dealt.join(least, ["component", "_salt"]).select("node", "component_id")
