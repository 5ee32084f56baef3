"""Connected components of a link table, as grouped aggregations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.jobs import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node reachable.

    Labels fall to the least label among a node's neighbours, roots take over the least
    label that any of their nodes met, and then each node takes its label's label, so that
    long chains shorten by jumps. Every round is written to the shared folder: the next
    reads files of known size, so that Spark may split hot nodes in its joins. Only the
    number of changed labels reaches the driver.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")),
        "labels",
    )
    while True:
        met = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        lower = stored(
            labels.join(met, "node").select("node", "root", F.least("root", "near").alias("new")), "lowered"
        )
        hooked = lower.groupBy(F.col("root").alias("node")).agg(F.min("new").alias("hook"))
        known = stored(
            lower.join(hooked, "node", "left").select("node", F.least("new", F.coalesce("hook", "new")).alias("up")), "hooked"
        )
        jumped = lower.join(known.select(F.col("node").alias("new"), "up"), "new", "left")
        after = stored(jumped.select("node", F.coalesce("up", "new").alias("root"), F.col("root").alias("before")), "labels")
        changed = after.where("root <> before").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels
