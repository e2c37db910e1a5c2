"""Connected components of a table of links, by smallest labels and label jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import store


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of the links (a, b).

    Each round a node takes the smallest label among its neighbours' and then the
    label of that label, so long chains close in logarithmically many rounds.
    Labels are written to the shared folder after each round. A node with very
    many links is met by partial aggregation and by joins whose large side can
    be split. Null ends and self-links are ignored; no links give no rows.
    """
    both = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = store(both.union(both.select("b", "a")).distinct(), "edges")
    labels = store(edges.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "labels")
    while True:
        near = edges.df.join(labels.df.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = labels.df.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.df.select(F.col("node").alias("at"), F.col("root").alias("further"))
        stepped = hooked.join(jump, F.col("root") == F.col("at"), "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root"))
        after = store(stepped, "labels")
        changed = after.df.where("root <> old").limit(1).count()
        labels.drop()
        labels = after
        if not changed:
            return labels.df.select("node", "root")
