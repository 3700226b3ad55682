"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.session import forget, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every node of ``edges``; the component is its smallest node id.

    Every round takes the smallest label among the neighbours (map-side combined, so a hub does not make
    one slow task) and then follows the label of the label, which halves long chains.  Labels live in
    tables of the shared folder, of which only the last is kept; nothing but one count per round reaches the
    driver.  Self-loops and repeated edges are harmless, NULL ends are dropped, an empty edge table gives an
    empty result.  Labels only ever become smaller, so the rounds end by themselves.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"))
    held = materialize(labels, "cc-0")
    for i in count(1):
        labels = held.select("id", "component")
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy("a").agg(F.min("component").alias("near"))
        )
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        parent = labels.select(F.col("id").alias("c"), F.col("component").alias("jump"))
        step = step.join(parent, "c").select("id", F.least("c", "jump").alias("component"), (F.least("c", "jump") != F.col("old")).alias("changed"))
        step = materialize(step, f"cc-{i}")
        forget(held)
        held = step
        if not step.where("changed").limit(1).count():
            forget(both)
            return step.select("id", "component")
