"""Connected components of a link table, as DataFrame rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.tasks import Batches, in_arrow
from spanmill.session import counted_copy, cut_lineage, small_copy

#: Tables of at most so many narrow rows are kept in one partition.
SMALL = 100_000
#: At most so many links (16 bytes each) are joined by one task, without rounds.
ONE_TASK = 1_000_000


def _joined(batches: Batches) -> Batches:
    """All rounds over the links of one task."""
    links = [np.stack([batch.column(c).to_numpy() for c in ("a", "b")]) for batch in batches if len(batch)]
    if not links:
        return
    nodes, ends = np.unique(np.concatenate(links, axis=1), return_inverse=True)
    one, two = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low, after = np.minimum(label[one], label[two]), label.copy()
        for end in (one, two):
            np.minimum.at(after, label[end], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    for at in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(nodes[label[at : at + (1 << 16)]])], ["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the smallest node it reaches.

    Each round takes the smallest label among the neighbours and then the label of that label, so paths shorten
    by halves; a round is written to the shared folder, and the loop ends with the round that changes nothing.
    A node with many neighbours is met by a map-side minimum, never gathered. An empty table has no components.
    One task goes through all rounds of up to ``ONE_TASK`` links.
    """
    pairs, count, _ = counted_copy(links.select("a", "b").filter("a <> b").distinct(), F.lit(False))
    if count <= ONE_TASK:
        return cut_lineage(in_arrow(pairs.coalesce(1), _joined, "node bigint, component bigint"))
    both = small_copy(pairs.union(pairs.select("b", "a")).distinct(), SMALL)
    labels = small_copy(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), SMALL)
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        after = lower.join(jump, "low").select("node", "before", F.least("low", "jump").alias("component"))
        after, rows, changed = counted_copy(after, F.col("before") != F.col("component"))
        labels = (after.coalesce(1) if rows <= SMALL else after).select("node", "component")
        if not changed:
            return labels
