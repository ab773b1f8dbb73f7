"""Connected components of a link table by alternating large-star and
small-star steps (Kiveris et al., 2014), each an aggregate and an equi-join.

No group is ever gathered in one task: the minimum of a node's neighbours is a
partial aggregate, and the join that brings it back to the links is one that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, saved


def components(links: DataFrame) -> DataFrame:
    """links(a, b), any orderable type -> (node, label): label is the smallest
    node of the component. Nodes without links are absent; nulls and loops are
    ignored; an empty table gives an empty one."""
    pairs = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, state = saved(pairs, "cc"), None
    while True:  # each round adds links to smaller labels only, so that it ends
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = saved(small, "cc")
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(edges)
        edges = nxt
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return saved(out.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels", (edges,))
