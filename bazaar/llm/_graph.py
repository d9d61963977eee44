"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.session import reliable_checkpoint


def find(parent: dict, x):
    """Root of x with path halving; ``parent`` only holds nodes that have been joined."""
    while (p := parent.get(x, x)) != x:
        parent[x] = parent.get(p, p)
        x = p
    return x


def union(parent: dict, a, b) -> bool:
    """Join two nodes under the smaller root; False if they were joined before."""
    a, b = find(parent, a), find(parent, b)
    if a == b:
        return False
    lo, hi = (a, b) if a < b else (b, a)
    parent[hi] = lo
    parent.setdefault(lo, lo)
    return True


def _contract(batches):
    """Links of each batch become a forest of stars: at most one row per node."""
    for batch in batches:
        parent: dict = {}
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            union(parent, a, b)
        rows = [(x, find(parent, x)) for x in list(parent)]
        rows = [r for r in rows if r[0] != r[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["u", "v"])


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (u, v) with u > v."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # minima are checkpointed, so that the joins have plain shuffles on both sides,
    # which adaptive execution splits where a node has very many links
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    low = reliable_checkpoint(low)
    large = (both.join(low, "u").where(F.col("v") > F.col("u"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
    low = reliable_checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
    return (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """-> (node, component): every node of a link with the smallest node it
    reaches. Alternates large-star and small-star steps (each a keyed minimum
    and a join) until the links no longer change; the number of rounds grows
    with the logarithm of the longest chain. Links with a NULL end are ignored."""
    e = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u != v")
    e = reliable_checkpoint(e.mapInArrow(_contract, "u bigint, v bigint"))
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(mark) == seen or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = tuple(mark)
        e = reliable_checkpoint(_stars(e))
