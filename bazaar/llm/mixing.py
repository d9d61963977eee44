"""Operator 4: mix sources to target weights by the cube method.

Every source has a target of words. A document of a source with
target/size = 2.3 is taken twice for sure and a third time with an inclusion
probability of 0.3. The cube method turns these probabilities into 0 or 1: in
a flight, the probabilities of three undecided documents move along the
null-space of the two balancing constraints (number of documents, number of
words) until one of them is settled, and the next document takes its place, so
both totals of the source stay exact. Flights run in blocks of about ``block``
documents of one source, drawn by a hash, so a hot source is many blocks. A
block ends with at most a few undecided documents, which form the blocks of
the next round (a thousandth of the rows). The last round lands what is left of
a source, at most a few documents, and evens out the words that this leaves
missing by exchanges.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaar.llm._tokens import NONSPACE, Words, slices, small_batches
from bazaar.session import reliable_checkpoint

_EPS = 1e-9


def flight(p: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Move probabilities to 0 or 1 while sum(p) and sum(p * size) hold; at most
    two entries (more only where three sizes agree by rounding) stay between."""
    p = list(p)
    open_: list[int] = []
    for i in range(len(p)):
        if _EPS < p[i] < 1 - _EPS:
            open_.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(open_) == 3:
            a, b, c = open_
            v = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if not any(v):
                v = (1.0, -1.0, 0.0)
            up = min(((1 - p[j]) if d > 0 else p[j]) / abs(d) for j, d in zip(open_, v) if d)
            down = min((p[j] if d > 0 else (1 - p[j])) / abs(d) for j, d in zip(open_, v) if d)
            move = up if rng.random() * (up + down) < down else -down
            for j, d in zip(open_, v):
                p[j] += move * d
                if p[j] < _EPS:
                    p[j] = 0.0
                elif p[j] > 1 - _EPS:
                    p[j] = 1.0
            open_ = [j for j in open_ if 0 < p[j] < 1]
    return p


def land(p: list[float], size: list[float]) -> list[float]:
    """Settle the last few entries: the 0/1 choice nearest to the number of
    documents, then the words, that they stand for. What is then missing in
    words (a long document is often the last one open) is made up by exchanges
    of a taken document for another: each time the one that leaves least
    missing, until none leaves half a word less."""
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    words, count = sum(p[i] * size[i] for i in open_), sum(p[i] for i in open_)
    best = min(itertools.product((0.0, 1.0), repeat=len(open_)),
               key=lambda t: (abs(sum(t) - count), abs(sum(x * size[i] for x, i in zip(t, open_)) - words)))
    p = list(p)
    for i, x in zip(open_, best):
        p[i] = x
    missing = words - sum(x * size[i] for x, i in zip(best, open_))
    s = np.array(size, np.float64)
    is_in = np.array(p) == 1.0
    while missing:
        taken, left = np.flatnonzero(is_in), np.flatnonzero(~is_in)
        if not len(taken) or not len(left):
            break
        taken = taken[np.argsort(s[taken], kind="stable")]
        near = np.searchsorted(s[taken], s[left] - missing)
        near = np.clip(np.stack([near - 1, near]), 0, len(taken) - 1)
        off = np.abs(s[left] - s[taken[near]] - missing)
        k, j = np.unravel_index(off.argmin(), off.shape)
        if off[k, j] > abs(missing) - 0.5:
            break
        missing -= s[left[j]] - s[taken[near[k, j]]]
        is_in[left[j]], is_in[taken[near[k, j]]] = True, False
    return [float(x) for x in is_in]


def _fly(level: int):
    """Rows sorted by (rank, block, ...): flights inside each block, and landing
    where the block is its source's only one."""
    def settle(t: pa.Table) -> pa.Table:
        p, size = t.column("p").to_pylist(), t.column("size").to_pylist()
        rank, block, blocks = (t.column(c)[0].as_py() for c in ("rank", "block", "blocks"))
        p = flight(p, size, random.Random(f"{level}:{rank}:{block}"))
        if blocks == 1:
            p = land(p, size)
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            while held.num_rows:
                rank, block = held.column("rank").to_numpy(), held.column("block").to_numpy()
                other = np.flatnonzero((rank != rank[0]) | (block != block[0]))
                if not len(other):
                    break
                yield from settle(held.slice(0, other[0])).to_batches()
                held = held.slice(other[0])
        if held is not None and held.num_rows:
            yield from settle(held).to_batches()
    return run


def _sizes(batches):
    words = Words(NONSPACE)
    for b in batches:
        for lo, hi, data, offs in slices(b.column("text")):
            _, _, at = words.spans(data, offs)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").slice(lo, hi - lo), b.column("source").slice(lo, hi - lo), pa.array(np.diff(at))],
                ["id", "source", "size"])


def source_targets(sized: DataFrame, weights=(5, 2, 1), most: float = 3.0) -> DataFrame:
    """-> (source, rank, n, source_size, target): shares of all words by weight,
    none above ``most`` times its source's size, the excess reshared by weight.
    The shares fill like water: the capped sources come first in the order of
    cap / weight, so running sums over one row per source give the level."""
    src = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    src = src.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    src = src.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    before = W.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    all_ = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    src = src.withColumn(
        "level", (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the level holds from the first source, in that order, whose cap is above its share
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("w"),
                         F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(all_)
    src = src.withColumn("level", first["level"])
    return src.select("source", "rank", "n", "source_size", F.coalesce(
        F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=(5, 2, 1), most: float = 3.0, block: int = 4096) -> DataFrame:
    """-> (doc_id, size, source_size, target, taken, copies), one row per input row.

    ``size`` counts runs of anything but ASCII white space (NULL: 0). Sources
    in code point order (NULL last) weigh ``weights`` in turn. ``copies`` is
    how often the mix takes the document, ``taken`` = size x copies; copies are
    0 to ``most``. Reruns on the same rows agree, however they are partitioned.

    Defined cases: NULL is a source of its own; a source without words has
    target 0 and none of its documents is taken. Rows that repeat an id are
    separate documents. No rows give no rows. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"),
                      F.col(text_col).cast("string").alias("text"))
    sized = reliable_checkpoint(src.mapInArrow(_sizes, "id bigint, source string, size bigint"))
    targets = reliable_checkpoint(source_targets(sized, weights, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (sized.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .select("id", "size", "rank", "source_size", "target", F.floor(ratio).cast("int").alias("base"),
                    (ratio - F.floor(ratio)).alias("p")))
    columns = "id bigint, size bigint, rank int, source_size bigint, target double, base int, p double"
    settled = rows.where(f"p <= {_EPS} OR p >= 1 - {_EPS}")
    todo = rows.where(f"p > {_EPS} AND p < 1 - {_EPS}")
    count = F.col("n")
    for level in itertools.count():
        # one row per source
        left = todo.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
        blocks = F.ceil(count / F.lit(float(block))).cast("int")
        sizes = left.select(F.col("rank").alias("r"), blocks.alias("blocks"))
        last = (sizes.agg(F.max("blocks")).first()[0] or 1) == 1
        dealt = (todo.join(sizes, F.col("rank") == F.col("r")).drop("r")
                 .withColumn("h", F.xxhash64(F.lit(level), "id", "size"))
                 .withColumn("block", F.pmod("h", F.col("blocks")).cast("int")))
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        flown = (dealt.select(*[c.split()[0] for c in columns.split(", ")], "blocks", "block", "h")
                 .repartition(n, "rank", "block").sortWithinPartitions("rank", "block", F.desc("size"), "h", "id")
                 .mapInArrow(_fly(level), f"{columns}, blocks int, block int, h bigint")
                 .drop("blocks", "block", "h"))
        flown = reliable_checkpoint(flown)
        settled = settled.unionByName(flown.where("p = 0 OR p = 1") if not last else flown)
        if last:
            break
        todo = flown.where("p > 0 AND p < 1")
    copies = F.least(F.col("base") + F.round("p").cast("int"), F.lit(int(most)))
    return settled.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                          (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"))
