"""Operator 9: shards of near-equal bytes from sampled splitters.

The key of a record is (hash of its text, id), so equal texts are neighbours.

1. A slim table (key, id, size, crc) is taken from the texts once.
2. Records are sampled with a chance in proportion to their size (about
   ``sample`` rows a range, so the driver's share is ``sample`` x ranges rows
   whatever the input). Weighted quantiles of the sample become splitters. A
   splitter falls on the border of a text's copies; only a text whose copies
   fill more than one range is cut inside, by id.
3. Records are dealt to ranges and ranges measured exactly; overfull ranges
   are sampled again, more densely, and subdivided.
4. Whole ranges go to shards by their running total of bytes, so a shard is
   off its share by at most about one range; slots number the records inside
   a range (a bounded group) after the exact count of the ranges before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaar.session import reliable_checkpoint

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SCHEMA = "id bigint, size bigint, crc bigint, key bigint"


def choose_splitters(sample: list[tuple[int, int, float]], step: float) -> list[tuple[int, int]]:
    """Weighted quantiles, about ``step`` apart, of sampled (key, id, weight)."""
    sample = sorted(sample)
    out: set[tuple[int, int]] = set()
    run, due, last = 0.0, step, None
    for key, rid, weight in sample:
        run += weight
        if run < due:
            continue
        due = run + step
        if key == last:  # copies of one text fill a range: cut among them
            out |= {(key, rid), (key, _HIGH)}
        else:
            out.add((key, _LOW))
        last = key
    return sorted(out)


def range_of(keys: np.ndarray, ids: np.ndarray, splitters: list[tuple[int, int]]) -> np.ndarray:
    """Number of splitters at or below each (key, id)."""
    k = np.array([s[0] for s in splitters], np.int64)
    i = np.array([s[1] for s in splitters], np.int64)
    lo, hi = np.searchsorted(k, keys, "left"), np.searchsorted(k, keys, "right")
    out = lo.copy()
    tied = np.flatnonzero(hi > lo)
    for a in np.unique(lo[tied]):
        rows = tied[lo[tied] == a]
        out[rows] = a + np.searchsorted(i[a:hi[rows[0]]], ids[rows], "right")
    return out


def _deal(splitters, shard=None, base=None):
    def run(batches):
        for b in batches:
            ids = b.column("id").fill_null(_LOW + 1).to_numpy(zero_copy_only=False)
            r = range_of(b.column("key").to_numpy(), ids, splitters)
            cols, names = list(b.columns) + [pa.array(r)], [*b.schema.names, "rng"]
            if shard is not None:
                cols += [pa.array(shard[r]), pa.array(base[r])]
                names += ["shard", "base"]
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                   ranges_per_shard: int = 128, rows_per_range: int = 2_000_000, sample: int = 32,
                   rounds: int = 3) -> DataFrame:
    """-> (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    ``size`` is the text's UTF-8 bytes plus 1 (NULL: 1, CRC 0). The law is
    `bytes`: shards hold near-equal sums of ``size``; ``grown_shard`` is NULL.
    Copies of a text share a shard unless they fill over one of the
    ``ranges_per_shard`` parts of it. Slots run from 0 without gaps.

    Defined cases: a NULL id sorts before all others among its text's copies.
    Rows equal in id and text cannot be told apart, so they stay in one range.
    No rows give no rows; fewer rows than shards leave shards empty. Other
    columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = reliable_checkpoint(docs.select(
        F.col(id_col).cast("bigint").alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key")))
    n, total = slim.agg(F.count(F.lit(1)), F.sum("size")).first()
    n_ranges = max(shards * ranges_per_shard, (n or 0) // rows_per_range)
    step = (total or 1) / n_ranges
    u = F.pmod(F.xxhash64(F.lit("shard"), "key", "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def draw(df: DataFrame, every: float) -> list[tuple[int, int, float]]:
        rows = df.where(u * every < F.col("size")).select("key", "id", "size").toLocalIterator()
        return [(r.key, _LOW + 1 if r.id is None else r.id, max(float(r.size), every)) for r in rows]

    cuts = choose_splitters(draw(slim, step / sample), step) if n else []
    measured: dict[int, tuple[int, int]] = {}
    for again in range(rounds + 1):
        dealt = slim.mapInArrow(_deal(cuts), f"{SCHEMA}, rng bigint")
        # one row per range
        measured = {r.rng: (r.b, r.c) for r in dealt.groupBy("rng").agg(
            F.sum("size").alias("b"), F.count(F.lit(1)).alias("c")).collect()}
        over = [r for r, (b, c) in measured.items() if b > 2 * step and c > 1]
        if not over or again == rounds:
            break
        every = step / (sample * 4 ** (again + 1))
        more = set(choose_splitters(draw(dealt.where(F.col("rng").isin(over)), every), step))
        if more <= set(cuts):
            break
        cuts = sorted(more | set(cuts))

    shard, base = np.zeros(len(cuts) + 1, np.int32), np.zeros(len(cuts) + 1, np.int64)
    run, filled = 0, [0] * shards
    for r in sorted(measured):
        b, c = measured[r]
        s = min(shards - 1, int(shards * (run + b / 2) / total))
        shard[r], base[r] = s, filled[s]
        run, filled[s] = run + b, filled[s] + c
    dealt = slim.mapInArrow(_deal(cuts, shard, base), f"{SCHEMA}, rng bigint, shard int, base bigint")
    at = F.row_number().over(W.partitionBy("rng").orderBy("key", "id"))
    return dealt.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("base") + at - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
