"""Operator 8: near-duplicate documents by circulant MinHash.

A document is its set of distinct word 5-grams. Its signature needs only two
permutations: ``sigma`` scrambles the shingles onto a circle of 2^32 places,
and coordinate k is the smallest ``pi(sigma(x) + k)``, that is the one second
permutation ``pi`` shifted by k places around the circle. Runs of coordinates
form bands; documents that agree in a band share a bucket.

1. One pass over the texts gives (id, set size, set hash, band keys).
2. Equal sets become one node at once, so copies are never compared.
3. Buckets with two nodes or more are kept once per distinct member list.
4. A bucket's texts meet in one task, where exact Jaccard similarities of the
   full sets are taken from the members' shingle lists; only links that join
   two parts are written (never pairs). A bucket of over ``block`` members is
   cut into blocks and every pair of blocks is a task of its own, so no
   member pair is skipped and no task holds more than two blocks.
5. Links become components by star contraction.

With ``bands`` x ``rows`` = 24 x 5 a pair at the threshold 0.85 is missed by
all bands with a chance of (1 - 0.85^5)^24 = 8e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm._graph import connected_components, find, union
from bazaar.llm._tokens import NONSPACE, U64, Words, add_at, mix64, slices, small_batches, windows
from bazaar.session import reliable_checkpoint


def pi(x: np.ndarray) -> np.ndarray:
    """The second permutation, of the 2^32 places (a bijective scramble)."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(words: Words, data: np.ndarray, offs: np.ndarray, size: int):
    """Sorted distinct shingles of each text, concatenated, and their offsets."""
    h, at = words.hashes(data, offs)
    s, at = windows(h, at, size)
    sets = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        x = np.sort(s[lo:hi])
        sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])


def circulant_signature(sets: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """(texts, size) coordinates; rows of texts without shingles mean nothing."""
    sigma = (mix64(sets ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(np.uint32)
    return np.stack([add_at(pi(sigma + np.uint32(k)), at, np.minimum) for k in range(size)], axis=1)


def _describe(shingle: int, bands: int, rows: int):
    def run(batches):
        words = Words(NONSPACE)
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                sets, at = shingle_sets(words, data, offs, shingle)
                n = np.diff(at)
                marks = np.stack([add_at(mix64(sets ^ U64(c)), at) for c in (0x1234567, 0x89ABCDEF01)], axis=1)
                sig = circulant_signature(sets, at, bands * rows).astype(U64)
                keys = np.empty((hi - lo, bands), U64)
                for j in range(bands):
                    k = np.full(hi - lo, j + 1, U64)
                    for c in range(j * rows, (j + 1) * rows):
                        k = mix64(k * U64(0x9E3779B97F4A7C15) + sig[:, c])
                    keys[:, j] = k
                some = n > 0
                raw = np.ascontiguousarray(marks).view(np.uint8).reshape(hi - lo, 16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n),
                     pa.array([r.tobytes() if ok else None for r, ok in zip(raw, some, strict=True)], pa.binary()),
                     pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32),
                                              keys[some].ravel().view(np.int64))],
                    ["id", "n", "hid", "bands"])
    return run


def _groups(batches, n_keys: int):
    """Rows of sorted batches by equal leading key columns, across batch borders."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        cut = np.zeros(t.num_rows, bool)
        cut[0] = True
        for c in range(n_keys):
            k = t.column(c).to_numpy()
            cut[1:] |= k[1:] != k[:-1]
        at = np.append(np.flatnonzero(cut), t.num_rows)
        if len(at) > 2:
            yield t.slice(0, at[-2]), at[:-1]
        held = t.slice(at[-2])
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _links(shingle: int, percent: int):
    """Exact links of each bucket (columns key, lo, hi, part, id, text), as a forest."""
    def linked(hub: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(x) for x in members])
        fits = (100 * np.minimum(sizes, len(hub)) >= percent * np.maximum(sizes, len(hub)))
        out = np.zeros(len(members), bool)
        if not fits.any():
            return out
        some = np.flatnonzero(fits)
        every = np.concatenate([members[i] for i in some])
        spot = np.minimum(np.searchsorted(hub, every), len(hub) - 1)
        at = np.concatenate([[0], np.cumsum(sizes[some])])
        both = np.add.reduceat((hub[spot] == every).astype(np.int64), at[:-1])
        out[some] = 100 * both >= percent * (sizes[some] + len(hub) - both)
        return out

    def run(batches):
        words = Words(NONSPACE)
        for table, at in _groups(batches, 3):
            ids = table.column("id").to_numpy()
            part, lo, hi = (table.column(c).to_numpy() for c in ("part", "lo", "hi"))
            sets: list[np.ndarray] = []
            for _, _, data, offs in slices(table.column("text")):
                s, so = shingle_sets(words, data, offs, shingle)
                sets += [s[i:j] for i, j in zip(so[:-1], so[1:], strict=True)]
            found = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                parent: dict = {}
                across = lo[a] != hi[a]  # two blocks: pairs inside a block are another task's
                for i in range(a, b):
                    if across and part[i] != lo[a]:
                        continue
                    mine = find(parent, ids[i])
                    rest = [j for j in (range(a, b) if across else range(i + 1, b))
                            if (part[j] == hi[a] or not across) and find(parent, ids[j]) != mine]
                    if rest:
                        for j in np.flatnonzero(linked(sets[i], [sets[j] for j in rest])):
                            if union(parent, int(ids[i]), int(ids[rest[j]])):
                                found.append((int(ids[i]), int(ids[rest[j]])))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 85, bands: int = 24, rows: int = 5, block: int = 256) -> DataFrame:
    """-> (doc_id, n_shingles, component_id, kept), one row per input row.

    Documents whose distinct shingle sets have a Jaccard similarity of at
    least ``percent``/100 are linked; a component is named by its smallest id,
    whose document is kept. Words are runs of anything but ASCII white space,
    A-Z lower-cased; a text of fewer than ``shingle`` words is one shingle.

    Defined cases: NULL, empty or blank text has no shingles, links with
    nothing and stays alone. Rows that repeat an id are one document with
    respect to links (equal texts or not) and all are returned. A row with a
    NULL id links with nothing: its component is NULL and it is kept. Other
    columns of ``docs`` are not looked at. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    told = reliable_checkpoint(src.mapInArrow(
        _describe(shingle, bands, rows), "id bigint, n bigint, hid binary, bands array<bigint>"))

    # one node per distinct set: copies of any number are one row from here on
    nodes = reliable_checkpoint(told.where("hid IS NOT NULL AND id IS NOT NULL").groupBy("hid")
                                .agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands")))
    placed = nodes.select("rep", F.explode("bands").alias("key"))
    mark = [F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "rep")).alias("x2")]
    buckets = (placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("low"),
                                         F.max("rep").alias("high"), *mark).where("low != high")
               # the same members under several bands are compared once
               .groupBy("m", "x1", "x2").agg(F.min("key").alias("key")).select("key", "m"))
    parts = F.ceil(F.col("m") / F.lit(block)).cast("int")
    member = (placed.join(buckets, "key").select("key", "rep", parts.alias("g"))
              .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
              .select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
                      "part", "rep"))
    member = reliable_checkpoint(member)
    texts = src.where("id IS NOT NULL").withColumnRenamed("id", "rep")
    met = member.join(texts, "rep").select("key", "lo", "hi", "part", F.col("rep").alias("id"), "text")
    n = _partitions(docs)
    links = (met.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
             .mapInArrow(_links(shingle, percent), "a bigint, b bigint"))
    # rows that repeat an id with another text tie two nodes together
    comp = connected_components(links, "a", "b")

    named = nodes.select("hid", "rep").join(comp, F.col("rep") == F.col("node"), "left").select(
        "hid", F.coalesce("component", "rep").alias("component"))
    out = told.select("id", "n", F.when(F.col("id").isNotNull(), F.col("hid")).alias("hid"))
    out = out.join(named, "hid", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
