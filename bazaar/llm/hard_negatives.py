"""Operator 12: hard-negative mining with Four-Russians scoring.

Components are whole numbers (floor of ``scale`` times the component), so a
score is an exact integer inner product. It is taken without multiplying:

* an anchor's dimensions are cut into groups of eight; for each group the 256
  sums of subsets of its components are tabled, each from a smaller subset
  with one addition;
* a candidate is stored as bit planes: byte (plane, group) holds that bit of
  the group's eight components, so it is an index into the group's table;
* score = the planes' table sums, shifted and added from the sign plane down.

Anchors and rows meet in a grid of blocks: one task holds one block of each
and scores all of its pairs, so nothing but tops of blocks is written.

1. Positives: blocks inside one label (a hot label is many blocks); the best
   five per anchor and block, then per anchor.
2. Negatives: every anchor block with every candidate block; per positive the
   best three in its score window per block, then over all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm._tokens import small_batches
from bazaar.operators.ranking import count_groups, join_groups
from bazaar.session import reliable_checkpoint

GROUP = 8        # dimensions of a table: 256 subset sums
AT_ONCE = 64     # anchors whose tables are held together
CHUNK = 4096     # candidates scored at a time


def pack_planes(v: np.ndarray, planes: int) -> np.ndarray:
    """(rows, dims) whole numbers -> (planes, groups, rows) bytes, two's complement, lowest plane first."""
    rows, dims = v.shape
    groups = -(-dims // GROUP)
    wide = np.zeros((rows, groups * GROUP), np.int64)
    wide[:, :dims] = v
    bits = np.stack([np.packbits(((wide >> p) & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(planes)])
    return np.ascontiguousarray(bits.transpose(0, 2, 1))


def subset_tables(anchors: np.ndarray, dtype) -> np.ndarray:
    """(anchors, dims) -> (groups, 256, anchors): the sum of every subset of each eight dimensions."""
    n, dims = anchors.shape
    groups = -(-dims // GROUP)
    wide = np.zeros((n, groups * GROUP), dtype)
    wide[:, :dims] = anchors
    parts = wide.reshape(n, groups, GROUP).transpose(1, 2, 0)
    out = np.zeros((groups, 1 << GROUP, n), dtype)
    for d in range(GROUP):
        out[:, 1 << d:2 << d] = out[:, :1 << d] + parts[:, d:d + 1]
    return out


def four_russians(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors) exact scores by table look-ups, shifts and additions."""
    groups, _, anchors = tables.shape
    total = np.zeros((planes.shape[2], anchors), tables.dtype)
    looked = np.empty_like(total)
    for p in range(planes.shape[0] - 1, -1, -1):
        total += total
        sign = p == planes.shape[0] - 1  # the highest plane counts negative
        for g in range(groups):
            np.take(tables[g], planes[p, g], axis=0, out=looked, mode="clip")
            if sign:
                total -= looked
            else:
                total += looked
    return total


def _matrix(column, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dims)


def _scores(left: pa.Table, right: pa.Table):
    """Blocks of scores: (first anchor, first candidate, (candidates, anchors) scores)."""
    dims, bits = (left.column(c)[0].as_py() for c in ("dims", "bits"))
    a = _matrix(left.column("v"), dims)
    raw = b"".join(right.column("planes").to_pylist())
    groups = -(-dims // GROUP)
    packed = np.frombuffer(raw, np.uint8).reshape(right.num_rows, bits, groups)
    narrow = dims << (2 * (bits - 1)) < 1 << 31
    for lo in range(0, len(a), AT_ONCE):
        tables = subset_tables(a[lo:lo + AT_ONCE], np.int32 if narrow else np.int64)
        for c in range(0, right.num_rows, CHUNK):
            planes = np.ascontiguousarray(packed[c:c + CHUNK].transpose(1, 2, 0))
            yield lo, c, four_russians(tables, planes)


def _best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k places of ``at`` with the highest scores, ties by place (rows lie in id order)."""
    if len(at) > k:
        s = scores[at]
        least = np.partition(s, len(s) - k)[len(s) - k]
        at = at[s >= least]
    return at[np.argsort(-scores[at], kind="stable")][:k]


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            mine, uid, ids = left.column("uid").to_numpy(), right.column("uid").to_numpy(), right.column("id").to_numpy()
            for lo, c, block in _scores(left, right):
                for j in range(block.shape[1]):
                    s = block[:, j]
                    at = _best(s, np.flatnonzero(uid[c:c + len(s)] != mine[lo + j]), k)
                    out += zip([mine[lo + j]] * len(at), ids[c + at], s[at])
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array([int(x) for x in c], pa.int64()) for c in cols], ["uid", "positive_id", "score"])
    return run


def _negatives(k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            mine, own = left.column("uid").to_numpy(), left.column("label").to_numpy()
            windows = left.column("positives").to_pylist()
            ids, label = right.column("id").to_numpy(), right.column("label").to_numpy()
            # 100 * score stays a long: first and last whole score of each window
            bounds = [[(p["place"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in w] for w in windows]
            for lo, c, block in _scores(left, right):
                for j in range(block.shape[1]):
                    b = [x for x in bounds[lo + j] if x[1] <= x[2]]
                    if not b:
                        continue
                    s = block[:, j]
                    at = np.flatnonzero((s >= min(x[1] for x in b)) & (s <= max(x[2] for x in b)))
                    at = at[label[c + at] != own[lo + j]]
                    for place, first, last in b:
                        for i in _best(s, at[(s[at] >= first) & (s[at] <= last)], k):
                            out.append((mine[lo + j], place, ids[c + i], s[i]))
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table([pa.array([int(x) for x in c], pa.int64()) for c in cols], ["uid", "place", "negative_id", "score"])
    return run


def _pack(batches):
    """Appends each row's bit planes to it."""
    for batch in batches:
        dims, bits = (batch.column(c).to_numpy() for c in ("dims", "bits"))
        planes = [None] * batch.num_rows
        for d, b in set(zip(dims.tolist(), bits.tolist())):
            at = np.flatnonzero((dims == d) & (bits == b))
            packed = pack_planes(_matrix(batch.column("v").take(pa.array(at)), d), b).transpose(2, 0, 1)
            for i, row in zip(at, packed):
                planes[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(planes, pa.binary())],
                                         [*batch.schema.names, "planes"])


def _top(df: DataFrame, by: list[str], id_col: str, k: int, out: str) -> DataFrame:
    """The k best rows per group, numbered; each task first cuts its own rows to k a group."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(id_col))
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def _grid(anchors: DataFrame, rows: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """Every anchor block with every row block of equal keys (columns a_blocks, r_blocks say how many there are)."""
    place = F.pmod(F.xxhash64("uid"), F.col("a_blocks")).cast("int"), F.pmod(F.xxhash64("uid"), F.col("r_blocks")).cast("int")
    each = [F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1)) for c in ("a_blocks", "r_blocks")]
    left = anchors.withColumn("ab", place[0]).withColumn("rb", each[1])
    right = rows.where("a_blocks > 0").withColumn("rb", place[1]).withColumn("ab", each[0])
    by = [*keys, "ab", "rb"]
    left = left.toDF(*left.columns)  # both sides come from one table: fresh columns tell them apart
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(fn, schema)


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: int = 256, anchor_block: int = 512, row_block: int = 8192) -> DataFrame:
    """-> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score, label, negatives_found).

    Anchors are the rows whose id is divisible by ``every``. An anchor's
    positives are its best other rows of its label; for each, the best rows of
    other labels with low * positive_score <= 100 * score <= high *
    positive_score. Higher scores come first, ties by smaller id.

    Defined cases: rows with a NULL id, label or vector, or with any NULL or
    non-finite component, take no part; nor do rows with a component so large
    that a score might leave the range of a long (for 64 dimensions, beyond
    +-2^28 after scaling). Only vectors of one length are compared; empty ones
    all score 0. Rows that repeat an id are rows of their own: each is an
    anchor, a positive (of its twin too) and a negative. A positive with a
    negative score has no window, one that scores 0 the window [0, 0]. Anchors
    without positives or fitting negatives have no rows. Other columns are not
    looked at. No rows give no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    least = F.lit((1 << 63) - 1) / F.greatest(F.size(vector_col), F.lit(1)).cast("double")
    fits = F.forall(F.col(vector_col).cast("array<double>"), lambda x: F.coalesce(
        (F.abs(x) < F.lit(float("inf"))) & (F.abs(x * F.lit(float(scale))) + 1 < F.sqrt(least) * 0.999), F.lit(False)))
    src = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                      F.size(vector_col).alias("dims"), F.when(fits, whole).alias("v")).where(
        "id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    src = reliable_checkpoint(src.withColumn("uid", F.monotonically_increasing_id()))

    # bits of the widest component per length: bounded by the number of lengths, of which there are few
    anchor = F.col("id") % every == 0
    stats = src.groupBy("dims", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(anchor, 1)).alias("a"),
        F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.greatest(x, -x - 1))), F.lit(0))).alias("most"))
    stats = reliable_checkpoint(stats)
    blocks = lambda c, size: F.ceil(F.col(c) / F.lit(size)).cast("bigint")
    lengths = stats.groupBy("dims").agg(
        blocks_sum("a", anchor_block).alias("a_all"), blocks_sum("n", row_block).alias("r_all"),
        (F.length(F.bin(F.max("most"))) + F.when(F.max("most") > 0, 1).otherwise(0)).cast("int").alias("bits"))
    groups = stats.select("dims", "label", blocks("a", anchor_block).alias("a_blocks"),
                          blocks("n", row_block).alias("r_blocks"))
    n_groups, n_lengths = count_groups(stats, ["dims", "label"]), count_groups(stats, ["dims"])
    told = join_groups(join_groups(src, groups, ["dims", "label"], n_groups), lengths, ["dims"], n_lengths)
    told = told.select("uid", "id", "label", "dims", "bits", "v", "a_blocks", "r_blocks", "a_all", "r_all")
    packed = told.mapInArrow(_pack, "uid bigint, id bigint, label bigint, dims int, bits int, v array<bigint>, "
                             "a_blocks bigint, r_blocks bigint, a_all bigint, r_all bigint, planes binary")
    packed = reliable_checkpoint(packed)
    anchors = packed.where(anchor).select("uid", "id", "label", "dims", "bits", "v", "a_blocks", "r_blocks",
                                          "a_all", "r_all")
    pool = packed.drop("v")

    found = _grid(anchors, pool, ["dims", "label"], _positives(positives), "uid bigint, positive_id bigint, score bigint")
    pos = reliable_checkpoint(_top(found, ["uid"], "positive_id", positives, "place"))
    marked = pos.groupBy("uid").agg(F.collect_list(F.struct("place", "score")).alias("positives"))
    asked = (anchors.drop("a_blocks", "r_blocks").join(marked, "uid")
             .withColumnRenamed("a_all", "a_blocks").withColumnRenamed("r_all", "r_blocks"))
    met = _grid(asked, pool.drop("a_blocks", "r_blocks").withColumnRenamed("a_all", "a_blocks")
                .withColumnRenamed("r_all", "r_blocks"), ["dims"], _negatives(negatives, low, high),
                "uid bigint, place bigint, negative_id bigint, score bigint")
    neg = _top(met, ["uid", "place"], "negative_id", negatives, "rank")
    neg = neg.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("uid", "place")))
    named = anchors.select("uid", F.col("id").alias("anchor_id"), "label")
    told = pos.select("uid", F.col("place").cast("bigint").alias("place"), "positive_id",
                      F.col("score").alias("positive_score")).join(named, "uid")
    return neg.withColumnRenamed("score", "negative_score").join(told, ["uid", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "label",
        F.col("found").alias("negatives_found"))


def blocks_sum(column: str, size: int):
    """Blocks of ``size`` for a column's total."""
    return F.ceil(F.sum(column) / F.lit(size)).cast("bigint")
