"""Exact global numbering, tiles and quantiles without a single-partition window.

``ROW_NUMBER() OVER (ORDER BY ...)`` with no PARTITION BY plans as an
``Exchange SinglePartition``: every row goes to one task. The same happens to
one hot group of a partitioned window. Here instead:

1. range-partition on (group keys, order keys, tie-break) and sort inside
   each partition -- the range bounds come from sampling, and the tie-break
   lets them fall inside a hot key value, so no task gets a whole group;
2. ``checkpoint()`` the sorted data to the reliable checkpoint folder, so the
   partition contents and their order are fixed (range bounds are sampled,
   and a recomputed lineage after an executor loss could move rows);
3. count rows per (partition, group): at most #partitions + #groups rows;
4. a prefix sum over that small table gives every (partition, group) the
   number of rows before it; each row adds its position inside the partition
   (``monotonically_increasing_id`` is dense within one partition).

Driver round trips: the eager checkpoint job, and for one global order (no
groups) the per-partition counts, one row per range partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.session import reliable_checkpoint

_PID, _MID, _CNT, _FIRST, _OFF, _N = "_rk_pid", "_rk_mid", "_rk_cnt", "_rk_first", "_rk_off", "_rk_n"


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def sorted_checkpoint(df: DataFrame, sort_keys: Sequence[Column], num_partitions: int | None = None,
                      materialised: bool = False) -> DataFrame:
    """Range-partition + sort ``df`` on ``sort_keys`` and checkpoint it reliably.

    The range partitioner samples its input in a separate pass before the
    shuffle; the input is persisted for that span so it is computed once. A
    lost cached block is recomputed with the same rows, and the bounds are
    already fixed by then, so the checkpoint sees the same partitions. An input
    that is ``materialised`` (a projection of a checkpoint) is read twice instead.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if materialised:
        return reliable_checkpoint(df.repartitionByRange(n, *sort_keys).sortWithinPartitions(*sort_keys))
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return reliable_checkpoint(src.repartitionByRange(n, *sort_keys).sortWithinPartitions(*sort_keys))
    finally:
        src.unpersist()


def global_row_number(df: DataFrame, order_by: Sequence[Column | str], partition_by: Sequence[str] = (),
                      out: str = "rn", tiebreak: Sequence[Column | str] = (), with_group_size: str | None = None,
                      num_partitions: int | None = None, materialised: bool = False) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY partition_by ORDER BY order_by, tiebreak)``.

    ``order_by`` are sort expressions (``F.desc('x')`` ...). ``tiebreak``
    columns are appended to the sort (ascending) and should make it unique or,
    where equal rows are interchangeable, at least spread a hot value.
    ``with_group_size`` names an extra output column with the row count of
    the row's group (what NTILE and quantiles need).
    """
    part = list(partition_by)
    keys = [F.asc_nulls_first(p) for p in part] + _cols(order_by) + [F.asc_nulls_first(c) for c in _cols(tiebreak)]
    cp = sorted_checkpoint(df, keys, num_partitions, materialised)
    lab = cp.withColumn(_PID, F.spark_partition_id()).withColumn(_MID, F.monotonically_increasing_id())

    if not part:
        return _number_unpartitioned(cp, lab, out, with_group_size)
    # the small statistics side carries its own column names: no self-join ambiguity
    gk = [f"_rk_g{i}" for i in range(len(part))]
    stats = lab.groupBy(F.col(_PID).alias("_rk_spid"), *[F.col(p).alias(g) for p, g in zip(part, gk)]).agg(
        F.count(F.lit(1)).alias(_CNT), F.min(_MID).alias(_FIRST))
    # prefix sums per group over that group's partitions (a group spans few partitions)
    w = Window.partitionBy(*gk).orderBy("_rk_spid")
    stats = stats.withColumn(_OFF, F.sum(_CNT).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    if with_group_size:
        stats = stats.withColumn(_N, F.sum(_CNT).over(Window.partitionBy(*gk)))
    stats = stats.drop(_CNT)
    cond = F.col(_PID) == F.col("_rk_spid")
    for p, g in zip(part, gk):
        cond = cond & F.col(p).eqNullSafe(F.col(g))
    joined = lab.join(stats, cond)
    rn = (F.coalesce(F.col(_OFF), F.lit(0)) + (F.col(_MID) - F.col(_FIRST)) + 1).alias(out)
    extra = [F.col(_N).alias(with_group_size)] if with_group_size else []
    return joined.select(*[F.col(c) for c in cp.columns], rn, *extra)


def _number_unpartitioned(cp: DataFrame, lab: DataFrame, out: str, with_group_size: str | None) -> DataFrame:
    """One global order: gather the row count of each range partition (one
    small row per partition, as ``zipWithIndex`` does), turn it into offsets
    on the driver and broadcast that table back (bounded by the partition count)."""
    spark = cp.sparkSession
    counts = sorted(tuple(r) for r in lab.groupBy(_PID).agg(F.count(F.lit(1)), F.min(_MID)).collect())
    rows, total = [], 0
    for pid, cnt, first in counts:
        rows.append((pid, total, first))
        total += cnt
    offs = spark.createDataFrame(rows, f"_rk_spid int, {_OFF} long, {_FIRST} long")
    joined = lab.join(F.broadcast(offs), F.col(_PID) == F.col("_rk_spid"))
    rn = (F.col(_OFF) + (F.col(_MID) - F.col(_FIRST)) + 1).alias(out)
    extra = [F.lit(total).cast("bigint").alias(with_group_size)] if with_group_size else []
    return joined.select(*[F.col(c) for c in cp.columns], rn, *extra)


def tile_of(rn: str, n: str, tiles: int) -> Column:
    """NTILE(tiles) of the 1-based row number in column ``rn`` among ``n`` rows
    (integer arithmetic): the first n mod tiles tiles hold one row more."""
    q, r = f"({n} div {tiles})", f"({n} % {tiles})"
    big = f"({r} * ({q} + 1))"
    return F.expr(f"CAST(CASE WHEN {rn} <= {big} THEN ({rn} - 1) div ({q} + 1) + 1 "
                  f"ELSE {r} + ({rn} - {big} - 1) div nullif({q}, 0) + 1 END AS BIGINT)")


def global_ntile(df: DataFrame, tiles: int, order_by: Sequence[Column | str], out: str,
                 partition_by: Sequence[str] = (), tiebreak: Sequence[Column | str] = ()) -> DataFrame:
    """``NTILE(tiles) OVER (PARTITION BY .. ORDER BY ..)`` computed without a one-task window."""
    numbered = global_row_number(df, order_by, partition_by, out="_rk_rn", tiebreak=tiebreak,
                                 with_group_size="_rk_size")
    return (numbered.withColumn(out, tile_of("_rk_rn", "_rk_size", tiles))
            .drop("_rk_rn", "_rk_size"))


def value_positions(df: DataFrame, value: str, by: Sequence[str], count: str | None = None) -> DataFrame:
    """Distinct values per group with their count and their 1-based position
    range in the group's sorted order: (by..., value, _w, _cs, _ce, _n).

    Rows are first reduced to a (group, value) -> count histogram (partial
    aggregation: a value held by a third of all rows becomes one row), then
    the histogram is range-partitioned, checkpointed and given running
    counts: per partition by a window over that partition's slice of a group,
    across partitions by prefix sums over per-(partition, group) totals.
    NULL values are ignored. ``by`` must not be empty. ``count`` names a column
    with the number of rows that a row of ``df`` stands for. The result is
    checkpointed, so several quantiles read one small table.
    """
    by = list(by)
    rows = F.count(F.lit(1)) if count is None else F.sum(count)
    h = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(rows.alias("_w"))
    cp = sorted_checkpoint(h, [F.asc_nulls_first(b) for b in by] + [F.asc(value)])
    lab = cp.withColumn(_PID, F.spark_partition_id())
    gk = [f"_rk_g{i}" for i in range(len(by))]
    stats = lab.groupBy(F.col(_PID).alias("_rk_spid"), *[F.col(b).alias(g) for b, g in zip(by, gk)]).agg(
        F.sum("_w").alias(_CNT))
    stats = (stats.withColumn(_OFF, F.sum(_CNT).over(Window.partitionBy(*gk).orderBy("_rk_spid")
                                                     .rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn(_N, F.sum(_CNT).over(Window.partitionBy(*gk))).drop(_CNT))
    local = F.sum("_w").over(Window.partitionBy(_PID, *by).orderBy(value)
                             .rowsBetween(Window.unboundedPreceding, 0))
    lab = lab.withColumn("_ce_local", local)
    cond = F.col(_PID) == F.col("_rk_spid")
    for b, g in zip(by, gk):
        cond = cond & F.col(b).eqNullSafe(F.col(g))
    ce = F.coalesce(F.col(_OFF), F.lit(0)) + F.col("_ce_local")
    return reliable_checkpoint(lab.join(stats, cond).select(
        *by, value, "_w", (ce - F.col("_w") + 1).alias("_cs"), ce.alias("_ce"), F.col(_N).alias("_n")))


#: Groups up to which a table with one row per group is sent to every task.
MAX_BROADCAST_GROUPS = 100_000


def join_groups(rows: DataFrame, groups: DataFrame, by: Sequence[str], n_groups: int, how: str = "inner",
                null_safe: bool = True, spread: int = 64) -> DataFrame:
    """``rows`` joined with a table of one row per group, without dealing the
    rows out by a few group keys: up to ``MAX_BROADCAST_GROUPS`` groups
    (``n_groups`` is their counted number) the table is broadcast; beyond, rows
    get a salt and every group's row is repeated ``spread`` times, so that a hot
    group is that many join keys. With ``null_safe`` a NULL group is a group."""
    tmp = {k: f"_ns_{i}" for i, k in enumerate(by)}
    g = groups.select(*[F.col(c).alias(tmp[c]) if c in tmp else F.col(c) for c in groups.columns])
    cond, extra = F.lit(True), list(tmp.values())
    if n_groups <= MAX_BROADCAST_GROUPS:
        g = F.broadcast(g)
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(spread)))
        g = g.withColumn("_gsalt", F.explode(F.expr(f"sequence(0L, {spread - 1}L)")))
        cond, extra = rows["_salt"] == g["_gsalt"], [*extra, "_salt", "_gsalt"]
    for k in by:
        cond = cond & (rows[k].eqNullSafe(g[tmp[k]]) if null_safe else rows[k] == g[tmp[k]])
    return rows.join(g, cond, how).drop(*extra)


def count_groups(df: DataFrame, by: Sequence[str]) -> int:
    return df.select(*by).distinct().count()


def positions_quantiles(pos: DataFrame, value: str, by: Sequence[str], probs: Sequence[float],
                        names: Sequence[str], bounds: DataFrame | None = None,
                        with_min_max_count: bool = False, n_groups: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles from ``value_positions``, over all
    values of each group or, with ``bounds`` (by..., _lo, _hi), over the values
    inside [_lo, _hi] only -- a contiguous run of the sorted order, so no new
    sort is needed. Groups with no value inside drop out. ``n_groups`` (counted
    if not given) is the number of groups."""
    by = list(by)
    n_groups = count_groups(pos, by) if n_groups is None else n_groups
    v = F.col(value)
    if bounds is None:
        level = pos.groupBy(*by).agg(F.lit(0).cast("bigint").alias("_below"), F.max("_n").alias("_m"))
    else:
        j = join_groups(pos, bounds, by, n_groups)
        inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
        level = j.groupBy(*by).agg(F.coalesce(F.sum(F.when(v < F.col("_lo"), F.col("_w"))), F.lit(0)).alias("_below"),
                                   F.coalesce(F.sum(F.when(inside, F.col("_w"))), F.lit(0)).alias("_m"))
    level = level.where(F.col("_m") > 0)
    p = join_groups(pos, level, by, n_groups)
    m, below = F.col("_m"), F.col("_below")

    def at(position):
        return (F.col("_cs") <= position) & (position <= F.col("_ce"))

    spots = []
    for q in probs:
        h = (m - 1) * F.lit(float(q))
        spots.append((below + F.floor(h) + 1, below + F.ceil(h) + 1))
    ends = [below + 1, below + m] if with_min_max_count else []
    wanted = F.lit(False)
    for position in [x for pair in spots for x in pair] + ends:
        wanted = wanted | at(position)
    aggs = [F.max("_m").alias("_mm")]
    for i, (lo, hi) in enumerate(spots):
        aggs += [F.max(F.when(at(lo), v)).alias(f"_lo{i}"), F.max(F.when(at(hi), v)).alias(f"_hi{i}")]
    if with_min_max_count:
        aggs += [F.max(F.when(at(ends[0]), v)).alias("min"), F.max(F.when(at(ends[1]), v)).alias("max")]
    g = p.where(wanted).groupBy(*by).agg(*aggs)
    outs = []
    for i, q in enumerate(probs):
        h = (F.col("_mm") - 1) * F.lit(float(q))
        d = h - F.floor(h)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        outs.append((lo + d * (hi - lo)).alias(names[i]))
    extra = [F.col("min"), F.col("max"), F.col("_mm").alias("n")] if with_min_max_count else []
    return g.select(*by, *outs, *extra)


def group_quantiles(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float],
                    names: Sequence[str] | None = None, with_min_max_count: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation (SQL ``percentile``/``quantile_cont``,
    pandas ``quantile``) per group, NULL values ignored.

    Built on ``value_positions``: only the histogram of distinct values is
    sorted, and only the rows at the interpolation positions reach the final
    (tiny) aggregate, so no group's values are ever held in one buffer.
    Returns ``by`` + one column per probability (+ min, max, n).
    """
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    by = list(by)
    if not by:  # one group: a constant key keeps every step keyed
        out = group_quantiles(df.withColumn("_q_all", F.lit(0)), value, ["_q_all"], probs, names,
                              with_min_max_count)
        return out.drop("_q_all")
    pos = value_positions(df, value, by)
    return positions_quantiles(pos, value, by, probs, names, None, with_min_max_count)


def row_quantiles(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float], names: Sequence[str],
                  tiebreak: Sequence[str], materialised: bool = False) -> DataFrame:
    """``group_quantiles`` for values that rarely repeat (e.g. residuals of a
    fit) and carry a unique key: rows are numbered directly by (value,
    tiebreak), which splits any run of equal values, and only the rows at the
    interpolation positions reach the final aggregate."""
    by = list(by)
    x = df.where(F.col(value).isNotNull()).select(*by, value, *tiebreak)
    numbered = global_row_number(x, [F.asc(value)], by, out="_q_rn", tiebreak=list(tiebreak),
                                 with_group_size="_q_n", materialised=materialised)
    rn, n, v = F.col("_q_rn"), F.col("_q_n"), F.col(value)
    spots = [(F.floor((n - 1) * F.lit(float(q))) + 1, F.ceil((n - 1) * F.lit(float(q))) + 1) for q in probs]
    wanted = F.lit(False)
    for lo, hi in spots:
        wanted = wanted | (rn == lo) | (rn == hi)
    aggs = [F.max(n).alias("_n")]
    for i, (lo, hi) in enumerate(spots):
        aggs += [F.max(F.when(rn == lo, v)).alias(f"_lo{i}"), F.max(F.when(rn == hi, v)).alias(f"_hi{i}")]
    g = numbered.where(wanted).groupBy(*by).agg(*aggs)
    outs = []
    for i, q in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(q))
        d = h - F.floor(h)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        outs.append((lo + d * (hi - lo)).alias(names[i]))
    return g.select(*by, *outs)
