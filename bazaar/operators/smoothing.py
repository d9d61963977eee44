"""Robust locally weighted regression (LOWESS, Cleveland 1979) as Spark jobs.

Semantics follow the common implementation the reference used: points sorted
by x, k = floor(frac * n) nearest points per fit (the window of k consecutive
points that a sliding search would settle on), tricube distance weights,
weighted linear fit evaluated at the point, then ``iters`` robustness rounds
with bisquare weights of residual / (6 * median |residual|).

Exact at every size, without neighbour pairs. Per series ``by``:

* points are numbered by (x, y) with ``global_row_number`` and laid in chunks of
  ``CHUNK`` consecutive ones. The window start of a point is the number of window
  midpoints (x[L] + x[L+k]) / 2 below it; both are in order, so a chunk of
  points meets the few chunks of midpoints that overlap it, and all its
  points are looked up at once;
* points are then blocks of ``BLOCK`` consecutive ones, a row each. On either
  side of a point the tricube weight is the polynomial 1 - 3 t^3 + 3 t^6 - t^9
  of the scaled distance t, so points enter a fit through twelve power sums
  (robustness weight x position^p, and x y). The sums are kept for the nodes
  of a dyadic tree over the blocks: node (l, j) holds blocks j 2^l .. (j+1) 2^l - 1;
* a block's windows have a common inner range; about 2 log2(k / BLOCK) nodes make
  it up. Only the block itself and those that its windows' ends touch are
  read point by point;
* a round fits all points of a block at once, by matrix products over (point,
  node) and (point, point of a block). Join keys are node and block numbers,
  of which there are thousands, never a whole series;
* medians of the residuals are selected (``selected_quantiles``), not sorted for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.operators.ranking import global_row_number, join_groups
from bazaar.operators.selection import counted_checkpoint, selected_quantiles
from bazaar.session import reliable_checkpoint

POWERS = 12
BLOCK, CHUNK = 128, 4096  # CHUNK is a multiple of BLOCK
LEVELS = 40               # of the tree, at most: 2^40 blocks
SUMS = 2 * POWERS + 3     # M_0.., N_0.., non-zero weights, those above the smallest x, those below the largest x
_P = np.arange(POWERS)
#: _SHIFT[m, q, r] = binomial(m, q) where q + r = m: (a + b)^m as a sum of a^q b^r
_SHIFT = np.array([[[float(math.comb(m, q)) if q + r == m else 0.0 for r in range(POWERS)] for q in range(POWERS)]
                   for m in range(POWERS)])
#: The tricube weight v^3 (3 - 3 v + v^2)^3 in powers 3..9 of v = 1 - t.
_END = np.polynomial.polynomial.polypow([3.0, -3.0, 1.0], 3)


# ---------------------------------------------------------------- rows of one key, as numpy arrays
def _column(column: pa.ChunkedArray) -> np.ndarray | list:
    """Numbers as an array; lists of numbers as a list of arrays (None for NULL)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_list(a.type):
        flat, at = a.values.to_numpy(zero_copy_only=False), a.offsets.to_numpy()
        some = a.is_valid().to_numpy(zero_copy_only=False)
        return [flat[at[i]:at[i + 1]] if some[i] else None for i in range(len(a))]
    return a.to_numpy(zero_copy_only=False)


def _grouped(batches, n_keys: int) -> Iterator[tuple[pa.Table, dict, list[tuple[int, int]]]]:
    """Sorted batches as tables of whole groups of equal leading columns: (table, columns, (first, end) of each group)."""
    def told(table):
        cut = np.zeros(table.num_rows, bool)
        cut[:1] = True
        for c in range(n_keys):
            code = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            cut[1:] |= code[1:] != code[:-1]
        return np.append(np.flatnonzero(cut), table.num_rows)

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        at = told(t)
        held = t.slice(at[-2])
        if len(at) > 2:
            whole = t.slice(0, at[-2])
            yield whole, {c: _column(whole.column(c)) for c in whole.column_names[n_keys:]}, list(zip(at[:-2], at[1:-1]))
    if held is not None and held.num_rows:
        yield held, {c: _column(held.column(c)) for c in held.column_names[n_keys:]}, [(0, held.num_rows)]


def _lists(values: list) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values) if values else np.zeros(0)))


# ---------------------------------------------------------------- windows
def _place(n_by: int):
    """Rows (by..., s, n, k, x, y, s2, xs, xe) in order of s2 within a chunk s -> its blocks with
    each point's window start and reach (largest distance to a point of its window)."""
    def run(batches):
        for table, c, groups in _grouped(batches, n_by + 1):
            at, blocks, out = [], [], {name: [] for name in ("x", "y", "start", "h")}
            for a, z in groups:
                x, y, k, last = c["x"][a], c["y"][a], c["k"][a], c["n"][a] - c["k"][a]
                start, reach, open_ = np.zeros(len(x), np.int64), np.zeros(len(x)), np.ones(len(x), bool)
                for i in range(a, z):
                    first, xs, xe = c["s2"][i] * CHUNK, c["xs"][i], c["xe"][i]
                    n_mids = min(CHUNK, last - first)
                    below = np.searchsorted((xs[:n_mids] + xe[1:n_mids + 1]) / 2, x)  # midpoints under each x
                    # the start lies here unless every midpoint here is below it and more follow
                    here = open_ & ((below < CHUNK) | (first + below >= last))
                    at_start = np.minimum(below[here], last - first)
                    start[here] = first + at_start
                    inside = at_start < len(xs)  # a start at the next chunk's first place is settled there
                    reach[here] = np.maximum(x[here] - xs[np.minimum(at_start, len(xs) - 1)],
                                             xe[np.minimum(at_start, len(xe) - 1)] - x[here])
                    open_[np.flatnonzero(here)[inside]] = False
                for lo in range(0, len(x), BLOCK):
                    at.append(a)
                    blocks.append((table.column(n_by)[a].as_py() * CHUNK + lo) // BLOCK)
                    for name, v in (("x", x), ("y", y), ("start", start), ("h", reach)):
                        out[name].append(v[lo:lo + BLOCK])
            base = table.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(base.column(i).combine_chunks() for i in range(n_by)), pa.array(blocks, pa.int64()),
                 base.column("n").combine_chunks(), base.column("k").combine_chunks(), *(_lists(out[v]) for v in out)],
                [*table.column_names[:n_by], "b", "n", "k", *out])
    return run


# ---------------------------------------------------------------- one round
def node_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A block's share of the sums of each of its nodes, which span x from ``lo`` to ``hi``: (nodes, SUMS)."""
    c, r = (lo + hi) / 2, np.where(hi > lo, (hi - lo) / 2, 1.0)
    z = ((x - c[:, None]) / r[:, None])[..., None] ** _P * w[:, None]
    some = w != 0
    counts = [np.full(len(lo), some.sum()), (some & (x > lo[:, None])).sum(1), (some & (x < hi[:, None])).sum(1)]
    return np.concatenate([z.sum(1), np.einsum("lpk,p->lk", z, y), np.stack(counts, 1)], axis=1)


def _sums(n_by: int):
    """Blocks (by..., b, x, y, w, lo, hi) -> (by..., l, j, lo, hi, v0..)."""
    def run(batches):
        for batch in batches:
            c = {n: _column(batch.column(n)) for n in ("b", "x", "y", "w", "lo", "hi")}
            n = [len(v) for v in c["lo"]]
            if not sum(n):
                continue
            sums = np.concatenate([node_sums(*(c[v][i] for v in ("x", "y", "w", "lo", "hi"))) for i in range(len(n))])
            level = np.concatenate([np.arange(m) for m in n])
            rows = np.repeat(np.arange(len(n)), n)
            keys = [batch.column(i).take(pa.array(rows)) for i in range(n_by)]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(level), pa.array(c["b"][rows] >> level), pa.array(np.concatenate(c["lo"])),
                 pa.array(np.concatenate(c["hi"])), *(pa.array(sums[:, i]) for i in range(SUMS))],
                [*batch.schema.names[:n_by], "l", "j", "lo", "hi", *(f"v{i}" for i in range(SUMS))])
    return run


def points_part(x: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, first: int, block: tuple) -> np.ndarray:
    """What the points of one block (x, y, w, the first numbered ``first``) add to the fits:
    rows (non-zero weights, sum w, w u, w u^2, w y, w u y) with u = (x - x_i) / h_i."""
    bx, by, bw = block
    number = first + np.arange(len(bx))
    inside = (number >= start[:, None]) & (number <= end[:, None])
    u = np.where(h[:, None] > 0, (bx - x[:, None]) / np.where(h > 0, h, 1.0)[:, None], 0.0)
    t = np.abs(u)
    w = np.where(inside & (t < 1), (1 - t ** 3) ** 3, 0.0) * bw
    wu = w * u
    return np.stack([(w != 0).sum(1), w.sum(1), wu.sum(1), (wu * u).sum(1), w @ by, wu @ by])


def nodes_part(x: np.ndarray, h: np.ndarray, left: bool, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The same for whole nodes on one side of all the points: ``v`` (nodes, SUMS)."""
    c, r = (lo + hi) / 2, np.where(hi > lo, (hi - lo) / 2, 1.0)
    flat, s = h <= 0, np.where(h > 0, h, 1.0)[:, None]
    # points exactly h away weigh nothing: whole nodes of them, or one end of a node
    far, near = (lo, hi) if left else (hi, lo)
    live = np.abs(near - x[:, None]) / s < 1
    edge = np.abs(far - x[:, None]) / s >= 1
    count = np.where(edge, v[:, -2 if left else -1], v[:, -3])
    sign = -1.0 if left else 1.0
    out = [np.where(flat, v[:, -3].sum(), (count * live).sum(1)), *np.zeros((5, len(x)))]
    # near the point in powers of u = (x - x_i) / h; near the window's end, where the weight vanishes, of 1 - |u|
    outer = np.abs(near - x[:, None]) / s > 0.5
    for some, middle, scale in ((live & ~outer, (c - x[:, None]) / s, r / s),
                                (live & outer, 1 - np.abs(c - x[:, None]) / s, -sign * r / s)):
        if not some.any():
            continue
        a = scale[..., None] ** _P * some[..., None]       # (points, nodes, q)
        d = middle[..., None] ** _P                        # (points, nodes, r)
        m, my = (np.einsum("pqr,mqr->mp", np.matmul((a * part).transpose(0, 2, 1), d), _SHIFT)
                 for part in (v[:, :POWERS], v[:, POWERS:2 * POWERS]))
        if (some & outer).any():
            w, wy = (np.stack([_END @ e[3 + i:10 + i] for i in range(n)]) for e, n in ((m, 3), (my, 2)))
            w = np.stack([w[0], sign * (w[0] - w[1]), w[0] - 2 * w[1] + w[2]])
            wy = np.stack([wy[0], sign * (wy[0] - wy[1])])
        else:
            w, wy = (np.stack([e[i] - 3 * sign * e[i + 3] + 3 * e[i + 6] - sign * e[i + 9] for i in range(n)])
                     for e, n in ((m, 3), (my, 2)))
        for i, e in enumerate((*w, *wy)):
            out[1 + i] = out[1 + i] + e
    for i, e in enumerate((v[:, 0].sum(), 0.0, 0.0, v[:, POWERS].sum(), 0.0)):
        out[1 + i] = np.where(flat, e, out[1 + i])
    return np.stack(out)


def solve(y: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The fitted values; the point's own y where at most one point has a weight."""
    count, s0, s1, s2, sy, suy = total
    none = (s0 <= 0) | (count <= 1)
    s0 = np.where(none, 1.0, s0)
    ub, yb = s1 / s0, sy / s0
    sxx, sxy = s2 / s0 - ub * ub, suy / s0 - ub * yb
    tilt = sxx > 1e-14
    return np.where(none, y, np.where(tilt, yb - ub * sxy / np.where(tilt, sxx, 1.0), yb))


def _fits(n_by: int):
    """Rows (by..., b, l, j, n, k, x, y, w, start, h, lo, hi, s) sorted by (by..., b), the
    block's own row among them -> the block with its fits f."""
    def run(batches):
        for table, c, groups in _grouped(batches, n_by + 1):
            own, fits = [], []
            for a, z in groups:
                b = table.column(n_by)[a].as_py()
                me = next(i for i in range(a, z) if c["start"][i] is not None)
                x, h, start = c["x"][me], c["h"][me], c["start"][me].astype(np.int64)
                end = start + c["k"][me] - 1
                total = np.zeros((6, len(x)))
                whole: dict[bool, list[int]] = {True: [], False: []}
                for i in range(a, z):
                    if c["l"][i] < 0:
                        total += points_part(x, h, start, end, c["j"][i] * BLOCK, (c["x"][i], c["y"][i], c["w"][i]))
                    else:
                        whole[(c["j"][i] << c["l"][i]) < b].append(i)
                for left, at in whole.items():
                    if at:
                        total += nodes_part(x, h, left, *(np.array([c[v][i][0] for i in at]) for v in ("lo", "hi")),
                                            np.array([c["s"][i] for i in at]))
                own.append(me)
                fits.append(solve(c["y"][me], total))
            base = table.take(pa.array(own, pa.int64()))
            names = [*table.column_names[:n_by + 1], "n", "k", "x", "y", "start", "h", "lo", "hi"]
            yield pa.RecordBatch.from_arrays([*(base.column(v).combine_chunks() for v in names), _lists(fits)],
                                             [*names, "f"])
    return run


# ---------------------------------------------------------------- the jobs
def _dyadic(first: str, last: str) -> str:
    """SQL: the nodes (l, j) that make up the blocks from ``first`` to ``last`` (none if first > last)."""
    s, e = f"shiftright({first} + shiftleft(1L, l) - 1, l)", f"shiftright({last} + 1, l)"
    return (f"filter(flatten(transform(sequence(0, {LEVELS}), l -> array("
            f"IF({s} < {e} AND {s} % 2 = 1, struct(l AS l, {s} AS j), NULL), "
            f"IF({s} < {e} AND {e} % 2 = 1, struct(l AS l, {e} - 1 AS j), NULL)))), v -> v IS NOT NULL)")


def _wanted(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., b, l, j): what each block's windows need; l = -1 is a block point by point."""
    d = blocks.selectExpr(*by, "b", f"start[0] div {BLOCK} AS a1", f"start[size(start) - 1] div {BLOCK} AS a2",
                          f"(start[0] + k - 1) div {BLOCK} AS z1", f"(start[size(start) - 1] + k - 1) div {BLOCK} AS z2")
    raw = ("transform(array_distinct(concat(sequence(a1, a2), sequence(z1, z2), array(b))), "
           "v -> struct(-1 AS l, v AS j))")
    split = "b > a2 AND b < z1"
    whole = (f"IF({split}, concat({_dyadic('(a2 + 1)', '(b - 1)')}, {_dyadic('(b + 1)', '(z1 - 1)')}), "
             f"{_dyadic('(a2 + 1)', '(z1 - 1)')})")
    return d.selectExpr(*by, "b", f"inline(concat({raw}, {whole}))")


def _types(df: DataFrame, names: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, NULL equal to NULL; the right side's keys are dropped."""
    tmp = {k: f"_r_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(tmp)
    cond = F.lit(True)
    for k, t in tmp.items():
        cond = cond & left[k].eqNullSafe(right[t])
    return left.join(right, cond).drop(*tmp.values())


def _round(blocks: DataFrame, by: list[str]) -> DataFrame:
    """One fit of every point: blocks (with weights w) -> blocks with fits f instead."""
    n_by, keys = len(by), ", ".join(f"`{c}`" for c in by)
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [f"v{i}" for i in range(SUMS)]
    leaf = blocks.select(*by, "b", "x", "y", "w", "lo", "hi").mapInArrow(_sums(n_by), (
        f"{_types(blocks, by)}, l bigint, j bigint, lo double, hi double, " + ", ".join(f"{v} double" for v in values)))
    nodes = leaf.groupBy(*by, "l", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                            *[F.expr(f"sum({v})").alias(v) for v in values])
    none = "CAST(NULL AS array<double>)"
    nodes = nodes.selectExpr(*by, "int(l) AS l", "j", "0L AS n", "0L AS k", f"{none} AS x", f"{none} AS y", f"{none} AS w",
                             "CAST(NULL AS array<bigint>) AS start_", f"{none} AS h", "array(lo) AS lo", "array(hi) AS hi",
                             f"array({', '.join(values)}) AS s")
    raw = blocks.selectExpr(*by, "-1 AS l", "b AS j", "n", "k", "x", "y", "w", "start AS start_", "h", "lo", "hi", f"{none} AS s")
    met = _met(_wanted(blocks, by), nodes.unionByName(raw), [*by, "l", "j"])
    own = "l < 0 AND j = b"
    met = met.selectExpr(*by, "b", "l", "j", "n", "k", "x", "y", "w", f"IF({own}, start_, NULL) AS start",
                         f"IF({own}, h, NULL) AS h", f"IF({own} OR l >= 0, lo, NULL) AS lo",
                         f"IF({own} OR l >= 0, hi, NULL) AS hi", "s")
    kept = [*by, "b", "n", "k", "x", "y", "start", "h", "lo", "hi"]
    return (met.repartition(n, *by, "b").sortWithinPartitions(*by, "b")
            .mapInArrow(_fits(n_by), f"{_types(blocks, kept)}, f array<double>"))


def _windows(points: DataFrame, by: list[str]) -> DataFrame:
    """Numbered points (by..., _i, _x, _y, n, k) -> blocks with window starts and reaches."""
    n_by, keys = len(by), ", ".join(f"`{c}`" for c in by)
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = points.groupBy(*by, F.expr(f"_i div {CHUNK}").alias("s")).agg(
        F.max("n").alias("n"), F.max("k").alias("k"), F.expr("array_sort(collect_list(struct(_i, _x, _y)))").alias("p"))
    chunks = reliable_checkpoint(chunks.selectExpr(*by, "s", "n", "k", "p._x AS x", "p._y AS y"))
    # starts L of chunk s: x[L], and x[L + k - 1] from the two chunks that lie (k - 1) places further on
    d, o = f"((k - 1) div {CHUNK})", f"int((k - 1) % {CHUNK})"
    pieces = chunks.selectExpr(*by, "n", "k", "x", f"inline(array(struct(s AS to, 0 AS part), struct(s - {d} AS to, 1 AS part), "
                               f"struct(s - {d} - 1 AS to, 2 AS part)))")
    starts = pieces.where(f"to >= 0 AND to * {CHUNK} <= n - k").groupBy(*by, F.col("to").alias("s2")).agg(
        F.max("n").alias("n"), F.max("k").alias("k"), *[F.expr(f"max(IF(part = {i}, x, NULL))").alias(f"x{i}") for i in range(3)])
    starts = starts.selectExpr(*by, "s2", "x0 AS xs", f"slice(concat(x1, coalesce(x2, array())), {o} + 1, {CHUNK + 1}) AS xe",
                               f"int(least({CHUNK}, n - k - s2 * {CHUNK})) AS mids")
    # chunks of midpoints that overlap a chunk of points, by merging their ends
    ends = chunks.selectExpr(*by, "s", "n", "k", "inline(array(struct(x[0] AS v, 0 AS kind), struct(x[size(x) - 1] AS v, 1 AS kind)))")
    marks = starts.where("mids > 0").selectExpr(*by, "0L AS s", "0L AS n", "0L AS k", "inline(array("
                                                "struct((xs[0] + xe[1]) / 2 AS v, 2 AS kind), "
                                                "struct((xs[mids - 1] + xe[mids]) / 2 AS v, 3 AS kind)))")
    run = f"OVER (PARTITION BY {keys} ORDER BY v, kind ROWS UNBOUNDED PRECEDING)"
    merged = ends.unionByName(marks).selectExpr("*", f"sum(int(kind = 2)) {run} AS begun", f"sum(int(kind = 3)) {run} AS over")
    near = merged.where("kind < 2").groupBy(*by, "s").agg(
        F.expr(f"least(min(IF(kind = 0, over, NULL)), max(n - k) div {CHUNK})").alias("a"),
        F.expr(f"least(max(IF(kind = 1, begun, NULL)), max(n - k) div {CHUNK})").alias("z"))
    asked = _met(chunks, near, [*by, "s"]).selectExpr(*by, "s", "n", "k", "x", "y", "explode(sequence(a, greatest(a, z))) AS s2")
    met = _met(asked, starts.drop("mids"), [*by, "s2"])
    placed = (met.select(*by, "s", "n", "k", "x", "y", "s2", "xs", "xe").repartition(n, *by, "s")
              .sortWithinPartitions(*by, "s", "s2").mapInArrow(_place(n_by), (
                  f"{_types(points, by)}, b bigint, n bigint, k bigint, x array<double>, y array<double>, "
                  "start array<bigint>, h array<double>")))
    blocks = reliable_checkpoint(placed)
    # the whole nodes above each block, with their span of x
    top = f"int(floor(log2((n - 1) div {BLOCK} + 1)))"
    up = blocks.selectExpr(*by, "n", "b", "x[0] AS lo", "x[size(x) - 1] AS hi", f"explode(sequence(0, {top})) AS l")
    up = up.where(f"(shiftright(b, l) + 1) * shiftleft(1L, l) <= (n - 1) div {BLOCK} + 1")
    node = f"OVER (PARTITION BY {keys}, l, shiftright(b, l))"
    up = up.selectExpr(*by, "b", "l", f"min(lo) {node} AS lo", f"max(hi) {node} AS hi").groupBy(*by, "b").agg(
        F.expr("array_sort(collect_list(struct(l, lo, hi)))").alias("up"))
    return _met(blocks, up, [*by, "b"]).selectExpr(*by, "b", "n", "k", "x", "y", "start", "h", "up.lo AS lo", "up.hi AS hi")


def lowess(df: DataFrame, x: str, y: str, frac: float = 2.0 / 3.0, iters: int = 3,
           by: Sequence[str] = (), out: str = "fit") -> DataFrame:
    """LOWESS fit per point. Rows with NULL x or y are dropped (pairing a
    fit with the wrong date would shift the trend).
    -> (by..., x, y, fit) with x and y as DOUBLE."""
    # series keys get names of their own; one series is a constant key, so that every step stays an equi-join
    keys = {c: f"_s{i}" for i, c in enumerate(by)} or {None: "_s0"}
    own = list(keys.values())
    pts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *[(F.lit(0) if c is None else F.col(c)).alias(s) for c, s in keys.items()],
        F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    num = global_row_number(pts, [F.asc("_x"), F.asc("_y")], own, out="_rn", with_group_size="n")
    k = f"bigint(greatest(least(floor({float(frac)}D * n + 1e-10D), n), least(2, n)))"
    blocks = _windows(num.selectExpr(*own, "_x", "_y", "_rn - 1 AS _i", "n", f"{k} AS k"), own)
    blocks, seen = counted_checkpoint(blocks.selectExpr("*", "transform(x, v -> 1D) AS w"),
                                      series=F.count_if(F.col("b") == 0), largest=F.max("n"))
    for rnd in range(iters + 1):
        fitted = _round(blocks, own)
        if rnd == iters:
            break
        fitted = reliable_checkpoint(fitted)
        rows = fitted.selectExpr(*own, "explode(zip_with(y, f, (u, v) -> abs(u - v))) AS _r")
        med = selected_quantiles(rows, "_r", own, {"_m": 0.5}, seen["series"], seen["largest"])
        scaled = "least(abs(u - v) / (6 * _m), 1D)"
        scaled = f"IF(_m = 0, IF(u = v, 0D, 1D), {scaled})"
        # one median per series meets whole blocks, not points
        blocks = join_groups(fitted, med, own, seen["series"]).selectExpr(
            *own, "b", "n", "k", "x", "y", "start", "h", "lo", "hi",
            f"zip_with(y, f, (u, v) -> power(1 - power({scaled}, 2), 2)) AS w")
    flat = fitted.selectExpr(*own, "inline(arrays_zip(x, y, f))")
    return flat.select(*[F.col(s).alias(c) for c, s in keys.items() if c is not None], F.col("x").alias(x),
                       F.col("y").alias(y), F.col("f").alias(out))
