"""Operator 10: near-duplicate vectors through an inverted multi-index.

1. Equal vectors become one node (with the number of its vectors).
2. Two codebooks, one per half of the unit vectors, are fitted by k-means on a
   bounded sample; the product grid of their codes is the index, and every
   node is stored in the cell of its two nearest codes.
3. A vector visits cells in the order of the sum of its two squared code
   distances (multi-sequence order). How many cells it visits is calibrated:
   ``probes`` vectors chosen by hash are compared with all others by brute
   force, more of the sample while they have under ``min_links`` links, and
   the traversal goes on until ``recall`` of the links found that way lie in
   visited cells. If that takes over ``most_cells`` cells, a coarser grid is
   taken; the coarsest is one cell, where all vectors meet in blocks. Where
   the whole sample has next to no links, neighbours made at the threshold
   are counted as well.
4. In each cell, visitors meet the stored nodes and cosines are taken in
   double precision. A cell of over ``block`` nodes or visitors is cut into
   blocks of either; every pair of a block of nodes and a block of visitors is
   a group of its own. Groups write one count per visitor and a spanning forest
   of their links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm._graph import connected_components, union
from bazaar.session import reliable_checkpoint


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows, and which rows those are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    right = n == dim
    flat = column.filter(pa.array(right)).flatten().cast(pa.float64()).fill_null(math.nan)
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    ok = np.isfinite(x).all(axis=1)
    x = x[ok]
    norm = np.sqrt((x * x).sum(axis=1))
    scale = np.abs(x).max(axis=1, initial=0.0)
    odd = (norm == 0) | ~np.isfinite(norm)  # squares under- or overflow: scale first
    if odd.any():
        y = x[odd] / np.where(scale[odd] > 0, scale[odd], 1.0)[:, None]
        x = x.copy()
        x[odd], norm[odd] = y, np.sqrt((y * y).sum(axis=1))
    usable = np.zeros(len(column), bool)
    usable[np.flatnonzero(right)[ok][norm > 0]] = True
    return x[norm > 0] / norm[norm > 0][:, None], usable


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


class Grid:
    """The product grid of two codebooks."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b

    def visits(self, x: np.ndarray, cells: int) -> np.ndarray:
        """The first ``cells`` cells of each row in multi-sequence order. The cell of
        the i-th and j-th nearest codes has (i + 1)(j + 1) - 1 cells before it at
        least, so only places with (i + 1)(j + 1) <= cells need be looked at."""
        half = self.a.shape[1]
        cells = min(cells, len(self.a) * len(self.b))
        d1, d2 = distances(x[:, :half], self.a), distances(x[:, half:], self.b)
        o1, o2 = d1.argsort(axis=1, kind="stable"), d2.argsort(axis=1, kind="stable")
        ij = [(i, j) for i in range(min(cells, len(self.a))) for j in range(min(cells // (i + 1), len(self.b)))]
        i, j = (np.array(v) for v in zip(*ij))
        total = np.take_along_axis(d1, o1, 1)[:, i] + np.take_along_axis(d2, o2, 1)[:, j]
        first = total.argsort(axis=1, kind="stable")[:, :cells]
        return np.take_along_axis(o1, i[first], 1) * len(self.b) + np.take_along_axis(o2, j[first], 1)

    def rank(self, x: np.ndarray, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells row ``row`` of x visits before ``cell`` (of equally far ones: all)."""
        half = self.a.shape[1]
        out = np.zeros(len(row), np.int64)
        order = np.argsort(row, kind="stable")
        which, first = np.unique(row[order], return_index=True)
        for lo in range(0, len(which), 256):
            some = which[lo:lo + 256]
            d1, d2 = distances(x[some, :half], self.a), distances(x[some, half:], self.b)
            for k, at in enumerate(np.split(order, first[1:])[lo:lo + 256]):
                near = np.sort(d2[k])
                far = d1[k][cell[at] // len(self.b)] + d2[k][cell[at] % len(self.b)] + 1e-12
                out[at] = [np.searchsorted(near, f - d1[k], "right").sum() - 1 for f in far]
        return out


def _vectors(flat: np.ndarray) -> pa.Array:
    n, dim = flat.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * dim, dim, dtype=np.int32), flat.ravel())


def _keys(dim: int):
    """(id, key, unit): NULL key for vectors that link with nothing."""
    import hashlib

    def run(batches):
        for b in batches:
            x, ok = unit_rows(b.column("vec"), dim)
            raw = b.column("vec").filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0
            keys = np.full(len(ok), None, object)
            keys[ok] = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in raw]
            every = np.zeros((len(ok), dim))
            every[ok] = x
            unit = _vectors(every)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.binary()), unit], ["id", "key", "unit"])
    return run


def _probe(grids: list[Grid], reps: np.ndarray, probes: np.ndarray, least: float, depth: int, held: int = 500_000):
    """(grid, rank, n): rank, in the probe's traversal, of the cell of every other vector linked with a probe."""
    cells = [len(grid.a) * len(grid.b) for grid in grids]

    def run(batches):
        total = np.zeros((len(grids), depth + 1), np.int64)
        pairs = [np.zeros(0, np.int64) for _ in grids]  # probe and cell as one number, for each grid
        n = [np.zeros(0, np.int64) for _ in grids]

        def ranked(g):
            if len(pairs[g]):
                rank = grids[g].rank(probes, pairs[g] // cells[g], pairs[g] % cells[g])
                np.add.at(total[g], np.minimum(rank, depth), n[g])
            pairs[g], n[g] = np.zeros(0, np.int64), np.zeros(0, np.int64)

        step = max(1, 4_000_000 // len(probes))
        for b in batches:
            x = b.column("unit").flatten().to_numpy().reshape(b.num_rows, -1)
            rep = b.column("rep").to_numpy()
            for lo in range(0, len(x), step):
                part = x[lo:lo + step]
                hit = probes @ part.T >= least
                hit &= reps[:, None] != rep[lo:lo + step][None, :]
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                for g, grid in enumerate(grids):
                    cell = grid.visits(part, 1)[:, 0].astype(np.int64)
                    more, count = np.unique(i * cells[g] + cell[j], return_counts=True)
                    pairs[g], where = np.unique(np.concatenate([pairs[g], more]), return_inverse=True)
                    n[g] = np.bincount(where, np.concatenate([n[g], count])).astype(np.int64)
                    if len(pairs[g]) > held:
                        ranked(g)
        for g in range(len(grids)):
            ranked(g)
        some, rank = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(rank), pa.array(total[some, rank])],
                                         ["grid", "rank", "n"])
    return run


def made_neighbours(x: np.ndarray, least: float, seed: int = 2) -> np.ndarray:
    """For each unit vector one at a cosine of ``least``, in a random direction."""
    r = np.random.default_rng(seed).normal(size=x.shape)
    r -= (r * x).sum(1)[:, None] * x
    r /= np.maximum(np.sqrt((r * r).sum(1)), 1e-300)[:, None]
    return least * x + math.sqrt(max(0.0, 1 - least * least)) * r


def _visit(grid: Grid, cells: int):
    """(cell, rep, m, own cell, unit, stored, visits): each node once as stored and once per visit."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                t = b.slice(lo, 1024)
                x = t.column("unit").flatten().to_numpy().reshape(t.num_rows, -1)
                v = grid.visits(x, cells).astype(np.int32)
                n, k = v.shape
                rows = pa.array(np.repeat(np.arange(n), k))
                own = np.repeat(v[:, 0], k)
                lists = pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), v.ravel())
                # the visit of the own cell (the first) is also where the node is stored
                mine = np.tile(np.arange(k) == 0, n)
                lists = lists.take(rows.filter(pa.array(mine)))
                at = np.full(n * k, -1)
                at[mine] = np.arange(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v.ravel()), t.column("rep").take(rows), t.column("m").take(rows), pa.array(own),
                     t.column("unit").take(rows), pa.array(mine),
                     lists.take(pa.array(at, mask=~mine))],
                    ["cell", "rep", "m", "own", "unit", "stored", "visits"])
    return run


def _meet(least: float):
    """Groups (cell, block, visitors' block) in sorted batches -> (kind 0: rep, credit) and (kind 1: rep, linked rep)."""
    def group(t: pa.Table):
        rep, m, own = (t.column(c).to_numpy() for c in ("rep", "m", "own"))
        here, comes = (t.column(c).to_numpy(zero_copy_only=False) for c in ("here", "comes"))
        dim = len(t.column("unit")[0])
        x = pc_flat(t.column("unit")).reshape(-1, dim)
        y, z = np.flatnonzero(here), np.flatnonzero(comes)
        if not len(y) or not len(z):
            return
        known = [np.asarray(v, np.int64) for v in t.column("visits").take(pa.array(y)).to_pylist()]
        visits = np.sort(np.array(known), axis=1)
        credit = np.zeros(len(rep), np.int64)
        parent: dict = {}
        edges = []
        for lo in range(0, len(z), 2048):
            some = z[lo:lo + 2048]
            hit = x[some] @ x[y].T >= least
            hit &= rep[some][:, None] != rep[y][None, :]
            credit[some] += hit @ m[y]
            for i in np.flatnonzero(hit.any(axis=1)):
                mates = np.flatnonzero(hit[i])
                a, ra = some[i], int(rep[some[i]])
                # a stored node that does not visit this one's cell would miss the link
                back = visits[mates]
                sees = (back == own[a]).any(axis=1)
                credit[y[mates[~sees]]] += m[a]
                for j in mates:
                    if union(parent, ra, int(rep[y[j]])):
                        edges.append((ra, int(rep[y[j]])))
        some = np.flatnonzero(credit)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([rep[some], np.array([e[0] for e in edges], np.int64)])),
             pa.array(np.concatenate([credit[some], np.zeros(len(edges), np.int64)])),
             pa.array([None] * len(some) + [e[1] for e in edges], pa.int64())], ["rep", "credit", "mate"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            while held.num_rows:
                key = [held.column(c).to_numpy() for c in ("cell", "block", "turn")]
                other = np.flatnonzero(np.any([c != c[0] for c in key], axis=0))
                if not len(other):
                    break
                yield from group(held.slice(0, other[0]).combine_chunks())
                held = held.slice(other[0])
        if held is not None and held.num_rows:
            yield from group(held.combine_chunks())
    return run


def pc_flat(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy()


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95,
                 recall: float = 0.99, probes: int = 1000, sample: int = 65_536, per_cell: int = 256,
                 block: int = 2048, min_links: int = 1000, most_cells: int = 512,
                 on_calibration: Callable[[int, float], None] | None = None) -> DataFrame:
    """-> (vec_id, n_links, component_id, kept), one row per input row.

    Vectors with a cosine of at least ``least`` are linked; a component is
    named by its smallest id, whose vector is kept. The links found hold at
    least about ``recall`` of all (measured on the probes; ``on_calibration``
    gets the cells visited and that share). None found is below ``least``.

    Defined cases: vectors that are NULL, zero, hold NULL or non-finite
    components, or whose length is not the table's most frequent one (ties:
    the smaller) link with nothing. Rows that repeat an id are vectors of
    their own when links are counted. Rows with a NULL id are returned without
    links, component NULL and kept. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    lengths = src.where("vec IS NOT NULL AND id IS NOT NULL").groupBy(F.size("vec").alias("d")).count()
    top = lengths.where("d > 0").orderBy(F.desc("count"), "d").first()
    if top is None:
        return src.select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"),
                          F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    told = reliable_checkpoint(src.mapInArrow(_keys(top.d), "id bigint, key binary, unit array<double>"))
    nodes = reliable_checkpoint(told.where("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.any_value("unit").alias("unit")))
    n = nodes.count()

    # a bounded sample fits the codebooks: about ``sample`` rows, chosen by hash and in the order of another
    u = F.pmod(F.xxhash64(F.lit("fit"), "rep"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    fit = nodes.where(u < F.lit(min(1.0, sample / max(n, 1)))).select(
        "rep", "unit", F.xxhash64(F.lit("probe"), "rep").alias("u")).limit(2 * sample).toArrow()
    fit = fit.sort_by([("u", "ascending"), ("rep", "ascending")])
    x = pc_flat(fit.column("unit")).reshape(-1, top.d) if len(fit) else np.zeros((0, top.d))
    k = int(np.clip(math.ceil(math.sqrt(n / per_cell)), 1, 1024))
    half = top.d // 2
    # the grid, and coarser ones for links that lie in too many of its cells; the last has one cell
    grids = [Grid(kmeans(x[:, :half], max(1, k >> c)), kmeans(x[:, half:], max(1, k >> c)))
             for c in range(k.bit_length())] if len(x) else []
    if not grids:
        links = spark.createDataFrame([], "rep bigint, credit bigint, mate bigint")
    else:
        reps = fit.column("rep").to_numpy()
        found, lo, hi = np.zeros((len(grids), most_cells + 1), np.int64), 0, min(probes, len(x))
        while lo < hi and found[0].sum() < min_links:  # rare links: more probes, up to the whole sample
            for r in (nodes.mapInArrow(_probe(grids, reps[lo:hi], x[lo:hi], least, most_cells),
                                       "grid bigint, rank bigint, n bigint")
                      .groupBy("grid", "rank").agg(F.sum("n").alias("n")).collect()):  # most_cells + 1 rows a grid
                found[r["grid"], r["rank"]] += r["n"]
            lo, hi = hi, min(4 * hi, len(x))
        total = int(found[0].sum())
        found = np.cumsum(found, axis=1)
        for grid, got in zip(grids, found, strict=True):
            cells = int(np.searchsorted(got, recall * total) + 1)
            if total < 100 and len(x) < n:  # too few links to measure on: neighbours made at the threshold as well
                y = made_neighbours(x[:probes], least)
                rank = np.sort(grid.rank(x[:probes], np.arange(len(y)), grid.visits(y, 1)[:, 0]))
                cells = max(cells, int(rank[math.ceil(recall * len(y)) - 1] + 1))
            if cells <= most_cells:
                break
        if on_calibration:
            on_calibration(cells, float(got[cells - 1] / total) if total else 1.0)
        placed = nodes.mapInArrow(
            _visit(grid, cells), "cell int, rep bigint, m bigint, own int, unit array<double>, stored boolean, "
            "visits array<int>")
        sizes = nodes.select("unit").mapInArrow(_cell_sizes(grid, cells), "cell int, s bigint, v bigint")
        sizes = reliable_checkpoint(sizes.groupBy("cell").agg(
            *(F.ceil(F.sum(c) / F.lit(block)).cast("int").alias(g) for c, g in (("s", "g"), ("v", "gv"))))
            .where("g > 0"))
        # a visitor meets every block of the nodes, a node every block of the visitors
        mine = F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")
        turn = F.pmod(F.xxhash64(F.lit("turn"), "rep"), F.col("gv")).cast("int")

        def met_in(block, turn):
            return F.struct(block.alias("block"), turn.alias("turn"))
        every = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda b: met_in(b, F.col("mine_turn")))
        every = F.when(F.col("stored"), F.array_union(every, F.transform(
            F.sequence(F.lit(0), F.col("gv") - 1), lambda v: met_in(F.col("mine"), v)))).otherwise(every)
        met = (placed.join(sizes, "cell").withColumn("mine", mine).withColumn("mine_turn", turn)
               .withColumn("at", F.explode(every)).withColumns({"block": F.col("at.block"), "turn": F.col("at.turn")})
               .withColumns({"here": F.col("stored") & (F.col("block") == F.col("mine")),
                             "comes": F.col("turn") == F.col("mine_turn")})
               .select("cell", "block", "turn", "rep", "m", "own", "unit", "here", "comes",
                       F.when(F.col("here"), F.col("visits")).alias("visits")))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        links = reliable_checkpoint(met.repartition(parts, "cell", "block", "turn")
                                    .sortWithinPartitions("cell", "block", "turn")
                                    .mapInArrow(_meet(least), "rep bigint, credit bigint, mate bigint"))
    comp = connected_components(links.where("mate IS NOT NULL"), "rep", "mate")
    credit = links.groupBy("rep").agg(F.sum("credit").alias("credit"))
    named = (nodes.select("key", "rep", "m").join(credit, "rep", "left")
             .join(comp, F.col("rep") == F.col("node"), "left")
             .select("key", (F.coalesce("credit", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component")))
    out = told.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                     F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _cell_sizes(grid: Grid, cells: int):
    """(cell, s, v): the nodes stored in a cell and those that visit it."""
    def run(batches):
        total = np.zeros((2, len(grid.a) * len(grid.b)), np.int64)
        for b in batches:
            x = b.column("unit").flatten().to_numpy().reshape(b.num_rows, -1)
            for lo in range(0, len(x), 1024):
                seen = grid.visits(x[lo:lo + 1024], cells)
                for k, v in enumerate((seen[:, 0], seen.ravel())):
                    total[k] += np.bincount(v, minlength=total.shape[1])
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(t[some]) for t in total)],
                                         ["cell", "s", "v"])
    return run
