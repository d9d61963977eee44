"""Exact order statistics by selection: no sort of rows or of distinct values.

Quantiles of a group need a few rows of its sorted order. Instead of sorting:

1. ``percentile_approx`` per group (a mergeable sketch of bounded size) gives
   narrow value brackets around every wanted position;
2. one pass counts the rows of every zone between brackets, with the zone's
   smallest and largest value. Values inside a bracket are counted each on
   their own, so a value that a third of all rows hold is one row. Partial
   aggregation leaves a few rows per group and task;
3. running counts over a group's zones (some hundredths of its values) give
   the exact value at each wanted position.

Outlier fences that are taken again over the rows inside the first ones need
no pass of their own: intervals for the fences and for the later quartiles
follow from the sketch, and the one counting pass has brackets for them all.

Rows of tiles (NTILE) are selected in the same way, with a bounded sample in
place of the sketch, because their order has several columns: ``tile_cuts``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from bazaar.operators.ranking import join_groups
from bazaar.session import reliable_checkpoint

#: percentile_approx is off by at most 1 / ACCURACY of a group's rows; brackets reach MARGIN times that.
ACCURACY, MARGIN = 10_000, 4
#: Evenly spaced quantiles of the sketch that later fences and quartiles are bracketed with.
GRID = 1024
#: Rows of a group up to which its values may sit in one aggregation buffer.
BUFFERED = 200_000
#: Rows of the sample that places the tile brackets, and rows of all brackets fetched at most.
SAMPLE, FETCH = 10_000, 50_000


def counted_checkpoint(df: DataFrame, **what: Column) -> tuple[DataFrame, dict]:
    """``df`` checkpointed, with aggregates over its rows taken by the same job."""
    seen = Observation()
    out = reliable_checkpoint(df.observe(seen, *[c.alias(k) for k, c in what.items()]))
    return out, seen.get


def _with(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with columns given as SQL text."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def sketch(df: DataFrame, value: str, by: Sequence[str], points: Sequence[float]) -> DataFrame:
    """-> (by..., _p: values at the given shares of the group's rows, _rows)."""
    array = "array(" + ", ".join(f"{p}D" for p in points) + ")"
    return df.groupBy(*by).agg(F.expr(f"percentile_approx(`{value}`, {array}, {ACCURACY})").alias("_p"),
                               F.expr("double(count(1))").alias("_rows")).where("_p IS NOT NULL")


def _tight(probs) -> list[float]:
    """Shares a bit below and above each probability."""
    d = MARGIN / ACCURACY
    return [min(1.0, max(0.0, q + s)) for q in probs for s in (-d, d)]


def zones(rows: DataFrame, value: str, by: Sequence[str], n_brackets: int) -> DataFrame:
    """Counted zones of ``rows`` (which carry _from_i and _to_i for each bracket), in
    order of value: (by..., _c rows, _lo, _hi smallest and largest value, _cs, _ce
    first and last position, _n rows of the group)."""
    v, fine, side = F.col(value), F.lit(False), F.lit(0)
    for i in range(n_brackets):
        fine = fine | v.between(F.col(f"_from{i}"), F.col(f"_to{i}"))
        side = side + (v > F.col(f"_to{i}")).cast("int")
    z = (rows.groupBy(*by, side.alias("_s"), F.when(fine, v).alias("_v"))
         .agg(F.count(F.lit(1)).alias("_c"), F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    w = Window.partitionBy(*by)
    ce = F.sum("_c").over(w.orderBy("_lo", "_hi").rowsBetween(Window.unboundedPreceding, 0))
    return z.select(*by, "_c", "_lo", "_hi", (ce - F.col("_c") + 1).alias("_cs"), ce.alias("_ce"),
                    F.sum("_c").over(w).alias("_n"))


def _position(p: str) -> str:
    """SQL of the value at position ``p``, if this zone holds it and pins it to one value."""
    return (f"CASE WHEN _cs <= {p} AND {p} <= _ce THEN "
            f"CASE WHEN {p} = _cs OR _lo = _hi THEN _lo WHEN {p} = _ce THEN _hi END END")


def _quantiles(z: DataFrame, by: Sequence[str], probs: dict[str, float], below: str, n: str) -> DataFrame:
    """``z`` with exact interpolated quantiles of the ``n`` values after the first ``below`` ones
    of each group. A position that no zone pins (a sketch off by more than its bound) is an error."""
    over = "OVER (PARTITION BY " + ", ".join(f"`{c}`" for c in by) + ")"
    ends, out = {}, {}
    for i, (name, q) in enumerate(probs.items()):
        h = f"(({n} - 1) * {float(q)}D)"
        for side, at in (("l", "floor"), ("u", "ceil")):
            ends[f"_{side}{i}"] = f"max({_position(f'({below} + {at}{h} + 1)')}) {over}"
        out[name] = (f"CASE WHEN _l{i} IS NULL OR _u{i} IS NULL THEN "
                     f"double(raise_error('a quantile lies outside its bracket')) "
                     f"ELSE _l{i} + ({h} - floor{h}) * (_u{i} - _l{i}) END")
    return _with(_with(z, **ends), **out).drop(*ends)


def selected_quantiles(df: DataFrame, value: str, by: Sequence[str], probs: dict[str, float], n_groups: int,
                       largest: int | None = None) -> DataFrame:
    """(by..., a column per named probability): exact interpolated quantiles (NULL values
    ignored) without a sort, by two aggregations of ``df``, which should be cheap to read twice.
    If the ``largest`` group is known to have at most ``BUFFERED`` rows, ``percentile``
    gives the same values from one aggregation whose buffers that bounds."""
    by = list(by)
    if largest is not None and largest <= BUFFERED:
        return df.where(F.col(value).isNotNull()).groupBy(*by).agg(
            *[F.expr(f"percentile(`{value}`, {q}D)").alias(name) for name, q in probs.items()])
    rows = df.where(F.col(value).isNotNull()).select(*by, value)
    told = sketch(rows, value, by, _tight(probs.values()))
    told = told.select(*by, *[F.expr(f"_p[{i}]").alias(f"{'_to' if i % 2 else '_from'}{i // 2}")
                              for i in range(2 * len(probs))])
    z = zones(join_groups(rows, told, by, n_groups), value, by, len(probs))
    return _quantiles(z, by, probs, "0", "_n").groupBy(*by).agg(*[F.max(name).alias(name) for name in probs])


class Fences:
    """Outlier fences Q1 - k*IQR, Q3 + k*IQR per group, each pass over the values that the
    pass before kept. The rows are read twice: for the sketch and for the counts.
    ``bounds``: (by..., _lo, _hi), checkpointed, with the quantiles ``summary`` of the
    values inside the last fences, their min, max and n, if any are asked for."""

    def __init__(self, df: DataFrame, value: str, by: Sequence[str], k: float, passes: int,
                 summary: dict[str, float] | None = None):
        by = list(by)
        quartiles = {"_q1": 0.25, "_q3": 0.75}
        rows = df.where(F.col(value).isNotNull()).select(*by, value)
        told = sketch(rows, value, by, _tight(quartiles.values()) + [i / GRID for i in range(GRID + 1)])
        told, n_brackets = self._brackets(told, by, k, passes, quartiles, summary or {})
        told, seen = counted_checkpoint(told, n=F.count(F.lit(1)))
        self.n_groups = seen["n"]

        z = zones(join_groups(rows, told, by, self.n_groups), value, by, n_brackets)
        over = "OVER (PARTITION BY " + ", ".join(f"`{c}`" for c in by) + ")"
        z = _with(z, _below="0L", _m="_n", _first="double('-Infinity')", _last="double('Infinity')", _split="0L")
        for done in range(passes):
            z = _quantiles(z, by, quartiles, "_below", "_m")
            # a value must pass the fences of every pass
            z = _with(z, _first=f"greatest(_first, _q1 - {k}D * (_q3 - _q1))", _last=f"least(_last, _q3 + {k}D * (_q3 - _q1))")
            if done + 1 < passes or summary:
                cut = "_lo < _hi AND (_lo < _first AND _first <= _hi OR _lo <= _last AND _last < _hi)"
                z = _with(z, _below=f"sum(IF(_hi < _first, _c, 0)) {over}", _split=f"_split + sum(IF({cut}, 1, 0)) {over}",
                          _m=f"sum(IF(_hi <= _last, _c, 0)) {over} - sum(IF(_hi < _first, _c, 0)) {over}")
        out = {"_f": "max(_first)", "_t": "max(_last)", "_s": "max(_split)"}
        if summary:
            z = _quantiles(z, by, summary, "_below", "_m")
            inside = "_cs > _below AND _ce <= _below + _m"
            out |= {name: f"max({name})" for name in summary}
            out |= {"min": f"min(IF({inside}, _lo, NULL))", "max": f"max(IF({inside}, _hi, NULL))", "n": "max(_m)"}
        told = z.groupBy(*by).agg(*[F.expr(x).alias(name) for name, x in out.items()])
        whole = "IF(_s = 0, _f, double(raise_error('a fence lies outside its bracket')))"
        self.bounds = reliable_checkpoint(_with(told, _f=whole).drop("_s").withColumnsRenamed({"_f": "_lo", "_t": "_hi"}))

    @staticmethod
    def _brackets(told: DataFrame, by: list[str], k: float, passes: int, quartiles: dict, summary: dict):
        """Brackets of all quartiles and fences of all passes, and of the summary, per group.

        Positions are shares of the group's rows. ``_e`` is the sketch's error and
        two rows; a share between two grid points is taken to the next ones."""
        def value_from(share):
            return f"double(_g[greatest(0, int(floor(({share} - _e) * {GRID}) - 1))])"

        def value_to(share):
            return f"double(_g[least({GRID}, int(ceil(({share} + _e) * {GRID}) + 1))])"

        told = _with(told, _g=f"slice(_p, {2 * len(quartiles) + 1}, {GRID + 1})", _e=f"{MARGIN / ACCURACY}D + 2 / _rows")
        close = f"_rows >= {2 * ACCURACY}"
        now, brackets, names = [], [], {}
        for i, q in enumerate(quartiles.values()):
            names |= {f"_a{i}": f"IF({close}, double(_p[{2 * i}]), {value_from(f'{q}D')})",
                      f"_b{i}": f"IF({close}, double(_p[{2 * i + 1}]), {value_to(f'{q}D')})"}
            now.append((f"_a{i}", f"_b{i}"))
        told = _with(told, **names)
        span = ("0D", "0D", "1D", "1D")  # shares below the lower fence (least, most), and up to the upper one
        for done in range(passes):
            (a1, b1), (a3, b3) = now
            f = [f"_f{done}{i}" for i in range(4)]
            told = _with(told, **dict(zip(f, (
                f"{1 + k}D * {a1} - {k}D * {b3}", f"{1 + k}D * {b1} - {k}D * {a3}",
                f"{1 + k}D * {a3} - {k}D * {b1}", f"{1 + k}D * {b3} - {k}D * {a1}"))))
            brackets += [*now, (f[0], f[1]), (f[2], f[3])]
            least = "(size(filter(_g, g -> g < {0})) - 1) / {1}D - _e"
            most = "size(filter(_g, g -> g <= {0})) / {1}D + _e"
            s = [f"_s{done}{i}" for i in range(4)]
            told = _with(told, **dict(zip(s, (
                f"greatest({span[0]}, {least.format(f[0], GRID)})", f"greatest({span[1]}, {most.format(f[1], GRID)})",
                f"least({span[2]}, {least.format(f[2], GRID)})", f"least({span[3]}, {most.format(f[3], GRID)})"))))
            span = tuple(s)
            now, names = [], {}
            for i, q in enumerate((quartiles if done + 1 < passes else summary).values()):
                now.append((f"_y{done}{i}a", f"_y{done}{i}b"))
                names |= {now[-1][0]: value_from(f"({span[0]} * {1 - q}D + {span[2]} * {q}D)"),
                          now[-1][1]: value_to(f"({span[1]} * {1 - q}D + {span[3]} * {q}D)")}
            told = _with(told, **names) if names else told
        brackets += now
        return told.select(*by, *[F.col(c).alias(f"{side}{i}") for i, ab in enumerate(brackets)
                                  for c, side in zip(ab, ("_from", "_to"))]), len(brackets)


# ---------------------------------------------------------------- tiles
def _in_order(rows) -> list[tuple]:
    """Structs as tuples in Spark's ascending order (NULL first)."""
    return sorted((tuple(r) for r in rows if r is not None), key=lambda r: tuple((v is not None, v) for v in r))


class _Order:
    """A struct to order by, the rows that take part, and literals of its type."""

    def __init__(self, df: DataFrame, struct: Column, where: Column):
        self.struct, self.where, self.known = struct, where, {}
        self.type = df.select(struct.alias("o")).schema["o"].dataType.simpleString()

    def literal(self, row) -> Column:
        if row not in self.known:
            self.known[row] = F.struct(*[F.lit(v) for v in row]).cast(self.type)
        return self.known[row]

    def inside(self, lo, hi) -> Column:
        at = self.where
        if lo is not None:
            at = at & (self.struct >= self.literal(lo))
        if hi is not None:
            at = at & (self.struct <= self.literal(hi))
        return at

    def before(self, lo) -> Column:
        return F.lit(0).cast("bigint") if lo is None else F.count_if(self.where & (self.struct < self.literal(lo)))


class _Spot:
    """A cut being looked for: the row of rank ``rank`` lies in the bracket [lo, hi],
    which has ``inside`` rows, some of them sampled, after ``before`` rows."""

    def __init__(self, name: str, cut: int, rank: int, inside: int):
        self.name, self.cut, self.rank = name, cut, rank
        self.before, self.lo, self.hi, self.inside, self.rows, self.slack = 0, None, None, inside, [], 6

    def narrowed(self):
        """(lo, hi, expected rows) of a bracket that very likely holds the row."""
        share, size = (self.rank - self.before) / self.inside, len(self.rows)
        if not size:
            return self.lo, self.hi, self.inside
        slack = self.slack * (size * max(share * (1 - share), 1 / size)) ** 0.5 + 2
        a, b = int(share * size - slack), int(share * size + slack) + 1
        return (self.rows[a] if a >= 0 else self.lo, self.rows[b] if b < size else self.hi,
                self.inside * min(1.0, (b - a + 2) / size))


def tile_cuts(df: DataFrame, tiles: int, orders: dict[str, tuple[Column, Column]], key: Column,
              sizes: dict[str, int]) -> dict[str, list]:
    """The last row of each tile but the last, per named order, as tuples.

    ``orders``: name -> (struct to order by, ascending; condition of the rows that
    take part); ``sizes``: name -> number of these rows. Structs must be unique,
    so they end with a unique key; their fields are numbers, booleans or
    strings, without NaN. ``key`` spreads the rows over the sample.

    A uniform sample of at most ``SAMPLE`` rows (one per hash bucket) brackets
    every cut; one aggregation counts the rows before each bracket. Brackets
    that hold few rows are fetched; larger ones are sampled again.
    """
    made = {name: _Order(df, *o) for name, o in orders.items()}
    found: dict[str, list] = {name: [None] * (tiles - 1) for name in orders}
    spots = [_Spot(name, c, c * (n // tiles) + min(c, n % tiles), n)  # rows of the first c tiles
             for name, n in sizes.items() if n for c in range(1, tiles)]
    while spots:
        near = {}
        for s in spots:
            lo, hi, rows = s.narrowed()
            near.setdefault((s.name, lo, hi), []).append((s, rows))
        # a sample of a few rows narrows nothing any more: its bracket is small
        few = (sum(about[0][1] for about in near.values()) <= FETCH
               or all(s.rows and rows > 0.8 * s.inside for about in near.values() for s, rows in about))
        told = _fetch(df, made, list(near)) if few else _sample(df, made, key, list(near))
        spots = []
        for ((_, lo, hi), about), (before, inside, rows) in zip(near.items(), told):
            for s, _ in about:
                if not before < s.rank <= before + inside:  # the sample misled: a wider bracket
                    s.slack *= 4
                    spots.append(s)
                elif len(rows) == inside:
                    found[s.name][s.cut - 1] = rows[s.rank - before - 1]
                else:
                    s.before, s.lo, s.hi, s.inside, s.rows, s.slack = before, lo, hi, inside, rows, 6
                    spots.append(s)
    return found


def _sample(df: DataFrame, orders: dict[str, _Order], key: Column, asked: list) -> list:
    """Per bracket: rows before it, rows in it, and one of these per hash bucket that has any."""
    aggs = []
    for s, (name, lo, hi) in enumerate(asked):
        o, inside = orders[name], orders[name].inside(lo, hi)
        aggs += [o.before(lo).alias(f"b{s}"), F.count_if(inside).alias(f"n{s}"),
                 F.min_by(F.when(inside, o.struct), F.when(inside, F.xxhash64(key, F.lit(s)))).alias(f"r{s}")]
    rows = df.groupBy(F.pmod(F.xxhash64(key), F.lit(SAMPLE)).alias("bucket")).agg(*aggs).collect()  # at most SAMPLE
    return [(sum(r[f"b{s}"] for r in rows), sum(r[f"n{s}"] for r in rows), _in_order(r[f"r{s}"] for r in rows))
            for s in range(len(asked))]


def _fetch(df: DataFrame, orders: dict[str, _Order], asked: list) -> list:
    """Per bracket: rows before it, rows in it, and all of these (about FETCH in all, by the sample's estimate)."""
    aggs = []
    for s, (name, lo, hi) in enumerate(asked):
        o = orders[name]
        aggs += [o.before(lo).alias(f"b{s}"), F.collect_list(F.when(o.inside(lo, hi), o.struct)).alias(f"r{s}")]
    row = df.agg(*aggs).first()
    return [(row[f"b{s}"], len(row[f"r{s}"]), _in_order(row[f"r{s}"])) for s in range(len(asked))]


def tile_number(df: DataFrame, order: tuple[Column, Column], cuts: Sequence) -> Column:
    """The tile of a row: one more than the cuts that lie before it."""
    o = _Order(df, *order)
    out = F.lit(1).cast("bigint")
    for cut in cuts:
        if cut is not None:
            out = out + (o.struct > o.literal(cut)).cast("bigint")
    return out
