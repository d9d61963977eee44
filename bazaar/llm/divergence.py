"""Operator 13: how far sources of one language diverge, by Gustavson row accumulation.

A group is a (lang, source). Its smoothed share of a kept term is
p = 1 + floor(SCALE * (count + ALPHA) / (N + ALPHA * V)); two groups are
compared by the sum of |p - q| over all V kept terms, though most counts are 0:

    sum |p - q| = V * |b - c| + own(g, c) + own(h, b) + shared(g, h)

with b, c the shares of a count of 0 (the baselines) of groups g and h;
own(g, c) = sum over g's terms of |p - c| - |b - c|, from g's shares and their
running sums in order; shared(g, h) corrects the terms that both have.

1. One pass over the texts gives counts per (lang, source, term), combined in
   each task and before the shuffle; terms travel as texts only here.
2. Kept counts are cut into tiles: term blocks by the term's hash, and pairs
   of source blocks. A tile holds a term-major index of its postings; each of
   its groups scatters its terms through it into a dense accumulator with one
   cell per peer. Postings are never paired as rows: only the accumulators
   leave the tile, and their sums over the term blocks are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm._tokens import LETTERS, U64, Words, mix64, slices, small_batches
from bazaar.operators.ranking import count_groups, join_groups
from bazaar.session import reliable_checkpoint

SCALE, ALPHA = 1_000_000_000, 5  # fixed values of the shares
PEERS = 256                      # about so many sources in a block
POSTINGS = 50_000                # about so many postings in a tile
CHUNK = 1 << 16                  # postings scattered at a time


def spans_as_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each span as a string column."""
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offs[-1]) - np.repeat(offs[:-1] - starts, size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data[at]))


def _counts(batches):
    """(text, lang, source) -> (lang, source, term, occurrences, documents) of each run of texts."""
    words = Words(LETTERS)
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column(0)):
            groups: dict = {}
            names = [batch.column(c).slice(lo, hi - lo).to_pylist() for c in (1, 2)]
            code = np.array([groups.setdefault(g, len(groups)) for g in zip(*names)], np.int64)
            known = list(groups)
            starts, ends, at = words.spans(data, offs)
            h, _ = words.hashes(data, offs)
            per = np.diff(at)
            group = np.repeat(code, per)
            key = mix64(h ^ mix64(group.astype(U64)))
            _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            _, once = np.unique(key ^ mix64(np.repeat(np.arange(hi - lo), per).astype(U64)), return_index=True)
            held = np.bincount(inverse[once], minlength=len(first))
            of = pa.array(group[first])
            lang, source = (pa.array([g[c] for g in known], pa.string()).take(of) for c in (0, 1))
            term = spans_as_strings(words.lower[data], starts[first], ends[first]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(n), pa.array(held)],
                                             ["lang", "source", "term", "n", "docs"])


def share(count, total, v):
    """1 + floor(SCALE * (count + ALPHA) / (total + ALPHA * v)) without rounding; NULL where no term is kept."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.when(v > 0, F.call_function("div", wide(count + ALPHA) * F.lit(SCALE).cast("decimal(10,0)"),
                                         wide(total + v * ALPHA)) + 1)


def own_corrections(p: np.ndarray, b: int, c: np.ndarray) -> np.ndarray:
    """Sum over a group's shares p of |p - c| - |b - c|, for each peer baseline c."""
    p = np.sort(p)
    run = np.concatenate([[0], np.cumsum(p)])
    below = np.searchsorted(p, c, "right")
    return (run[-1] - run[below] - (len(p) - below) * c) + (below * c - run[below]) - len(p) * np.abs(b - c)


def accumulate(term: np.ndarray, group: np.ndarray, p: np.ndarray, base: np.ndarray, rows: np.ndarray,
               peers: np.ndarray) -> np.ndarray:
    """(rows, peers): the tile's correction of V * |b - c| for each row group and peer group.
    ``term``, ``group``, ``p``: postings; ``base``: baseline of each group."""
    seat = np.full(len(base), -1, np.int64)
    seat[peers] = np.arange(len(peers))
    # term-major index of the peers' postings
    mine = np.flatnonzero(seat[group] >= 0)
    mine = mine[np.argsort(term[mine], kind="stable")]
    n_terms = int(term.max()) + 1 if len(term) else 0
    index = np.searchsorted(term[mine], np.arange(n_terms + 1))
    seat_of, p_of, c_of = seat[group[mine]], p[mine], base[group[mine]]
    by_group = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[by_group], np.arange(len(base) + 1))
    out = np.zeros((len(rows), len(peers)), np.int64)
    for r, g in enumerate(rows):
        own = by_group[ends[g]:ends[g + 1]]
        b, line = base[g], out[r]
        for lo in range(0, len(own), CHUNK):
            t, q = term[own[lo:lo + CHUNK]], p[own[lo:lo + CHUNK]]
            n = index[t + 1] - index[t]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - index[t], n)
            q, o, c = np.repeat(q, n), p_of[at], c_of[at]
            np.add.at(line, seat_of[at], np.abs(q - o) - np.abs(q - c) - np.abs(b - o) + np.abs(b - c))
        line += own_corrections(p[own], b, base[peers])
    for k, h in enumerate(peers):  # the peers' own terms against the rows' baselines
        out[:, k] += own_corrections(p[by_group[ends[h]:ends[h + 1]]], base[h], base[rows])
    return out


def _tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One tile: rows (part, source, base, term, p), groups with a NULL term."""
    lo, hi = key[1].as_py(), key[2].as_py()
    told = table.filter(pc.is_null(table.column("term"))).sort_by("source")
    names = told.column("source").combine_chunks()
    base, part = told.column("base").to_numpy(), told.column("part").to_numpy()
    has = table.filter(pc.is_valid(table.column("term")))
    group = pc.index_in(has.column("source"), value_set=names).to_numpy().astype(np.int64)
    _, term = np.unique(has.column("term").to_numpy(), return_inverse=True)
    rows, peers = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    out = accumulate(term, group, has.column("p").to_numpy(), base, rows, peers)
    a, b = np.repeat(rows, len(peers)), np.tile(peers, len(rows))
    some = a < b if lo == hi else np.ones(len(a), bool)
    a, b, v = a[some], b[some], out.ravel()[some]
    lang = pa.array([key[0].as_py()], pa.string()).take(pa.array(np.zeros(len(a), np.int64)))
    return pa.table([lang, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(np.abs(base[a] - base[b])),
                     pa.array(v)], ["lang", "a", "b", "gap", "v"])


def divergence_audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                     min_docs: int = 30, top: int = 50) -> DataFrame:
    """-> (lang, source, part, item, value, rank).

    Terms are runs of letters a-z and characters beyond ASCII, A-Z lower-cased.
    A lang keeps the terms that at least ``min_docs`` of its documents hold. Part
    ``pair``: each other source of the lang, value the sum of |p - q| over all
    kept terms; part ``term``: the ``top`` kept terms that the group has and
    whose share is above the whole lang's, value the difference. Ranks go by
    value descending, then item ascending by its UTF-8 bytes.

    Defined cases: NULL text, lang or source reads as ''. Every row is a
    document, repeated rows too. A group without kept terms has pairs (its
    shares are the baselines) and no terms; a lang that keeps no term has pairs
    of value 0; a lang with one source has no pairs. Texts of any length are
    taken whole. Other columns are not looked at. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
             for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    texts = docs.select(*plain)
    groups = texts.select("lang", "source").distinct()
    counts = texts.mapInArrow(_counts, "lang string, source string, term string, n bigint, docs bigint").groupBy(
        "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term's rows are at most one per source; terms that too few documents hold go before anything is written
    of_term = Window.partitionBy("lang", "term")
    postings = reliable_checkpoint(
        counts.withColumn("held", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
        .where(F.col("held") >= min_docs).select("lang", "source", "term", "n", "lang_n"))
    langs = postings.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"), F.count(F.lit(1)).alias("held_by"))
    langs = langs.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"),
                                      F.sum("held_by").alias("postings"))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(PEERS)).cast("int").alias("parts"))
    langs = reliable_checkpoint(sizes.join(langs, "lang", "left").select(
        "lang", "parts", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("postings", F.lit(0)) / (F.col("parts") * POSTINGS))).cast("int")
        .alias("cuts")))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    n_langs = langs.count()
    told = join_groups(groups.join(totals, ["lang", "source"], "left"), langs, ["lang"], n_langs)
    total = F.coalesce("total", F.lit(0))
    told = reliable_checkpoint(told.select(
        "lang", "source", total.alias("total"), "parts", "cuts", "v", "lang_total",
        F.coalesce(share(F.lit(0), total, F.col("v")), F.lit(0)).alias("base"),
        F.pmod(F.xxhash64("source"), F.col("parts")).cast("int").alias("part")))
    n_groups = told.count()
    placed = join_groups(postings, told, ["lang", "source"], n_groups)
    placed = placed.select("lang", "source", "term", "n", "lang_n", "v", "lang_total", "parts", "part", "base", "cuts",
                           share(F.col("n"), F.col("total"), F.col("v")).alias("p"))

    # tiles: (lang, two source blocks, term block); groups reach every tile of their block
    seat = told.select("lang", "source", "parts", "part", "base", F.lit(None).cast("bigint").alias("term"),
                       F.lit(0).cast("bigint").alias("p"),
                       F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    post = placed.select("lang", "source", "parts", "part", "base", F.xxhash64("term").alias("term"), "p",
                         F.pmod(F.xxhash64(F.lit("cut"), "term"), F.col("cuts")).cast("int").alias("cut"))
    both = seat.unionByName(post).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = both.select("lang", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "cut",
                       "part", "source", "base", "term", "p")
    sums = (both.groupBy("lang", "lo", "hi", "cut").applyInArrow(
        _tile, "lang string, a string, b string, gap bigint, v bigint")
        .groupBy("lang", "a", "b").agg(F.max("gap").alias("gap"), F.sum("v").alias("v")))
    pairs = join_groups(sums.withColumnRenamed("v", "corrections"), langs.select("lang", "v"), ["lang"], n_langs)
    value = F.col("corrections") + F.col("v") * F.col("gap")
    ends = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))])
    pairs = (pairs.select("lang", value.alias("value"), F.explode(ends).alias("e"))
             .select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value"))

    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    terms = (placed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                           (F.col("p") - q).alias("value")).where("value > 0")
             .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))
    return pairs.withColumn("rank", F.row_number().over(w)).unionByName(terms)
