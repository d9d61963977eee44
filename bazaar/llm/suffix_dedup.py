"""Operator 6: passages that repeat across documents, by sparse suffix arrays.

1. Equal word sequences become one document at once.
2. A text keeps only the suffixes that start at minimisers: of every
   ``window`` consecutive ``gram``-word hashes, the smallest. Equal passages
   choose equal places, and a passage of ``window`` + ``gram`` - 1 <=
   ``min_words`` words holds at least one.
3. Suffixes whose first ``gram`` words no other document has are dropped
   (a count per hash, combined before the shuffle).
4. The others get their words up to ``window`` before and ``min_words`` after
   the place, and are sorted by (first words, words after): the sparse suffix
   array, a task holding whole runs of equal first words.
5. An entry must match one other document in L words to the left and at least
   min_words - L to the right. For every L the entries that agree in the L
   words before them are neighbours in the order of the words after: the
   nearest ones of other documents above and below have the longest match to
   the right, and no other entry can do better. So all L together give the
   exact union of the matches, extended left and right.
6. First words of more than ``hot`` entries are not brought together: their
   entries' windows of ``min_words`` words, one for each L, are counted by hash
   (smallest and largest document, combined before the shuffle), which gives
   the same spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm._tokens import NONSPACE, U64, Words, add_at, mix64, slices, windows
from bazaar.session import reliable_checkpoint


def minimisers(grams: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest of every ``window`` consecutive values of one text;
    a text with fewer values has its smallest one. Of equals, the place chosen
    for the window before if it is still inside, else the last one: a run of one
    repeated phrase gives a place per window, not one per word."""
    n = np.diff(at)
    out = []
    long_ = n >= window
    if long_.any():
        # every full window inside one text
        ends = np.repeat(at[1:], n)
        begin = np.flatnonzero(np.arange(len(grams)) + window <= ends)
        left, right = begin.copy(), begin.copy()
        low = grams[begin]
        for k in range(1, window):
            x = grams[begin + k]
            left = np.where(x < low, begin + k, left)
            right = np.where(x <= low, begin + k, right)
            low = np.minimum(x, low)
        for t in np.flatnonzero(left != right):
            before = right[t - 1] if t and begin[t] == begin[t - 1] + 1 else -1
            if before >= begin[t] and grams[before] == low[t]:
                right[t] = before
        out.append(np.unique(right))
    for i in np.flatnonzero((n > 0) & ~long_):
        out.append(np.array([at[i] + grams[at[i]:at[i + 1]].argmin()]))
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _scan(gram: int, window: int):
    """(id, n, hid, places, grams): word count, hash of the words, and minimisers of each text."""
    def run(batches):
        words = Words(NONSPACE)
        for b in batches:
            for lo, hi, data, offs in slices(b.column("text")):
                h, at = words.hashes(data, offs)
                n = np.diff(at)
                g, ga = windows(h, at, gram)
                whole = n >= gram  # shorter texts have no full gram
                keep = np.repeat(whole, np.diff(ga))
                g, ga = g[keep], np.concatenate([[0], np.cumsum(np.where(whole, np.diff(ga), 0))])
                m = minimisers(g, ga, window)
                doc = np.searchsorted(ga, m, "right") - 1
                cut = np.searchsorted(m, ga).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), pa.array(n),
                     pa.array(_sequence_hash(h, at), pa.binary()),
                     pa.ListArray.from_arrays(cut, (m - ga[doc]).astype(np.int32)),
                     pa.ListArray.from_arrays(cut, g[m].view(np.int64))],
                    ["id", "n", "hid", "places", "grams"])
    return run


def _words(batches):
    """(id, hid, words): word hashes of 32 bits as bytes."""
    words = Words(NONSPACE)
    for b in batches:
        for lo, hi, data, offs in slices(b.column("text")):
            h, at = words.hashes(data, offs)
            short = (h >> U64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").slice(lo, hi - lo), pa.array(_sequence_hash(h, at), pa.binary()),
                 pa.array([short[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                ["id", "hid", "words"])


def _sequence_hash(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits of the words in their order, and their number, for each text."""
    n = np.diff(at)
    pos = np.arange(len(h)) - np.repeat(at[:-1], n)
    marks = [add_at(mix64(h ^ mix64(pos.astype(U64) + U64(c))), at) for c in (11, 1 << 33)]
    raw = np.ascontiguousarray(np.stack([*marks, n.astype(U64)], axis=1)).view(np.uint8).reshape(len(n), 24)
    return [r.tobytes() for r in raw]


def _suffixes(before: int, after: int):
    """(id, words, [(pos, gram)]) -> one row per suffix with its words on both
    sides as bytes: those before in reverse order; shorter at the text's ends."""
    def run(batches):
        for b in batches:
            for rid, raw, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = np.frombuffer(raw, np.uint32)
                pos = [f["pos"] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid] * len(pos), pa.int64()), pa.array(pos, pa.int32()),
                     pa.array([f["gram"] for f in found], pa.int64()),
                     pa.array([w[p:p + after].tobytes() for p in pos], pa.binary()),
                     pa.array([w[max(0, p - before):p][::-1].tobytes() for p in pos], pa.binary())],
                    ["id", "pos", "gram", "after", "before"])
    return run


def _windows_of(before: int, size: int):
    """(id, words, [(pos, gram)]) -> (id, start, k1, k2): the windows of ``size`` words
    that begin at most ``before`` words before a suffix, hashed to 128 bits."""
    def run(batches):
        for b in batches:
            for rid, raw, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = np.frombuffer(raw, np.uint32).astype(U64)
                starts = np.unique(np.concatenate([np.arange(f["pos"] - before, f["pos"] + 1) for f in found]))
                starts = starts[(starts >= 0) & (starts + size <= len(w))]
                if not len(starts):
                    continue
                keys = []
                for seed in (3, 1 << 40):
                    k = np.full(len(starts), seed, U64)
                    for i in range(size):
                        k = mix64(k * U64(0x9E3779B97F4A7C15) + w[starts + i])
                    keys.append(pa.array(k.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), rid)), pa.array(starts), *keys], ["id", "start", "k1", "k2"])
    return run


def _matrix(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) // 4 for x in column])
    return np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in column), np.uint32).reshape(-1, width), n


def _common(m: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common start of rows i and j."""
    same = m[i] == m[j]
    run = np.where(same.all(axis=1), m.shape[1], same.argmin(axis=1))
    return np.minimum(run, np.minimum(n[i], n[j]))


def _spans(ids, pos, gram, after, before, widths, min_words: int):
    """Matches of entries sorted by (gram, after), whole grams: (id, start, end) arrays."""
    a, na = _matrix(after, widths[1])
    b, nb = _matrix(before, widths[0])
    left, right = np.full(len(ids), -1), np.full(len(ids), -1)
    # the entries by the words before them; how many words each shares with the one above
    by_before = np.lexsort((*b.T[::-1], gram))
    x, y = by_before[1:], by_before[:-1]
    shared = np.concatenate([[-1], np.where(gram[x] == gram[y], _common(b, nb, x, y), -1)])
    agree = np.empty(len(ids), np.int64)
    for words in range(widths[0] + 1):
        agree[by_before] = np.cumsum(shared < words)  # entries that agree in so many words before them
        many = np.bincount(agree)[agree] > 1
        o = np.flatnonzero(many)
        if not len(o):
            break
        o = o[np.argsort(agree[o], kind="stable")]
        g, d = agree[o], ids[o]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        for near in (first[run] - 1, np.append(first, len(o))[run + 1]):  # the entry above / below this document's run
            i = np.flatnonzero((near >= 0) & (near < len(o)))
            i = i[g[near[i]] == g[i]]
            reach = _common(a, na, o[i], o[near[i]])
            hit = words + reach >= min_words
            e = o[i[hit]]
            left[e] = words
            right[e] = np.maximum(right[e], reach[hit])
    e = np.flatnonzero(left >= 0)
    return ids[e], pos[e] - left[e], pos[e] + right[e]


def _neighbours(widths, min_words: int):
    """Sorted entries -> spans (id, start, end)."""
    def spans(t):
        found = _spans(t.column("id").to_numpy(), t.column("pos").to_numpy().astype(np.int64), t.column("gram").to_numpy(),
                       t.column("after").to_pylist(), t.column("before").to_pylist(), widths, min_words)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["id", "start", "end"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            gram = held.column("gram").to_numpy()
            cut = np.flatnonzero(gram != gram[-1])
            if len(cut):
                yield from spans(held.slice(0, cut[-1] + 1).combine_chunks())
                held = held.slice(cut[-1] + 1)
        if held is not None:
            yield from spans(held.combine_chunks())
    return run


def _merge(batches):
    """(id, sorted spans) -> the union of the spans."""
    for b in batches:
        rows = []
        for spans in b.column("spans").to_pylist():
            out: list[list[int]] = []
            for s in spans:
                if out and s["start"] <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], s["end"])
                else:
                    out.append([s["start"], s["end"]])
            rows.append([{"start": s, "end": e} for s, e in out])
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["id", "spans"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50,
                      gram: int = 20, window: int = 30, hot: int = 5_000) -> DataFrame:
    """-> (doc_id, n_words, n_repeated, spans): the documents with passages of at
    least ``min_words`` words that another document has too; ``spans`` are word
    ranges [start, end), in order and apart; n_repeated is their total length.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A
    document whose whole text (of ``min_words`` words or more) another one has
    is one span. ``hot`` bounds the entries of one task; results do not depend on it.

    Defined cases: NULL, empty and shorter texts have no passages. Rows that
    repeat an id are one document, so a text does not repeat itself that way;
    their spans are joined and returned with every row. Rows with a NULL id
    are left out. Repeats inside one document do not count. Other columns are
    not looked at. Texts of any length are taken whole. No rows give no rows.
    """
    if window + gram - 1 > min_words:
        raise ValueError("window + gram - 1 must not be over min_words")
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"),
                                                       F.col(text_col).cast("string").alias("text"))
    told = reliable_checkpoint(src.mapInArrow(
        _scan(gram, window),
        "id bigint, n bigint, hid binary, places array<int>, grams array<bigint>"))
    some = told.where(F.col("n") >= min_words)
    nodes = some.groupBy("hid").agg(F.min("id").alias("rep"), F.max("id").alias("high"))
    nodes = reliable_checkpoint(nodes)

    # one row per distinct word sequence from here on
    lead = some.select("id", "hid", "places", "grams").join(
        nodes.select("hid", "rep"), "hid").where(F.col("id") == F.col("rep")).drop("rep")
    places = lead.select("id", "hid", F.explode(F.arrays_zip(F.col("places").alias("pos"), F.col("grams").alias("gram")))
                         .alias("p")).select("id", "hid", F.col("p.pos").alias("pos"), F.col("p.gram").alias("gram"))
    shared = reliable_checkpoint(places.groupBy("gram").agg(F.min("id").alias("a"), F.max("id").alias("b"),
                                                             F.count(F.lit(1)).alias("m"))
                                 .where("a != b").select("gram", (F.col("m") > hot).alias("hot")))
    # the texts of those documents are read again: their words travel once, as hashes
    texts = src.mapInArrow(_words, "id bigint, hid binary, words binary")

    def words_of(grams: DataFrame) -> DataFrame:
        """(id, words, found) of the documents with places of these grams."""
        found = places.join(grams, "gram").groupBy("id", "hid").agg(F.collect_set(F.struct("pos", "gram")).alias("found"))
        return texts.join(found, ["id", "hid"]).dropDuplicates(["id", "hid"]).select("id", "words", "found")

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = words_of(shared.where("NOT hot").select("gram")).mapInArrow(
        _suffixes(window, min_words), "id bigint, pos int, gram bigint, after binary, before binary")
    spans = (entries.repartition(parts, "gram").sortWithinPartitions("gram", "after")
             .mapInArrow(_neighbours((window, min_words), min_words), "id bigint, start bigint, end bigint"))
    if not shared.where("hot").isEmpty():
        seen = reliable_checkpoint(words_of(shared.where("hot").select("gram")).mapInArrow(
            _windows_of(min_words - gram, min_words), "id bigint, start bigint, k1 bigint, k2 bigint"))
        twice = reliable_checkpoint(seen.groupBy("k1", "k2").agg(F.min("id").alias("a"), F.max("id").alias("b"))
                                    .where("a != b").select("k1", "k2"))
        spans = spans.unionByName(seen.join(twice, ["k1", "k2"]).select(
            "id", "start", (F.col("start") + min_words).alias("end")))
    merged = (spans.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
              .mapInArrow(_merge, "id bigint, spans array<struct<start:bigint,end:bigint>>"))

    # a copy has the spans of its word sequence; several copies are a repeat as a whole
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n").alias("end")))
    out = (some.select("id", "n", "hid").join(nodes, "hid")
           .join(merged.withColumnRenamed("id", "rep"), "rep", "left")
           .select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"),
                   F.when(F.col("rep") != F.col("high"), whole).otherwise(F.col("spans")).alias("spans"))
           .where("spans IS NOT NULL"))
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_words", total.alias("n_repeated"), "spans")
