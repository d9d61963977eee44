"""Operator 2: benchmark decontamination with a positional inverted index.

1. Benchmark items are cut into windows of ``size`` words. Items are handled
   in blocks of at most ``block_words`` words (one longer item is a block), so
   what is sent to the tasks is bounded whatever the benchmark's size.
2. One pass counts how often each benchmark term occurs in the training texts.
3. The index: for the two rarest terms of every window, all training postings
   (term, document, position) with the neighbouring words up to ``size`` - 1
   places away, written to the checkpoint folder.
4. Phrase search: postings join the places that a term has in the items; list
   entries agree when position minus offset does, so a window is a candidate
   where its two rarest terms' offset-adjusted lists meet in one document.
5. A candidate counts when its neighbouring words equal the whole window.

Texts are never shuffled: postings carry what the exact check needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm._tokens import U64, WORD, Words, slices, small_batches
from bazaar.session import reliable_checkpoint


def _terms(batches):
    words = Words(WORD)
    for b in batches:
        for lo, hi, data, offs in slices(b.column("text")):
            h, at = words.hashes(data, offs)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").slice(lo, hi - lo),
                 pa.ListArray.from_arrays(at.astype(np.int32), h.view(np.int64))], ["id", "terms"])


def _in(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    i = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return sorted_[i] == h


def _frequencies(vocabulary: np.ndarray):
    def run(batches):
        words, total = Words(WORD), np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for _, _, data, offs in slices(b.column("text")):
                h, _ = words.hashes(data, offs)
                h = h[_in(vocabulary, h)]
                total += np.bincount(np.searchsorted(vocabulary, h), minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[some].view(np.int64)), pa.array(total[some])],
                                         ["term", "n"])
    return run


def _postings(anchors: np.ndarray, reach: int):
    """(id, term, pos, near): ``near`` is the words from ``reach`` places before to
    ``reach`` after, 0 beyond the text's ends."""
    def run(batches):
        words = Words(WORD)
        for b in batches:
            for lo, hi, data, offs in slices(b.column("text")):
                h, at = words.hashes(data, offs)
                hit = np.flatnonzero(_in(anchors, h))
                doc = np.searchsorted(at, hit, "right") - 1
                place = hit[:, None] + np.arange(-reach, reach + 1)
                inside = (place >= at[doc][:, None]) & (place < at[doc + 1][:, None])
                near = np.where(inside, h[np.clip(place, 0, max(len(h) - 1, 0))], U64(0)) if len(h) else \
                    np.zeros((0, 2 * reach + 1), U64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo).take(pa.array(doc)), pa.array(h[hit].view(np.int64)),
                     pa.array(hit - at[doc]),
                     pa.FixedSizeListArray.from_arrays(near.ravel().view(np.int64), 2 * reach + 1).cast(
                         pa.list_(pa.int64()))],
                    ["id", "term", "pos", "near"])
    return run


def _word_counts(batches):
    words = Words(WORD)
    for b in batches:
        for lo, hi, data, offs in slices(b.column("text")):
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "id")),
                 pa.array(np.diff(words.spans(data, offs)[2]))], ["doc_id", "id", "n"])


class _Items:
    """One block of items: their words, windows and each window's two rarest terms."""

    def __init__(self, ids: list, terms: list[np.ndarray], size: int):
        self.ids, self.terms, self.size = ids, terms, size
        self.vocabulary = np.unique(np.concatenate(terms))

    def choose(self, counts: dict[int, int]) -> None:
        """``pairs``[item, start] = positions of the two rarest terms of the window."""
        n = np.array([counts.get(int(t), 0) for t in self.vocabulary.view(np.int64)])
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        places: set[tuple[int, int]] = set()
        for i, words in enumerate(self.terms):
            rare = n[np.searchsorted(self.vocabulary, words)]
            width = min(self.size, len(words))
            for s in range(len(words) - width + 1):
                order = np.argsort(rare[s:s + width], kind="stable")
                if not rare[s + order[0]]:
                    continue  # a word that no training text has
                a, b = s + int(order[0]), s + int(order[min(1, width - 1)])
                self.pairs[i, s] = (a, b)
                places |= {(i, a), (i, b)}
        self.places = sorted(places)

    def anchors(self) -> np.ndarray:
        return np.unique(np.array([self.terms[i][p] for i, p in self.places], U64))


def _confirm(items: _Items, reach: int):
    """Candidates (id, item, shift, places) -> exact windows (id, item, start, width)."""
    by_item: dict[int, list] = {}
    for (i, s), (a, b) in items.pairs.items():
        by_item.setdefault(i, []).append((s, a, b))

    def run(batches):
        for batch in batches:
            rows = []
            for rid, item, shift, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = items.terms[item].view(np.int64)
                width = min(items.size, len(words))
                at: dict[int, list] = {}  # texts that share an id have a posting each
                for x in places:
                    at.setdefault(x["off"], []).append(x["near"])
                for s, a, b in by_item.get(item, ()):
                    if a in at and b in at:
                        lo, want = s - a + reach, words[s:s + width].tolist()
                        if any(near[lo:lo + width] == want for near in at[a]):
                            rows.append((rid, item, shift + s, width))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], batch.schema.field("id").type if not k else pa.int64())
                 for k in range(4)], ["id", "item", "start", "width"])
    return run


def phrase_hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
                size: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """-> (id, item_id, start, width): every occurrence of an item window in a text."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = items.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    cut = cut.where("id IS NOT NULL").mapInArrow(_terms, "id string, terms array<bigint>").where("size(terms) > 0")
    cut = reliable_checkpoint(cut)
    total = cut.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // block_words)
    found = None
    for k in range(blocks):
        # one block of items, at most about block_words words
        part = cut.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id").collect()
        if not part:
            continue
        it = _Items([r.id for r in part], [np.array(r.terms, np.int64).view(U64) for r in part], size)
        counts = src.select("text").mapInArrow(_frequencies(it.vocabulary), "term bigint, n bigint") \
            .groupBy("term").agg(F.sum("n").alias("n"))
        it.choose({r.term: r.n for r in counts.collect()})  # at most one row per benchmark term
        if not it.places:
            continue
        index = reliable_checkpoint(src.mapInArrow(
            _postings(it.anchors(), size - 1), "id bigint, term bigint, pos bigint, near array<bigint>"))
        at = spark.createDataFrame([(int(it.terms[i][p].view(np.int64)), i, p, len(it.terms[i]) == 1)
                                    for i, p in it.places], "term bigint, item int, off int, lone boolean")
        # bounded: at most two places for each window of the block
        met = (index.join(F.broadcast(at), "term")
               .groupBy("id", "item", (F.col("pos") - F.col("off")).alias("shift"))
               .agg(F.collect_list(F.struct("off", "near")).alias("places"), F.max("lone").alias("lone"))
               .where("size(places) > 1 OR lone").drop("lone"))
        rows = met.mapInArrow(_confirm(it, size - 1), "id bigint, item bigint, start bigint, width bigint")
        names = spark.createDataFrame(list(enumerate(it.ids)), "item bigint, item_id string")
        rows = rows.join(F.broadcast(names), "item").select("id", "item_id", "start", "width")
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame(
        [], "id bigint, item_id string, start bigint, width bigint")


def proximity_hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str,
                   item_text_col: str, within: int = 20, block_words: int = 1_000_000) -> DataFrame:
    """-> (id, item_id, first, last): places where all distinct words of an item
    stand within ``within`` words of each other, in any order, around an
    occurrence of its rarest word (every such place has one)."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = items.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    cut = reliable_checkpoint(cut.where("id IS NOT NULL").mapInArrow(_terms, "id string, terms array<bigint>")
                              .select("id", F.array_distinct("terms").alias("terms"))
                              .where((F.size("terms") > 0) & (F.size("terms") <= within)))
    total = cut.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // block_words)
    found = spark.createDataFrame([], "id bigint, item_id string, first bigint, last bigint")
    for k in range(blocks):
        part = cut.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()  # bounded as above
        if not part:
            continue
        terms = {r.id: np.array(r.terms, np.int64) for r in part}
        vocabulary = np.unique(np.concatenate(list(terms.values())).view(U64))
        n = {r.term: r.n for r in src.select("text").mapInArrow(_frequencies(vocabulary), "term bigint, n bigint")
             .groupBy("term").agg(F.sum("n").alias("n")).collect()}
        rare = {i: min((int(t) for t in w), key=lambda t: (n.get(t, 0), t)) for i, w in terms.items()}
        rare = {i: t for i, t in rare.items() if n.get(t)}
        if not rare:
            continue
        anchors = np.unique(np.array(list(rare.values()), np.int64).view(U64))
        index = reliable_checkpoint(src.mapInArrow(
            _postings(anchors, within - 1), "id bigint, term bigint, pos bigint, near array<bigint>"))
        at = spark.createDataFrame([(t, i, terms[i].tolist()) for i, t in rare.items()],
                                   "term bigint, item_id string, want array<bigint>")
        near = index.join(F.broadcast(at), "term")
        starts = near.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(within - 1))))
        view = F.slice("near", F.col("s") + 1, within)
        full = starts.where(F.size(F.array_except("want", view)) == 0)
        found = found.unionByName(full.groupBy("id", "item_id", "pos").agg(F.max("s").alias("s")).select(
            "id", "item_id", (F.col("pos") - (within - 1) + F.col("s")).alias("first"),
            (F.col("pos") + F.col("s")).alias("last")))
    return found


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = 10,
                  block_words: int = 1_000_000) -> DataFrame:
    """-> (doc_id, n_words, n_hit, n_items, items, contaminated), one row per input row.

    Words are runs of digits, letters and anything beyond ASCII, A-Z
    lower-cased. A window is ``size`` consecutive item words; an item of fewer
    words, but not none, is one window. Document words inside any occurrence
    of a window are hit; ``items`` lists the items with occurring windows,
    sorted as strings.

    Defined cases: NULL or empty texts and items have no words and hit nothing.
    Texts of any length are read whole. Rows that repeat an id share their
    hits. A row with a NULL id is a document of its own, named by its text.
    Items that repeat an item id are one item with several texts. NULL item
    ids are ignored. Other columns are not looked at.
    """
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"),
                      F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(F.lit("no id"), text)).alias("id"))
    hits = phrase_hits(src.select("id", "text"), items, "id", "text", item_col, item_text_col, size, block_words)
    per = hits.where("id IS NOT NULL").groupBy("id").agg(
        F.collect_set(F.struct("start", "width")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    words = F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["start"], s["start"] + s["width"] - 1))))
    per = per.select("id", F.size(words).cast("bigint").alias("n_hit"), "items")
    sized = src.mapInArrow(_word_counts, "doc_id bigint, id bigint, n bigint")
    return sized.join(per, "id", "left").select(
        "doc_id", F.col("n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
