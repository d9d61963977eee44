"""Operator 11: quality rules with cross-document line frequency.

1. One pass over the texts takes the base figures of every document and the
   128-bit hash of every line's normalised form (its words, A-Z lower-cased,
   one space between them). From here on only hashes and counts travel.
2. Equal texts of one host are one document; a line counts once in each. So
   the count of a (host, line) is a plain sum, combined before its shuffle: a
   line that a third of all documents hold is one row per task.
3. Lines in at least ``min_docs`` documents of a host and in more than
   ``percent_docs`` of its documents are above the limit. Their list is
   counted; a short one is sent to every task, a longer one meets the lines
   in a join whose hot partitions adaptive execution splits.
4. What a document loses is summed per document; it is depleted if too few
   words, or too small a share of its words, are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm._tokens import NONSPACE, U64, Words, add_at, mix64, slices, small_batches, windows
from bazaar.operators.ranking import count_groups, join_groups
from bazaar.session import reliable_checkpoint

#: Lines above the limit up to which their list (20 bytes a line) is sent to every task.
BROADCAST_LINES = 200_000

#: Fixed values of the base rules: symbol characters, words of a window, fewest words, most repeated words (percent).
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20


def base_figures(raw: Words, data: np.ndarray, offs: np.ndarray):
    """Per text (words, code points in words, symbols, repeated lines, words in
    repeated windows, two hashes of the whole text), and the lines with words
    as (text, place in the text, first word, words)."""
    n_texts, n = len(offs) - 1, len(data)
    run = raw.running(data)
    starts, ends, at = raw.spans(data, offs)
    h = raw.of_spans(run, starts, ends)
    text_of = np.repeat(np.arange(n_texts), np.diff(at))
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points begin at these bytes
    chars = add_at(lead[ends] - lead[starts], at)
    marks = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8)))])
    symbols = marks[offs[1:]] - marks[offs[:-1]]

    # windows found twice or more in one text cover their words
    w, w_at = windows(h, at, WINDOW)
    runs = np.diff(w_at)
    begin = np.arange(len(w)) - np.repeat(w_at[:-1] - at[:-1], runs)
    _, again, count = np.unique(w ^ mix64(np.repeat(np.arange(n_texts), runs).astype(U64)),
                                return_inverse=True, return_counts=True)
    twice = begin[count[again] > 1]
    cover = np.zeros(len(h) + WINDOW + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    repeated = add_at((np.cumsum(cover)[:len(h)] > 0).astype(np.int64), at)

    # lines: begin at a text's start and after each newline
    newline = np.flatnonzero(data == 10)
    line_at = np.unique(np.concatenate([offs[:-1], newline + 1]))
    of_word = np.searchsorted(line_at, starts, "right") - 1
    lines, first, words = np.unique(of_word, return_index=True, return_counts=True)
    owner = text_of[first] if len(first) else np.zeros(0, np.int64)
    begins = line_at[lines]
    next_newline = np.concatenate([newline, [n]])[np.searchsorted(newline, begins)]
    key = raw.of_spans(run, begins, np.minimum(next_newline, offs[owner + 1])) ^ mix64(owner.astype(U64))
    lines_at = np.searchsorted(owner, np.arange(n_texts + 1))
    _, seen = np.unique(key, return_index=True)
    fresh = np.zeros(len(key), np.int64)
    fresh[seen] = 1
    dup_lines = np.diff(lines_at) - add_at(fresh, lines_at)
    place = np.searchsorted(newline, begins) - np.searchsorted(newline, offs[owner])
    inside = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
    whole = (raw.of_spans(run, offs[:-1], offs[1:]),
             add_at(mix64(h + inside.astype(U64) * U64(0x9E3779B97F4A7C15)), at))
    return np.diff(at), chars, symbols, dup_lines, repeated, whole, (lines_at, place, first, words)


def _describe(batches):
    raw, folded = Words(NONSPACE, fold=False), Words(NONSPACE)
    for batch in batches:
        column = batch.column(2)
        for lo, hi, data, offs in slices(column):
            n_words, chars, symbols, dup, rep, whole, (lines_at, place, first, words) = base_figures(raw, data, offs)
            h, _ = folded.hashes(data, offs)
            inside = (np.arange(len(h)) - np.repeat(first, words)).astype(U64)
            line_of = np.concatenate([first, [len(h)]])
            keys = [add_at(mix64(h * U64(2 * c + 1) + inside * U64(0xD6E8FEB86659FD93) + U64(c)), line_of)
                    for c in (0, 0x51ED27)]
            # the first place of a line in its document counts, in the order of the text
            owner = np.repeat(np.arange(hi - lo), np.diff(lines_at)).astype(U64)
            _, seen = np.unique(keys[0] ^ mix64(keys[1] ^ mix64(owner)), return_index=True)
            counts = np.zeros(len(first), bool)
            counts[seen] = True
            lines = pa.StructArray.from_arrays(
                [pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(place.astype(np.int32)),
                 pa.array(words.astype(np.int32)), pa.array(counts)], ["h1", "h2", "pos", "words", "counts"])
            out = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                   *(pa.array(np.asarray(c, np.int64)) for c in (n_words, chars, symbols, dup, rep)),
                   *(pa.array(c.view(np.int64)) for c in whole),
                   pa.ListArray.from_arrays(pa.array(lines_at.astype(np.int32)), lines)]
            names = ["id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "t1", "t2",
                     "lines"]
            if batch.num_columns > 3:
                out.append(batch.column(3).slice(lo, hi - lo))
                names.append("whole")
            yield pa.RecordBatch.from_arrays(out, names)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  min_docs: int = 10, percent_docs: float = 5.0, least_left: int = LEAST_WORDS,
                  percent_left: float = 50.0, with_text: bool = False) -> DataFrame:
    """-> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_frequent_lines, n_left_words, dropped_lines, depleted, kept
    [, kept_text]), one row per input row.

    ``base_failed``: fewer than 10 words, or over 20 percent of them in 5-word
    windows that the text holds twice or more. ``dropped_lines``: the places
    (from 0, text split at \\n) of lines that at least ``min_docs`` documents
    of the host and more than ``percent_docs`` percent of its documents hold.
    ``depleted``: fewer than ``least_left`` words or less than ``percent_left``
    percent of them are left. ``kept``: neither. ``with_text`` adds the text
    without its dropped lines; texts then travel once.

    Defined cases: NULL or empty text has no words and fails the base rules.
    A NULL host is a host of its own. Rows with equal text and host, be their
    ids equal or not, are one document in all counts, and each is returned;
    rows that repeat an id with other texts are documents of their own, and a
    NULL id is an id. Lines without words are never counted or dropped. A text
    of any length is taken whole, in a run of its own over 1 MB. Other columns
    of ``docs`` are not looked at, whatever their names. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("text"),
                      *([F.coalesce(text, F.lit("")).alias("whole")] if with_text else []))
    id_type = src.schema["id"].dataType.simpleString()
    told = src.mapInArrow(_describe, (
        f"id {id_type}, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, t1 bigint, t2 bigint, "
        "lines array<struct<h1:bigint,h2:bigint,pos:int,words:int,counts:boolean>>"
        + (", whole string" if with_text else "")))
    told = reliable_checkpoint(told.withColumn("row", F.monotonically_increasing_id()))

    texts = told.select("host", "t1", "t2", F.transform(F.filter("lines", lambda x: x["counts"]), lambda x: F.struct(
        x["h1"].alias("h1"), x["h2"].alias("h2"))).alias("keys"))
    texts = texts.groupBy("host", "t1", "t2").agg(F.any_value("keys").alias("keys"))
    hosts = told.select("host", "t1", "t2").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    held = (texts.select("host", F.explode("keys").alias("k")).groupBy("host", "k.h1", "k.h2")
            .agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= min_docs))
    frequent = join_groups(held, hosts, ["host"], count_groups(told, ["host"])).where(
        F.col("held") * 100.0 > F.col("documents") * F.lit(float(percent_docs))).select(
        F.col("host").alias("at"), "h1", "h2")
    frequent = reliable_checkpoint(frequent)
    few = frequent.count() <= BROADCAST_LINES
    lines = told.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.*")
    hit = F.broadcast(frequent) if few else frequent
    same = (lines["h1"] == hit["h1"]) & (lines["h2"] == hit["h2"]) & lines["host"].eqNullSafe(hit["at"])
    lost = (lines.join(hit, same).groupBy(F.col("row").alias("of"))
            .agg(F.sum("words").alias("lost"), F.array_sort(F.collect_list("pos")).alias("places")))

    both = told.drop("lines").join(lost, F.col("row") == F.col("of"), "left")
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    depleted = (left < least_left) | (left * 100.0 < F.col("n_words") * F.lit(float(percent_left)))
    places = F.coalesce("places", F.array().cast("array<int>"))
    out = [F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           failed.alias("base_failed"), F.size(places).cast("bigint").alias("n_frequent_lines"),
           left.cast("bigint").alias("n_left_words"), places.alias("dropped_lines"), depleted.alias("depleted"),
           (~failed & ~depleted).alias("kept")]
    if with_text:
        split = F.split("whole", "\n", -1)
        gone = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), places)
        out.append(F.when(F.size(places) == 0, F.col("whole")).otherwise(
            F.array_join(F.transform(gone, lambda i: F.get(split, i)), "\n")).alias("kept_text"))
    return both.select(*out)
