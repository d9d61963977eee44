"""Operator 1: drop lines that several documents share (DataFrame functions only).

Lines are exploded with a 128-bit hash of their normalised form, counted per
hash over distinct documents, and the surplus ones are joined back as
positions per document. Texts are shuffled once, to meet their positions;
lines travel as hashes. The per-hash minimum, maximum and count are combined
before the shuffle, so a line that a third of all documents hold costs one row
per task; the join that finds its holders is a plain sort-merge join whose hot
partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.session import reliable_checkpoint

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, everything else as it is. ``lower`` is the faster
    form and does the same where all characters are ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def line_keys(lines: Column) -> Column:
    """Each line's normalised form."""
    return F.transform(lines, lambda x: lower_ascii(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
               min_docs: int = 2) -> DataFrame:
    """-> (doc_id, n_lines, n_dropped, kept_text), one row per input row.

    A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased. Keys of at least ``min_chars`` code points that ``min_docs``
    documents or more hold are dropped everywhere but in the smallest id.

    Defined cases: NULL or empty text is one empty line, and kept_text is then
    ''. Texts of any length are split whole. Rows that repeat an id are the
    same document: they count once, and each is cleaned, by its own text, and
    returned. A row with a NULL id neither counts nor
    loses lines. Lines of a text with all lines dropped join to ''. Other
    columns are not looked at.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("t", F.xxhash64("text"))  # rows that repeat an id may hold different texts
    split = F.split("text", "\n", -1)
    keyed = F.transform(
        line_keys(split), lambda k, i: F.struct(
            i.alias("pos"), F.when(F.length(k) >= min_chars, F.xxhash64(k)).alias("h1"),
            F.xxhash64(F.lit("line"), k).alias("h2")))
    lines = (src.where("id IS NOT NULL").select("id", "t", F.explode(keyed).alias("l"))
             .select("id", "t", "l.pos", "l.h1", "l.h2").where("h1 IS NOT NULL"))
    if min_docs <= 2:  # two holders differ: smallest and largest id do
        shared = lines.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high")) \
            .where("low != high" if min_docs == 2 else "true")
    else:
        shared = (lines.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.count_distinct("id").alias("held"))
                  .where(F.col("held") >= min_docs))
    # checkpointed, so that the join below has plain shuffles on both sides and a
    # hot line's holders can be split
    shared = reliable_checkpoint(shared)
    surplus = (lines.join(shared.select("h1", "h2", "low"), ["h1", "h2"]).where("id != low")
               .groupBy("id", "t").agg(F.collect_set("pos").alias("gone")))
    both = src.withColumn("lines", split).join(surplus, ["id", "t"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    return both.select(
        F.col("id").alias("doc_id"), F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(
            F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).alias("kept_text"))
