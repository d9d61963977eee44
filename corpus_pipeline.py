"""A training-corpus pipeline of five of the operators in ``bazaar.llm``.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of their input documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.decontamination import decontaminate
from bazaar.llm.language_id import identify_language
from bazaar.llm.mixing import mix_sources
from bazaar.llm.near_dedup import near_duplicates
from bazaar.llm.sharding import shard_by_bytes
from bazaar.session import ensure_checkpoint_dir, reliable_checkpoint


#: Ids up to which a list of them is sent to every task; a longer one is joined by a shuffle.
BROADCAST_IDS = 200_000


def _listed(ids: DataFrame) -> DataFrame:
    """One column of ids, written out and counted, so that a short list spares the texts a shuffle."""
    ids = reliable_checkpoint(ids.toDF("__id"))
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a key that names one text, and whether any row shares or lacks an id:
    the doc_id where no other row has it, else a hash of id and text. Equal rows share it."""
    again = reliable_checkpoint(docs.groupBy(F.col("doc_id").alias("__id")).count()
                                .where("count > 1 OR __id IS NULL").select("__id", F.lit(True).alias("__shared")))
    n = again.count()
    if not n:
        return docs.withColumns({"__key": F.col("doc_id"), "__shared": F.lit(False)}), False
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    marked = docs.join(again, docs["doc_id"].eqNullSafe(again["__id"]), "left")
    named = F.when(F.col("__shared"), F.xxhash64(F.lit("row"), "doc_id", "text")).otherwise(F.col("doc_id"))
    return marked.withColumns({"__key": named, "__shared": F.coalesce("__shared", F.lit(False))}), True


def _only(keyed: DataFrame, keys: DataFrame, how: str, columns: list[str]) -> DataFrame:
    """Rows whose key is (left_semi) or is not (left_anti) among ``keys``."""
    keys = keys.withColumnRenamed("__id", "__of")
    return keyed.join(keys, keyed["__key"] == keys["__of"], how).select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like one of the languages.

    NULL, empty and letterless texts go. Rows are judged one by one by their
    text, whatever ids they share or lack; rows with a NULL lang are judged like
    others. Learned from the labelled rows that op7 learns from. No rows give no rows."""
    keyed, _ = _keyed(docs)
    told = identify_language(keyed, id_col="__key").where("rejected")
    return _only(keyed, _listed(told.select("doc_id")), "left_anti", docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest key.

    Texts without words stay. Rows that share an id with another text, or have
    none, are documents of their own; of rows equal in id and text one stays.
    No rows give no rows."""
    keyed, shared = _keyed(docs)
    told = near_duplicates(keyed, id_col="__key", percent=80).where("NOT kept")
    left = keyed.join(_listed(told.select("doc_id")).withColumnRenamed("__id", "__of"),
                      F.col("__key") == F.col("__of"), "left_anti")
    if shared:
        left = left.where("NOT __shared").unionByName(left.where("__shared").dropDuplicates(["__key"]))
    return left.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window.

    Rows are judged by their own text, also those that share an id or have
    none; NULL and empty texts stay. No rows give no rows."""
    keyed, _ = _keyed(docs)
    told = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__key").where("contaminated")
    return _only(keyed, _listed(told.select("doc_id")), "left_anti", docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 3 times).

    Rows that share an id or have none are taken by their own key; rows equal
    in id and text are taken as often as the most taken of them. No rows give no rows."""
    keyed, _ = _keyed(docs)
    taken = (mix_sources(keyed, id_col="__key").where("copies > 0").groupBy(F.col("doc_id").alias("__of"))
             .agg(F.max("copies").alias("__copies")))
    taken = reliable_checkpoint(taken)
    again = F.explode(F.array_repeat(F.lit(0), F.col("__copies")))
    return (keyed.join(taken, F.col("__key") == F.col("__of"))
            .withColumn("__again", again).select(*docs.columns))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return shard_by_bytes(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

#: Signatures, models and samples are not expressible in SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the tables between them lie in the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out.write.parquet(f"{folder}/{k}-{name}")
            out = spark.read.parquet(f"{folder}/{k}-{name}")
        docs = out
    return docs
