"""Sinks: every result is written as Parquet by the executors, never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> str:
    """Write ``df`` as Parquet. Small results stay as written (AQE has already
    coalesced their partitions); ``partition_by`` enables directory pruning."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path
