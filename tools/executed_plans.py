"""Final plans of everything a query runs, eager checkpoint jobs included.

The session must write Spark's event log (``EVENT_LOG`` into a folder of its
own). ``executed(spark, folder, run)`` calls ``run`` and returns one tree per
SQL execution that began meanwhile: adaptive execution's last plan where
there is one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path


def event_log(folder: str) -> dict[str, str]:
    """Session settings that write the event log into ``folder`` (which must exist)."""
    return {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{folder}",
            "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
            "spark.eventLog.buffer.kb": "1k", "spark.sql.maxMetadataStringLength": "2000"}


def _events(folder: str) -> Iterator[dict]:
    for file in Path(folder).iterdir():
        for line in file.open(errors="replace"):
            if '"sparkPlanInfo"' in line:
                try:
                    yield json.loads(line)
                except ValueError:  # the last line may be unfinished
                    pass


def executed(spark, folder: str, run: Callable[[], None]) -> list[dict]:
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = {e["executionId"] for e in _events(folder)}
    run()
    bus.waitUntilEmpty()
    plans = {e["executionId"]: e["sparkPlanInfo"] for e in _events(folder) if e["executionId"] not in before}
    return [plans[k] for k in sorted(plans)]


def nodes(plan: dict) -> Iterator[dict]:
    """Every node; a reused exchange is listed, what it reuses is not."""
    yield plan
    if not plan["nodeName"].startswith("ReusedExchange"):
        for child in plan["children"]:
            yield from nodes(child)


def count(plans: list[dict], text: str) -> int:
    """Nodes whose description holds ``text``."""
    return sum(text in n["simpleString"] for p in plans for n in nodes(p))


def scans(plans: list[dict], table: str) -> int:
    """Parquet scans of one table."""
    return sum(n["nodeName"].startswith("Scan parquet") and f"/{table}.parquet" in n["simpleString"] + str(n["metadata"])
               for p in plans for n in nodes(p))


def windows_over_one_partition(plans: list[dict]) -> int:
    """Window nodes whose rows come from an exchange into a single partition."""
    def below(n: dict) -> Iterator[dict]:
        for c in n["children"]:
            yield c
            if "Exchange" not in c["nodeName"]:
                yield from below(c)
    return sum(any("SinglePartition" in c["simpleString"] for c in below(n))
               for p in plans for n in nodes(p) if n["nodeName"] == "Window")
