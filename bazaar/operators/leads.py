"""Lead conversion by origin (O25). The reference calls this query without its
SQL; the contract (qualified, closed, percentage) is taken from its charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lead_conversion(leads: DataFrame, deals: DataFrame, key: str = "lead_id", origin: str = "origin") -> DataFrame:
    """Per origin, leads, leads with a closed deal and 100 * closed / leads.
    Deals are reduced to distinct keys first so a lead closes at most once.
    -> (origin, qualified_leads, closed_leads, conversion_rate)"""
    closed = deals.select(F.col(key).alias("_closed")).distinct()
    j = leads.join(closed, leads[key] == closed["_closed"], "left")
    g = j.groupBy(F.col(origin).alias("origin")).agg(F.count(F.lit(1)).alias("qualified_leads"),
                                                     F.count("_closed").alias("closed_leads"))
    rate = F.try_divide(F.col("closed_leads") * F.lit(100.0), F.col("qualified_leads"))
    return g.select("origin", "qualified_leads", "closed_leads", rate.alias("conversion_rate"))
