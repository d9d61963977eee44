"""Numeric conventions shared by operators and oracle SQL.

Money is summed as DECIMAL(18,2) (exact, independent of partitioning) and
turned into DOUBLE only at the end. Operators return ratios and means as they
are; registered queries round them in their last select, so that two engines
that add doubles in different orders still agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def r4(c: Column) -> Column:
    """Round a double to 4 places (HALF_UP, same as SQL ROUND)."""
    return F.round(c.cast("double"), 4)


def r2(c: Column) -> Column:
    return F.round(c.cast("double"), 2)
