"""As-of joins: to each row the nearest row of a log at or after its time, however far away."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_in_log(rows: DataFrame, log: DataFrame, ts: str, value: str, by: list[str] | None = None, cell: int = 3_600_000_000) -> DataFrame:
    """``rows`` with ``next_ts`` and ``next_value``: of the log's rows with the same ``by``, time and value of the one with the least ``ts`` that is greater than the row's; null where there is none.

    Of log rows of equal time the smallest value counts. Times are longs. There is no bound on how far away the next row may be.

    Time is cut into cells of ``cell`` units. A row looks among its own cell's log rows first; where there is no later one, the answer is the first row of the next cell that has any, which
    is the same for all rows of a cell and is found on the table of cells alone. So rows are only ever joined by cell, with no range that spans cells, and a cell that holds many of them is split like any skewed
    join. Only the cells, not rows or log, are put in order as a whole, by ``by``: one row for each hour that has any, if ``ts`` is in microseconds.
    """
    by = by or []
    of = lambda c: F.floor(F.col(c) / cell)
    held = log.groupBy(*by, F.col(ts).alias("__at")).agg(F.min(value).alias("__value")).withColumn("__cell", of("__at"))
    within = Window.partitionBy(*by, "__cell").orderBy("__at")
    spans = held.withColumn("__from", F.lag("__at").over(within))
    entry = F.struct("__at", "__value")
    firsts = held.groupBy(*by, "__cell").agg(F.min(entry).alias("__first"))
    asked = rows.select(*by, of(ts).alias("__cell")).distinct()
    cells = asked.join(firsts, [*by, "__cell"], "full")
    later = Window.partitionBy(*by).orderBy("__cell").rowsBetween(1, Window.unboundedFollowing)
    cells = cells.select(*by, "__cell", F.first("__first", ignorenulls=True).over(later).alias("__next"))
    left = rows.withColumn("__cell", of(ts)).join(cells, [*by, "__cell"], "left").alias("l")
    s = spans.alias("s")
    match = [F.col("l.__cell") == F.col("s.__cell"), *(F.col(f"l.{b}") == F.col(f"s.{b}") for b in by), F.col(f"l.{ts}") < F.col("s.__at"), F.col("s.__from").isNull() | (F.col(f"l.{ts}") >= F.col("s.__from"))]
    found = F.coalesce(F.when(F.col("s.__at").isNotNull(), F.struct(F.col("s.__at").alias("__at"), F.col("s.__value").alias("__value"))), F.col("l.__next"))
    return left.join(s, match, "left").select(*(F.col(f"l.{c}").alias(c) for c in rows.columns), found["__at"].alias("next_ts"), found["__value"].alias("next_value"))
