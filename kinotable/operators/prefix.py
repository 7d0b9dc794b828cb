"""Running values over long groups, in chunks: no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, chunk: int | None = None, strict: bool = False) -> DataFrame:
    """rows with the sum (``sums``) or the last value that is not null (``lasts``) of columns, up to and with each row.

    ``order`` is a whole number.  With ``chunk``, rows are sorted inside
    stretches of so many of it only: a stretch becomes one short row of what
    it adds, and of a whole group only these are put in order.  ``strict``
    leaves the row itself out.  A null counts as 0 in a sum.
    """
    sums, lasts = {n: F.coalesce(c, F.lit(0)).cast("long") for n, c in (sums or {}).items()}, lasts or {}
    names = [*sums, *lasts]
    end = -1 if strict else Window.currentRow
    upto = Window.partitionBy(*keys, *(["__chunk"] if chunk else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    own = rows.withColumn("__chunk", F.floor(F.col(order) / chunk)) if chunk else rows
    inside = own.withColumns({n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()})
    if not chunk:
        return inside
    totals = own.groupBy(*keys, "__chunk").agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(n) for n, c in lasts.items()])
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__chunk").alias("__c"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums], *[F.last(n, ignorenulls=True).over(before).alias(f"__{n}") for n in lasts])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__chunk") == F.col("__c")]
    on = same[0]
    for x in same[1:]:
        on = on & x
    found = inside.join(carried, on)
    return found.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums} | {n: F.coalesce(n, f"__{n}") for n in lasts}).select(*[c for c in rows.columns if c not in names], *names)
