"""Ranks and running sums of a key's rows, of which no task holds all.

Rows are brought into cells of a bounded number of rows, or values into a bounded number of buckets; only
the cells' or buckets' totals of a key meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import durable

#: Positions of a cell.
CELL = 4_096
#: Buckets into which the range that holds a rank is cut in each pass.
BUCKETS = 65_536


def running_sums(rows: DataFrame, by: list[str], position: str, amounts: dict[str, Column], cell: int = CELL) -> DataFrame:
    """``rows`` with the sums of ``amounts`` over the rows of the same key up to each row, by position.

    Positions are whole numbers, distinct within a key; a cell has ``cell`` of them. ``rows`` is read twice.
    """
    own = rows.withColumns({f"__{k}": a.cast("long") for k, a in amounts.items()} | {"__cell": F.floor(F.col(position) / cell)})
    totals = own.groupBy(*by, "__cell").agg(*(F.sum(f"__{k}").alias(f"__t_{k}") for k in amounts))
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "__cell", *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__c_{k}") for k in amounts))
    upto = Window.partitionBy(*by, "__cell").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    found = own.join(carried, [*by, "__cell"]).withColumns({k: F.col(f"__c_{k}") + F.sum(f"__{k}").over(upto) for k in amounts})
    return found.select(*rows.columns, *amounts)


def values_at(rows: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """``by``, and for each name the value that stands at a rank (from 0) among the key's values in order.

    ``value`` is a whole number; nulls have no rank. A rank is an expression of ``n``, the number of a key's
    values, and null for a rank that is not there. The range of a key's values is cut into ``BUCKETS``, the
    one that holds the rank is found from the buckets' counts and cut again, until it is one value wide: at
    most four passes, of which each sees equal values as one row.
    """
    counted = durable(rows.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("decimal(20,0)").alias("v")).agg(F.count("*").alias("c")))
    ends = counted.groupBy(by).agg(F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    entries = F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()))
    asked = ends.select(by, "n", "low", "high", F.explode(entries).alias("e")).select(by, "e.*", "low", "high").filter("rank >= 0 AND rank IS NOT NULL")
    width = ends.agg(F.max(F.col("high") - F.col("low")).alias("w")).first()["w"]
    width = 1 if width is None else int(width) + 1
    while width > 1:
        step = F.expr(f"(high - low + {BUCKETS}) div {BUCKETS}").cast("decimal(20,0)")
        key = F.col(by).eqNullSafe(F.col("__of"))
        ranges = asked.select(F.col(by).alias("__of"), "name", "rank", "low", "high", step.alias("step"))
        inside = counted.join(ranges, key & F.col("v").between(F.col("low"), F.col("high")))
        bucket = F.expr("(v - low) div step").cast("decimal(20,0)")
        held = inside.groupBy(by, "name", "rank", "low", "high", "step", bucket.alias("bucket")).agg(F.sum("c").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(by, "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        first = held.withColumn("upto", upto).filter("upto > rank AND upto - c <= rank")
        start = F.col("low") + F.col("bucket") * F.col("step")
        asked = durable(first.select(by, "name", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), start.cast("decimal(20,0)").alias("low"), F.least("high", start + F.col("step") - 1).cast("decimal(20,0)").alias("high")))
        width = -(-width // BUCKETS)
    own = lambda k: F.max(F.when(F.col("name") == k, F.col("low"))).cast("long").alias(k)
    return ends.select(by).join(asked.withColumnRenamed(by, "__of"), F.col(by).eqNullSafe(F.col("__of")), "left").groupBy(by).agg(*(own(k) for k in ranks))


def middle_ranks() -> dict[str, Column]:
    """The two ranks around the middle, between whose values a median is the mean."""
    middle = (F.col("n") - 1) / 2
    return {"low_mid": F.floor(middle), "high_mid": F.ceil(middle)}


def median() -> Column:
    return (F.col("low_mid") + F.col("high_mid")) / 2
