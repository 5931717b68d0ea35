"""As-of joins by one pass over time blocks (JN24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def last_before(asked: DataFrame, events: DataFrame, key: str, at: str, value: str, width: Column | str = "1 day") -> DataFrame:
    """``asked`` (key, at, ...) with ``value``: that of the key's last event (key, at, value) at or before the moment.

    Time is cut into blocks of ``width``.  Both sides are sorted together inside
    a key's block, and a block's last value is carried on to the key's later
    blocks through a window over blocks, so a key with a third of all rows is
    many blocks and no task holds more than one of them.  Of events of one moment
    the greatest value counts, and null is the least.  An event without a value is
    an event: what comes after it finds null.  A null key or moment finds nothing.
    """
    kind = events.schema[value].dataType
    none = F.lit(None).cast(StructType([StructField("v", kind)]))  # no event, other than an event that holds null
    block = lambda c: F.window(c, width)["start"]
    left = asked.select("*", none.alias("_value"), F.lit(1).alias("_asked"))
    rest = [c for c in asked.columns if c not in (key, at)]
    right = events.select(key, at, *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in rest), F.struct(F.col(value).alias("v")).alias("_value"), F.lit(0).alias("_asked"))
    rows = left.select(key, at, *rest, "_value", "_asked").unionByName(right.where(F.col(at).isNotNull() & F.col(key).isNotNull()))
    # window() leaves rows without a moment out: they are joined back as those that find nothing
    timed = rows.where(F.col(at).isNotNull()).withColumn("_block", block(F.col(at)))
    over = Window.partitionBy(key, "_block").orderBy(at, "_asked", "_value").rowsBetween(Window.unboundedPreceding, 0)
    inside = timed.withColumn("_last", F.last("_value", True).over(over)).where("_asked = 1")
    ends = timed.where("_asked = 0").groupBy(key, "_block").agg(F.max_by("_value", F.struct(at, "_value")).alias("_end"))
    # blocks that are asked about, with the last value of an earlier one
    marks = ends.unionByName(inside.select(key, "_block").distinct().select(key, "_block", none.alias("_end")))
    marks = marks.groupBy(key, "_block").agg(F.max("_end").alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(key, "_block", F.last("_end", True).over(earlier).alias("_carried"))
    found = inside.join(carried, [key, "_block"], "left").select(*asked.columns, F.coalesce("_last", "_carried")["v"].alias(value))
    never = asked.where(F.col(at).isNull()).select(*asked.columns, F.lit(None).cast(kind).alias(value))
    return found.unionByName(never)
