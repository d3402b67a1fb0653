"""One row for each store entry and for each Message-ID.

Winners come from aggregations of keys (with partial minima in each task), and the
payload joins last.  Rows with blank identifiers go around the aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.functions import text as X


def union_archives(archives: list[DataFrame]) -> DataFrame:
    """Many archives as one input, with their order in ``archive_no``."""
    numbered = [a.withColumn("archive_no", F.lit(i)) for i, a in enumerate(archives)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def first_by(rows: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Add ``flag``: whether the row is the first of its keys.  Rows need distinct (keys, order)."""
    least = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    return rows.join(least, keys).withColumn(flag, F.struct(*order).eqNullSafe(F.col("__first"))).drop("__first")


def once_per_entry(rows: DataFrame, order: tuple[str, ...] = ("folder_order", "seq")) -> DataFrame:
    """Of a store entry that several folders list, ``first_entry`` marks the first in folder order."""
    return first_by(rows, ["archive_id", "nid"], list(order), "first_entry")


def once_per_message_id(rows: DataFrame, order: tuple[str, ...] = ("archive_no", "folder_order", "seq")) -> DataFrame:
    """``first_copy`` marks the first row of a trimmed Message-ID; blank ones are never copies."""
    keyed = rows.withColumn("__id", X.strip(F.coalesce("message_id", F.lit("")), X.BLANK_OR_LINE_END))
    named = first_by(keyed.where("__id <> ''"), ["__id"], list(order), "first_copy")
    return named.unionByName(keyed.where("__id = ''").withColumn("first_copy", F.lit(True))).drop("__id")


def split_unreadable(rows: DataFrame, *errors: str) -> tuple[DataFrame, DataFrame]:
    """Rows that can be written, and the others as failures; an unreadable copy doesn't hide a readable one."""
    error = F.coalesce(*map(F.col, errors))
    return rows.where(error.isNull()), rows.where(error.isNotNull()).select("archive_id", "location", "msg_key", error.alias("reason"))


def distinct_refs(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(["archive_id", "msg_key"])
