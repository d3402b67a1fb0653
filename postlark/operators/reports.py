"""Reports, counts and list orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlark.functions import text as X


def export_report(rows: DataFrame) -> DataFrame:
    """One row of counts over ``status``: written, duplicate, miss, failure."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(F.count(F.lit(1)).alias("scanned"), is_("written").alias("written"), is_("duplicate").alias("duplicates"), is_("failure").alias("failures"), is_("miss").alias("misses"))


def result_counts(rows: DataFrame, match: Column) -> DataFrame:
    """Found, unread among them, and all."""
    return rows.agg(F.count_if(match).alias("found"), F.count_if(match & (F.col("flags").bitwiseAND(1) == 0)).alias("unread"), F.count(F.lit(1)).alias("total"))


def incomplete_warning(failures: DataFrame, names: int = 3) -> DataFrame:
    """Unreadable folders (how many, the first names in order) and unreadable messages, by archive."""
    folder = F.col("msg_key").isNull()
    place = Window.partitionBy("archive_id").orderBy("location")
    first = failures.where(folder).select("archive_id", "location").distinct().withColumn("n", F.row_number().over(place)).where(F.col("n") <= names)
    named = first.groupBy("archive_id").agg(F.array_sort(F.collect_list("location")).alias("first_folders"))
    counts = failures.groupBy("archive_id").agg(F.count_if(folder).alias("folders"), F.count_if(~folder).alias("messages"))
    return counts.join(named, "archive_id", "left").withColumn("first_folders", F.coalesce("first_folders", F.array().cast("array<string>")))


def first_failures(failures: DataFrame, n: int) -> DataFrame:
    """The first n failures; the feature is the limit."""
    return failures.orderBy("archive_id", "location", F.col("msg_key").asc_nulls_first(), "reason").limit(n)


def failure_summary(failures: DataFrame, n: int) -> DataFrame:
    """First n failures in order and how many more there are."""
    more = failures.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0).cast("long")).alias("more"))
    return first_failures(failures, n).crossJoin(F.broadcast(more))  # one row


def newest_first(*keys: str) -> list[Column]:
    return [F.desc_nulls_last("date"), *map(F.col, keys)]


def oldest_first(*keys: str) -> list[Column]:
    return [F.asc_nulls_first("date"), *map(F.col, keys)]


def column_order(column: str, descending: bool = False, *keys: str) -> list[Column]:
    """Order of a list column: attachments, correspondent, subject (without case), date, size."""
    shown = {"attachments": F.col("flags").bitwiseAND(16), "correspondent": F.lower("correspondent"), "subject": F.lower("subject")}.get(column, F.col(column))
    return [shown.desc_nulls_last() if descending else shown.asc_nulls_first(), *map(F.col, keys)]


def correspondent(folder_kind: Column, sender: Column, to: Column, cc: Column) -> Column:
    """The recipients (To, else Cc) in folders of outgoing mail, else the sender."""
    return F.when(folder_kind.isin("sent", "outbox", "drafts"), F.coalesce(F.nullif(to, F.lit("")), cc)).otherwise(sender)


def listing(messages: DataFrame) -> DataFrame:
    """Folder, then date, sender, subject and attachment mark of each message."""
    return messages.select("archive_id", "folder_path", "seq", "date", "from_name", "subject", F.when(F.col("flags").bitwiseAND(16) != 0, "+").otherwise("").alias("mark"))


def reference_listing(messages: DataFrame, attachments: DataFrame, key: str = "msg_key") -> DataFrame:
    """Folder, trimmed subject and number of attachments of each message, for a comparison of two runs."""
    counts = attachments.groupBy(key).agg(F.count(F.lit(1)).alias("n_attachments"))
    rows = messages.join(counts, key, "left")
    return rows.select("archive_id", "folder_path", X.strip(F.coalesce("subject", F.lit("")), X.BLANK_OR_LINE_END).alias("subject"), F.coalesce("n_attachments", F.lit(0).cast("long")).alias("n_attachments"))


def write_listing(rows: DataFrame, path: str, *order: str) -> None:
    """A listing as tab-separated text in order of its columns (or of ``order``); part files follow each other."""
    wanted = order or tuple(rows.columns)
    rows.repartitionByRange(*wanted).sortWithinPartitions(*wanted).write.mode("error").option("sep", "\t").option("timestampFormat", "yyyy-MM-dd HH:mm").csv(path)
