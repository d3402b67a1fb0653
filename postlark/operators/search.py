"""Search filters over message rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_FIELDS = ("subject", "from_name", "to_list", "cc_list")


def terms(query: str) -> list[str]:
    return query.lower().split()


def matches(query: str | Column, *fields: Column) -> Column:
    """All words of the query stand somewhere in the joined fields; an empty query matches all."""
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in fields)))
    if isinstance(query, str):
        return reduce(lambda a, b: a & b, [hay.contains(t) for t in terms(query)], F.lit(True))
    words = F.filter(F.split(F.lower(query), "\\s+"), lambda w: w != "")
    return F.forall(words, lambda w: hay.contains(w))


def in_list(query: str | Column, columns: tuple[str, ...] = LIST_FIELDS) -> Column:
    return matches(query, *map(F.col, columns))


def with_addresses(query: str | Column, addresses: str = "addresses", columns: tuple[str, ...] = LIST_FIELDS) -> Column:
    """List fields and the complete addresses of sender and all recipients."""
    return matches(query, *map(F.col, columns), F.col(addresses))


def with_bodies(query: str | Column, body: str = "body_text", attachments: str = "attachment_names", addresses: str = "addresses", columns: tuple[str, ...] = LIST_FIELDS) -> Column:
    """As with addresses, and the plain body and attachment names; words may stand in different fields."""
    return matches(query, *map(F.col, columns), F.col(addresses), F.col(body), F.col(attachments))


def in_folder(text: str, path: str = "folder_path") -> Column:
    """The folder path, without its archive, contains the text."""
    return F.lower(F.col(path)).contains(text.lower()) if text else F.lit(True)


def in_scope(messages: DataFrame, visible_folders: DataFrame, archive_id: str | None = None, folder_id: str | None = None) -> DataFrame:
    """One folder, or the visible folders of one archive or of all."""
    if folder_id is not None:
        return messages.where((F.col("archive_id") == archive_id) & (F.col("folder_id") == folder_id))
    rows = messages if archive_id is None else messages.where(F.col("archive_id") == archive_id)
    return rows.join(visible_folders.select("archive_id", "folder_id"), ["archive_id", "folder_id"], "left_semi")


def misses_that_may_be_wrong(rows: DataFrame, match: Column, *errors: str) -> DataFrame:
    """Failures: messages that don't match though a part of them couldn't be read."""
    error = F.coalesce(*map(F.col, errors))
    return rows.where(~match & error.isNotNull()).select("archive_id", F.col("location"), "msg_key", error.alias("reason"))


def location(archive: str = "archive_id", path: str = "folder_path") -> Column:
    return F.concat_ws("/", F.col(archive), F.nullif(F.col(path), F.lit("")))


def matching_properties(properties: DataFrame, text: str) -> DataFrame:
    """Properties whose name, shown value or tag contains the text."""
    found = [F.lower(F.col(c)).contains(text.lower()) for c in ("name", "shown", "tag")]
    return properties.where(found[0] | found[1] | found[2])
