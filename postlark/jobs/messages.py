"""Messages with their recipients, bodies and attachments: from raw mail and from decoded store tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.functions import text as X
from postlark.operators import mime, properties
from postlark.sources import mbox


def _addresses(sender: Column, people: Column) -> Column:
    """All complete addresses in one text: the sender's, then the recipients'."""
    return F.concat_ws(" ", sender, F.array_join(F.transform(people, lambda r: r["email"]), " "))


def searchable(rows: DataFrame, bodies: bool = False) -> DataFrame:
    """Add to raw messages with headers what a search looks through: ``addresses`` and, if asked, ``body_text``,
    ``attachment_names`` and ``body_error``.

    Each message is parsed in the task that reads it; nothing is shuffled.
    """
    people = mime.recipient_list(F.col("headers"))
    out = rows.withColumn("addresses", F.coalesce(_addresses(F.col("from_email"), people), F.lit("")))
    return with_bodies(out) if bodies else out


def with_bodies(rows: DataFrame) -> DataFrame:
    """Raw messages with body_text (plain, else of the HTML), body_html, body_kind, attachments, attachment_names and body_error in place of ``raw``.

    Without ``raw`` the bytes are read by their extents (file_path, offset, size) where they are parsed.
    """
    kept = [c for c in rows.columns if c not in ("raw", "body_text", "body_html", "body_kind", "attachments", "attachment_names", "body_error")]
    extent = None if "raw" in rows.columns else ("file_path", "offset", "size")
    keyed = rows.select(F.struct(*kept).alias("__row"), *(extent or ["raw"]))
    parts = mime.bodies_and_attachments(mime.message_parts(keyed, "__row", extent=extent), "__row")
    plain, kind = mime.body_of(F.col("body_text"), F.lit(None).cast("string"), F.col("body_html"))
    return parts.select(*(F.col("__row")[c].alias(c) for c in kept), plain.alias("body_text"), "body_html", kind.alias("body_kind"), "attachments", F.array_join(F.transform("attachments", lambda a: a["filename"]), " ").alias("attachment_names"), F.col("parse_error").alias("body_error"))


def full_messages(rows: DataFrame) -> DataFrame:
    """Raw messages with headers as full messages: sender (From, else Sender), importance, date of the header alone, recipients, bodies, attachments."""
    sender = mime.full_sender(F.col("headers"))
    people = mime.recipient_list(F.col("headers"))
    out = rows.withColumns({"__sender": sender, "recipients": people, "importance": mbox.full_importance(F.col("headers")), "date": F.col("header_date")})
    name = F.coalesce(F.nullif(F.col("__sender.name"), F.lit("")), F.col("__sender.email"), F.lit(""))
    out = out.withColumns({"from_name": name, "from_email": F.coalesce("__sender.email", F.lit(""))}).drop("__sender")
    return with_bodies(out.withColumn("addresses", _addresses(F.col("from_email"), F.col("recipients"))))


def store_messages(contents: DataFrame, recipients: DataFrame, attachments: DataFrame, bodies: DataFrame, payload: bool = True) -> DataFrame:
    """Contents rows of a decoded store joined with recipients, attachments and bodies of their nodes: full messages to search and to build.

    ``recipients`` (archive_id, nid, pos, kind, name, email) and ``attachments``
    (archive_id, nid, att_no, ...) are gathered by message before they join;
    ``bodies`` has body_text, body_html and body_error by (archive_id, nid).  A
    message's lists are its own; messages without rows have empty ones.  Where
    recipients or attachments have an ``error``, the message gets the least of them.
    Without ``payload`` the attachments have none, and none is read.
    """
    key = ["archive_id", "nid"]
    given = lambda rows, name, kind: F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    person = F.struct("pos", F.col("kind").bitwiseAND(0x0F).cast("int").alias("kind"), F.coalesce("name", F.lit("")).alias("name"), F.when(F.col("email").contains("@"), F.col("email")).otherwise("").alias("email"))
    people = recipients.groupBy(*key).agg(F.array_sort(F.collect_list(person)).alias("recipients"), F.min(given(recipients, "error", "string")).alias("recipient_error"))
    content = F.col("payload") if payload else F.lit(None).cast("binary")
    file = F.struct("att_no", "filename", "size", "method", "mime_type", "content_id", "is_hidden", content.alias("payload"), given(attachments, "embedded_nid", "long").alias("embedded_nid"))
    files = attachments.groupBy(*key).agg(F.array_sort(F.collect_list(file), lambda a, b: a["att_no"] - b["att_no"]).alias("attachments"), F.min(given(attachments, "error", "string")).alias("attachment_error"))
    rows = contents.withColumnRenamed("row_id", "nid").join(people, key, "left").join(files, key, "left").join(bodies.select(*key, "body_text", "body_html", "body_error"), key, "left")
    date = properties.message_date(F.col("delivery_time"), F.col("submit_time"), F.col("modified_time"))
    name = properties.sender_name(F.col("represented_name"), F.col("sender_name"))
    rows = rows.withColumns({"recipients": F.coalesce("recipients", F.array().cast(rows.schema["recipients"].dataType)), "attachments": F.coalesce("attachments", F.array().cast(rows.schema["attachments"].dataType))})
    shown = lambda kind: F.array_join(F.transform(F.filter("recipients", lambda p: p["kind"] == kind), lambda p: properties.display(p["name"], p["email"])), ", ")
    listed = lambda kind, display: F.coalesce(F.nullif(shown(kind), F.lit("")), F.col(display), F.lit(""))
    email = F.coalesce(given(contents, "sender_email", "string"), F.lit(""))
    return rows.select(
        *key, "folder_nid", F.concat_ws("#", "archive_id", F.col("nid").cast("string")).alias("msg_key"), X.strip(X.clean_subject(F.coalesce("subject", F.lit(""))), X.BLANK_OR_LINE_END).alias("subject"), name.alias("from_name"), email.alias("from_email"),
        listed(1, "display_to").alias("to_list"), listed(2, "display_cc").alias("cc_list"), shown(3).alias("bcc_list"), date.alias("date"), "size", "flags", "message_class", "importance", given(contents, "message_id", "string").alias("message_id"),
        "recipients", "recipient_error", "body_text", "body_html", "body_error", "attachments", "attachment_error", F.array_join(F.transform("attachments", lambda a: a["filename"]), " ").alias("attachment_names"), _addresses(F.nullif(email, F.lit("")), F.col("recipients")).alias("addresses"))
