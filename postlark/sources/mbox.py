"""Mbox files and folder trees as DataFrames.

Tasks read ranges of bytes of the files (see :mod:`postlark.sources.mailfiles`).  A 'From '
line starts a message only if it carries a time and a header field follows; all other
'From ' lines belong to the text.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlark.functions import mail
from postlark.functions import text as X
from postlark.sources import mailfiles


def classify_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, size_bytes, kind, eol, error) of all files under ``root``; kind is mbox, empty, pst, other or unreadable.

    Tasks look at the heads of the files.  Hidden files (a leading dot) are left out.
    """
    return mailfiles.load(spark, mailfiles.MailFiles, root)


def folder_steps(rel_path: Column) -> Column:
    """A mail file's folder and those above it, as array<struct<key,name>>; equal keys are one folder.

    'X.sbd' holds the subfolders of the file 'X', so both have the key 'X'; a file 'X.mbox'
    is another folder that shows the name X as well.  'X.mbox/mbox' is one folder, other
    directories are folders of their own.
    """
    parts = F.split(rel_path, "/")
    apple = F.get(parts, F.size(parts) - 1).eqNullSafe("mbox") & F.lower(F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))).endswith(".mbox")
    used = F.when(apple, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    bare = lambda p: F.regexp_replace(p, "(?i)(?<=.)\\.(mbox|mbx)$", "")

    def step(p: Column, i: Column) -> Column:
        is_file, is_apple = (i == F.size(parts) - 1), apple & (i == F.size(parts) - 2)
        holder = F.lower(p).endswith(".sbd")
        above = F.regexp_replace(p, "(?i)\\.sbd$", "")
        key = F.when(is_file, p).when(holder & ~is_apple, above).otherwise(F.concat(p, F.lit("/")))
        return F.struct(key.alias("key"), F.when(is_file | is_apple, bare(p)).when(holder, above).otherwise(p).alias("name"))

    return F.transform(used, step)


def folder_id(rel_path: Column) -> Column:
    """What tells a mail file's folder from all others of its archive."""
    return F.array_join(F.transform(folder_steps(rel_path), lambda s: s["key"]), "/")


def folder_path(rel_path: Column) -> Column:
    """The names of a mail file's folder and those above it, joined: '.sbd', '.mbox' and '.mbx' don't show."""
    return F.array_join(F.transform(folder_steps(rel_path), lambda s: s["name"]), "/")


def archive_name(root: str) -> str:
    return unquote(root.rstrip("/").rsplit("/", 1)[-1])


def read_mbox(spark: SparkSession, root: str, archive_id: str | None = None, payload: bool = True, errors: bool = False, range_bytes: int = mailfiles.RANGE_BYTES) -> DataFrame:
    """Raw messages of all mbox files under ``root``: archive_id, folder_path, folder_id, file_path, block, mid, offset, size, sep_line, raw.

    ``raw`` holds the bytes as they are in the file, ``size`` of them from ``offset`` on;
    (block, mid) orders a file's messages.  Without ``payload`` it holds the first 256 KB,
    enough for all list columns.  Empty messages are dropped.  With ``errors`` there is an
    ``error`` column, and a row without a message for each range that couldn't be read.
    """
    rows = mailfiles.load(spark, mailfiles.Mbox, root, payload=str(payload).lower(), range_bytes=str(range_bytes))
    rel = F.col("rel_path")
    out = rows.select(F.lit(archive_id or archive_name(root)).alias("archive_id"), folder_path(rel).alias("folder_path"), folder_id(rel).alias("folder_id"), "file_path", "rel_path", "block", "mid", "offset", "size", "sep_line", "raw", "error")
    return out if errors else out.where("error is null").drop("error")


def unreadable_files(rows: DataFrame) -> DataFrame:
    """(archive_id, folder_path, file_path, reason) of the files that have rows with an ``error``, one for each file."""
    return rows.where("error is not null").groupBy("archive_id", "folder_path", "file_path").agg(F.min_by("error", "block").alias("reason"))


HEADER_BYTES = 262_144


def with_headers(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Add ``headers``: the fields of the block before the first empty line (256 KB at most)."""
    head = X.normalize_eol(X.latin1(F.substring(F.col(raw_col), 1, HEADER_BYTES)))
    block = X.once(head, lambda h: F.when(h.startswith("\n"), "").otherwise(F.substring_index(h, "\n\n", 1)))
    parsed = X.once(X.once(X.bytes_of(block), X.decode_default), X.parse_headers)
    # The explode of one element is there so that no later use of the column parses again.
    return raw.select(*(c for c in raw.columns if c != "headers"), F.explode(F.array(parsed)).alias("headers"))


def is_read(headers: Column) -> Column:
    """X-Mozilla-Status bit 1, else R in Status, else read."""
    mozilla = X.header(headers, "X-Mozilla-Status")
    bits = F.when(mozilla.rlike("^[0-9A-Fa-f]{1,4}$"), F.conv(mozilla, 16, 10).cast("int"))
    return F.coalesce(bits.bitwiseAND(1) != 0, X.header(headers, "Status").contains("R"), F.lit(True))


def is_expunged(headers: Column) -> Column:
    mozilla = X.header(headers, "X-Mozilla-Status")
    return F.coalesce(F.when(mozilla.rlike("^[0-9A-Fa-f]{1,4}$"), F.conv(mozilla, 16, 10).cast("int")).bitwiseAND(8) != 0, F.lit(False))


def list_importance(headers: Column) -> Column:
    """2, 1 or 0 by the first digit of X-Priority."""
    digit = F.regexp_extract(F.coalesce(X.header(headers, "X-Priority"), F.lit("")), "^([0-9])", 1)
    return F.when(digit == "", 1).when(digit <= "2", 2).when(digit >= "4", 0).otherwise(1)


def full_importance(headers: Column) -> Column:
    """As in a list row; without a telling X-Priority by Importance."""
    listed, named = list_importance(headers), F.lower(F.coalesce(X.header(headers, "Importance"), F.lit("")))
    return F.when(listed != 1, listed).when(named.contains("high"), 2).when(named.contains("low"), 0).otherwise(1)


def expunged_counts(raw: DataFrame) -> DataFrame:
    """(archive_id, file_path, expunged): messages that a mail file holds but doesn't show; ``raw`` may have headers already."""
    return (raw if "headers" in raw.columns else with_headers(raw)).where(is_expunged(F.col("headers"))).groupBy("archive_id", "file_path").agg(F.count(F.lit(1)).alias("expunged"))


def guesses_attachments(kind: Column) -> Column:
    """From the content type alone."""
    return (kind == "multipart/mixed") | ((kind != "") & ~kind.startswith("text/") & ~kind.isin("multipart/alternative", "multipart/related"))


def names(people: Column) -> Column:
    """'; '-joined names, or addresses where there is no name."""
    return F.array_join(F.transform(people, lambda a: F.when(a["name"] == "", a["email"]).otherwise(a["name"])), "; ")


def people(headers: Column, field: str) -> Column:
    """Mailboxes of all fields of a name, in order; the helper sees one joined list."""
    return mail.addresses(F.array_join(X.header_all(headers, field), ", "))


def message_summaries(raw: DataFrame, default_minutes: int = 0, zone: str | Column | None = None, numbered: bool = True) -> DataFrame:
    """List rows of raw messages that aren't expunged, with ``seq`` counted within each file unless ``numbered`` is false.

    Counting goes by file block, so a large file isn't one task's; it reads the rows twice.  Rows of what couldn't
    be read (no ``mid``) stay and don't count.  Columns of the raw messages stay.  Dates
    without a zone are local time of ``zone``, else ``default_minutes`` ahead of UTC.
    """
    h = F.col("headers")
    rows = with_headers(raw).where(~is_expunged(h))
    base = rows.withColumns({
        "subject": X.strip(mail.words(F.coalesce(X.header(h, "Subject"), F.lit(""))), X.BLANK_OR_LINE_END), "sender": F.get(mail.addresses(X.header(h, "From")), 0),
        "to_people": people(h, "To"), "cc_people": people(h, "Cc"), "ct": mail.content_type(X.header(h, "Content-Type")),
        "header_date": mail.mail_date(mail.words(X.header(h, "Date")), default_minutes, zone), "sep_date": mail.mail_date(F.substring("sep_line", 6, 10_000), default_minutes, zone),
    })
    flags = F.when(is_read(h), 1).otherwise(0).bitwiseOR(F.when(guesses_attachments(F.col("ct.type")), 16).otherwise(0))
    own = ("subject", "from_name", "from_email", "to_list", "cc_list", "date", "header_date", "flags", "message_class", "importance", "message_id")
    listed = base.select(
        *(c for c in rows.columns if c not in own), "subject",
        F.coalesce(F.when(F.col("sender.name") == "", F.col("sender.email")).otherwise(F.col("sender.name")), F.lit("")).alias("from_name"), F.coalesce("sender.email", F.lit("")).alias("from_email"),
        names(F.col("to_people")).alias("to_list"), names(F.col("cc_people")).alias("cc_list"), F.coalesce("header_date", "sep_date").alias("date"), "header_date", flags.alias("flags"),
        F.lit("IPM.Note").alias("message_class"), list_importance(h).alias("importance"), X.strip(F.coalesce(X.header(h, "Message-ID"), F.lit(""))).alias("message_id"))
    return number_messages(listed) if numbered else listed


def number_messages(rows: DataFrame, file: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Add ``seq``, from 0 in each file by (block, mid), and ``msg_key``."""
    within = F.row_number().over(Window.partitionBy(*file, "block").orderBy(F.col("mid").asc_nulls_last()))
    blocks = rows.groupBy(*file, "block").agg(F.count("mid").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*file).orderBy("block")) - F.col("n")
    numbered = rows.withColumn("w", within).join(blocks.select(*file, "block", before.alias("before")), [*file, "block"])
    return numbered.withColumn("seq", F.col("before") + F.col("w") - 1).withColumn("msg_key", F.concat_ws("#", "file_path", F.col("seq").cast("string"))).drop("w", "before")
