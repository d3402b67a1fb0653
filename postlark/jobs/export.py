"""Search many archives and export what matches, each message once, with a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlark.functions import text as X
from postlark.jobs import messages, stores
from postlark.operators import dedupe, folders, reports, search, sinks
from postlark.sources import mailfiles, mbox
from postlark.storage import materialize, small


KEYS = ["archive_no", "folder_order", "seq"]


def index_archives(spark: SparkSession, paths: list[str], numbers: list[int] | None = None) -> DataFrame:
    """The messages of all archives, in the order given, as a table without their bytes: one scan of the files.

    List rows with ``addresses``, the message's extent (file_path, offset, size), its
    folder (folder_id, folder_path) and ``folder_order``, each folder's place in pre-order:
    (archive_no, folder_order, seq) identifies a message, as does (archive_no, msg_key).
    Rows with an ``error`` stand for what couldn't be read of a file.  ``numbers`` are the
    archives' places among others.
    """
    listed = dedupe.union_archives([messages.searchable(mbox.message_summaries(mbox.read_mbox(spark, p, payload=False, errors=True), numbered=False)) for p in paths])
    if numbers:
        listed = listed.withColumn("archive_no", F.get(F.array(*map(F.lit, numbers)), F.col("archive_no")))
    # Numbering reads its rows twice: not the files, but the table without bytes.
    rows = materialize(mbox.number_messages(materialize(listed.drop("raw", "headers")), ("archive_no", "file_path")))
    files = rows.select(F.col("archive_no").alias("archive_id"), "file_path", mbox.folder_steps(F.col("rel_path")).alias("steps")).distinct()
    tree = folders.with_preorder(folders.folders_from_files(files), keys="keys").where("file_path is not null")
    places = tree.select(F.col("archive_id").alias("archive_no"), "file_path", F.array_join("path", "/").alias("folder_path"), "folder_order")
    return rows.drop("folder_path").join(small(materialize(places)), ["archive_no", "file_path"])


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The readable messages of :func:`index_archives`."""
    return index_archives(spark, paths).where("error is null").drop("error")


def decide(rows: DataFrame, query: str = "", folder: str = "", match: Column | None = None, search_bodies: bool = False) -> DataFrame:
    """Add ``status`` (written, duplicate, miss or failure) and ``reason`` (of a failure) to the rows of matching folders.

    Optional columns tell what couldn't be read of a message: ``recipient_error``,
    ``body_error`` and ``attachment_error``.  Any of them makes a match a failure, and
    an unreadable copy doesn't hide a readable one.  A miss is a failure too if what
    was searched couldn't be read; bodies and attachments count only with ``search_bodies``.
    Rows that aren't the ``first_entry`` of a store's message are duplicates.
    """
    rows = rows.where(search.in_folder(folder))
    hit = search.in_list(query) if match is None else match
    given = lambda *names: F.coalesce(*(F.col(c) for c in names if c in rows.columns), F.lit(None).cast("string"))
    all_errors = given("recipient_error", "body_error", "attachment_error")
    searched = all_errors if search_bodies else given("recipient_error")
    first = F.col("first_entry") if "first_entry" in rows.columns else F.lit(True)
    reason = F.when(~first, None).when(hit, all_errors).otherwise(searched)
    rows = rows.withColumn("reason", reason).withColumn("status", F.when(~first, "duplicate").when(F.col("reason").isNotNull(), "failure").when(~hit, "miss").otherwise("candidate"))
    marked = dedupe.once_per_message_id(rows.where("status = 'candidate'").select(*KEYS, "archive_id", "message_id")).select(*KEYS, "first_copy")
    joined = rows.join(marked, KEYS, "left")
    return joined.withColumn("status", F.when(F.col("status") != "candidate", F.col("status")).when(F.col("first_copy"), "written").otherwise("duplicate")).drop("first_copy")


def failures(decided: DataFrame) -> DataFrame:
    """(archive_id, location, msg_key, reason) of the messages that couldn't be read or searched completely."""
    return decided.where("status = 'failure'").select("archive_id", F.concat(search.location(), F.lit(" / "), X.shown_subject(F.col("subject"))).alias("location"), F.col("msg_key").cast("string").alias("msg_key"), "reason")


def unreadable_files(index: DataFrame, folder: str = "") -> DataFrame:
    """Failures of whole files of the matching folders: one for each file that couldn't be read, wholly or in part."""
    rows = mbox.unreadable_files(index.where(search.in_folder(folder)))
    return rows.select("archive_id", search.location().alias("location"), F.lit(None).cast("string").alias("msg_key"), "reason")


def searched(rows: DataFrame, query: str, search_bodies: bool = False) -> DataFrame:
    """Add ``hit`` to indexed messages: list fields and complete addresses are searched first.

    Only the bytes of what they miss are read and decoded, and only if bodies are searched.
    """
    if not query.strip():
        return rows.withColumn("hit", F.lit(True))
    hit = search.in_list(query) | search.with_addresses(query)
    if not search_bodies:
        return rows.withColumn("hit", hit)
    missed = messages.with_bodies(rows.where(~hit))
    missed = missed.withColumn("hit", search.with_bodies(query)).select(*rows.columns, "body_error", "hit")
    found = rows.where(hit).withColumns({"body_error": F.lit(None).cast("string"), "hit": F.lit(True)})
    return found.unionByName(missed)


def export(spark: SparkSession, sources: list[str | stores.Store], output: str, query: str = "", folder: str = "", append: bool = False, search_bodies: bool = False, failures_path: str | None = None) -> DataFrame:
    """Write the matching messages of mbox files and stores as mbox text and return the report; failures go to a Parquet table if it has a path.

    ``sources`` are paths of mbox files or trees, and decoded stores, in the order in which
    copies count.  Files are scanned once, for an index; decisions are made once, on keys,
    over all sources.  Then only the bytes of written messages are read from the files, by
    the tasks that write them in order, so these are never shuffled; messages of stores
    are built where their tables lie and shuffled once, into the order of the output.
    """
    paths = {k: s for k, s in enumerate(sources) if isinstance(s, str)}
    others = {k: s for k, s in enumerate(sources) if k not in paths}
    sinks.refuse_overlap(spark, output, *paths.values())
    candidates, index = [], None
    if paths:
        index = index_archives(spark, list(paths.values()), list(paths))
        rows = index.where("error is null").drop("error").where(search.in_folder(folder))
        candidates.append(searched(rows, query, search_bodies).withColumn("first_entry", F.lit(True)))
    candidates += [stores.index(s, k, folder).withColumn("hit", search.with_bodies(query) if search_bodies else search.with_addresses(query)) for k, s in others.items()]
    columns = [*KEYS, "archive_id", "folder_path", "msg_key", "subject", "message_id", "hit", "first_entry"]
    kinds = ("recipient_error", "body_error", "attachment_error")
    with_kinds = lambda rows: rows.select(*columns, *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in kinds))
    # Decisions read their rows four times; bodies are parsed and searched once.
    every = materialize(reduce(DataFrame.unionByName, [with_kinds(c) for c in candidates]))
    decided = materialize(decide(every, query, folder, F.col("hit"), search_bodies).select(*KEYS, "archive_id", "folder_path", "msg_key", "subject", "status", "reason"))
    written, out = decided.where("status = 'written'"), []
    kept = [*KEYS, "archive_id", "folder_path"]
    none = lambda **kinds: [F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    if paths:
        out.append(rows.join(small(written.select(*KEYS)), KEYS, "left_semi").select(*kept, "file_path", "offset", "size", "from_email", "header_date", *none(entry="string")))
    for k, s in others.items():
        own = written.where(F.col("archive_no") == k).select(*kept, F.col("seq").alias("nid"))
        # The order of the output is found by looking at its rows: what has to be built is built once before.
        built = materialize(stores.entries(s, own).select(*kept, "entry"))
        out.append(built.select(*kept, *none(file_path="string", offset="long", size="long", from_email="string", header_date="timestamp"), "entry"))
    ordered = reduce(DataFrame.unionByName, out).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    entry = sinks.mbox_entry(F.col("raw"), F.col("from_email"), F.col("header_date"), sinks.folder_header(F.col("archive_id"), F.col("folder_path")), F.lit(True))
    sinks.write_mbox(mailfiles.with_bytes(ordered).select(F.coalesce("entry", entry).alias("entry")), output, append=append, ordered=True)
    if failures_path:
        failed = failures(decided)
        (failed if index is None else failed.unionByName(unreadable_files(index, folder))).write.mode("error").parquet(failures_path)
    return reports.export_report(decided)


def mail_folders(files: DataFrame) -> DataFrame:
    """The folder tree of mail files (archive_id, file_path, rel_path), in pre-order."""
    return folders.with_preorder(folders.folders_from_files(files.select("archive_id", "file_path", mbox.folder_steps(F.col("rel_path")).alias("steps")).distinct()), keys="keys")


def folder_list(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Folders with their own and all counts, in list order; ``files`` (archive_id, file_path, rel_path) may add those without messages."""
    own = rows.select("archive_id", "file_path", "rel_path")
    tree = mail_folders(own if files is None else own.unionByName(files.select(*own.columns)))
    counts = folders.message_counts(rows, "archive_id", "folder_id")
    counted = tree.join(counts, ["archive_id", "folder_id"], "left").fillna(0, ["content_count", "unread_count"])
    totals = folders.subtree_totals(counted, ("content_count", "unread_count"), "keys")
    return counted.join(totals, ["archive_id", "keys"]).select("archive_id", "folder_id", "folder_order", F.array_join("path", "/").alias("path"), "name", "depth", "content_count", "unread_count", "total_content_count", "total_unread_count")


def body_search(rows: DataFrame, query: str) -> DataFrame:
    """Search list fields, then bodies of what they miss; newest first, undated last."""
    listed = rows.where(search.in_list(query))
    deeper = rows.where(~search.in_list(query)).where(search.with_bodies(query))
    return listed.unionByName(deeper).orderBy(*reports.newest_first("archive_id", "msg_key"))


def shown_subject(rows: DataFrame) -> DataFrame:
    return rows.withColumn("subject", X.shown_subject(F.col("subject")))


def archive_facts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Mail files, bytes, folders, messages, unread and expunged ones of each archive; the files are scanned once."""
    h = F.col("headers")
    rows = dedupe.union_archives([mbox.with_headers(mbox.read_mbox(spark, p, payload=False)) for p in paths]).select("archive_id", "file_path", "folder_path", mbox.is_expunged(h).alias("gone"), mbox.is_read(h).alias("read"))
    each = materialize(rows.groupBy("archive_id", "file_path", "folder_path").agg(F.count_if(~F.col("gone")).alias("content_count"), F.count_if(~F.col("gone") & ~F.col("read")).alias("unread_count"), F.count_if("gone").alias("expunged")))
    files = materialize(dedupe.union_archives([mbox.classify_files(spark, p).where("kind in ('mbox', 'empty')").select(F.lit(mbox.archive_name(p)).alias("archive_id"), "size_bytes", F.col("path").alias("file_path"), "rel_path") for p in paths]))
    return folders.archive_facts(files, mail_folders(files), each, each.groupBy("archive_id").agg(F.sum("expunged").alias("expunged")))
