"""Folder trees: paths, kinds, order, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlark.functions import text as X

#: Folder names by kind.
KIND_NAMES = {
    "inbox": ["inbox", "postvak in", "posteingang", "boîte de réception", "bandeja de entrada", "posta in arrivo"],
    "sent": ["sent items", "sent", "sent mail", "sent messages", "verzonden items", "verzonden", "gesendete elemente", "gesendete objekte", "éléments envoyés", "elementos enviados", "posta inviata", "skickat", "skickade objekt", "sendt", "sendte elementer", "sendt post"],
    "trash": ["deleted items", "verwijderde items", "trash"],
    "drafts": ["drafts", "concepten", "entwürfe", "brouillons", "borradores", "bozze"],
    "outbox": ["outbox", "unsent messages", "postvak uit", "postausgang", "boîte d'envoi", "bandeja de salida", "posta in uscita"],
    "junk": ["junk e-mail", "ongewenste e-mail", "junk email", "spam"],
}
#: Container classes by kind.
KIND_CLASSES = {"ipf.contact": "contacts", "ipf.appointment": "calendar", "ipf.task": "tasks", "ipf.stickynote": "notes", "ipf.journal": "journal"}
#: Message classes by item kind, tried in this order.
ITEM_CLASSES = {"ipm.note": "mail", "ipm.post": "mail", "ipm.contact": "contact", "ipm.distlist": "distributionList", "ipm.appointment": "appointment", "ipm.schedule.meeting": "meetingRequest", "ipm.task": "task", "ipm.stickynote": "note", "report.": "report"}
#: Folders that mail programs keep for themselves.
SYSTEM_NAMES = [
    "search root", "spam search folder 2", "ipm_views", "ipm_common_views", "reminders", "to-do search", "itemprocsearch", "freebusy data", "tracked mail processing", "racine (pour la recherche)",
    "zoekhoofdmap", "finder", "views", "common views", "shortcuts", "schedule", "deferred action", "spooler queue", "conversation action settings", "quick step settings", "yammer root",
    "recoverable items", "root - public", "non_ipm_subtree", "eforms registry", "organization forms", "conversation history",
]
SYSTEM_PREFIXES = ["sync issues", "conversation action settings", "quick step settings", "recoverable items", "~"]
SUBTREE_PREFIXES = ["top of", "bovenkant van", "début du", "persoonlijke mappen", "personal folders", "oberste ebene"]
#: Places of well-known folders in the list.
RANKS = {"inbox": 0, "unsent messages": 1, "outbox": 1, "drafts": 2, "templates": 3, "sent": 4, "sent mail": 4, "sent items": 4, "trash": 5, "deleted items": 5}


def folder_kind(container_class: Column, special: Column, name: Column) -> Column:
    """By class prefix, else what the store declares, else the name, else mail."""
    cls, bare = F.lower(F.coalesce(container_class, F.lit(""))), X.strip(F.lower(name))
    out = None
    for prefix, kind in KIND_CLASSES.items():
        out = F.when(cls.startswith(prefix), kind) if out is None else out.when(cls.startswith(prefix), kind)
    out = out.when(special.isNotNull(), special)
    for kind, known in KIND_NAMES.items():
        out = out.when(bare.isin(known), kind)
    return out.otherwise("mail")


def item_kind(message_class: Column) -> Column:
    cls = F.lower(F.coalesce(message_class, F.lit("")))
    out = F.when(cls.isin("", "ipm"), "mail")
    for prefix, kind in ITEM_CLASSES.items():
        out = out.when(cls.startswith(prefix), kind)
    return out.otherwise("other")


def is_system(name: Column) -> Column:
    bare = F.lower(name)
    found = bare.isin(SYSTEM_NAMES)
    for prefix in SYSTEM_PREFIXES:
        found = found | bare.startswith(prefix)
    return found


def has_subtree_name(name: Column) -> Column:
    bare = F.lower(name)
    found = bare == "ipm_subtree"
    for prefix in SUBTREE_PREFIXES:
        found = found | bare.startswith(prefix)
    return found


def steps(rows: DataFrame, path: str) -> Column:
    """The steps of a path column: an array of names or ids as it is, a text at its slashes."""
    return F.col(path) if isinstance(rows.schema[path].dataType, T.ArrayType) else F.split(path, "/")


def joined(rows: DataFrame, path: str, parts: Column) -> Column:
    """Steps as the kind of path that the column holds."""
    return parts if isinstance(rows.schema[path].dataType, T.ArrayType) else F.array_join(parts, "/")


def prefixes(parts: Column) -> Column:
    """All beginnings of a path, itself included."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, F.lit(1), n))


def folders_from_files(files: DataFrame) -> DataFrame:
    """Folders of (archive_id, file_path, steps array<struct<key,name>>) and those above them.

    folder_id and parent_id are the joined keys, ``path`` is the array of names, ``keys`` that
    of keys.  A folder of a mail file has that file's name, one that only holds others its own.
    """
    parts = F.col("steps")
    rows = files.select("archive_id", "file_path", F.explode(prefixes(parts)).alias("p"), F.size(parts).alias("n"))
    keys = F.transform("p", lambda s: s["key"])
    is_file = F.size("p") == F.col("n")
    rows = rows.select("archive_id", keys.alias("keys"), F.when(is_file, F.col("file_path")).alias("file_path"), is_file.alias("is_file"), F.element_at("p", -1)["name"].alias("name"))
    found = rows.groupBy("archive_id", "keys").agg(F.max_by("name", F.struct("is_file", "name")).alias("name"), F.max("file_path").alias("file_path"))
    # A folder's path has the names of all folders above, whatever they were called from below.
    above = found.select("archive_id", "keys", "file_path", "name", F.posexplode(prefixes(F.col("keys"))).alias("at", "above"))
    named = above.join(found.select("archive_id", F.col("keys").alias("above"), F.col("name").alias("step")), ["archive_id", "above"])
    paths = named.groupBy("archive_id", "keys", "name", "file_path").agg(F.array_sort(F.collect_list(F.struct("at", "step"))).alias("s"))  # as many as a path has steps
    return paths.select("archive_id", F.array_join("keys", "/").alias("folder_id"), F.when(F.size("keys") > 1, F.array_join(F.slice("keys", F.lit(1), F.size("keys") - 1), "/")).alias("parent_id"), "keys", F.col("s.step").alias("path"), "name", F.size("keys").alias("depth"), "file_path")


def folders_from_paths(files: DataFrame, path: str = "folder_path") -> DataFrame:
    """Folders of mail files and all folders above them: archive_id, path, parent_path, name, depth, file_path (null without a file).

    Paths are arrays of names, or texts joined by slashes if no name has one.
    """
    put = lambda parts: joined(files, path, parts)
    rows = files.select("archive_id", "file_path", steps(files, path).alias("p")).select("archive_id", "file_path", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    rows = rows.select("archive_id", put(F.slice("p", 1, F.col("depth"))).alias("path"), put(F.slice("p", 1, F.col("depth") - 1)).alias("parent_path"), F.element_at("p", F.col("depth")).alias("name"), "depth", F.when(F.col("depth") == F.size("p"), F.col("file_path")).alias("file_path"))
    return rows.groupBy("archive_id", "path", "parent_path", "name", "depth").agg(F.max("file_path").alias("file_path"))


def name_key(name: Column) -> Column:
    """Sort key among siblings: well-known folders first, then natural order."""
    bare = F.lower(name)
    rank = F.lit(10)
    for known, place in RANKS.items():
        rank = F.when(bare == known, place).otherwise(rank)
    return F.concat(F.lpad(rank.cast("string"), 2, "0"), X.natural_key(name), F.lit("\x01"), name)


def preorder_keys(names: Column, keys: Column | None = None) -> Column:
    """Array that sorts folders depth-first with siblings in order; ``keys`` tell siblings of one name apart."""
    if keys is None:
        return F.transform(names, name_key)
    return F.zip_with(names, keys, lambda n, k: F.concat(name_key(n), F.lit("\x01"), k))


def with_preorder(folders: DataFrame, path: str = "path", keys: str | None = None) -> DataFrame:
    """Add ``folder_order``, a folder's number in pre-order within its archive (folders of one archive are few)."""
    order = preorder_keys(steps(folders, path), F.col(keys) if keys else None)
    return folders.withColumn("folder_order", F.row_number().over(Window.partitionBy("archive_id").orderBy(order)) - 1)


def tree_from_parents(folders: DataFrame, root: Column, max_depth: int = 64, missing: str = "(unreadable folder)") -> DataFrame:
    """Walk (archive_id, folder_id, parent_id, name) from the roots: adds path, depth and the visited ids.

    Each folder is visited once, cycles are cut, a folder without a name keeps a
    placeholder.  One join for each level.  ``names`` is the path as an array, as names may
    hold slashes; ``visited`` identifies the folder and those above it.
    """
    spark = folders.sparkSession
    named = folders.withColumn("name", F.coalesce("name", F.lit(missing))).dropDuplicates(["archive_id", "folder_id"])
    named.withColumn("is_root", root).createOrReplaceTempView("__folders")
    return spark.sql(f"""
        WITH RECURSIVE tree (archive_id, folder_id, parent_id, name, path, depth, visited, names) MAX RECURSION LEVEL {max_depth + 2} AS (
          SELECT archive_id, folder_id, parent_id, name, name, 0, array(folder_id), array(name) FROM __folders WHERE is_root
          UNION ALL
          SELECT f.archive_id, f.folder_id, f.parent_id, f.name, concat(t.path, '/', f.name), t.depth + 1, array_append(t.visited, f.folder_id), array_append(t.names, f.name)
          FROM __folders f JOIN tree t ON f.archive_id = t.archive_id AND f.parent_id = t.folder_id
          WHERE NOT array_contains(t.visited, f.folder_id) AND NOT f.is_root AND t.depth < {max_depth})
        SELECT * FROM tree""")


def subtree_totals(folders: DataFrame, counts: tuple[str, ...] = ("content_count",), path: str = "path") -> DataFrame:
    """Sums over each folder and all below it: every folder's count goes to all its ancestors in one shuffle.

    ``path`` may be an array of names, or of ids where names repeat among siblings.
    """
    above = F.explode(prefixes(steps(folders, path)))
    rows = folders.select("archive_id", above.alias("__p"), *counts).select("archive_id", joined(folders, path, F.col("__p")).alias(path), *counts)
    return rows.groupBy("archive_id", path).agg(*(F.sum(c).alias(f"total_{c}") for c in counts))


def message_counts(messages: DataFrame, *keys: str) -> DataFrame:
    """Messages and unread ones by folder."""
    return messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("content_count"), F.count_if(F.col("flags").bitwiseAND(1) == 0).alias("unread_count"))


def children_per_parent(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("archive_id", "nid_parent").agg(F.count(F.lit(1)).alias("children"))


def archive_facts(files: DataFrame, folders: DataFrame, counts: DataFrame, expunged: DataFrame) -> DataFrame:
    """Mail files, bytes, folders, messages and expunged ones of each archive."""
    a = files.groupBy("archive_id").agg(F.count(F.lit(1)).alias("mail_files"), F.sum("size_bytes").alias("total_bytes"))
    b = folders.groupBy("archive_id").agg(F.count(F.lit(1)).alias("folders"))
    c = counts.groupBy("archive_id").agg(F.sum("content_count").alias("items"), F.sum("unread_count").alias("unread"))
    out = a.join(b, "archive_id", "left").join(c, "archive_id", "left").join(expunged, "archive_id", "left")
    return out.fillna(0)


def visible(folders: DataFrame) -> DataFrame:
    """Folders without system folders and all below them; what stands below an IPM subtree moves up to the top.

    ``folders``: archive_id, path (below the root; an array, or a text), name, kind,
    content_count.  A subtree folder itself stays only if it holds messages.
    """
    rows = folders.withColumn("__p", steps(folders, "path"))
    hidden = rows.where(is_system(F.col("name"))).select("archive_id", F.col("__p").alias("__above"))
    gone = rows.withColumn("__above", F.explode(prefixes(F.col("__p")))).join(hidden, ["archive_id", "__above"], "left_semi").select("archive_id", "__p").distinct()
    rest = rows.join(gone, ["archive_id", "__p"], "left_anti")
    parent = F.slice("__p", F.lit(1), F.size("__p") - 1)
    inner = rest.where(F.col("kind").isin("inbox", "sent", "trash") & (F.size("__p") > 1)).select("archive_id", parent.alias("__p")).distinct()
    tops = rest.where(F.size("__p") == 1)
    subtree = tops.where(has_subtree_name(F.col("name"))).select("archive_id", "__p").union(tops.join(inner, ["archive_id", "__p"], "left_semi").select("archive_id", "__p")).distinct()
    lifted = rest.withColumn("__top", F.slice("__p", 1, 1)).join(subtree.select("archive_id", F.col("__p").alias("__top"), F.lit(True).alias("__lift")), ["archive_id", "__top"], "left")
    below = F.size("__p") > 1
    lifted = lifted.where(F.col("__lift").isNull() | below | (F.col("content_count") > 0))
    path = F.when(F.col("__lift").isNotNull() & below, F.slice("__p", F.lit(2), F.size("__p"))).otherwise(F.col("__p"))
    return lifted.withColumn("shown_path", joined(folders, "path", path)).drop("__p", "__top", "__lift")


def default_folder(folders: DataFrame) -> DataFrame:
    """Each archive's first inbox with messages, else its first folder with messages, else its first."""
    choice = F.struct(F.when((F.col("kind") == "inbox") & (F.col("content_count") > 0), 0).when(F.col("content_count") > 0, 1).otherwise(2).alias("p"), "folder_order", "path")
    return folders.groupBy("archive_id").agg(F.min(choice).alias("c")).select("archive_id", "c.path")
