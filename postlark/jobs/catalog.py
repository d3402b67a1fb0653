"""Registered queries over the given tables, each with its SQL twin.

The tables hold no mail, so they are read as mail: documents as messages (first
line, text, archive = source, folder = language, Message-ID = md5 of the text),
conversations as folders, region / nation as a folder tree, orders and lineitem as
nodes and contents rows.  Round trips build mail text from a row, parse it, and the
twin gives the row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlark import schemas, storage
from postlark.functions import mail
from postlark.functions import text as X
from postlark.jobs import export, messages, stores
from postlark.operators import dedupe, folders, mime, properties, reports, search, sinks
from postlark.sources import mailfiles, mbox

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""
    def register(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.lit(0).alias("archive_no"), F.col("source").alias("archive_id"), F.col("lang").alias("folder_path"), F.col("lang").alias("folder_id"), F.col("lang").alias("folder_order"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("msg_key"),
        F.substring_index("text", "\n", 1).alias("subject"), F.concat(F.lit("User "), "source").alias("from_name"), F.concat("source", F.lit("@example.org")).alias("from_email"), F.col("lang").alias("to_list"), F.lit("").alias("cc_list"),
        F.concat("source", F.lit("@example.org")).alias("addresses"), F.col("text").alias("body_text"), F.concat("source", F.lit(".txt")).alias("attachment_names"), F.md5("text").alias("message_id"), F.octet_length("text").cast("long").alias("size"),
        (F.when(F.col("doc_id") % 3 != 0, 1).otherwise(0) + F.when(F.col("doc_id") % 5 == 0, 16).otherwise(0)).alias("flags"))


MESSAGES = """m AS (SELECT source AS archive_id, lang AS folder_path, doc_id AS seq, doc_id::VARCHAR AS msg_key, split_part(text, chr(10), 1) AS subject, 'User ' || source AS from_name, source || '@example.org' AS from_email, lang AS to_list,
 text AS body_text, source || '.txt' AS attachment_names, md5(text) AS message_id, strlen(text)::BIGINT AS size, CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 16 ELSE 0 END AS flags, doc_id FROM documents)"""
HAY = "lower(subject || ' ' || from_name || ' ' || to_list || ' ')"


def with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("seq"), F.lit("recipients cannot be read").alias("recipient_error"))
    return as_messages(spark, sf_dir).join(bad, "seq", "left")


@query(f"""WITH {MESSAGES}, s AS (SELECT m.*, toxic IS NOT NULL AS bad, contains({HAY}, 'the') AND contains({HAY}, 'of') AS hit FROM m LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) USING (doc_id) WHERE contains(folder_path, 'e')),
c AS (SELECT *, row_number() OVER (PARTITION BY message_id, bad OR NOT hit ORDER BY folder_path, seq) AS rn FROM s)
SELECT count(*) AS scanned, count(*) FILTER (WHERE NOT bad AND hit AND rn = 1) AS written, count(*) FILTER (WHERE NOT bad AND hit AND rn > 1) AS duplicates, count(*) FILTER (WHERE bad) AS failures, count(*) FILTER (WHERE NOT bad AND NOT hit) AS misses FROM c""")
def export_report(spark, sf_dir):
    """Flagship: messages with these words in some folders, each once, with a report."""
    return reports.export_report(export.decide(with_errors(spark, sf_dir), "the OF", "E"))


@query(f"""WITH {MESSAGES} SELECT msg_key, archive_id || '/' || folder_path AS location FROM m WHERE contains({HAY}, 'the') AND contains({HAY}, 'er')""")
def search_list_fields(spark, sf_dir):
    return as_messages(spark, sf_dir).where(search.in_list("The er")).select("msg_key", search.location().alias("location"))


@query(f"""WITH {MESSAGES} SELECT msg_key FROM m WHERE contains({HAY} || from_email, 'src1@example') AND contains({HAY} || from_email, 'en')""")
def search_with_addresses(spark, sf_dir):
    return as_messages(spark, sf_dir).where(search.with_addresses("SRC1@example en")).select("msg_key")


@query(f"""WITH {MESSAGES}, h AS (SELECT *, {HAY} || from_email || ' ' || lower(body_text) || ' ' || attachment_names AS hay FROM m) SELECT msg_key FROM h WHERE contains(hay, 'license') AND contains(hay, 'src')""")
def search_in_bodies(spark, sf_dir):
    return export.body_search(as_messages(spark, sf_dir).withColumn("date", F.lit(None).cast("timestamp")), "license SRC").select("msg_key")


@query(f"""WITH {MESSAGES} SELECT msg_key FROM m WHERE archive_id = 'src3' AND folder_path IN ('en', 'de') AND contains({HAY}, 'the')""")
def search_scope(spark, sf_dir):
    rows = as_messages(spark, sf_dir)
    shown = rows.select("archive_id", "folder_id").distinct().where(F.col("folder_id").isin("en", "de"))
    return search.in_scope(rows, shown, "src3").where(search.in_list("the")).select("msg_key")


@query(f"""WITH {MESSAGES}, s AS (SELECT m.*, l.doc_id IS NULL AS unread FROM m LEFT JOIN labels l USING (doc_id)), f AS (SELECT archive_id, count(*) FILTER (WHERE NOT contains({HAY}, 'the') AND unread) AS messages, 0::BIGINT AS folders FROM s GROUP BY archive_id)
SELECT archive_id, folders, messages FROM f WHERE messages > 0""")
def incomplete_search(spark, sf_dir):
    """Misses on messages without a readable part, counted by archive."""
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), F.lit(True).alias("known"))
    rows = as_messages(spark, sf_dir).join(known, "seq", "left").withColumns({"location": search.location(), "body_error": F.when(F.col("known").isNull(), "body cannot be read")})
    failures = search.misses_that_may_be_wrong(rows, search.in_list("the"), "body_error")
    return reports.incomplete_warning(failures).select("archive_id", "folders", "messages")


@query(f"""WITH {MESSAGES} SELECT archive_id, folder_path, count(*) AS content_count, count(*) FILTER (WHERE flags % 2 = 0) AS unread_count FROM m GROUP BY ALL""")
def folder_counts(spark, sf_dir):
    return folders.message_counts(as_messages(spark, sf_dir), "archive_id", "folder_path")


@query("""WITH p AS (SELECT r_name || '/' || n_name AS path, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 'world' AS archive_id, path, count(*)::BIGINT AS total FROM (SELECT path FROM p UNION ALL SELECT split_part(path, '/', 1) FROM p) GROUP BY path""")
def subtree_totals(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    own = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("content_count"))
    rows = own.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.lit("world").alias("archive_id"), F.concat_ws("/", "r_name", "n_name").alias("path"), "content_count")
    return folders.subtree_totals(rows).select("archive_id", "path", F.col("total_content_count").alias("total"))


@query("""WITH l AS (SELECT r_name, n_name, n_nationkey AS nk, s_name, s_suppkey AS sk FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT archive_id, path, (row_number() OVER (PARTITION BY archive_id ORDER BY nk, sk) - 1)::BIGINT AS folder_order FROM (SELECT DISTINCT r_name AS archive_id, n_name AS path, nk, -1 AS sk FROM l UNION ALL SELECT r_name, n_name || '/' || s_name, nk, sk FROM l)""")
def folder_preorder(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    files = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("archive_id"), F.concat_ws("/", "n_name", "s_name").alias("folder_path"), F.col("s_name").alias("file_path"))
    return folders.with_preorder(folders.folders_from_paths(files)).select("archive_id", "path", F.col("folder_order").cast("long").alias("folder_order"))


@query("""SELECT 'w' AS archive_id, folder_id, path, depth FROM (SELECT 'root' AS folder_id, 'root' AS path, 0 AS depth UNION ALL SELECT 'r' || r_regionkey, 'root/' || r_name, 1 FROM region
UNION ALL SELECT 'n' || n_nationkey, 'root/' || r_name || '/' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'c' || s_suppkey, 'root/' || r_name || '/' || n_name || '/' || s_name, 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
def folder_tree(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    rows = r.select(F.concat(F.lit("r"), "r_regionkey").alias("folder_id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("name"))
    rows = rows.union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")).union(s.select(F.concat(F.lit("c"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), "s_name"))
    rows = rows.union(r.limit(1).select(F.lit("root"), F.lit("n0"), F.lit("root")))  # the root hangs below its own grandchild: a cycle
    return folders.tree_from_parents(rows.withColumn("archive_id", F.lit("w")), F.col("folder_id") == "root").select("archive_id", "folder_id", "path", "depth")


@query("""WITH l AS (SELECT r_name AS archive_id, n_name AS top, CASE s_suppkey % 5 WHEN 0 THEN 'Inbox' WHEN 1 THEN 'Sync Issues ' || s_suppkey ELSE s_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT DISTINCT archive_id, top AS path, top, name = 'x' AS inbox FROM l UNION SELECT archive_id, top || '/' || name, top, name = 'Inbox' FROM l WHERE NOT starts_with(name, 'Sync'))
SELECT archive_id, path, CASE WHEN lift AND path <> top THEN substr(path, length(top) + 2) ELSE path END AS shown_path FROM (SELECT *, bool_or(inbox) OVER (PARTITION BY archive_id, top) AS lift FROM f) WHERE NOT (lift AND path = top)""")
def visible_folders(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    name = F.when(F.col("s_suppkey") % 5 == 0, "Inbox").when(F.col("s_suppkey") % 5 == 1, F.concat(F.lit("Sync Issues "), "s_suppkey")).otherwise(F.col("s_name"))
    leaves = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("archive_id"), F.col("n_name").alias("top"), name.alias("name"))
    rows = leaves.select("archive_id", F.col("top").alias("path"), F.col("top").alias("name"), F.lit(0).alias("content_count")).union(leaves.select("archive_id", F.concat_ws("/", "top", "name"), "name", F.lit(1))).distinct()
    rows = rows.withColumn("kind", folders.folder_kind(F.lit(""), F.lit(None).cast("string"), F.col("name")))
    return folders.visible(rows).select("archive_id", "path", "shown_path")


@query("""SELECT s_nationkey AS archive_no, min(path) AS path FROM (SELECT s_nationkey, s_name AS path, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 5000 THEN CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END ELSE 2 END, s_suppkey) AS rn FROM supplier) WHERE rn = 1 GROUP BY 1""")
def default_folders(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("archive_id"), F.col("s_name").alias("path"), F.when(F.col("s_suppkey") % 4 == 0, "inbox").otherwise("mail").alias("kind"), F.when(F.col("s_acctbal") > 5000, 1).otherwise(0).alias("content_count"), F.col("s_suppkey").alias("folder_order"))
    return folders.default_folder(s).withColumnRenamed("archive_id", "archive_no")


KINDS = ["IPM.Note", "ipm.contact.x", "IPM.DistList", "IPM.Appointment", "IPM.Schedule.Meeting.Request", "IPM.Task", "IPM.StickyNote", "REPORT.IPM.Note.NDR", "IPM.Other", ""]


@query(f"""SELECT event_id, (['mail','contact','distributionList','appointment','meetingRequest','task','note','report','other','mail'])[(event_id % {len(KINDS)})::INT + 1] AS kind FROM events""")
def item_kinds(spark, sf_dir):
    cls = F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % len(KINDS)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", folders.item_kind(cls).alias("kind"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'contacts' WHEN 'view' THEN 'sent' WHEN 'error' THEN 'trash' WHEN 'signup' THEN 'drafts' ELSE 'mail' END AS kind FROM events""")
def folder_kinds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = folders.folder_kind(F.when(F.col("event_type") == "click", "IPF.Contact.MOC"), F.when(F.col("event_type") == "view", "sent"), F.when(F.col("event_type") == "error", "Verwijderde items").when(F.col("event_type") == "signup", " Brouillons").otherwise("Projects"))
    return e.select("event_id", kind.alias("kind"))


@query(f"""WITH {MESSAGES} SELECT msg_key, rn = 1 AS first_copy FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY folder_path, seq) AS rn FROM m)""")
def message_id_copies(spark, sf_dir):
    return dedupe.once_per_message_id(as_messages(spark, sf_dir)).select("msg_key", "first_copy")


@query("""SELECT l_partkey AS nid, count(*) AS listed, count(*) FILTER (WHERE rn = 1) AS firsts, max(CASE WHEN rn = 1 THEN l_suppkey END) AS folder FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_orderkey, l_linenumber) AS rn FROM (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem)) GROUP BY 1""")
def store_entries_once(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit("a").alias("archive_id"), F.col("l_partkey").alias("nid"), F.col("l_suppkey").alias("folder_order"), F.struct("l_orderkey", "l_linenumber").alias("seq")).distinct()
    once = dedupe.once_per_entry(rows)
    return once.groupBy("nid").agg(F.count(F.lit(1)).alias("listed"), F.count_if("first_entry").alias("firsts"), F.max(F.when(F.col("first_entry"), F.col("folder_order"))).alias("folder"))


@query("""WITH a AS (SELECT o_orderkey AS nid FROM orders WHERE o_orderkey % 7 <> 0), l AS (SELECT DISTINCT l_suppkey AS folder_nid, l_orderkey AS row_id FROM lineitem)
SELECT folder_nid, row_id FROM l WHERE row_id IN (SELECT nid FROM a)""")
def contents_with_nodes(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.lit("a").alias("archive_id"), F.col("o_orderkey").alias("nid"))
    rows = table(spark, sf_dir, "lineitem").select(F.lit("a").alias("archive_id"), F.col("l_suppkey").alias("folder_nid"), F.col("l_orderkey").alias("row_id")).distinct()
    return properties.existing(rows, nodes).select("folder_nid", "row_id")


@query("""WITH nodes AS (SELECT o_orderkey * 32 + 4 AS nid, o_custkey AS parent FROM orders), l AS (SELECT DISTINCT o_custkey AS folder_nid, o_orderkey * 32 + 4 AS row_id FROM orders WHERE o_orderkey % 3 = 0)
SELECT folder_nid, row_id, 0 AS source_rank FROM l UNION ALL SELECT parent, nid, 1 FROM nodes WHERE nid NOT IN (SELECT row_id FROM l)""")
def contents_and_orphans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("archive_id", F.lit("a"))
    nodes = o.select("archive_id", (F.col("o_orderkey") * 32 + 4).alias("nid"), F.col("o_custkey").alias("nid_parent"))
    rows = o.where("o_orderkey % 3 = 0").select("archive_id", F.col("o_custkey").alias("folder_nid"), (F.col("o_orderkey") * 32 + 4).alias("row_id"))
    return properties.with_orphans(rows, nodes, properties.NODE_TYPE_MESSAGE).select("folder_nid", "row_id", "source_rank")


@query("""SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE o_orderstatus END AS subject, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE 'S' END AS sender_name FROM orders""")
def sparse_contents(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("archive_id", F.lit("a"))
    blank = F.col("o_orderkey") % 4 == 0
    rows = o.select("archive_id", F.col("o_orderkey").alias("row_id"), F.when(~blank, F.col("o_orderstatus")).alias("subject"), F.when(~blank, F.lit("S")).otherwise("").alias("sender_name"))
    own = o.select("archive_id", F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("sender_name"))
    return properties.fill_sparse(rows, own, ["subject", "sender_name"]).select("row_id", "subject", "sender_name")


def as_properties(spark, sf_dir) -> DataFrame:
    """Parts as property rows; property 12289 comes twice, the second time with the name."""
    p = table(spark, sf_dir, "part")
    rows = F.array(*(F.struct(F.lit(pos).alias("pos"), F.lit(i).alias("prop_id"), F.lit(31).alias("prop_type"), v.cast("string").alias("v_str")) for pos, i, v in ((0, 0x3001, F.col("p_brand")), (1, 0x3001, F.col("p_name")), (2, 0x3A17, F.col("p_type")), (3, 0x8001, F.col("p_size")))))
    return p.select(F.lit("a").alias("archive_id"), F.col("p_partkey").alias("nid"), F.explode(rows).alias("r")).select("archive_id", "nid", "r.*").withColumns({"v_arr": F.lit(None).cast("array<string>"), "v_ts": F.lit(None).cast("timestamp"), "v_long": F.lit(None).cast("long"), "v_double": F.lit(None).cast("double"), "v_bin": F.lit(None).cast("binary")})


@query("""SELECT p_partkey AS nid, p_name AS display_name, p_type AS title FROM part""")
def property_pivot(spark, sf_dir):
    return properties.to_columns(as_properties(spark, sf_dir), {0x3001: "display_name", 0x3A17: "title"}, "v_str").select("nid", "display_name", "title")


@query("""SELECT p_partkey AS nid, 'PSETID_Address' AS set_name, p_size::VARCHAR AS v_str FROM part""")
def named_properties(spark, sf_dir):
    p = as_properties(spark, sf_dir)
    named = p.groupBy("archive_id", "prop_id").agg(F.lit("{00062004-0000-0000-C000-000000000046}").alias("guid")).where("prop_id >= 32768")
    return properties.named_values(p, named).select("nid", properties.set_name(F.col("guid")).alias("set_name"), "v_str")


@query("""SELECT nid, tag, name, type_name, shown FROM (SELECT p_partkey AS nid, unnest(['0x3001001F', '0x3001001F', '0x3A17001F', '0x8001001F']) AS tag, unnest(['Display name', 'Display name', 'Title', '0x8001']) AS name, 'Unicode' AS type_name, unnest([p_brand, p_name, p_type, p_size::VARCHAR]) AS shown FROM part) WHERE contains(lower(shown), 'ring') OR contains(lower(name), 'ring') OR contains(lower(tag), 'ring')""")
def property_listing(spark, sf_dir):
    p = as_properties(spark, sf_dir)
    names = p.select("prop_id").distinct().select("prop_id", F.when(F.col("prop_id") == 0x3001, "Display name").when(F.col("prop_id") == 0x3A17, "Title").alias("name"))
    return search.matching_properties(properties.listing(p, names), "RING").select("nid", "tag", "name", "type_name", "shown")


@query("""SELECT p_partkey AS nid, unnest(['Name', 'Job title']) AS label, unnest([p_name, p_type]) AS value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'Complete', p_size || '%' FROM part WHERE p_partkey % 2 = 1""")
def item_details(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit("a").alias("archive_id"), F.col("p_partkey").alias("nid"), F.when(F.col("p_partkey") % 2 == 0, "contact").otherwise("task").alias("kind"), F.concat(F.lit(" "), "p_name").alias("display_name"), F.col("p_type").alias("title"), F.concat(X.percent(F.col("p_size") / 100 + 0.001).cast("string"), F.lit("%")).alias("percent_complete"))
    return properties.details(p).select("nid", "label", "value")


@query("""SELECT n_regionkey::BIGINT AS nid_parent, count(*) AS children FROM nation GROUP BY 1 UNION ALL SELECT 1000 + c_nationkey, count(*) FROM customer GROUP BY 1""")
def node_children(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    nodes = n.select(F.col("n_regionkey").cast("long").alias("nid_parent")).union(c.select((F.col("c_nationkey") + 1000).cast("long"))).withColumn("archive_id", F.lit("a"))
    return folders.children_per_parent(nodes).select("nid_parent", "children")


@query("""SELECT l_orderkey AS msg_key, coalesce(string_agg(shown, ', ' ORDER BY pos, shown) FILTER (WHERE k = 1), '') AS to_list, coalesce(string_agg(shown, ', ' ORDER BY pos, shown) FILTER (WHERE k = 2), '') AS cc_list, coalesce(string_agg(shown, ', ' ORDER BY pos, shown) FILTER (WHERE k = 3), '') AS bcc_list
FROM (SELECT l_orderkey, l_linenumber::BIGINT * 1000000000 + l_partkey AS pos, l_linenumber % 3 + 1 AS k, CASE WHEN l_suppkey % 2 = 0 THEN 'S' || l_suppkey || ' <s' || l_suppkey || '@x.org>' ELSE 'S' || l_suppkey END AS shown FROM lineitem) GROUP BY 1""")
def recipient_lists(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("msg_key"), (F.col("l_linenumber") * F.lit(1_000_000_000).cast("long") + F.col("l_partkey")).alias("pos"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("kind"), F.concat(F.lit("S"), "l_suppkey").alias("name"),
                                                F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("s"), "l_suppkey", F.lit("@x.org"))).otherwise(F.concat(F.lit("/O=ORG/CN="), "l_suppkey")).alias("email"))
    return properties.recipient_strings(r)


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'u' || user_id || '@x.org' ELSE 'U <u' || user_id || '@x.org>' END AS shown, make_timestamp(epoch_us(ts)) AS date FROM events""")
def sender_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    email = properties.sender_email(F.lit("/O=EX"), F.concat(F.lit("u"), "user_id", F.lit("@x.org")))
    name = properties.sender_name(F.lit(""), F.when(F.col("user_id") % 3 != 0, "U"))
    return e.select("event_id", properties.display(name, email).alias("shown"), properties.message_date(F.lit(None).cast("timestamp"), F.when(F.col("user_id") % 2 == 0, F.col("ts")), F.col("ts")).alias("date"))


@query("""SELECT s_suppkey AS nid, CASE WHEN s_suppkey % 6 = 0 THEN 'sent' WHEN s_suppkey % 6 = 1 THEN 'trash' END AS special_kind FROM supplier""")
def special_folders(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit("a").alias("archive_id"), F.col("s_suppkey").alias("nid"))
    digits = F.lpad(F.hex("nid"), 8, "0")
    little = F.unhex(F.concat(F.repeat(F.lit("AB"), F.lit(20)), *(F.substring(digits, i, 2) for i in (7, 5, 3, 1))))
    entries = s.where("nid % 6 < 2").select("archive_id", F.when(F.col("nid") % 6 == 0, "sent").otherwise("trash").alias("kind"), little.alias("entry_id"))
    return properties.special_folders(s, entries).select("nid", "special_kind")


@query("""SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS seq, CASE role WHEN 'user' THEN 'to' || conv_id ELSE role END AS correspondent FROM conversations WHERE role <> 'system'""")
def message_numbers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "role", F.col("conv_id").cast("string").alias("file_path"), F.expr("turn div 3").alias("block"), F.col("turn").alias("mid"))
    shown = reports.correspondent(F.when(F.col("role") == "user", "sent").otherwise("inbox"), F.col("role"), F.lit(""), F.concat(F.lit("to"), "conv_id"))
    return mbox.number_messages(c).select("conv_id", "turn", "seq", shown.alias("correspondent"))


@query("""SELECT event_id, ts AS date FROM events ORDER BY ts DESC, event_id LIMIT 50""")
def newest_messages(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("date")).orderBy(*reports.newest_first("event_id")).limit(50)


@query(f"""WITH {MESSAGES} SELECT msg_key, size FROM m ORDER BY CASE WHEN flags >= 16 THEN 1 ELSE 0 END DESC, size DESC, seq LIMIT 40""")
def largest_with_attachments(spark, sf_dir):
    order = [reports.column_order("attachments", True)[0], *reports.column_order("size", True, "seq")]
    return as_messages(spark, sf_dir).orderBy(*order).limit(40).select("msg_key", "size")


@query(f"""WITH {MESSAGES} SELECT count(*) FILTER (WHERE contains({HAY}, 'the')) AS found, count(*) FILTER (WHERE contains({HAY}, 'the') AND flags % 2 = 0) AS unread, count(*) AS total FROM m""")
def result_counts(spark, sf_dir):
    return reports.result_counts(as_messages(spark, sf_dir), search.in_list("the"))


@query(f"""WITH {MESSAGES}, f AS (SELECT archive_id, archive_id || '/' || folder_path AS location, msg_key FROM m JOIN labels USING (doc_id) WHERE toxic = 1) SELECT *, greatest((SELECT count(*) FROM f) - 15, 0)::BIGINT AS more FROM f ORDER BY archive_id, location, msg_key LIMIT 15""")
def first_failures(spark, sf_dir):
    rows = with_errors(spark, sf_dir).withColumn("location", search.location())
    _, failures = dedupe.split_unreadable(rows, "recipient_error")
    return reports.failure_summary(failures, 15).drop("reason")


@query(f"""WITH {MESSAGES} SELECT archive_id, count(*)::BIGINT AS mail_files, sum(size)::BIGINT AS total_bytes, count(DISTINCT folder_path)::BIGINT AS folders, count(*)::BIGINT AS items, count(*) FILTER (WHERE flags % 2 = 0)::BIGINT AS unread, count(*) FILTER (WHERE seq % 10 = 0)::BIGINT AS expunged FROM m GROUP BY 1""")
def archive_facts(spark, sf_dir):
    m = as_messages(spark, sf_dir)
    expunged = m.where("seq % 10 = 0").groupBy("archive_id").agg(F.count(F.lit(1)).alias("expunged"))
    return folders.archive_facts(m.select("archive_id", F.col("size").alias("size_bytes")), m.select("archive_id", "folder_path").distinct(), folders.message_counts(m, "archive_id", "folder_path"), expunged)


@query("""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style.*?</style>', '', 'g'), '(?is)<script.*?</script>', '', 'g'), '(?is)<head.*?</head>', '', 'g'), '(?is)<br[^>]*>', chr(10), 'g'), '(?i)</(p|div|tr|li|h[1-6])>', chr(10), 'g'), '<[^>]+>', '', 'g'),
'&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&nbsp;', ' '), chr(13) || chr(10), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS text_md5 FROM pages""".replace("\\\\n", "\\n"))
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(mail.html_to_text(F.col("html"))).alias("text_md5"))


@query("""SELECT page_id, nullif(regexp_extract(lower(html[:4096]), 'charset\\s*=\\s*["'']?\\s*([a-z0-9_\\-]+)', 1), '') AS charset FROM pages""".replace("\\\\", "\\"))
def html_charsets(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_charset(F.encode("html", "UTF-8")).alias("charset"))


@query("""SELECT event_id, date_trunc('second', ts) AS date FROM events""")
def mail_dates(spark, sf_dir):
    """Round trip: the time in one of three forms, read again."""
    ts = F.col("ts")
    text = F.when(F.col("event_id") % 3 == 0, X.format_rfc2822(ts)).when(F.col("event_id") % 3 == 1, X.format_mbox_date(ts)).otherwise(F.date_format(ts + F.expr("interval 60 minutes"), "d MMM yy HH:mm:ss 'MET'"))
    return table(spark, sf_dir, "events").select("event_id", mail.mail_date(text).alias("date"))


@query("""SELECT event_id, make_timestamp(epoch_us(ts)) AS filetime, make_timestamp(epoch_us(ts)) AS ole, user_id / 10000.0 AS money FROM events""")
def store_times(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", X.filetime_to_ts((micros + 11644473600000000) * 10 + 3).alias("filetime"), F.timestamp_micros(F.unix_micros(X.filetime_to_ts((micros + 11644473600000000) * 10)) + F.unix_micros(X.ole_date_to_ts(F.lit(25569.0)))).alias("ole"), X.currency(F.col("user_id")).alias("money"))


def mail_text(spark, sf_dir) -> DataFrame:
    """Documents as raw mail with folded headers, CRLF and a status."""
    d = table(spark, sf_dir, "documents")
    lines = F.concat_ws("\r\n", F.concat(F.lit("X-Mozilla-Status: "), F.when(F.col("doc_id") % 10 == 0, "0009").when(F.col("doc_id") % 3 == 0, "0000").otherwise("0001")), F.concat(F.lit("SUBJECT : Note\r\n\tnumber "), "doc_id"), F.concat(F.lit("From: \"Src, "), "source", F.lit("\" <"), "source", F.lit("@x.org>")),
                        F.concat(F.lit("To: a@x.org, B <b@x.org>;\r\n "), "lang", F.lit("@x.org (L)")), F.concat(F.lit("X-Priority: "), (F.col("doc_id") % 6).cast("string")), F.lit("Date: 4 Nov 99 12:00 MET"), F.lit("Content-Type: text/plain; charset=\"UTF-8\""), F.lit(">From garbage"), F.concat(F.lit("Message-ID: <"), "doc_id", F.lit("@x>")))
    raw = F.encode(F.concat(lines, F.lit("\r\n\r\n"), "text"), "UTF-8")
    return d.select(F.lit("a").alias("archive_id"), F.col("lang").alias("folder_path"), F.col("lang").alias("file_path"), F.expr("doc_id div 1000").alias("block"), F.col("doc_id").alias("mid"), F.lit("From - Thu Nov 04 12:00:00 1999").alias("sep_line"), raw.alias("raw"), F.octet_length(raw).cast("long").alias("size"))


@query("""SELECT lang AS folder_path, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::BIGINT AS seq, 'Note number ' || doc_id AS subject, 'Src, ' || source AS from_name, source || '@x.org' AS from_email, 'a@x.org; B; L' AS to_list, TIMESTAMP '1999-11-04 11:00:00' AS date,
CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS flags, CASE WHEN doc_id % 6 <= 2 THEN 2 WHEN doc_id % 6 >= 4 THEN 0 ELSE 1 END AS importance, '<' || doc_id || '@x>' AS message_id FROM documents WHERE doc_id % 10 <> 0""")
def message_list(spark, sf_dir):
    rows = mbox.message_summaries(mail_text(spark, sf_dir))
    return rows.select("folder_path", "seq", "subject", "from_name", "from_email", "to_list", "date", "flags", "importance", "message_id")


@query("""SELECT doc_id AS msg_key, pos, kind, name, email FROM (SELECT doc_id, unnest([0, 1, 2]) AS pos, 1 AS kind, unnest(['', 'B', 'L']) AS name, unnest(['a@x.org', 'b@x.org', lang || '@x.org']) AS email FROM documents)""")
def recipients(spark, sf_dir):
    return mime.recipients(mbox.with_headers(mail_text(spark, sf_dir)).withColumnRenamed("mid", "msg_key"))


@query("""SELECT doc_id, md5(text) AS plain_md5, 1::BIGINT AS n_attachments, 'dö c' || doc_id || '.bin' AS filename, md5(source) AS payload_md5, (length(to_base64(source::BLOB)) * 3 // 4)::BIGINT AS size FROM documents""")
def mime_parts(spark, sf_dir):
    """Round trip: multipart mail with a base64 body and an attachment with an RFC 2231 name."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("filename*=iso-8859-1''d%F6%20c"), "doc_id", F.lit(".bin"))
    raw = F.concat_ws("\n", F.lit("Content-Type: multipart/mixed;"), F.lit(" boundary=\"b 1\""), F.lit(""), F.lit("preamble"), F.lit("--b 1"), F.lit("Content-Type: text/plain; charset=utf-8"), F.lit("Content-Transfer-Encoding: base64"), F.lit(""), F.base64(F.encode("text", "UTF-8")), F.lit("--b 1 "),
                      F.lit("Content-Type: application/octet-stream"), F.concat(F.lit("Content-Disposition: attachment; "), name), F.lit("Content-Transfer-Encoding: BASE64"), F.lit(""), F.base64(F.encode("source", "UTF-8")), F.lit("--b 1--"), F.lit("epilogue"))
    out = mime.bodies_and_attachments(mime.message_parts(d.select(F.col("doc_id").alias("msg_key"), F.encode(raw, "UTF-8").alias("raw"))))
    a = F.get("attachments", 0)
    return out.select(F.col("msg_key").alias("doc_id"), F.md5("body_text").alias("plain_md5"), F.size("attachments").cast("long").alias("n_attachments"), a["filename"].alias("filename"), F.md5(a["payload"]).alias("payload_md5"), a["size"].alias("size"))


@query("""SELECT doc_id, md5(text) AS plain_md5, md5('<p>' || text || '</p>') AS html_md5, 'é ' || source AS subject, 'Ä ' || lang AS from_name FROM documents""")
def built_messages(spark, sf_dir):
    """Round trip: messages built from decoded columns and parsed again."""
    d = table(spark, sf_dir, "documents")
    nothing = F.lit(None).cast("string")
    m = d.select(F.col("doc_id").alias("msg_key"), F.concat(F.lit("Ä "), "lang").alias("from_name"), F.concat("source", F.lit("@x.org")).alias("from_email"), F.array(F.struct(F.lit(1).alias("kind"), F.col("source").alias("name"), F.lit("t@x.org").alias("email"))).alias("recipients"), nothing.alias("display_to"), nothing.alias("display_cc"), nothing.alias("display_bcc"),
                 F.concat(F.lit("é "), "source").alias("subject"), F.lit(None).cast("timestamp").alias("date"), nothing.alias("message_id"), F.lit("IPM.Note").alias("message_class"), F.col("text").alias("body_text"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("body_html"),
                 F.array(F.struct(F.lit("a.bin").alias("filename"), F.lit(1).alias("method"), F.lit("x/y").alias("mime_type"), F.lit("").alias("content_id"), F.encode("source", "UTF-8").alias("payload"))).alias("attachments"), F.lit(None).cast("binary").alias("raw"))
    built = sinks.build_eml(m).select("msg_key", F.col("eml").alias("raw"))
    # What the headers tell goes along with the key, so a message is built once, and nothing is shuffled.
    heads = mbox.with_headers(built).select(F.struct("msg_key", mail.words(X.header(F.col("headers"), "Subject")).alias("subject"), F.get(mail.addresses(X.header(F.col("headers"), "From")), 0)["name"].alias("from_name")).alias("key"), "raw")
    out = mime.bodies_and_attachments(mime.message_parts(heads, "key"), "key")
    return out.select(F.col("key.msg_key").alias("doc_id"), F.md5("body_text").alias("plain_md5"), F.md5("body_html").alias("html_md5"), "key.subject", "key.from_name")


@query("""SELECT doc_id, md5('From ' || source || '@x.org Thu Jan 01 00:00:00 1970' || chr(10) || 'X-Folder: ' || source || '/' || lang || chr(10) || regexp_replace('From me' || chr(10) || '>From you' || chr(10) || text, '(?m)^From ', '>From ', 'g') || chr(10)) AS entry_md5 FROM documents""")
def mbox_entries(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.encode(F.concat(F.lit("From me\r\n>From you\r"), "text"), "UTF-8")
    entry = sinks.mbox_entry(raw, F.concat(F.lit("N <"), "source", F.lit("@x.org>")), F.lit(None).cast("timestamp"), sinks.folder_header(F.col("source"), F.col("lang")), F.lit(True))
    return d.select("doc_id", F.md5(X.bytes_of(entry)).alias("entry_md5"))


@query("""SELECT doc_id, md5(text) AS base64_md5, md5(text) AS charset_md5, 'é ' || source AS words FROM documents""")
def decoders(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    noisy = F.concat(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "=+$", ""), F.lit("=ignored"))
    return d.select("doc_id", F.md5(X.decode_base64_lenient(F.regexp_replace(noisy, "(.{76})", "$1\r\n*"))).alias("base64_md5"), F.md5(mail.text_of(F.encode("text", "UTF-8"), F.lit("us-ascii"))).alias("charset_md5"), mail.words(F.concat(F.lit("=?iso-8859-1?Q?=E9?= =?utf-8*en?B?"), F.base64(F.encode(F.concat(F.lit(" "), "source"), "UTF-8")), F.lit("?="))).alias("words"))


@query(f"""WITH {MESSAGES} SELECT msg_key, CASE WHEN strlen(s) <= 200 THEN s END AS name, strlen(s) > 200 AS cut FROM (SELECT msg_key, CASE WHEN t = '' THEN 'zonder onderwerp' ELSE t END AS s FROM (SELECT msg_key, trim(regexp_replace('a:b ' || subject, '[/\\\\:?%*|"<>\\n\\r\\t]', '_', 'g'), ' ' || chr(9)) AS t FROM m))""".replace("\\\\\\\\", "\\\\"))
def safe_names(spark, sf_dir):
    name = X.safe_name(F.concat(F.lit("a:b "), "subject"))
    cut = F.octet_length(X.strip(F.concat(F.lit("a:b "), "subject"))) > 200
    return as_messages(spark, sf_dir).select("msg_key", F.when(~cut, name).alias("name"), cut.alias("cut"))


@query("""SELECT p_brand AS directory, p_partkey, p_name || CASE WHEN rn = 1 THEN '' ELSE ' (' || rn || ')' END || '.eml' AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS rn FROM part)""")
def unique_file_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "directory")
    return sinks.unique_names(p, "directory", "p_name", "p_partkey", ".eml").select("directory", "p_partkey", "file_name")


@query("""SELECT page_id, src AS ref, CASE WHEN length(src) % 2 = 0 THEN 1 END AS att_no FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"\\s>)'']+)"', 1)) AS src FROM pages)""".replace("\\\\", "\\"))
def content_references(spark, sf_dir):
    """Links of pages read as cid: references; every other one has its attachment."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_key"), F.regexp_replace("html", "href=\"/([^\"\\s>)']+)\"", "href=\"CID:$1\"").alias("body_html"))
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_key"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("href=\"/([^\"\\s>)']+)\""), F.lit(1)))).alias("content_id")).where(F.length("content_id") % 2 == 0).withColumn("att_no", F.lit(1))
    return mime.content_references(p, files.withColumn("content_id", F.upper("content_id"))).select(F.col("msg_key").alias("page_id"), "ref", "att_no")


@query("""SELECT s_suppkey, s_nationkey AS archive_no, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 1 END, s_suppkey)::BIGINT AS place FROM supplier""")
def natural_order(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = F.when(F.col("s_suppkey") % 9 == 0, "INBOX").otherwise(F.concat(F.lit("Folder "), "s_suppkey"))
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(folders.name_key(name), "s_suppkey"))
    return s.select("s_suppkey", F.col("s_nationkey").alias("archive_no"), place.cast("long").alias("place"))


def uuencoded(raw: Column) -> Column:
    """One line of at most 45 bytes: base64 in another alphabet, its length first."""
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="
    return F.concat(F.char((F.octet_length(raw) + 32).cast("long")), F.translate(F.base64(raw), plain, "`" + "".join(map(chr, range(33, 96))) + "`"))


@query("""SELECT doc_id, md5(text) AS quoted_printable, source AS uu, 'é' || source AS western, 'ł' || source AS central FROM documents""")
def transfer_decoders(spark, sf_dir):
    """Round trips: quoted-printable with soft breaks, uuencode, 8-bit store strings of two code pages."""
    d = table(spark, sf_dir, "documents")
    soft = F.replace(F.replace(F.regexp_replace("text", "(.{60})", "$1\u0001"), F.lit("="), F.lit("=3D")), F.lit("\u0001"), F.lit("= \n"))
    uu = F.concat(F.lit("begin 644 f\n"), uuencoded(F.encode("source", "UTF-8")), F.lit("\n`\nend\n"))
    return d.select("doc_id", F.md5(mail.quoted_printable(F.encode(soft, "UTF-8"))).alias("quoted_printable"), mail.uudecoded(F.encode(uu, "UTF-8")).cast("string").alias("uu"), mail.codepage_text(F.encode(F.concat(F.lit("é"), "source", F.lit("\0\0")), "ISO-8859-1")).alias("western"),
                    mail.codepage_text(F.encode(F.concat(F.lit("³"), "source", F.lit("\0")), "ISO-8859-1"), 28592).alias("central"))


@query("""SELECT doc_id, md5(chr(10) || '[Attachment: f' || doc_id || '.txt]' || chr(10) || 'after' || chr(10) || 'begin 644 cut') AS text_md5, 'f' || doc_id || '.txt' AS filename, source AS payload FROM documents""")
def uu_attachments(spark, sf_dir):
    """Round trip: a complete uuencoded block in a plain body, and one without end."""
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.lit("Subject: x\n\n\nbegin 644 f"), "doc_id", F.lit(".txt\n"), uuencoded(F.encode("source", "UTF-8")), F.lit("\n`\nend\nafter\nbegin 644 cut"))
    out = mime.bodies_and_attachments(mime.message_parts(d.select(F.col("doc_id").alias("msg_key"), F.encode(body, "UTF-8").alias("raw"))))
    a = F.get("attachments", 0)
    return out.select(F.col("msg_key").alias("doc_id"), F.md5("body_text").alias("text_md5"), a["filename"].alias("filename"), a["payload"].cast("string").alias("payload"))


@query("""SELECT page_id, url AS plain, CASE page_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'rtf' ELSE 'html' END AS kind FROM pages""")
def body_choice(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    of = lambda k, value: F.when(F.col("page_id") % 3 == k, value)
    plain, kind = mime.body_of(of(0, F.col("url")), of(1, F.col("url")), of(2, F.concat(F.lit("<p>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</p>"))))
    return p.select("page_id", plain.alias("plain"), kind.alias("kind"))


@query("""SELECT doc_id AS msg_key, '1.2' AS parent_path, '1.2.1' AS part_path, 'Inner ' || doc_id AS subject, 3 AS level FROM documents""")
def enclosed_messages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("Content-Type: multipart/mixed; boundary=b\n\n--b\n\n"), F.regexp_replace("text", "(?m)^--", "- -"), F.lit("\n--b\nContent-Type: message/rfc822\n\nSubject: Inner "), "doc_id", F.lit("\n\nx\n--b--\n"))
    return mime.embedded_messages(mime.explode_parts(d.select(F.col("doc_id").alias("msg_key"), F.encode(raw, "UTF-8").alias("raw"))))


@query("""SELECT doc_id::VARCHAR AS msg_key, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS archive_no FROM documents""")
def united_archives(spark, sf_dir):
    """Two archives in order, one of them given with every message twice."""
    m = as_messages(spark, sf_dir).drop("archive_no")
    english, other = m.where("folder_id = 'en'"), m.where("folder_id <> 'en'")
    return dedupe.distinct_refs(dedupe.union_archives([english, other.unionByName(other)])).select("msg_key", "archive_no")


@query("""SELECT doc_id, md5(text || chr(10) || 'From here on at 10:30' || chr(10) || 'no field' || chr(10)) AS body_md5 FROM documents""")
def mbox_round_trip(spark, sf_dir):
    """Documents written as mbox files, with lines in their texts that look like separators, and read back."""
    d = table(spark, sf_dir, "documents")
    entry = F.concat(F.lit("From - Thu Nov 04 12:00:00 1999\nSubject: "), "doc_id", F.lit("\n\n"), X.latin1(F.encode("text", "UTF-8")), F.lit("\nFrom here on at 10:30\nno field\n"))
    place = f"{storage.shared_dir(spark)}/mail-{uuid.uuid4().hex}"
    sinks.write_mbox(d.select("lang", "doc_id", entry.alias("entry")), place, ("lang", "doc_id"))
    raw = mbox.with_headers(mbox.read_mbox(spark, place, "a"))
    text = X.latin1(F.col("raw"))
    return raw.select(X.header(F.col("headers"), "Subject").cast("long").alias("doc_id"), F.md5(X.bytes_of(F.substring(text, F.instr(text, "\n\n") + 2, F.length(text)))).alias("body_md5"))


@query(f"""WITH {MESSAGES}, s AS (SELECT m.*, toxic IS NOT NULL AS bad, {HAY} || from_email || ' ' || lower(body_text) || ' ' || attachment_names AS h FROM m LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) USING (doc_id)),
t AS (SELECT *, contains(h, 'license') AND contains(h, 'src') AS hit FROM s), c AS (SELECT *, row_number() OVER (PARTITION BY message_id, bad OR NOT hit ORDER BY folder_path, seq) AS rn FROM t)
SELECT count(*) AS scanned, count(*) FILTER (WHERE NOT bad AND hit AND rn = 1) AS written, count(*) FILTER (WHERE NOT bad AND hit AND rn > 1) AS duplicates, count(*) FILTER (WHERE bad) AS failures, count(*) FILTER (WHERE NOT bad AND NOT hit) AS misses FROM c""")
def export_with_bodies(spark, sf_dir):
    """The decisions of an export that searches bodies and attachment names; unreadable bodies are failures."""
    rows = with_errors(spark, sf_dir).withColumnRenamed("recipient_error", "body_error")
    return reports.export_report(export.decide(rows, match=search.in_list("license SRC") | search.with_bodies("license SRC"), search_bodies=True))


@query("""WITH r AS (SELECT l_orderkey AS nid, count(*) AS n_recipients, coalesce(string_agg('S' || l_suppkey, ', ' ORDER BY l_linenumber, l_suppkey), '') AS to_list FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) GROUP BY 1),
a AS (SELECT l_orderkey AS nid, count(*) AS n_attachments, string_agg('p' || l_partkey, ' ' ORDER BY l_partkey) AS attachment_names FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1)
SELECT o_orderkey AS nid, 'Order ' || o_orderkey AS subject, coalesce(to_list, '') AS to_list, coalesce(n_recipients, 0)::BIGINT AS n_recipients, coalesce(n_attachments, 0)::BIGINT AS n_attachments, coalesce(attachment_names, '') AS attachment_names, o_orderpriority AS body_text FROM orders LEFT JOIN r ON r.nid = o_orderkey LEFT JOIN a ON a.nid = o_orderkey""")
def store_messages(spark, sf_dir):
    """Orders as contents rows, joined with line items as recipients and attachments."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    none = lambda kind: F.lit(None).cast(kind)
    contents = o.select(F.lit("a").alias("archive_id"), F.lit(1).alias("folder_nid"), F.col("o_orderkey").alias("row_id"), F.concat(F.lit("\u0001x Order "), "o_orderkey").alias("subject"), none("string").alias("represented_name"), F.col("o_orderstatus").alias("sender_name"), F.lit("").alias("display_to"), F.lit("").alias("display_cc"),
                        F.col("o_orderdate").alias("delivery_time"), none("timestamp").alias("submit_time"), none("timestamp").alias("modified_time"), F.lit(1).alias("size"), F.lit(1).alias("flags"), F.lit("IPM.Note").alias("message_class"), F.lit(1).alias("importance"))
    people = li.select("l_orderkey", "l_linenumber", "l_suppkey").distinct().select(F.lit("a").alias("archive_id"), F.col("l_orderkey").alias("nid"), (F.col("l_linenumber") * F.lit(10_000_000).cast("long") + F.col("l_suppkey")).alias("pos"), F.lit(0x11).alias("kind"), F.concat(F.lit("S"), "l_suppkey").alias("name"), F.lit("/O=X").alias("email"))
    files = li.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct().select(F.lit("a").alias("archive_id"), F.col("l_orderkey").alias("nid"), F.col("l_partkey").cast("int").alias("att_no"), F.concat(F.lit("p"), "l_partkey").alias("filename"), F.lit(0).cast("long").alias("size"), F.lit(1).alias("method"), F.lit("x/y").alias("mime_type"),
                                                                                 F.lit("").alias("content_id"), F.lit(False).alias("is_hidden"), none("binary").alias("payload"))
    bodies = o.select(F.lit("a").alias("archive_id"), F.col("o_orderkey").alias("nid"), F.col("o_orderpriority").alias("body_text"), none("string").alias("body_html"), none("string").alias("body_error"))
    out = messages.store_messages(contents, people, files, bodies)
    return out.select("nid", "subject", "to_list", F.size("recipients").cast("long").alias("n_recipients"), F.size("attachments").cast("long").alias("n_attachments"), "attachment_names", "body_text")


@query("""SELECT p_brand AS msg_key, p_partkey::INT AS att_no, CASE rn WHEN 1 THEN 'photo (2).jpg' WHEN 2 THEN 'photo.jpg' ELSE 'photo (' || rn || ').jpg' END AS rel_path FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)""")
def attachment_names(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("msg_key"), F.col("p_partkey").cast("int").alias("att_no"), F.when(rn == 1, "photo (2).jpg").otherwise("photo.jpg").alias("filename"), F.lit(1).alias("method"), F.lit(None).cast("binary").alias("payload"))
    return sinks.attachment_rows(files).select("msg_key", "att_no", "rel_path")


@query("""WITH f AS (SELECT source, bool_or(lang = 'en') AS paired FROM documents GROUP BY 1) SELECT source AS archive_id, CASE WHEN lang <> 'en' AND paired THEN 'A_B (2)' ELSE 'A_B' END || '/Re_ x' || CASE WHEN rn = 1 THEN '' ELSE ' (' || rn || ')' END || '.eml' AS rel_path, text_md5
FROM (SELECT source, lang, md5(text) AS text_md5, row_number() OVER (PARTITION BY source, lang = 'en' ORDER BY doc_id) AS rn FROM documents) JOIN f USING (source)""")
def eml_names(spark, sf_dir):
    """Sibling folders of one safe name, messages of one subject."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("archive_id"), F.when(F.col("lang") == "en", "A:B").otherwise("A?B").alias("folder_path"), F.col("doc_id").alias("seq"), F.lit("Re: x").alias("subject"), F.encode("text", "UTF-8").alias("raw"))
    return sinks.eml_rows(d).select("archive_id", "rel_path", F.md5("content").alias("text_md5"))


@query("""SELECT page_id, '<img src="data:image/png;base64,' || to_base64(url::BLOB) || '"> cid:' || page_id || '0' AS body_html FROM pages""")
def inlined_references(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    a = F.struct(F.col("page_id").cast("string").alias("content_id"), F.lit("").alias("mime_type"), F.lit("a.PNG").alias("filename"), F.encode("url", "UTF-8").alias("payload"))
    rows = p.select("page_id", F.concat(F.lit('<img src="CID:'), "page_id", F.lit('"> cid:'), "page_id", F.lit("0")).alias("body_html"), F.array(a).alias("attachments"))
    return mime.inline_references(rows).select("page_id", "body_html")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'F' ELSE 'S' END || doc_id AS name, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS importance FROM documents""")
def full_message_fields(spark, sf_dir):
    """Sender of From, else of Sender; importance of X-Priority, else of Importance."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id") % 4
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("From: F"), "doc_id", F.lit(" <f@x>\n"))).otherwise(""), F.lit("Sender: S"), F.col("doc_id").cast("string"), F.lit(" <s@x>\n"),
                   F.when(i == 0, "X-Priority: 1\nImportance: low\n").when(i == 1, "Importance: High\n").when(i == 2, "X-Priority: 3\nImportance: low\n").otherwise(""), F.lit("\n"), "text")
    rows = mbox.with_headers(d.select("doc_id", F.encode(raw, "UTF-8").alias("raw")))
    return rows.select("doc_id", mime.full_sender(F.col("headers"))["name"].alias("name"), mbox.full_importance(F.col("headers")).alias("importance"))


@query("""SELECT doc_id, list_aggregate(list_filter(range(1, 201), lambda n: strlen(left(s, n::INT)) <= 200), 'max')::INT AS n_chars, strlen(s) <= 200 OR strlen(left(s, list_aggregate(list_filter(range(1, 201), lambda n: strlen(left(s, n::INT)) <= 200), 'max')::INT)) > 196 AS full_use
FROM (SELECT doc_id, repeat('é', 20) || replace(replace(regexp_replace(text, '[^A-Za-z0-9 ]', 'x', 'g'), '  ', ' '), ' ', 'ü') || repeat('日', 200) AS s FROM documents)""")
def long_names(spark, sf_dir):
    """Names over 200 bytes are cut between characters."""
    d = table(spark, sf_dir, "documents")
    other = "[\\x00-\\x1f!-/:-@\\[-`{-\\x{10ffff}]"  # all but ASCII letters, digits and blanks; written as [^A-Za-z0-9 ] Java takes ten times as long
    s = F.concat(F.repeat(F.lit("é"), F.lit(20)), F.replace(F.replace(F.regexp_replace("text", other, "x"), F.lit("  "), F.lit(" ")), F.lit(" "), F.lit("ü")), F.repeat(F.lit("日"), F.lit(200)))
    return d.select("doc_id", X.safe_name(s).alias("name")).select("doc_id", F.length("name").alias("n_chars"), (F.octet_length("name") > 196).alias("full_use"))


@query("""WITH f AS (SELECT DISTINCT source, source || '/' || lang AS location FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY location) AS n FROM f)
SELECT source AS archive_id, count(*) AS folders, (SELECT count(*) FROM documents d WHERE d.source = r.source) AS messages, string_agg(location, ', ' ORDER BY location) FILTER (WHERE n <= 3) AS first_folders FROM r GROUP BY source""")
def incomplete_folders(spark, sf_dir):
    m = as_messages(spark, sf_dir).select("archive_id", search.location().alias("location"), "msg_key")
    failures = m.select("archive_id", "location", F.lit(None).cast("string").alias("msg_key")).distinct().unionByName(m).withColumn("reason", F.lit("x"))
    return reports.incomplete_warning(failures).withColumn("first_folders", F.array_join("first_folders", ", "))


@query("""SELECT p_partkey AS nid, replace(p_name, ' ', '; ') AS shown, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '(no subject)' END AS subject FROM part""")
def shown_values(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    subject = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\u0001y "), "p_type", F.lit(" \r\n"))).otherwise("\u0001z \t")
    return p.select(F.col("p_partkey").alias("nid"), properties.joined_values(F.split("p_name", " ")).alias("shown"), X.shown_subject(subject).alias("subject"))


@query(f"""WITH {MESSAGES} SELECT archive_id, folder_path, trim(subject, ' ' || chr(9) || chr(13)) AS subject, n AS n_attachments FROM m JOIN (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(range(doc_id % 3 + 1)) FROM documents) GROUP BY 1) USING (doc_id)""")
def listing_for_comparison(spark, sf_dir):
    m = as_messages(spark, sf_dir)
    files = m.select("msg_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seq") % 3)))
    return reports.reference_listing(m, files)


@query("""SELECT event_id, ts AS date FROM events ORDER BY ts, event_id LIMIT 50""")
def oldest_messages(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("date")).orderBy(*reports.oldest_first("event_id")).limit(50)


def as_mbox(spark, sf_dir, ends: str = "\nFrom From here\nFrom here on at 10:30\nno field\n") -> str:
    """Documents written as mbox files with lines that look like separators; one file's name begins with an underscore."""
    d = table(spark, sf_dir, "documents")
    entry = F.concat(F.lit("From - Thu Nov 04 12:00:00 1999\nSubject: "), "doc_id", F.lit("\n\n"), X.latin1(F.encode("text", "UTF-8")), F.lit(ends))
    place = f"{storage.shared_dir(spark)}/mail-{uuid.uuid4().hex}"
    sinks.write_mbox(d.select("lang", "doc_id", entry.alias("entry")), place, ("lang", "doc_id"))
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    first = next(s.getPath() for s in files.listStatus(jvm.Path(place)) if s.getPath().getName().startswith("part-"))
    files.rename(first, jvm.Path(place, "_Old"))
    return place


@query("""SELECT doc_id, md5(text || chr(10) || 'From From here' || chr(10) || 'From here on at 10:30' || chr(10) || 'no field' || chr(10)) AS body_md5 FROM documents""")
def messages_by_extent(spark, sf_dir):
    """An index of places and lengths from one scan in small ranges; each message's bytes are then read by its place."""
    raw = mbox.read_mbox(spark, as_mbox(spark, sf_dir), "a", payload=False, range_bytes=1 << 18)
    index = storage.materialize(mbox.with_headers(raw).select("file_path", "offset", "size", X.header(F.col("headers"), "Subject").cast("long").alias("doc_id")))
    text = X.latin1(F.col("raw"))
    return mailfiles.with_bytes(index).select("doc_id", F.md5(X.bytes_of(F.substring(text, F.instr(text, "\n\n") + 2, F.length(text)))).alias("body_md5"))


@query(f"""WITH {MESSAGES}, s AS (SELECT *, contains(lower(text), 'license') AND contains(lower(text), 'the') AS hit FROM (SELECT doc_id, text FROM documents))
SELECT count(*) AS scanned, count(*) FILTER (WHERE hit) AS written, 0::BIGINT AS duplicates, 0::BIGINT AS failures, count(*) FILTER (WHERE NOT hit) AS misses, count(*) FILTER (WHERE hit) AS read_back, sum(CASE WHEN hit THEN doc_id END)::BIGINT AS read_back_ids FROM s""")
def export_round_trip(spark, sf_dir):
    """Documents as mbox files, searched in their bodies and exported; the report, and what a reader finds in the export."""
    source, out = as_mbox(spark, sf_dir, "\n"), f"{storage.shared_dir(spark)}/found-{uuid.uuid4().hex}"
    report = export.export(spark, [source], out, "license the", search_bodies=True)
    again = mbox.with_headers(mbox.read_mbox(spark, out)).agg(F.count(F.lit(1)).alias("read_back"), F.sum(X.header(F.col("headers"), "Subject").cast("long")).alias("read_back_ids"))
    return report.crossJoin(F.broadcast(again))  # one row each


@query("""SELECT lang AS file_path, count(*)::BIGINT AS expunged FROM documents WHERE doc_id % 10 = 0 GROUP BY lang""")
def expunged_messages(spark, sf_dir):
    return mbox.expunged_counts(mail_text(spark, sf_dir)).select("file_path", "expunged")


#: A store whose folder names hold slashes: below each region r its nations n, and beside each nation folders "n/supplier".
STORE_FOLDERS = """f AS (SELECT 'r' || r_regionkey AS id, 'root' AS up, r_name AS name, 0::BIGINT AS own FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) FROM nation
UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, n_name || '/' || s_name, s_suppkey % 7 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def store_folders(spark, sf_dir) -> DataFrame:
    n, r, s, c = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "customer"))
    own = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("own"))
    rows = spark.createDataFrame([("root", None, "root", 0)], "folder_id string, parent_id string, name string, own long")
    rows = rows.union(r.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("root"), "r_name", F.lit(0)))
    rows = rows.union(n.join(own, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name", F.coalesce("own", F.lit(0))))
    rows = rows.union(s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("r"), "n_regionkey"), F.concat_ws("/", "n_name", "s_name"), F.col("s_suppkey") % 7))
    tree = folders.tree_from_parents(rows.withColumn("archive_id", F.lit("w")), F.col("folder_id") == "root")
    return tree.join(rows.select("folder_id", F.col("own").alias("content_count")), "folder_id")


@query(f"""WITH {STORE_FOLDERS}, t AS (SELECT id AS folder_id, own AS total FROM f WHERE id[1] <> 'r' UNION ALL SELECT up, sum(own) FROM f WHERE id[1] <> 'r' GROUP BY up UNION ALL SELECT 'root', sum(own) FROM f) SELECT folder_id, sum(total)::BIGINT AS total FROM t GROUP BY 1""")
def totals_by_folder(spark, sf_dir):
    """Subtree totals of a store's folders by their ids: names with slashes don't stand in for folders below others."""
    totals = folders.subtree_totals(store_folders(spark, sf_dir), path="visited")
    return totals.select(F.element_at("visited", -1).alias("folder_id"), F.col("total_content_count").alias("total"))


@query("""WITH k AS (SELECT 'r' || r_regionkey AS id, r_regionkey AS rk, -1 AS nk, -1 AS sk FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey, n_nationkey, -1 FROM nation UNION ALL SELECT 's' || s_suppkey, n_regionkey, n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'root' AS folder_id, 0::BIGINT AS folder_order, 1 AS n_steps UNION ALL SELECT id, row_number() OVER (ORDER BY (SELECT r_name FROM region WHERE r_regionkey = rk), nk, sk), CASE WHEN id[1] = 'r' THEN 2 ELSE 3 END FROM k""")
def preorder_by_folder(spark, sf_dir):
    """Pre-order of folders whose names hold slashes: a step is a name, whatever is in it."""
    rows = folders.with_preorder(store_folders(spark, sf_dir), "names", "visited")
    return rows.select("folder_id", F.col("folder_order").cast("long").alias("folder_order"), F.size("names").alias("n_steps"))


@query("""WITH l AS (SELECT r_name AS a, n_name AS n, s_name AS s, s_suppkey % 4 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT a, n AS id, n AS name, 1 AS depth FROM l WHERE k = 0 UNION SELECT a, n || '.mbox', n, 1 FROM l WHERE k = 1 UNION SELECT a, n, n, 1 FROM l WHERE k = 2 UNION SELECT a, n || '.mbox/', n, 1 FROM l WHERE k = 3
UNION SELECT a, n || '/' || s, s, 2 FROM l WHERE k = 2 UNION SELECT a, n || '.mbox/', n, 1 FROM l WHERE k = 3)
SELECT a AS archive_id, id AS folder_id, name, depth, CASE WHEN depth = 2 THEN split_part(id, '/', 1) END AS parent_id FROM f""")
def mail_file_folders(spark, sf_dir):
    """Folders of paths: a file X, the folders of X.sbd below it, X.mbox beside it and X.mbox/mbox."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    rows = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    k, name = F.col("s_suppkey") % 4, F.col("n_name")
    rel = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit(".mbox"))).when(k == 2, F.concat(name, F.lit(".sbd/"), "s_name")).otherwise(F.concat(name, F.lit(".mbox/mbox")))
    files = rows.select(F.col("r_name").alias("archive_id"), rel.alias("rel_path"), rel.alias("file_path"))
    return export.mail_folders(files).select("archive_id", "folder_id", "name", "depth", "parent_id")


def store_table(rows: DataFrame, name: str) -> DataFrame:
    """The columns of a store table; those that ``rows`` lacks are null."""
    wanted = T.StructType.fromDDL(schemas.TABLES[f"store_{name}"])
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))


@query("""WITH s AS (SELECT o_orderkey AS nid, o_custkey, o_orderstatus AS st, o_orderkey % 50 = 0 AS bad, contains(lower(o_orderpriority), 'urgent') OR contains('p' || o_custkey || '@x.org', 'urgent') AS hit FROM orders WHERE o_orderstatus <> 'F'),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY st, nid) AS rn FROM s WHERE hit AND NOT bad))
SELECT (SELECT count(*) FROM s) AS scanned, count(*) FILTER (WHERE rn = 1) AS written, count(*) FILTER (WHERE rn > 1) AS duplicates, (SELECT count(*) FROM s WHERE bad) AS failures, (SELECT count(*) FROM s WHERE NOT bad AND NOT hit) AS misses,
count(*) FILTER (WHERE rn = 1) AS read_back, coalesce(sum(nid) FILTER (WHERE rn = 1), 0)::BIGINT AS read_back_ids FROM w""")
def export_from_store(spark, sf_dir):
    """Orders as a store's messages, with line items as recipients, searched in their bodies, once per Message-ID and built; the report and what a reader finds."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tree = spark.createDataFrame([("w", 1, None, "root"), ("w", 2, 1, "Done/F"), ("w", 3, 1, "Open/O"), ("w", 4, 1, "Open/P")], schemas.TABLES["store_folders"])
    folder = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 3).otherwise(4)
    key = lambda rows, nid: rows.withColumns({"archive_id": F.lit("w"), "nid": F.col(nid)})
    contents = key(o, "o_orderkey").withColumns({"folder_nid": folder, "subject": F.col("o_orderkey").cast("string"), "sender_name": F.lit("P"), "sender_email": F.concat(F.lit("p"), "o_custkey", F.lit("@x.org")), "submit_time": F.col("o_orderdate"), "message_class": F.lit("IPM.Note"), "message_id": F.concat(F.lit("<"), "o_custkey", F.lit(">"))})
    # Dealt out by message once: what follows, distinct rows and lists, keeps to that.
    people = key(li.select("l_orderkey", "l_suppkey").repartition("l_orderkey"), "l_orderkey").select("archive_id", "nid", "l_suppkey").distinct().withColumns({"pos": F.col("l_suppkey"), "kind": F.lit(1), "name": F.concat(F.lit("S"), "l_suppkey"), "email": F.concat(F.lit("s"), "l_suppkey", F.lit("@x.org"))})
    bodies = key(o, "o_orderkey").withColumns({"body_text": F.col("o_orderpriority"), "body_error": F.when(F.col("o_orderkey") % 50 == 0, "body cannot be read")})
    store = stores.Store(tree, store_table(contents, "contents"), store_table(people, "recipients"), store_table(people.limit(0), "attachments"), store_table(bodies, "bodies"))
    out = f"{storage.shared_dir(spark)}/found-{uuid.uuid4().hex}"
    report = export.export(spark, [store], out, "urgent", "open/", search_bodies=True)
    again = mbox.with_headers(mbox.read_mbox(spark, out)).agg(F.count(F.lit(1)).alias("read_back"), F.coalesce(F.sum(X.header(F.col("headers"), "Subject").cast("long")), F.lit(0)).alias("read_back_ids"))
    return report.crossJoin(F.broadcast(again))  # one row each


@query("""SELECT doc_id, 3::BIGINT AS n_messages, 'doc ' || doc_id AS subject, source AS outer_text, lang AS middle_text, md5(text) AS inner_md5 FROM documents""")
def nested_messages(spark, sf_dir):
    """Documents in messages within messages within messages of a store: built from the innermost out, and parsed again."""
    d = table(spark, sf_dir, "documents").withColumn("archive_id", F.lit("w"))
    level = lambda k: d.withColumns({"nid": F.col("doc_id") * 3 + k, "subject": F.concat(F.lit("doc "), "doc_id") if k == 0 else F.lit(f"level {k}"), "body_text": F.col(("source", "lang", "text")[k]), "folder_nid": F.lit(2 if k == 0 else None), "embedded_nid": F.col("doc_id") * 3 + k + 1, "message_class": F.lit("IPM.Note")})
    every = level(0).unionByName(level(1)).unionByName(level(2))
    files = level(0).unionByName(level(1)).withColumns({"att_no": F.lit(0), "filename": F.lit("inside"), "method": F.lit(5), "size": F.lit(0), "is_hidden": F.lit(False)})
    tree = spark.createDataFrame([("w", 1, None, "root"), ("w", 2, 1, "Mail")], schemas.TABLES["store_folders"])
    store = stores.Store(tree, store_table(every, "contents"), store_table(every.limit(0), "recipients"), store_table(files, "attachments"), store_table(every, "bodies"))
    built = stores.as_eml(store, level(0).select("archive_id", "nid")).select((F.col("nid") / 3).cast("long").alias("doc_id"), F.col("eml").alias("raw"))
    heads = mbox.with_headers(built).select(F.struct("doc_id", X.header(F.col("headers"), "Subject").alias("subject")).alias("head"), "raw")
    parts = mime.message_parts(heads, "head").withColumn("texts", F.transform(F.filter("parts", lambda p: p["leaf"] & (p["content_type"] == "text/plain")), lambda p: p["text"]))
    return parts.select("head.doc_id", F.size("texts").cast("long").alias("n_messages"), "head.subject", F.get("texts", 0).alias("outer_text"), F.get("texts", 1).alias("middle_text"), F.md5(F.get("texts", 2)).alias("inner_md5"))


@query("""SELECT p_brand AS directory, p_partkey, CASE WHEN rn = 1 THEN 'x' WHEN rn = 2 THEN 'X (2)' WHEN rn = 3 THEN 'x (2) (2)' WHEN rn = 4 THEN 'x (2) (3)' ELSE 'x (' || (rn - 2) || ')' END || '.eml' AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)""")
def unique_names_in_turn(spark, sf_dir):
    """Names with numbers of their own that come after a name got by number."""
    rn = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    p = table(spark, sf_dir, "part").withColumn("rn", rn).select(F.col("p_brand").alias("directory"), "p_partkey", F.when(F.col("rn") == 2, "X").when(F.col("rn").isin(3, 4), "x (2)").otherwise("x").alias("name"))
    return sinks.unique_names(p, "directory", "name", "p_partkey", ".eml").select("directory", "p_partkey", "file_name")


@query("""SELECT rel_path, content_md5 FROM (SELECT source || '/' || lang || '/Note' || CASE WHEN rn = 1 THEN '' ELSE ' (' || rn || ')' END || '.eml' AS rel_path, md5(text) AS content_md5, strlen(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents)) WHERE n > 0""")
def files_round_trip(spark, sf_dir):
    """Messages written as .eml files of their folders and read back from the folder tree; empty files aren't read."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("archive_id"), F.col("lang").alias("folder_path"), F.col("doc_id").alias("seq"), F.lit("Note").alias("subject"), F.encode("text", "UTF-8").alias("raw"))
    place = f"{storage.shared_dir(spark)}/files-{uuid.uuid4().hex}"
    sinks.write_files(sinks.eml_rows(d).select(F.concat_ws("/", "archive_id", "rel_path").alias("rel_path"), "content"), place)
    files = mailfiles.files_below(spark, place).where("size > 0")
    return mailfiles.whole_files(files).select("rel_path", F.md5("raw").alias("content_md5"))


@query("""SELECT event_id, TIMESTAMP '1899-12-30' + to_microseconds((event_id * 1000003 % 5000000000000000)::BIGINT) AS ts FROM events""")
def ole_dates(spark, sf_dir):
    """Days with fractions since the end of 1899, to the microsecond that a double holds."""
    micros = F.col("event_id") * 1_000_003 % 5_000_000_000_000_000
    found = X.ole_date_to_ts(micros / F.lit(86_400_000_000.0))
    # A double of this size is exact to less than a hundredth of a millisecond.
    near = F.abs(F.unix_micros(found) - (micros - 2_209_161_600_000_000)) <= 10
    return table(spark, sf_dir, "events").select("event_id", F.when(near, F.timestamp_micros(micros - 2_209_161_600_000_000)).alias("ts"))


@query("""SELECT event_id, date_trunc('second', CASE WHEN ts >= TIMESTAMP '2024-10-27 01:00:00' AND ts < TIMESTAMP '2024-10-27 02:00:00' THEN ts - INTERVAL 1 HOUR ELSE ts END) AS date FROM events""")
def local_dates(spark, sf_dir):
    """Dates without a zone in local time of a place with summer time; of an hour that comes twice the first is meant."""
    text = F.date_format(F.from_utc_timestamp("ts", "Europe/Amsterdam"), "d MMM yyyy HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", mail.mail_date(text, zone="Europe/Amsterdam").alias("date"))


@query("""SELECT doc_id, md5(text || chr(13)) AS body_md5 FROM (SELECT doc_id, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM documents)""")
def old_line_ends(spark, sf_dir):
    """Mail files with carriage returns only, one for each document."""
    d = table(spark, sf_dir, "documents")
    text = F.regexp_replace("text", "[\\n\\r]", " ")
    entry = F.concat(F.lit("From - Thu Nov 04 12:00:00 1999\rSubject: "), "doc_id", F.lit("\r\r"), text, F.lit("\r\r"))
    files = d.select(F.concat(F.lit("f"), "doc_id").alias("rel_path"), F.encode(entry, "UTF-8").alias("content"))
    place = f"{storage.shared_dir(spark)}/old-{uuid.uuid4().hex}"
    sinks.write_files(files, place)
    raw = X.normalize_eol(X.latin1(F.col("raw")))
    return mbox.read_mbox(spark, place, "a").select(F.substring_index(F.substring_index(raw, "\n", 1), " ", -1).cast("long").alias("doc_id"), F.md5(X.bytes_of(F.concat(F.substring(F.regexp_replace(raw, "\n\\z", ""), F.instr(raw, "\n\n") + 2, F.length(raw)), F.lit("\r")))).alias("body_md5"))
