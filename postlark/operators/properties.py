"""Decoded store tables: nodes, contents rows, properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlark import schemas
from postlark.functions import text as X

NODE_TYPE_FOLDER, NODE_TYPE_MESSAGE = 0x02, 0x04
#: Wire types.
TYPE_NAMES = {2: "Int16", 3: "Int32", 4: "Float32", 5: "Float64", 6: "Currency", 7: "AppTime", 10: "Error", 11: "Boolean", 13: "Object", 20: "Int64", 30: "String8", 31: "Unicode", 64: "SysTime", 72: "Guid", 258: "Binary"}
#: Named property sets.
SET_NAMES = {"{00062008-0000-0000-C000-000000000046}": "PSETID_Common", "{00062004-0000-0000-C000-000000000046}": "PSETID_Address", "{00062002-0000-0000-C000-000000000046}": "PSETID_Appointment", "{00062003-0000-0000-C000-000000000046}": "PSETID_Task", "{00020328-0000-0000-C000-000000000046}": "PS_MAPI", "{00020329-0000-0000-C000-000000000046}": "PS_PUBLIC_STRINGS"}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A decoded store table with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(path)


def node_type(nid: Column) -> Column:
    return nid.bitwiseAND(0x1F)


def existing(rows: DataFrame, nodes: DataFrame, nid: str = "row_id") -> DataFrame:
    """Contents or hierarchy rows whose node exists."""
    return rows.join(nodes.select("archive_id", F.col("nid").alias(nid)), ["archive_id", nid], "left_semi")


def orphans(nodes: DataFrame, rows: DataFrame, kind: int, folder: str = "folder_nid", nid: str = "row_id") -> DataFrame:
    """Nodes of a type below a folder that its table doesn't list."""
    mine = nodes.where(node_type(F.col("nid")) == kind).select("archive_id", F.col("nid_parent").alias(folder), F.col("nid").alias(nid))
    return mine.join(rows.select("archive_id", folder, nid), ["archive_id", folder, nid], "left_anti")


def with_orphans(rows: DataFrame, nodes: DataFrame, kind: int, folder: str = "folder_nid", nid: str = "row_id") -> DataFrame:
    """Existing rows once each, then orphans; ``source_rank`` orders them (orphans by nid)."""
    listed = existing(rows, nodes, nid).dropDuplicates(["archive_id", folder, nid]).withColumn("source_rank", F.lit(0))
    return listed.unionByName(orphans(nodes, rows, kind, folder, nid).withColumn("source_rank", F.lit(1)), allowMissingColumns=True)


def fill_sparse(contents: DataFrame, own: DataFrame, columns: list[str], nid: str = "row_id") -> DataFrame:
    """Rows without subject and sender take all list columns from the message's own properties (``own``, same column names)."""
    sparse = (F.coalesce("subject", F.lit("")) == "") & (F.coalesce("sender_name", F.lit("")) == "")
    joined = contents.join(own.select("archive_id", nid, *(F.col(c).alias(f"own_{c}") for c in columns), F.lit(True).alias("found")), ["archive_id", nid], "left")
    use = sparse & F.col("found").isNotNull()
    rest = [c for c in contents.columns if c not in columns]
    return joined.select(*rest, *(F.when(use, F.col(f"own_{c}")).otherwise(F.col(c)).alias(c) for c in columns))


def message_date(delivery: Column, submit: Column, modified: Column) -> Column:
    return F.coalesce(delivery, submit, modified)


def sender_name(represented: Column, sender: Column) -> Column:
    return F.coalesce(F.nullif(represented, F.lit("")), sender, F.lit(""))


def sender_email(*candidates: Column, transport_from: Column | None = None) -> Column:
    """First candidate with an '@', else From of the transport headers, else empty."""
    found = F.get(F.filter(F.array(*candidates), lambda e: e.contains("@")), 0)
    return F.coalesce(found, *([transport_from] if transport_from is not None else []), F.lit(""))


def display(name: Column, email: Column) -> Column:
    """'Name <email>'; one of them if the other is empty, the same or complete already."""
    return F.when((email == "") | (email == name), name).when(name == "", email).when(email.contains("<"), email).otherwise(F.concat(name, F.lit(" <"), email, F.lit(">")))


def transport_header(headers_text: Column, name: str) -> Column:
    return X.header(X.parse_headers(X.normalize_eol(headers_text)), name)


def recipient_strings(recipients: DataFrame, key: str = "msg_key") -> DataFrame:
    """To, Cc and Bcc strings of each message, by position; addresses without '@' don't show."""
    email = F.when(F.col("email").contains("@"), F.col("email")).otherwise("")
    rows = recipients.withColumns({"shown": display(F.coalesce("name", F.lit("")), F.coalesce(email, F.lit(""))), "k": F.col("kind").bitwiseAND(0x0F)})
    of = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("pos", "shown")))), lambda r: r["shown"]), ", ")
    return rows.groupBy(key).agg(of(1).alias("to_list"), of(2).alias("cc_list"), of(3).alias("bcc_list"))


def named_values(properties: DataFrame, name_map: DataFrame) -> DataFrame:
    """Properties with the set and id or name that the archive's map gives them."""
    return properties.join(F.broadcast(name_map) if name_map.count() <= 200_000 else name_map, ["archive_id", "prop_id"])


def entry_nid(entry_id: Column) -> Column:
    """The node number in bytes 20 to 23 of an entry id, little-endian."""
    digits = F.concat(*(F.substring(F.hex(entry_id), 2 * p + 1, 2) for p in (23, 22, 21, 20)))
    return F.when(F.octet_length(entry_id) >= 24, F.conv(digits, 16, 10).cast("long"))


def special_folders(folders: DataFrame, entries: DataFrame) -> DataFrame:
    """Folders with the kind that the store's entry ids declare (archive_id, kind, entry_id), null for others."""
    declared = entries.select("archive_id", F.col("kind").alias("special_kind"), entry_nid(F.col("entry_id")).alias("nid"))
    return folders.join(declared.groupBy("archive_id", "nid").agg(F.min("special_kind").alias("special_kind")), ["archive_id", "nid"], "left")


def to_columns(properties: DataFrame, wanted: dict[int, str], value: str, order: str = "pos") -> DataFrame:
    """Property rows to one row for each node; of an id that repeats the last counts."""
    rows = properties.where(F.col("prop_id").isin(list(wanted)))
    last = lambda i: F.max_by(F.when(F.col("prop_id") == i, F.col(value)), F.when(F.col("prop_id") == i, F.col(order)))
    return rows.groupBy("archive_id", "nid").agg(*(last(i).alias(n) for i, n in wanted.items()))


def joined_values(values: Column) -> Column:
    return F.array_join(values, "; ")


def type_name(prop_type: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair))
    single = F.coalesce(F.element_at(names, prop_type.bitwiseAND(0xFFF)), F.concat(F.lit("0x"), F.lpad(F.hex(prop_type.bitwiseAND(0xFFF)), 4, "0")))
    return F.when(prop_type.bitwiseAND(0x1000) != 0, F.concat(single, F.lit("[]"))).otherwise(single)


def set_name(guid: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in SET_NAMES.items() for x in pair))
    return F.coalesce(F.element_at(names, guid), guid)


def rendered(prop_type: Column) -> Column:
    """A property's value as text, from the typed columns."""
    return F.coalesce(F.col("v_str"), joined_values(F.col("v_arr")), F.when(prop_type == 11, F.when(F.col("v_long") != 0, "true").otherwise("false")), X.format_iso(F.col("v_ts")),
                      F.col("v_long").cast("string"), F.col("v_double").cast("string"), F.hex("v_bin"))


def listing(properties: DataFrame, names: DataFrame) -> DataFrame:
    """Tag, name, type and shown value of each property; ``names`` has prop_id and name."""
    rows = properties.join(F.broadcast(names) if names.count() <= 200_000 else names, "prop_id", "left")
    return rows.select("archive_id", "nid", "prop_id", X.property_tag(F.col("prop_id"), F.col("prop_type")).alias("tag"), F.coalesce("name", F.concat(F.lit("0x"), F.lpad(F.hex("prop_id"), 4, "0"))).alias("name"),
                       type_name(F.col("prop_type")).alias("type_name"), rendered(F.col("prop_type")).alias("shown"))


#: Labels of an item's own fields and the columns they come from, the preferred one first.
DETAILS = {
    "contact": {"Name": ["display_name"], "First name": ["given_name"], "Last name": ["surname"], "Company": ["company_name"], "Job title": ["title"], "Department": ["department"], "Email": ["email_1"], "Email 2": ["email_2"], "Email 3": ["email_3"],
                "Work phone": ["business_phone"], "Home phone": ["home_phone"], "Mobile": ["mobile_phone"], "Work fax": ["business_fax"], "Work address": ["business_street"], "Work city": ["business_city"], "Home address": ["home_street"],
                "Home city": ["home_city"], "Website": ["business_home_page"], "Birthday": ["birthday"]},
    "appointment": {"Start": ["named_start", "start_date"], "End": ["named_end", "end_date"], "Location": ["location"], "Organizer": ["represented_name"]},
    "task": {"Start date": ["task_start"], "Due date": ["task_due"], "Complete": ["percent_complete"]},
    "distributionList": {"Name": ["list_name"]},
}
DETAILS["meetingRequest"] = DETAILS["appointment"]


def details(items: DataFrame, kind: str = "kind") -> DataFrame:
    """Label and value rows of each item's own fields, in order; blank values are left out.  Missing columns count as null."""
    value = lambda c: F.col(c).cast("string") if c in items.columns else F.lit(None).cast("string")
    rows = F.lit(None)
    for item, fields in DETAILS.items():
        pairs = F.array(*(F.struct(F.lit(i).alias("no"), F.lit(label).alias("label"), X.strip(F.coalesce(*map(value, sources)), X.BLANK_OR_LINE_END).alias("value")) for i, (label, sources) in enumerate(fields.items())))
        rows = F.when(F.col(kind) == item, pairs).otherwise(rows)
    return items.select("archive_id", "nid", F.explode(rows).alias("d")).select("archive_id", "nid", "d.*").where("value <> ''")
