"""Export, duplicates, names and MIME structure on the documented cases."""

import base64
import datetime
import glob
import pickle
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlark import schemas
from postlark.functions import text as X
from postlark.jobs import catalog, export, messages, stores
from postlark.operators import dedupe, folders, mime, sinks
from postlark.sources import mailfiles, mbox
from tests.core.test_mbox import tree  # noqa: F401


def test_export_and_read_back(spark, tree, tmp_path):  # noqa: F811
    report = export.export(spark, [tree], str(tmp_path / "out"))
    assert report.first().asDict() == {"scanned": 6, "written": 6, "duplicates": 0, "failures": 0, "misses": 0}
    text = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/out/part-*"))).decode("latin-1")
    assert text.startswith("From jan@example.nl Thu Nov 04 09:14:51 1999\nX-Folder: netscape/Inbox\n") and "X-Folder: netscape/Projecten/Klant A\n" in text
    assert "\n>From here on things change" in text and ">>From the start" not in text
    again = mbox.message_summaries(mbox.read_mbox(spark, str(tmp_path / "out")))
    assert again.count() == 6
    assert export.export(spark, [tree], str(tmp_path / "one"), "piet", "sent").first().written == 1
    twice = export.decide(export.read_archives(spark, [tree, tree])).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in twice} == {"written": 10, "duplicate": 2}  # two messages have an id
    with pytest.raises(ValueError):
        export.export(spark, [tree], tree + "/Sent.sbd/out")


def test_files_are_scanned_once_and_bodies_parsed_once(spark, tree, tmp_path, monkeypatch):  # noqa: F811
    plans, kept = [], export.materialize
    monkeypatch.setattr(export, "materialize", lambda df: plans.append(plan_of(df)) or kept(df))
    assert export.export(spark, [tree, tree], str(tmp_path / "out"), "the", search_bodies=True).first().scanned == 12
    assert sum(p.count("BatchScan mbox") for p in plans) == 2  # one an archive
    # The only step of the search that has bytes in Python reads and parses them, one message at a time.
    assert sum(p.count("MapInArrow") for p in plans) == 1
    raw = export.read_archives(spark, [tree]).withColumn("seq", F.col("seq").cast("int"))
    by_place, with_raw = messages.with_bodies(raw), messages.with_bodies(mailfiles.with_bytes(raw))
    assert by_place.orderBy("msg_key").collect() == with_raw.select(*by_place.columns).orderBy("msg_key").collect()


def test_append(spark, tree, tmp_path):  # noqa: F811
    out = str(tmp_path / "out")
    assert export.export(spark, [tree], out, folder="inbox").first().written == 3
    assert export.export(spark, [tree], out, "piet", "sent", append=True).first().written == 1
    assert mbox.read_mbox(spark, out).count() == 4


def test_folder_list(spark, tree):  # noqa: F811
    rows = export.folder_list(export.read_archives(spark, [tree])).orderBy("folder_order").collect()
    assert [(r.path, r.content_count, r.unread_count, r.total_content_count) for r in rows] == [("Inbox", 3, 1, 3), ("Sent", 2, 0, 2), ("Projecten", 0, 0, 1), ("Projecten/Klant A", 1, 0, 1)]


def test_unreadable_copies_do_not_hide_readable_ones(spark):
    rows = spark.createDataFrame([(0, "a", "f", "f", 1, "<1>", "broken"), (0, "a", "f", "f", 2, " <1> ", None), (1, "b", "f", "f", 1, "<1>", None), (1, "b", "f", "f", 2, "", None), (1, "b", "f", "f", 3, None, None)],
                                 "archive_no int, archive_id string, folder_path string, folder_order string, seq long, message_id string, body_error string")
    got = {(r.archive_no, r.seq): r.status for r in export.decide(rows, match=F.lit(True)).collect()}
    assert got == {(0, 1): "failure", (0, 2): "written", (1, 1): "duplicate", (1, 2): "written", (1, 3): "written"}
    assert dedupe.distinct_refs(rows.withColumn("msg_key", F.lit("k"))).count() == 2


def in_turn(names):
    """One after the other, with a set of what is taken."""
    used, out = set(), []
    for base in names:
        name, n = base, 2
        while name.lower() in used:
            name, n = f"{base} ({n})", n + 1
        used.add(name.lower())
        out.append(name)
    return out


def test_unique_names(spark):
    rng = random.Random(2)
    fixed = [["Re:", "re:", "Re: (2)", "RE:", "x", "x (2)", "x (3)", "x", "x"], ["x", "x", "x (2)", "x (2) (2)", "X (2)"], ["y"] * 40, ["z (02)", "z", "z", "z (1)", "z (1)", " (2)", ""]]
    mixed = [[rng.choice(["a", "A", "a (2)", "a (3)", "A (2) (2)", "a (2) (3)", "b", "a (10)", "a (12)"]) for _ in range(30)] for _ in range(40)]
    lists = [*fixed, *mixed]
    rows = spark.createDataFrame([(d, n, i) for d, names in enumerate(lists) for i, n in enumerate(names)], "dir int, name string, i int").repartition(5)
    got = {(r.dir, r.i): r.file_name for r in sinks.unique_names(rows, "dir", "name", "i", ".eml").collect()}
    assert got == {(d, i): n + ".eml" for d, names in enumerate(lists) for i, n in enumerate(in_turn(names))}


def test_files_are_all_there_or_none(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("dir é "), F.col("id") % 7, F.lit("/sub/f#"), "id", F.lit(".eml")).alias("rel_path"), F.when(F.col("id") % 10 > 0, F.encode(F.repeat(F.lit("é\n"), F.col("id").cast("int")), "UTF-8")).alias("content"), "id").repartition(6)
    sinks.write_files(rows, str(tmp_path / "out"))
    want = {r.rel_path: bytes(r.content or b"") for r in rows.collect()}
    assert {str(f.relative_to(tmp_path / "out")): f.read_bytes() for f in (tmp_path / "out").rglob("*") if f.is_file()} == want
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "out"))  # leaves out empty files
    assert read.count() == 180 and read.agg(F.sum("length")).first()[0] == sum(map(len, want.values()))
    with pytest.raises(ValueError):
        sinks.write_files(rows, str(tmp_path / "out"))
    broken = rows.withColumn("rel_path", F.when(F.col("id") == 150, "../outside").otherwise(F.col("rel_path")))
    with pytest.raises(Exception, match="not a path below"):
        sinks.write_files(broken, str(tmp_path / "none"))
    assert not [f for f in (tmp_path / "none").rglob("*") if f.is_file()] and not (tmp_path / "outside").exists()


MESSAGE = b"""Content-Type: multipart/mixed; boundary=m\r
\r
--m\r
Content-Type: multipart/alternative; boundary=a\r
\r
--a\r
\r
plain =E9\r
--a\r
Content-Type: text/html; charset=iso-8859-1\r
Content-Transfer-Encoding: quoted-printable\r
\r
<b>h=E9</b>\r
--a--\r
--m\r
Content-Type: message/rfc822\r
\r
Subject: Original report\r
\r
inner text\r
--m\r
Content-Type: image/gif\r
Content-ID: <pic@x>\r
Content-Transfer-Encoding: base64\r
\r
R0lGODlh\r
"""


def test_mime_structure(spark):
    raw = spark.createDataFrame([("k", bytearray(MESSAGE)), ("e", bytearray(b""))], "msg_key string, raw binary")
    whole, parts = mime.message_parts(raw), mime.explode_parts(raw)
    assert {r.part_path for r in parts.where("msg_key = 'k'").collect()} == {"1", "1.1", "1.1.1", "1.1.2", "1.2", "1.2.1", "1.3"}
    r = mime.bodies_and_attachments(whole).where("msg_key = 'k'").first()
    assert (r.body_text, r.body_html) == ("plain =E9", "<b>hé</b>")
    assert [(a.filename, a.method, a.is_hidden, bytes(a.payload)) for a in r.attachments][1] == ("attachment-2.gif", 1, False, b"GIF89a")
    assert r.attachments[0].filename == "Original report" and r.attachments[0].method == 5
    inner = mime.embedded_messages(parts).collect()
    assert [(e.parent_path, e.part_path, e.subject) for e in inner] == [("1.2", "1.2.1", "Original report")]
    text, files = mime.uu_blocks("a\nbegin 644 f.txt\n#0V%T\n`\nend\nb\nbegin 644 cut\n#0V%T")
    assert text == "a\n[Attachment: f.txt]\nb\nbegin 644 cut\n#0V%T" and files == [("f.txt", b"Cat")]


@pytest.mark.parametrize("name, kind", [("Posteingang", "inbox"), (" Sent Items ", "sent"), ("x", "mail")])
def test_folder_kind(spark, name, kind):
    assert spark.range(1).select(folders.folder_kind(F.lit(""), F.lit(None).cast("string"), F.lit(name)).alias("k")).first().k == kind


def test_two_files_of_one_path_and_search_in_bodies(spark, tmp_path):
    """A and A.mbox share a folder path: each message is written once; searches reach addresses, bodies and attachment names."""
    root = tmp_path / "pair"
    root.mkdir()
    mail = lambda i, body: f"From - Thu Nov 04 10:15:0{i} 1999\nFrom: s{i}@x.org\nBcc: Hidden <bcc{i}@x.org>\nSubject: m{i}\n\n{body}\n\n"
    (root / "A").write_text(mail(1, "alpha") + mail(2, "beta\n\nFrom here no message at 10:30\nhidden word"))
    (root / "A.mbox").write_text(mail(3, "gamma") + mail(4, "delta"))
    (root / "empty").write_text("")
    assert export.export(spark, [str(root)], str(tmp_path / "all")).first().written == 4
    rows = mbox.message_summaries(mbox.read_mbox(spark, str(tmp_path / "all")))
    assert sorted(r.subject for r in rows.collect()) == ["m1", "m2", "m3", "m4"]
    assert export.export(spark, [str(root)], str(tmp_path / "bcc"), "bcc3").first().written == 1
    assert export.export(spark, [str(root)], str(tmp_path / "none"), "hidden word m2").first().written == 0
    report = export.export(spark, [str(root)], str(tmp_path / "body"), "WORD m2 from", search_bodies=True, failures_path=str(tmp_path / "failures"))
    assert report.first().written == 1 and spark.read.parquet(str(tmp_path / "failures")).count() == 0
    facts = export.archive_facts(spark, [str(root)]).first()
    assert (facts["mail_files"], facts["items"], facts["folders"]) == (3, 4, 3)  # A and A.mbox are two folders of one name
    link = tmp_path / "link"
    link.symlink_to(root)
    with pytest.raises(ValueError):
        export.export(spark, [str(root)], str(link / "out"))


def test_errors_of_what_was_not_searched_are_no_failures(spark):
    rows = spark.createDataFrame([(0, "a", "f", 0, 1, "k1", "x", "bad body"), (0, "a", "f", 0, 2, "k2", "hit", "bad body")], "archive_no int, archive_id string, folder_path string, folder_order int, seq long, msg_key string, subject string, body_error string").withColumn("message_id", F.lit(""))
    listed = F.col("subject") == "hit"
    assert {r.msg_key: r.status for r in export.decide(rows, match=listed).collect()} == {"k1": "miss", "k2": "failure"}
    decided = export.decide(rows, match=listed, search_bodies=True)
    assert {r.status for r in decided.collect()} == {"failure"}
    assert {r.location for r in export.failures(decided).collect()} == {"a/f / x", "a/f / hit"}


def test_attachment_and_folder_names(spark):
    files = spark.createDataFrame([("m", i, n, 1, bytearray(b"x")) for i, n in enumerate(["photo (2).jpg", "photo.jpg", "photo.jpg", "noext", "photo.png"])] + [("m", 9, "Fwd", 5, bytearray(b"y"))], "msg_key string, att_no int, filename string, method int, payload binary")
    got = {r.att_no: r.rel_path for r in sinks.attachment_rows(files).collect()}
    assert got == {0: "photo (2).jpg", 1: "photo.jpg", 2: "photo (3).jpg", 3: "noext.bin", 4: "photo (4).png", 9: "Fwd.eml"}
    messages = spark.createDataFrame([("a", "A:B", 1, "s"), ("a", "A?B", 1, "s"), ("a", "A?B/x", 1, "Re: 1"), ("a", "A?B", 2, "S")], "archive_id string, folder_path string, seq int, subject string").withColumn("raw", F.lit(b"r"))
    assert sorted(r.rel_path for r in sinks.eml_rows(messages).collect()) == ["A_B (2)/S (2).eml", "A_B (2)/s.eml", "A_B (2)/x/Re_ 1.eml", "A_B/s.eml"]


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_long_safe_names(spark):
    texts = ["é" * 99 + "a" + "日" * 9, "a" + "é" * 300, "日" * 66 + "aa", "日" * 66 + "aaa", "😀" * 51, " " * 300 + "x" * 200 + " " * 300, "." * 201, "\t", "  "]
    expected = ["é" * 99 + "a", "a" + "é" * 99, "日" * 66 + "aa", "日" * 66 + "aa", "😀" * 50, "x" * 200, "_" * 200, "_", "zonder onderwerp"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r.n for r in rows.select("k", X.safe_name(F.col("t")).alias("n")).orderBy("k").collect()] == expected
    # The text is worked out once, whatever it costs.
    assert plan_of(rows.select(X.safe_name(F.initcap("t")).alias("n"))).count("initcap(") == 1


def test_built_messages_are_built_once_and_not_shuffled(spark):
    plan = plan_of(catalog.built_messages(spark, "/root/testdata/sf0.001"))
    assert "Exchange" not in plan and plan.count("Scan parquet") <= 1


def test_base64_lines_of_either_setting(spark):
    rows = spark.createDataFrame([(bytearray(b"a" * n),) for n in (0, 1, 56, 57, 58, 114, 115)], "b binary")
    expected = [base64.b64encode(b"a" * n) for n in (0, 1, 56, 57, 58, 114, 115)]
    expected = ["\r\n".join(e[i:i + 76].decode() for i in range(0, len(e), 76)) + "\r\n" for e in expected]
    assert [r.t for r in rows.select(sinks._base64_lines(F.col("b")).alias("t")).collect()] == expected
    assert mime._pieces(b"--b\n1\n--bb\n--b \t\n2\nx--b\n--b--x\n--b--\nend", "b") == [b"1\n--bb", b"2\nx--b\n--b--x"]


def test_inline_references(spark):
    rows = spark.createDataFrame([('<img src="CID:pic@x"> cid:pic@x2 cid:none', [("pic@x", "image/gif", "p.gif", bytearray(b"GIF")), (None, None, "q", bytearray(b""))])], "body_html string, attachments array<struct<content_id:string,mime_type:string,filename:string,payload:binary>>")
    assert mime.inline_references(rows).first().body_html == '<img src="data:image/gif;base64,R0lG"> cid:pic@x2 cid:none'


def test_long_inline_references_have_no_line_ends(spark):
    rows = spark.sql("SELECT '<img src=\"cid:a\">' AS body_html, array(named_struct('content_id', 'a', 'mime_type', '', 'filename', 'a.gif', 'payload', cast(repeat('GIF', 100) AS binary))) AS attachments")
    assert mime.inline_references(rows).first().body_html == '<img src="data:image/gif;base64,' + "R0lG" * 100 + '">'


def small_store(spark):
    """Two archives; a folder name with a slash; a message in two folders; messages within messages; a cycle."""
    make = lambda rows, name: spark.createDataFrame(rows, schemas.TABLES[f"store_{name}"])
    tree = [("a", 1, None, "root"), ("a", 2, 1, "Inbox"), ("a", 3, 1, "Inbox/Old"), ("b", 1, None, "root"), ("b", 2, 1, "Mail")]
    when = datetime.datetime(1999, 11, 4, 9, 0)
    listed = lambda archive, folder, nid, subject, mid=None: (archive, folder, nid, subject, None, "Ann", "ann@x.org", "", "", when, None, None, 10, 1, "IPM.Note", 1, mid)
    contents = [listed("a", 3, 36, "shared", "<1>"), listed("a", 2, 36, "shared", "<1>"), listed("a", 2, 68, "outer"), listed("a", None, 100, "inner"), listed("a", None, 132, "innermost é"), listed("a", 2, 164, "cycle"),
                listed("a", 2, 196, "broken", "<2>"), listed("b", 2, 36, "copy", "<1>"), listed("b", 2, 68, "readable copy of broken", " <2> ")]
    recipients = [("a", 68, 1, 1, "Bob", "bob@x.org", None), ("a", 68, 0, 2, "Exchange", "/O=X", None), ("a", 68, 2, 3, "", "hidden@x.org", None), ("a", 196, 0, 1, "", "", "recipients cannot be read")]
    file = lambda nid, no, name, method, payload=None, embedded=None: ("a", nid, no, name, 3, method, "image/gif", "", False, payload, embedded, None)
    files = [file(68, 1, "inner", 5, embedded=100), file(68, 0, "p.gif", 1, bytearray(b"GIF")), file(100, 0, "innermost", 5, embedded=132), file(164, 0, "self", 5, embedded=164)]
    bodies = [("a", 68, "outer text", "<b>outer</b>", None), ("a", 132, "From the deepest", None, None), ("b", 36, None, None, None)]
    return stores.Store(make(tree, "folders"), make(contents, "contents"), make(recipients, "recipients"), make(files, "attachments"), make(bodies, "bodies"))


def test_stores_and_files_in_one_export(spark, tree, tmp_path):  # noqa: F811
    store = small_store(spark)
    stores.save(store, "small", 3)
    store = stores.load(spark, "small")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = stores.full(store)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # gathered and joined where the buckets lie
    report = export.export(spark, [tree, store], str(tmp_path / "out"), failures_path=str(tmp_path / "failures"))
    # Twice listed, a copy in the other archive; the cycle and the message without readable recipients fail.
    assert report.first().asDict() == {"scanned": 13, "written": 9, "duplicates": 2, "failures": 2, "misses": 0}
    failed = {(r.location, r.msg_key): r.reason for r in spark.read.parquet(str(tmp_path / "failures")).collect()}
    assert failed == {("a/Inbox / cycle", "a#164"): stores.TOO_DEEP, ("a/Inbox / broken", "a#196"): "recipients cannot be read"}
    rows = mbox.message_summaries(mbox.read_mbox(spark, str(tmp_path / "out"))).collect()
    texts = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/out/part-*"))).decode("latin-1")
    assert texts.index("Subject: Fwd: Report") < texts.index("Subject: shared") < texts.index("Subject: outer") < texts.index("Subject: readable copy of broken")
    assert "X-Folder: a/Inbox\n" in texts and "X-Folder: b/Mail\n" in texts and len(rows) == 9
    outer = next(r for r in rows if r.subject == "outer")
    assert (outer.to_list, outer.cc_list, outer.from_email) == ("Bob", "Exchange", "ann@x.org")
    parts = mime.explode_parts(spark.createDataFrame([("k", outer.raw)], "msg_key string, raw binary")).collect()
    inner = [p for p in parts if p.content_type == "message/rfc822"]
    assert len(inner) == 2 and [p.text.strip() for p in parts if p.leaf and p.content_type == "text/plain"] == ["outer text", "", "From the deepest"]
    assert export.export(spark, [store], str(tmp_path / "old"), folder="inbox/old").first().written == 1
    assert export.export(spark, [store], str(tmp_path / "body"), "DEEPEST").first().written == 0
    assert export.export(spark, [store], str(tmp_path / "bcc"), "hidden@x.org outer").first().written == 1
    assert export.export(spark, [store], str(tmp_path / "gif"), "p.gif outer", search_bodies=True).first().written == 1


def test_only_wanted_messages_are_gathered_and_built_once(spark):
    store = small_store(spark)
    built = stores.as_eml(store, spark.createDataFrame([("a", 36), ("a", 68)], "archive_id string, nid long"))
    assert plan_of(built).count("LeftSemi") >= 4  # contents, recipients, attachments and bodies
    assert {r.nid for r in built.collect()} == {36, 68} and built.count() == 2
    # One explode that holds the building, one that holds the headers.
    assert plan_of(catalog.nested_messages(spark, "/root/testdata/sf0.001")).count("Generate explode(array(") == 2


def test_messages_of_stores_are_built_once(spark, tmp_path, monkeypatch):
    plans, kept = [], sinks.write_mbox
    monkeypatch.setattr(sinks, "write_mbox", lambda rows, *a, **k: plans.append(plan_of(rows)) or kept(rows, *a, **k))
    assert export.export(spark, [small_store(spark)], str(tmp_path / "out"), folder="inbox/old").first().written == 1
    # Ordering looks at its rows once more, so what it reads is built already.
    assert "rangepartitioning" in plans[0] and "Join" not in plans[0]


def test_full_messages_of_raw_mail(spark, tree):  # noqa: F811
    rows = messages.full_messages(mbox.message_summaries(mbox.read_mbox(spark, tree))).where("folder_path = 'Inbox'").orderBy("seq").collect()
    assert [(r.from_name, r.from_email, r.importance, r.body_kind) for r in rows] == [("Jan de Vries", "jan@example.nl", 1, "text"), ("Anna Smith", "anna@example.com", 2, "text"), ("René Janssen", "rene@example.nl", 1, "text")]
    assert [(p.kind, p.name, p.email) for p in rows[0].recipients] == [(1, "", "mvberkum@example.nl"), (1, "Berg, Piet", "piet@example.nl")]
    assert rows[0].addresses == "jan@example.nl mvberkum@example.nl piet@example.nl" and "and more" in rows[1].body_text


def test_files_take_their_places_without_a_look_up_each(tmp_path, monkeypatch):
    calls, opened = [], sinks.opened
    monkeypatch.setattr(sinks, "opened", lambda uri: calls.append(uri) or opened(uri))
    writer = sinks.FileTreeWriter(str(tmp_path / "x"))
    names = [f"d{i % 2}/n%20 {i}" for i in range(1_200)] + ["top"]
    writer.commit([writer.write(iter([pa.record_batch({"rel_path": names, "content": [n.encode() for n in names]})])), None])
    found = {str(p.relative_to(tmp_path / "x")): p.read_text() for p in (tmp_path / "x").rglob("*") if p.is_file()}
    assert found == {n: n for n in names} and len(calls) < 10


def test_no_names_of_files_pass_through_the_driver(spark, tmp_path):
    root = str(tmp_path / "x")
    writer = sinks.FileTreeWriter(root)
    names = [f"d{i % 3}/e%20 {i % 2}/_n + é {i}" for i in range(1_300)] + ["top", "d0/empty"]
    contents = [b"" if n == "d0/empty" else n.encode() for n in names]
    message = writer.write(iter([pa.record_batch({"rel_path": names, "content": contents})]))
    assert len(pickle.dumps(message)) < 200  # once all names, for the driver to hold
    writer.commit([message, None, writer.write(iter([]))])
    found = {str(p.relative_to(root)): p.read_bytes() for p in (tmp_path / "x").rglob("*") if p.is_file()}
    assert found == dict(zip(names, contents, strict=True))
    files = mailfiles.files_below(spark, root)
    assert {(r.rel_path, r.size) for r in files.collect()} == set(mailfiles.listed(root))
    assert {r.rel_path: bytes(r.raw) for r in mailfiles.whole_files(files).collect()} == found
    assert not [p for p in files.inputFiles() if p.startswith(f"file://{root}")]  # Spark's own sources list in the driver
    (tmp_path / "none").mkdir()
    assert mailfiles.whole_files(mailfiles.files_below(spark, str(tmp_path / "none"))).count() == 0
