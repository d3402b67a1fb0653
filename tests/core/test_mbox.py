"""The documented mbox tree, written here and read back."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlark.functions import mail
from postlark.jobs import export
from postlark.sources import mailfiles, mbox


def entry(status, when, lines):
    return [f"From - {when}", f"X-Mozilla-Status: {status}", "X-Mozilla-Status2: 00000000", *lines, ""]


INBOX = [
    *entry("0001", "Thu Nov 04 10:15:00 1999", ["Date: Thu, 04 Nov 1999 10:14:51 +0100", "From: Jan de Vries <jan@example.nl>", 'To: mvberkum@example.nl, "Berg, Piet" <piet@example.nl>', "Subject: =?iso-8859-1?Q?Caf=E9_morgen?=", "Message-ID: <38214A1B.1@example.nl>", "", "Tot morgen"]),
    *entry("0000", "Wed Nov 03 09:00:00 1999", ["Date: Wed, 3 Nov 1999 08:59:10 -0500", "From: anna@example.com (Anna Smith)", "To: mvberkum@example.nl", "Subject: Report with attachment", "X-Priority: 1", "Content-Type: multipart/mixed;", ' boundary="b"', "Message-ID: <38214A1B.2@example.com>", "", "--b", "", ">From the start", "From here on things change at 10:30", "and more", "--b--"]),
    *entry("0009", "Tue Nov 02 12:00:00 1999", ["Date: Tue, 2 Nov 1999 12:00:00 +0100", "From: spam@example.org", "Subject: Deleted message", "", "x"]),
    *entry("0001", "Mon Nov 01 08:00:00 1999", ["Date: 1 Nov 99 07:59 MET", "From: Ren\xe9 Janssen <rene@example.nl>", "To: mvberkum@example.nl", "Subject: HTML mail", "", "y"]),
]
SENT = [*entry("0001", "Mon Oct 18 14:00:00 1999", ["Date: Mon, 18 Oct 1999 14:00:00 +0200", "From: Martijn <mvberkum@example.nl>", "To: anna@example.com", "Subject: Old style attachment", "", "z"]),
        *entry("0001", "Tue Oct 19 15:00:00 1999", ["Date: Tue, 19 Oct 1999 15:00:00 +0200", "From: Martijn <mvberkum@example.nl>", "To: piet@example.nl", "Subject: Fwd: Report with attachment", "", "w"])]
KLANT = entry("0001", "Fri Jul 30 11:00:00 1999", ["Date: Fri, 30 Jul 1999 11:00:00 +0200", "From: klant@example.com", "To: mvberkum@example.nl", "Subject: Project kickoff", "", "plain text"])


@pytest.fixture(scope="session")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("mail") / "netscape"
    (root / "Projecten.sbd").mkdir(parents=True)
    for name, lines, eol in (("Inbox", INBOX, "\r\n"), ("Sent", SENT, "\n"), ("Projecten.sbd/Klant A", KLANT, "\r")):
        (root / name).write_bytes((eol.join(lines) + eol).encode("latin-1"))
    for name in ("Templates", "Projecten", "Inbox.snm"):
        (root / name).write_bytes(b"")
    (root / "rules.dat").write_bytes(b"\0\1")
    return str(root)


def test_classification(spark, tree):
    got = {r.rel_path: (r.kind, r.eol) for r in mbox.classify_files(spark, tree).collect()}
    assert got == {"Inbox": ("mbox", "\n"), "Sent": ("mbox", "\n"), "Projecten.sbd/Klant A": ("mbox", "\r"), "Templates": ("empty", "\n"), "Projecten": ("empty", "\n"), "Inbox.snm": ("other", "\n"), "rules.dat": ("other", "\n")}


def test_message_list(spark, tree):
    rows = mbox.message_summaries(mbox.read_mbox(spark, tree)).withColumn("t", F.unix_timestamp("date")).orderBy("folder_path", "seq").collect()
    assert len(rows) == 6
    inbox = [r for r in rows if r.folder_path == "Inbox"]
    assert [r.subject for r in inbox] == ["Café morgen", "Report with attachment", "HTML mail"] and [r.seq for r in inbox] == [0, 1, 2]
    assert [r.flags & 1 for r in inbox] == [1, 0, 1] and inbox[1].flags & 16 and inbox[1].importance == 2
    assert inbox[0].to_list == "mvberkum@example.nl; Berg, Piet" and inbox[1].from_name == "Anna Smith" and inbox[2].from_name == "René Janssen"
    assert (inbox[0].t, inbox[2].t) == (941706891, 941439540)
    body = bytes(inbox[1].raw).decode("latin-1")
    assert "From here on things change at 10:30\r\nand more" in body and body.endswith("--b--\r\n")
    assert [r.subject for r in rows if r.folder_path == "Projecten/Klant A"] == ["Project kickoff"]


@pytest.mark.parametrize("value, want", [
    ("Thu, 4 Nov 1999 12:00:00 +0100", 941713200), ("4 Nov 99 12:00 MET", 941713200), ("Thu Nov  4 12:00:00 1999", 941716800), ("4 Nov 1999 12:00:00 GMT", 941716800),
    ("4 Nov 1999 12:00 MET DST", 941709600), ("4 Nov 1999 12:00 EST -0500", 941734800), ("no date", None), (None, None)])
def test_dates(spark, value, want):
    row = spark.createDataFrame([(value,)], "v string").select(F.unix_timestamp(mail.mail_date(F.col("v"))).alias("t")).first()
    assert row.t == want


def test_words_addresses_and_types():
    assert mail.decode_words("=?utf-8?B?w6k=?= =?iso-8859-1?Q?_=E9?= tail =?x?Z?y?=") == "é é tail =?x?Z?y?="
    assert mail.parse_addresses("Friends: a@b.c, 'Q' <c@d.e>;") == [("", "a@b.c"), ("Q", "c@d.e")]
    assert mail.parse_content_type('Text/Plain; charset="utf-8"; name*=iso-8859-1\'\'caf%E9.txt; charset=x (comment)') == ("text/plain", {"charset": "utf-8", "name": "café.txt"})
    assert mail.decode_uu(b"begin 644 f\n#0V%T\n`\nend\n") == b"Cat"
    long = "é" * 60
    assert mail.decode_words(mail.encode_word(long).replace("\r\n ", " ")) == long and all(len(w) <= 75 for w in mail.encode_word(long).split("\r\n "))
    assert mail.parse_content_type("a/b; " + mail.mime_param("filename", "naïve " * 30).replace("\r\n ", " "))[1]["filename"] == ("naïve " * 30).strip()


def write(path, *messages, end="\n\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"From - Thu Nov 04 10:15:0{k} 1999\nSubject: {m}\n\n{m}{end}" for k, m in enumerate(messages)))


def test_names_with_underscores_and_lines_that_look_like_separators(spark, tmp_path):
    root = tmp_path / "m"
    write(root / "_Old", "a", "From From here", "From b 10:30\nno field", "From c\nd: e")
    write(root / "_dir" / "In", "b")
    write(root / "_temporary" / "x", "unfinished")
    (root / "_SUCCESS").write_bytes(b"")
    (root / "ends").write_text("From - 10:15\nSubject: x\n\ny\nFrom z 10:16\n")
    want = {("_Old", "Subject: a\n\na\n"), ("_Old", "Subject: From From here\n\nFrom From here\n"), ("_Old", "Subject: From b 10:30\nno field\n\nFrom b 10:30\nno field\n"), ("_Old", "Subject: From c\nd: e\n\nFrom c\nd: e\n"),
            ("_dir/In", "Subject: b\n\nb\n"), ("ends", "Subject: x\n\ny")}
    for range_bytes in (7, 50, 1 << 20):
        rows = mbox.read_mbox(spark, str(root), range_bytes=range_bytes).collect()
        assert {(r.folder_path, bytes(r.raw).decode()) for r in rows} == want and len(rows) == len(want)
        assert all(open(r.file_path.removeprefix("file:"), "rb").read()[r.offset:r.offset + r.size] == bytes(r.raw) for r in rows)
    assert {r.rel_path for r in mbox.classify_files(spark, str(root)).collect()} == {"_Old", "_dir/In", "ends"}


def test_scanner_equals_one_that_goes_line_by_line(monkeypatch):
    def by_line(b):
        eol = b"\n" if b"\n" in b else b"\r"
        n, starts, at = len(b), [], 0
        end_of = lambda i: n if b.find(eol, i) < 0 else b.find(eol, i)
        while at < n:
            e = end_of(at)
            if re.match(rb"From .*[0-9]:[0-9][0-9]", b[at:e], re.DOTALL) and (e + 1 >= n or re.match(rb"[\x21-\x39\x3b-\x7e]+:", b[e + 1:end_of(e + 1)])):
                starts.append((at, min(e + 1, n)))
            at = e + 1
        for (_, first), following in zip(starts, [s for s, _ in starts[1:]] + [n], strict=True):
            text = b[first:following].removesuffix(eol)
            text = text.removesuffix(b"\r") if eol == b"\n" else text
            if text:
                yield first, len(text), text

    rng = random.Random(3)
    bits = [b"From ", b"From x 10:30", b"From a Thu Nov 04 10:15:00 1999", b"\n", b"\n", b"\r\n", b"Subject: x", b"A-b:", b"no field", b"From From here 1:00", b"x", b" sp:"]
    for k in range(3000):
        b = b"From - 10:00\nA: b\n" + b"".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        b = b.replace(b"\r\n", b"\n").replace(b"\n", b"\r") if k % 3 == 0 else b
        monkeypatch.setattr(mailfiles, "STEP", rng.choice([1, 3, 1000]))
        cut = rng.choice([1, 5, 9, 1000])
        got = [(m[1], m[2], m[4]) for low in range(0, len(b), cut) for m in mailfiles.messages_of(pa.BufferReader(b), len(b), low, min(low + cut, len(b)))]
        assert got == list(by_line(b)), (b, cut)


def test_unreadable_and_truncated_files_are_rows(spark, tmp_path):
    root = tmp_path / "m"
    write(root / "good", "a", "b")
    write(root / "cut", "c", "d")
    size = (root / "good").stat().st_size
    reader = mailfiles.MboxReader({"path": str(root)})
    files = [("cut", size + 10, 0, 20), ("cut", size + 10, 20, size + 10), ("gone", 9, 0, 9), ("good", size, 0, size)]
    rows = [r for batch in reader.read(mailfiles.Ranges(files)) for r in batch.to_pylist()]
    assert [r["rel_path"] for r in rows if not r["error"]] == ["good", "good"]
    table = spark.createDataFrame([(r["rel_path"], r["block"], r["error"]) for r in rows], "file_path string, block long, error string").selectExpr("'m' archive_id", "file_path folder_path", "*")
    failed = {r.file_path: r.reason for r in mbox.unreadable_files(table).collect()}
    assert set(failed) == {"cut", "gone"} and failed["cut"] == "file cannot be read: file is shorter than listed"
    found = [r for batch in mailfiles.FilesReader({"path": str(root)}).read(mailfiles.Ranges(files)) for r in batch.to_pylist()]
    assert [r["kind"] for r in found] == ["unreadable", "unreadable", "unreadable", "mbox"]
    small = [p.ranges for p in mailfiles._dealt([("a", 10), ("b", 25 << 20), ("c", 0), ("d", 3)], 10 << 20)]
    assert [(r[0], r[2], r[3]) for p in small for r in p] == [("a", 0, 10), ("b", 0, 10 << 20), ("b", 10 << 20, 20 << 20), ("b", 20 << 20, 25 << 20), ("c", 0, 0), ("d", 0, 3)]


def test_an_error_in_a_file_does_not_stop_the_export(spark, tmp_path, monkeypatch):
    root = tmp_path / "m"
    write(root / "A", "a", "b")
    write(root / "B", "c")
    read = mbox.read_mbox

    def failing(*given, **options):
        rows = read(*given, **options)
        broken = rows.where("rel_path = 'A'").limit(1).withColumns({c: F.lit(None) for c in ("mid", "offset", "size", "sep_line", "raw")}).withColumn("error", F.lit("file cannot be read: disk"))
        return rows.unionByName(broken)

    monkeypatch.setattr(mbox, "read_mbox", failing)
    report = export.export(spark, [str(root)], str(tmp_path / "out"), failures_path=str(tmp_path / "failures"))
    assert report.first().asDict() == {"scanned": 3, "written": 3, "duplicates": 0, "failures": 0, "misses": 0}
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "failures")).collect()] == [("m", "m/A", None, "file cannot be read: disk")]


def test_folders_of_one_name(spark, tmp_path):
    root = tmp_path / "m"
    write(root / "X.mbox", "a")
    write(root / "X.sbd" / "In", "b")
    write(root / "Y", "c")
    write(root / "Y.sbd" / "In", "d")
    write(root / "Z.mbox" / "mbox", "e")
    write(root / "Z.mbox" / "Sub", "f")
    rows = export.folder_list(export.read_archives(spark, [str(root)])).collect()
    got = [(r.folder_id, r.path, r.content_count, r.total_content_count) for r in sorted(rows, key=lambda r: r.folder_order)]
    assert got == [("X", "X", 0, 1), ("X/In", "X/In", 1, 1), ("X.mbox", "X", 1, 1), ("Y", "Y", 1, 2), ("Y/In", "Y/In", 1, 1), ("Z.mbox/", "Z", 1, 2), ("Z.mbox//Sub", "Z/Sub", 1, 1)]


@pytest.mark.parametrize("value, want", [
    ("4 Jul 1999 12:00:00", "1999-07-04 10:00:00"), ("4 Nov 1999 12:00:00", "1999-11-04 11:00:00"), ("28 Mar 1999 02:30", "1999-03-28 01:30:00"), ("31 Oct 1999 02:30", "1999-10-31 00:30:00"),
    ("4 Jul 1999 12:00:00 GMT", "1999-07-04 12:00:00"), ("4 Jul 1999 12:00:00 +0000", "1999-07-04 12:00:00"), ("no date", None)])
def test_dates_in_local_time(spark, value, want):
    for zone in ("Europe/Amsterdam", F.col("z")):
        row = spark.createDataFrame([(value, "Europe/Amsterdam")], "v string, z string").select(mail.mail_date(F.col("v"), zone=zone).cast("string").alias("t")).first()
        assert row.t == want


def test_small_files_are_read_by_few_tasks():
    files = [(f"f{i:04}", 2_000) for i in range(2_000)]
    tasks = mailfiles._dealt(files, mailfiles.RANGE_BYTES)
    assert [r[0] for p in tasks for r in p.ranges] == [f for f, _ in files] and len(tasks) <= 5
