"""Text, byte and date columns built from Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Explicit classes: Spark's trim cuts U+0020 only.
BLANK, BLANK_OR_LINE_END, CONTROL = "[ \\t]", "[ \\t\\r\\n]", "[\\x00-\\x1f\\x7f-\\x9f]"


def strip(text: Column, cls: str = BLANK) -> Column:
    """Remove leading and trailing characters of a class."""
    return F.regexp_replace(text, f"^{cls}+|{cls}+$", "")


def normalize_eol(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, "\\r\\n?", "\n")


def latin1(raw: Column) -> Column:
    """Bytes as text with one character for each byte."""
    return F.decode(raw, "ISO-8859-1")


def bytes_of(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


#: What Windows-1252 has at 0x80 to 0x9F where it differs from ISO-8859-1.
_WESTERN = {b: c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


def decode_western(raw: Column) -> Column:
    """Windows-1252 bytes as text; undefined bytes keep their number."""
    return F.translate(latin1(raw), "".join(map(chr, _WESTERN)), "".join(_WESTERN.values()))


def decode_default(raw: Column) -> Column:
    """UTF-8 if the bytes are valid, else Windows-1252."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(decode_western(raw))


def parse_headers(block: Column) -> Column:
    """Header block (LF line ends) to ARRAY<STRUCT<name, value>>: lines unfolded, lines that are no field dropped."""
    unfolded = F.regexp_replace(block, "[ \\t]*\\n[ \\t]+", " ")
    fields = F.filter(F.split(unfolded, "\n"), lambda line: line.rlike("^[^:\\n]*[^: \\t\\n][^:\\n]*:") & ~strip(F.substring_index(line, ":", 1)).contains(" ") & ~line.rlike("^[ \\t]"))
    return F.transform(fields, lambda line: F.struct(strip(F.substring_index(line, ":", 1)).alias("name"), strip(F.regexp_replace(line, "^[^:]*:", "")).alias("value")))


def header(headers: Column, name: str, last: bool = False) -> Column:
    """First (or last) value of a field, names compared without case; null if there is none."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.get(found, F.size(found) - 1 if last else F.lit(0))["value"]


def header_all(headers: Column, name: str) -> Column:
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"])


def base64_of(raw: Column) -> Column:
    """Base64 in one line; Spark's own has line ends after 76 characters, unless a setting of the session says otherwise."""
    return F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))


def decode_base64_lenient(text: Column) -> Column:
    """Base64 bytes: other characters skipped, the end at '=', a dangling character dropped."""
    clean = F.regexp_replace(F.regexp_replace(text, "(?s)=.*", ""), "[^A-Za-z0-9+/]", "")
    whole = F.when(F.length(clean) % 4 == 1, F.substring(clean, F.lit(1), F.length(clean) - 1)).otherwise(clean)
    return F.unbase64(F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), "="))


def html_to_plain(html: Column) -> Column:
    """Text of HTML with entities still encoded and blanks not yet tidied."""
    out = html
    for tag in ("style", "script", "head"):
        out = F.regexp_replace(out, f"(?is)<{tag}.*?</{tag}>", "")
    out = F.regexp_replace(out, "(?is)<br[^>]*>", "\n")
    out = F.regexp_replace(out, "(?i)</(p|div|tr|li|h[1-6])>", "\n")
    return F.regexp_replace(out, "<[^>]+>", "")


def tidy_plain(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, "\\r\\n", "\n"), "\\n{3,}", "\n\n"), "[\\s\\x{85}\\x{a0}]")


def html_charset(raw: Column) -> Column:
    """Character set that HTML bytes declare: a UTF-8 mark, or charset= in the first 4096 bytes; else null."""
    head = F.lower(latin1(F.substring(raw, 1, 4096)))
    named = F.regexp_extract(head, "charset\\s*=\\s*[\"']?\\s*([a-z0-9_\\-]+)", 1)
    return F.when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", "utf-8").otherwise(F.nullif(named, F.lit("")))


def once(value: Column, used: Callable[[Column], Column]) -> Column:
    """``used`` of a value that is worked out once, as a lambda's variable, not for each use."""
    return F.get(F.transform(F.array(value), used), 0)


def safe_name(text: Column) -> Column:
    """A file name: forbidden characters and leading dots become '_'; 200 UTF-8 bytes at most, cut between characters."""
    def shown(name: Column) -> Column:
        dots = F.length(F.regexp_extract(name, "^\\.*", 0))
        return F.when(name == "", "zonder onderwerp").when(name.startswith("."), F.concat(F.repeat(F.lit("_"), dots), F.regexp_replace(name, "^\\.+", ""))).otherwise(name)

    def cut(octets: Column) -> Column:
        # If the byte behind the 200th goes on with a character, the bytes of that character before it go too.
        begins = F.left(octets, F.lit(200))
        return F.when(F.substring(octets, 201, 1).rlike("[\\x80-\\xbf]"), F.regexp_replace(begins, "[\\xc0-\\xff][\\x80-\\xbf]*\\z", "")).otherwise(begins)

    # Tabs become '_', so blanks are cut at the ends; 200 bytes lie in 201 characters, and nothing behind them is looked at.
    begun = F.translate(F.left(F.trim(text), F.lit(201)), "/\\:?%*|\"<>\n\r\t", "_" * 13)
    return once(once(begun, shown), lambda name: F.when(F.octet_length(name) <= 200, name).otherwise(bytes_of(once(latin1(F.encode(name, "UTF-8")), cut)).cast("string")))


def flat(text: Column) -> Column:
    """Control characters become blanks; blanks at the ends go."""
    return strip(F.regexp_replace(text, CONTROL, " "))


def addr_spec(text: Column) -> Column:
    """The bare address: inside the last pair of brackets, without blanks, brackets, quotes and commas."""
    inside = F.regexp_extract(text, "(?s)^.*<(.*)>[^>]*$", 1)
    return F.regexp_replace(F.when(text.rlike("(?s)<.*>"), inside).otherwise(text), "[\\s\\x00-\\x1f\\x7f-\\x9f<>\",]", "")


def quoted_param(text: Column) -> Column:
    escaped = F.replace(F.replace(flat(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def quote_from(text: Column, kept_raw: Column) -> Column:
    """mbox quoting: messages that still carry a file's quoting need '>' before bare 'From ' lines only."""
    return F.when(kept_raw, F.regexp_replace(text, "(?dm)^From ", ">From ")).otherwise(F.regexp_replace(text, "(?dm)^(>*From )", ">$1"))


def clean_subject(text: Column) -> Column:
    """Without the marker U+0001 and the character behind it."""
    return F.regexp_replace(text, "(?s)^\\x01.", "")


def shown_subject(text: Column) -> Column:
    trimmed = strip(clean_subject(text), BLANK_OR_LINE_END)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", "(no subject)").otherwise(trimmed)


def guid_string(raw: Column) -> Column:
    """{XXXXXXXX-XXXX-XXXX-XXXX-XXXXXXXXXXXX} of 16 bytes, the first three groups little-endian; others as plain hex."""
    digits = F.hex(raw)
    at = lambda *places: F.concat(*(F.substring(digits, 2 * p + 1, 2) for p in places))
    text = F.concat(F.lit("{"), at(3, 2, 1, 0), F.lit("-"), at(5, 4), F.lit("-"), at(7, 6), F.lit("-"), at(8, 9), F.lit("-"), at(*range(10, 16)), F.lit("}"))
    return F.when(F.octet_length(raw) >= 16, text).otherwise(digits)


def property_tag(prop_id: Column, prop_type: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(prop_id.cast("long") * 65536 + prop_type), 8, "0"))


def natural_key(text: Column) -> Column:
    """Sort key in which digit runs count by value: each run, without leading zeros, after its length."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(r)).cast("string"), 4, "0"), number(r))).otherwise(r)), "")


#: Microseconds from 1601 to 1970; days from 1899-12-30 to 1970.
_FILETIME_EPOCH, _OLE_EPOCH = 11644473600000000, 25569


def filetime_to_ts(filetime: Column) -> Column:
    """100 ns units since 1601; null for 0, the largest value and years past 9999."""
    valid = (filetime > 0) & (filetime < F.lit(2650467744000000000))
    return F.when(valid, F.timestamp_micros(F.call_function("div", filetime, F.lit(10).cast("long")) - _FILETIME_EPOCH))


def ole_date_to_ts(days: Column) -> Column:
    """Days since 1899-12-30."""
    return F.timestamp_micros(F.round((days - _OLE_EPOCH) * 86_400_000_000.0).cast("long"))


def format_mbox_date(ts: Column) -> Column:
    """asctime form, in the session's zone; undated messages get the epoch."""
    return F.date_format(F.coalesce(ts, F.timestamp_micros(F.lit(0).cast("long"))), "EEE MMM dd HH:mm:ss yyyy")


def format_rfc2822(ts: Column) -> Column:
    """In the session's zone, which is written as its offset."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss xx")


def format_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


_RFC5322 = "^\\s*(?:[A-Za-z]{3},\\s*)?([0-9]{1,2}) ([A-Za-z]{3}) ([0-9]{4}) ([0-9]{2}:[0-9]{2}:[0-9]{2}) ([+-][0-9]{4})(?:\\s*\\([A-Z]+\\))?\\s*$"


def rfc5322_date(text: Column) -> Column:
    """The common form '[Thu, ]4 Nov 1999 12:00:00 +0100' as a timestamp; null for all others."""
    part = lambda i: F.regexp_extract(text, _RFC5322, i)
    return F.when(part(0) != "", F.try_to_timestamp(F.concat_ws(" ", part(1), F.initcap(part(2)), part(3), part(4), part(5)), F.lit("d MMM yyyy HH:mm:ss xx")))


def currency(value: Column) -> Column:
    return (value.cast("decimal(19,0)") / 10000).cast("double")


def percent(value: Column) -> Column:
    return (value * 100).cast("int")


def base64_size(size: Column) -> Column:
    return F.call_function("div", size * 3, F.lit(4).cast("long"))
