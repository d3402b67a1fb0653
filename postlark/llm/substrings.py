"""Exact removal of long repeated byte strings with a logarithmic family of suffix arrays.

Every string of ``length`` bytes holds an anchor: the place of the smallest hash of
its k-byte substrings.  Equal strings have their anchors at the same place, so only
strings whose anchor's k bytes repeat need a look, and only together with others of
the same anchor.  The strings that share an anchor in one document start next to
each other; they travel as one segment.

1. All documents are cut into segments; segments are counted by anchor and
   content.  An anchor seen once has no repeats.  A segment whose content repeats
   as a whole repeats everywhere, without its bytes being moved.
2. Anchors with different segments send one segment of each content to the
   anchor's shard.  There, each incoming batch of segments gets a suffix array (of
   its suffixes cut to ``length`` bytes), is merge-scanned against the existing
   levels for equal strings, and levels of like size merge, so that a shard of n
   suffixes has about log2(n) levels.
3. Repeated starts go back to all documents of the content, become byte ranges,
   and the ranges are cut out.

Anchors with very many different contents don't fit one shard's memory; their
strings are counted by hash, spread over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.llm.common import bounded, discard, materialize, mix64

LENGTH = 400
GRAM = 100
#: Different contents of one anchor that a shard takes; anchors with more are counted by string.
CONTENTS_IN_SHARD = 30_000
#: Segments in a batch that gets a suffix array of its own.
BATCH_SEGMENTS = 4096
#: Segments of a shard on average.
SEGMENTS_IN_SHARD = 20_000
#: Segments or runs (some 50 bytes each) that may be broadcast; more are joined by shuffle.
BROADCAST_ENTRIES = 400_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_HEAD = np.uint64(0xFFFFFF0000000000)
_UPPER = np.uint64(0xFFFFFFFF00000000)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    found = _POWERS.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 17), base & (2**64 - 1), np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if n <= 1 << 22:
            _POWERS[base] = found
    return found[:n]


class Roller:
    """Hashes of all substrings of one length, from prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = _powers(_INVERSE, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=self.sums[1:])

    def at(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return mix64((self.sums[starts + size] - self.sums[starts]) * self.inverse[starts])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:-size]) * self.inverse[:n])


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the smallest of each run of ``size`` values by their upper 32 bits, of equal ones the leftmost."""
    n, blocks = len(values) - size + 1, -(-len(values) // size)
    padded = np.full(blocks * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = (values & _UPPER) | np.arange(len(values), dtype=np.uint64)
    grid = padded.reshape(blocks, size)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[size - 1:size - 1 + n]) & ~_UPPER).astype(np.int64)


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, first and last start of the strings of each anchor, and its place from the first."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    roller = Roller(data)
    places = window_minima(roller.all(gram), length - gram + 1)
    first = np.nonzero(np.r_[True, places[1:] != places[:-1]])[0]
    last = np.r_[first[1:], len(places)] - 1
    anchors = roller.at(places[first], gram)
    place = places[first] - first
    contents = mix64(roller.at(first, last - first + length) ^ (last - first).astype(np.uint64) ^ mix64(place.astype(np.uint64)))
    return anchors, contents, first, last, place


_SEGMENTS = "doc long, text_hash long, anchor long, content long, first long, last long, place long"


def _cut(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ["doc", "text_hash", "anchor", "content", "first", "last", "place"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            docs, hashes, texts = (part.column(i).to_pylist() for i in range(3))
            found = [segments(np.frombuffer((t or "").encode(), np.uint8), length, gram) for t in texts]
            counts = [len(f[0]) for f in found]
            columns = [pa.array(np.repeat(np.array(hashes, np.int64), counts))]
            columns.insert(0, pa.array(docs, pa.int64()).take(pa.array(np.repeat(np.arange(len(docs)), counts))))
            columns += [pa.array(np.concatenate([f[k] for f in found]).view(np.int64) if found else np.zeros(0, np.int64)) for k in range(5)]
            yield pa.RecordBatch.from_arrays(columns, names)


class SuffixArray:
    """Suffixes cut to a length, in order of their first bytes and, beyond those, of a hash; each string once.

    ``key`` holds three bytes and the hash's upper bits, ``tail`` the hash; ``owner``
    is a start that has the string, ``many`` tells whether others have it too.
    """

    def __init__(self, key: np.ndarray, tail: np.ndarray, owner: np.ndarray, many: np.ndarray):
        self.key, self.tail, self.owner, self.many = key, tail, owner, many

    @classmethod
    def build(cls, key: np.ndarray, tail: np.ndarray, owner: np.ndarray, repeated: list[np.ndarray], many: np.ndarray | None = None) -> SuffixArray:
        """Sort; starts beyond the first of equal strings go to ``repeated``."""
        order = np.argsort(key, kind="stable")
        if ((key[order][1:] == key[order][:-1]) & (tail[order][1:] != tail[order][:-1])).any():
            order = np.lexsort((owner, tail, key))  # different strings with one key are rare
        key, tail, owner = key[order], tail[order], owner[order]
        many = np.zeros(len(order), bool) if many is None else many[order]
        new = np.ones(len(order), bool)
        new[1:] = tail[1:] != tail[:-1]
        repeated.append(owner[~new])
        starts = np.nonzero(new)[0]
        several = np.diff(np.r_[starts, len(order)]) > 1
        return cls(key[starts], tail[starts], owner[starts], (np.logical_or.reduceat(many, starts) if len(starts) else many) | several)

    def __len__(self) -> int:
        return len(self.key)

    def part(self, keep: np.ndarray) -> SuffixArray:
        return SuffixArray(self.key[keep], self.tail[keep], self.owner[keep], self.many[keep])

    def find(self, other: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """Merge scan: places in ``other`` and here of strings that both have."""
        place, end = np.searchsorted(self.key, other.key, "left"), np.searchsorted(self.key, other.key, "right")
        open_ = np.nonzero(place < end)[0]
        found = []
        while len(open_):
            same = self.tail[place[open_]] == other.tail[open_]
            found.append(open_[same])
            open_ = open_[~same]
            place[open_] += 1
            open_ = open_[place[open_] < end[open_]]
        hit = np.concatenate([*found, np.zeros(0, np.int64)])
        return hit, place[hit]

    def merge(self, other: SuffixArray) -> SuffixArray:
        """Both together; no string is in both."""
        key, tail = np.concatenate([self.key, other.key]), np.concatenate([self.tail, other.tail])
        owner, many = np.concatenate([self.owner, other.owner]), np.concatenate([self.many, other.many])
        order = np.argsort(key, kind="stable")
        return SuffixArray(key[order], tail[order], owner[order], many[order])


class Family:
    """Levels of suffix arrays, each at least twice as large as the next."""

    def __init__(self):
        self.levels: list[SuffixArray] = []
        self.repeated: list[np.ndarray] = []

    def add(self, batch: SuffixArray) -> None:
        """A string that a level has is repeated there and here, and doesn't enter again."""
        for level in self.levels:
            here, there = level.find(batch)
            level.many[there] = True
            self.repeated.append(batch.owner[here])
            keep = np.ones(len(batch), bool)
            keep[here] = False
            batch = batch.part(keep)
        while self.levels and len(self.levels[-1]) <= 2 * len(batch):
            batch = self.levels.pop().merge(batch)
        self.levels.append(batch)

    def repeats(self) -> np.ndarray:
        """All starts whose string was added more than once."""
        return np.unique(np.concatenate([*self.repeated, *(level.owner[level.many] for level in self.levels), np.zeros(0, np.int64)]))


def _shard(batches: Iterator[pa.RecordBatch], length: int, batch_segments: int) -> Iterator[pa.RecordBatch]:
    """Segments (anchor, content, place, bytes) of a shard to the runs of repeated starts of each."""
    family, keys, spans, total = Family(), [], [], 0
    for whole in batches:
        for low in range(0, whole.num_rows, batch_segments):
            batch = whole.slice(low, batch_segments)
            anchors, contents, place, texts = (batch.column(i) for i in range(4))
            raw = texts.to_pylist()
            sizes = np.array([len(r) for r in raw], np.int64)
            data = np.frombuffer(b"".join(raw) + b"\0" * 8, np.uint8)
            begins = np.cumsum(sizes) - sizes
            counts = sizes - length + 1
            starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            roller = Roller(data)
            # The anchor and its place in the string are part of the string's key: strings of other anchors differ.
            inside = np.repeat(place.to_numpy().astype(np.int64) + begins, counts) - starts
            tail = mix64(roller.at(starts, length) ^ mix64(np.repeat(anchors.to_numpy().view(np.uint64), counts) + inside.astype(np.uint64)))
            head = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))[starts].astype(np.uint64) & _HEAD
            family.add(SuffixArray.build(head | (tail >> np.uint64(24)), tail, total + np.arange(len(starts)), family.repeated))
            keys.append((anchors, contents))
            spans.append(counts)
            total += len(starts)
    if not keys:
        return
    starts, counts = family.repeats(), np.concatenate(spans)
    edges = np.r_[0, np.cumsum(counts)]
    segment = np.searchsorted(edges, starts, "right") - 1
    opens = np.nonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(segment) != 0)])[0] if len(starts) else starts
    closes = np.r_[opens[1:], len(starts)] - 1 if len(starts) else starts
    anchors = np.concatenate([k[0].to_numpy() for k in keys])
    contents = np.concatenate([k[1].to_numpy() for k in keys])
    which = segment[opens]
    yield pa.RecordBatch.from_arrays([pa.array(anchors[which]), pa.array(contents[which]), pa.array(starts[opens] - edges[which]), pa.array(starts[closes] - edges[which])], ["anchor", "content", "low", "high"])


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Segments to their strings' hashes, for anchors with too many contents."""
    for whole in batches:
        for low in range(0, whole.num_rows, 256):
            anchors, contents, place, texts = (whole.slice(low, 256).column(i) for i in range(4))
            out = [[], [], [], []]
            for a, c, p, t in zip(anchors.to_pylist(), contents.to_pylist(), place.to_pylist(), texts.to_pylist(), strict=True):
                n = len(t) - length + 1
                offset = np.arange(n)
                key = mix64(Roller(np.frombuffer(t, np.uint8)).all(length) ^ mix64((p - offset).astype(np.uint64) + np.array([a], np.int64).view(np.uint64)))
                for column, values in zip(out, (np.full(n, a), np.full(n, c), offset, key.view(np.int64)), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in out], ["anchor", "content", "low", "string"])


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, contents_in_shard: int = CONTENTS_IN_SHARD,
                    batch_segments: int = BATCH_SEGMENTS) -> DataFrame:
    """Rows (doc, text_hash, runs): for each text with repeats, its runs of starts of repeated strings."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    cut = materialize(keyed.mapInArrow(lambda b: _cut(b, length, gram), _SEGMENTS))
    at = F.struct("doc", "text_hash", "first", "last", "place")
    by_content = cut.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at"))
    by_anchor = cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("anchor")
    contents = materialize(by_content.join(by_anchor, "anchor", "left_semi"))
    several = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # One segment of each content of an anchor with several goes to the shards, with its bytes.
    wanted = contents.join(several, "anchor").select("anchor", "content", "at.*", "m")
    part = F.struct("anchor", "content", "first", "last", "place", "m")
    requests = materialize(wanted.groupBy("doc", "text_hash").agg(F.collect_list(part).alias("parts")))  # at most a text's segments
    side = requests.withColumnRenamed("doc", "doc_")
    asked = keyed.join(bounded(side, "parts", BROADCAST_ENTRIES), "text_hash").where(F.col("doc").eqNullSafe(F.col("doc_")))
    piece = "anchor long, content long, place long, bytes binary, m long"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                rows = []
                for t, parts in zip(*(whole.slice(low, 256).column(i).to_pylist() for i in range(2)), strict=True):
                    raw = t.encode()
                    rows += [(p["anchor"], p["content"], p["place"], raw[p["first"]:p["last"] + length], p["m"]) for p in parts]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor", "content", "place", "bytes", "m"])

    # A row that repeats in the table sends its segments again; their contents do repeat.
    pieces = materialize(asked.select("text", "parts").mapInArrow(fetch, piece))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces.count() // SEGMENTS_IN_SHARD)
    runs = "anchor long, content long, low long, high long"
    sharded = pieces.where(F.col("m") <= contents_in_shard).drop("m").repartition(shards, "anchor").mapInArrow(lambda b: _shard(b, length, batch_segments), runs)
    counted = pieces.where(F.col("m") > contents_in_shard).drop("m").mapInArrow(lambda b: _strings(b, length), "anchor long, content long, low long, string long")
    twice = counted.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
    spread = counted.join(twice, "string", "left_semi").select("anchor", "content", "low", F.col("low").alias("high"))
    whole = contents.where("n > 1").select("anchor", "content", F.lit(0).cast("long").alias("low"), (F.col("at.last") - F.col("at.first")).alias("high"))
    found = whole.unionByName(sharded).unionByName(spread).groupBy("anchor", "content").agg(F.collect_list(F.struct("low", "high")).alias("runs"))  # at most a segment's starts
    found = materialize(found)  # apart from the join, so that a content of very many texts can be split there
    back = cut.join(found, ["anchor", "content"]).select("doc", "text_hash", F.transform("runs", lambda r: F.struct((F.col("first") + r["low"]).alias("low"), (F.col("first") + r["high"]).alias("high"))).alias("runs"))
    out = back.groupBy("doc", "text_hash").agg(F.flatten(F.collect_set("runs")).alias("runs"))  # a text's own segments
    out = materialize(out)
    for table in (cut, contents, requests, pieces, found):
        discard(table)
    return out


def merge_runs(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by strings that start in the given runs, as maximal removed runs."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high + length))
        else:
            out.append((low, high + length))
    return out


REMOVAL = "n_bytes long, n_removed long, kept binary, removed array<struct<start: long, end: long>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, **options) -> DataFrame:
    """Add ``removal``: a text's size in bytes, the removed bytes and ranges, and the bytes that are left.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere
    else, in the same or another document.  Null counts as an empty text; rows that
    repeat are copies of each other.  All rows and columns stay (one named ``removal``
    is replaced); an empty table gives none.  Ids are whole numbers, or texts of such.  A very long text is held whole by the
    task that has it, with some eight-byte arrays as long as the text.
    """
    ranges = repeated_ranges(docs, id_col, text_col, length, gram, **options)
    side = ranges.select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__side"), F.col("runs").alias("__runs"))

    @F.pandas_udf(REMOVAL)
    def remove(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = []
        for t, r in zip(texts, runs, strict=True):
            raw = (t or "").encode()
            spans = merge_runs([(x["low"], x["high"]) for x in r], length) if r is not None else []
            edges = [0, *(e for s in spans for e in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(raw), len(raw) - len(kept), kept, [{"start": a, "end": b} for a, b in spans]))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "kept", "removed"])

    keyed = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = [F.col("__hash") == F.col("__side"), F.col(id_col).cast("long").eqNullSafe(F.col("__doc"))]
    joined = keyed.join(bounded(side, "__runs", BROADCAST_ENTRIES), same, "left")
    return joined.withColumn("removal", remove(F.col(text_col).cast("string"), "__runs")).drop("__hash", "__side", "__doc", "__runs")

