"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words.  A shingle's weight is its count in the text times
a damped inverse document frequency; frequencies are counted over all documents in
a table of fixed size, by hash.  Each hash function of the sketch samples a shingle
consistently (two texts pick the same one with the probability of their weighted
Jaccard similarity); four samples make a band, and texts that share a band meet.

Within a band's bucket all texts are paired with one of them, not with each other.
Pairs are verified on their whole texts by weighted Jaccard similarity; linked texts
form components.  In buckets that still hold several components all others meet one
text of the largest; then all pairs of a bucket that are in different components and
weren't tried yet are compared, but for those that can't be similar: what a text
shares with no other text of such buckets is weight that no pair can have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlark.llm.common import discard, materialize, mix64
from postlark.llm.components import components
from postlark.llm.words import find_words, hash_words, windows

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Document frequencies are counted in so many buckets, whatever the corpus.
FREQUENCY_BITS = 20
#: Weights lie between 1 and 1 + DAMPING: a group's own size can't push its copies apart.
DAMPING = 0.25
#: Pairs whose sketches agree in fewer places (of 64) aren't verified: at 0.8 one in a million has under 36.
LEAST_AGREEMENT = 34
#: Ids that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
TEXTS_AT_ONCE = 64
#: Texts of a bucket that a row holds at once when all pairs are compared.
LIST = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each text's distinct shingles, sorted; one to four words make one shingle."""
    found = find_words(texts)
    hashes = hash_words(found)
    grams, first = windows(hashes, found.bounds, SHINGLE)
    owner = np.searchsorted(found.bounds, first, "right") - 1
    n = np.diff(found.bounds)
    short = np.nonzero((n > 0) & (n < SHINGLE))[0]
    if len(short):
        whole = []
        for i in short:
            own = hashes[found.bounds[i]:found.bounds[i + 1]]
            whole.append(np.bitwise_xor.reduce(mix64(own + np.arange(len(own)).astype(np.uint64) * _ODD)))
        grams, owner = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    starts = np.nonzero(new)[0]
    return owner[starts], grams[starts], np.diff(np.r_[starts, len(grams)])


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them a shingle of each bucket stands.

    Every task counts its rows; the counts are summed by Spark in pieces.
    """
    piece = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << FREQUENCY_BITS, np.int32), 0
        for whole in batches:
            rows += whole.num_rows
            for low in range(0, whole.num_rows, 256):
                owner, grams, _ = shingles(whole.slice(low, 256).column(0).to_pylist())
                pairs = np.unique((owner << FREQUENCY_BITS) | _bucket(grams))
                total += np.bincount(pairs & ((1 << FREQUENCY_BITS) - 1), minlength=len(total)).astype(np.int32)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total) // piece)], pa.int64()), pa.array([np.array([rows], np.int32).tobytes(), *(p.tobytes() for p in total.reshape(-1, piece))], pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(counts, np.int32).astype(np.int64)
                sums[k] = sums[k] + values if k in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["piece", "counts"])

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "piece long, counts binary")
    summed = {r["piece"]: np.frombuffer(r["counts"], np.int64) for r in parts.repartition("piece").mapInArrow(add, "piece long, counts binary").collect()}  # FREQUENCY_BITS fix its size
    n = int(summed.pop(-1, np.zeros(1))[0])
    return n, np.concatenate([summed[k] for k in sorted(summed)]) if summed else np.zeros(1 << FREQUENCY_BITS, np.int64)


def idf(n: int, frequencies: np.ndarray) -> np.ndarray:
    """1 for a shingle of all documents, up to 1 + DAMPING for a rare one."""
    rare = np.log((n + 1) / (frequencies + 1)) / np.log(max(n, 1) + 1) if n else np.zeros(len(frequencies))
    return (1 + DAMPING * np.clip(rare, 0, 1)).astype(np.float32)


class Sketcher:
    """Improved consistent weighted sampling with BANDS x ROWS hash functions.

    For a shingle of weight w, with r and c from Gamma(2, 1) and b uniform, all fixed
    by shingle and function: t = floor(ln w / r + b), ln y = r (t - b), and the sample
    is the shingle of the least ln c - ln y - r, together with its t.
    """

    def __init__(self):
        rng = np.random.default_rng(20240517)
        self.gamma = rng.gamma(2, 1, 4096).astype(np.float32)
        self.inverse = 1 / self.gamma
        self.log_c = np.log(rng.gamma(2, 1, 4096)).astype(np.float32)
        self.keys = mix64(np.arange(1, BANDS * ROWS + 1).astype(np.uint64)) | np.uint64(1)

    def sketch(self, owner: np.ndarray, grams: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """Samples (n x functions), as 32-bit hashes; zeros for texts without shingles."""
        out = np.zeros((n, len(self.keys)), np.uint32)
        if not len(grams):
            return out
        starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
        who, log_w = owner[starts], np.log(weights).astype(np.float32)
        mask = np.uint64(4095)
        for k, key in enumerate(self.keys):
            x = grams * key
            x ^= x >> np.uint64(32)
            x *= _ODD
            x ^= x >> np.uint64(29)
            i = (x & mask).astype(np.intp)
            r = self.gamma[i]
            b = ((x >> np.uint64(12)) & np.uint64(0xFFFFF)).astype(np.float32) * np.float32(2.0**-20)
            t = np.floor(log_w * self.inverse[i] + b)
            a = self.log_c[((x >> np.uint64(32)) & mask).astype(np.intp)] - r * (t - b + 1) + np.float32(256)
            sample = (x >> np.uint64(32)) ^ ((t.astype(np.int64) + 7).astype(np.uint64) * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF))
            packed = (np.maximum(a, 0).view(np.uint32).astype(np.uint64) << np.uint64(32)) | sample
            out[who, k] = np.minimum.reduceat(packed, starts).astype(np.uint32)
        return out

    @staticmethod
    def bands(samples: np.ndarray) -> np.ndarray:
        out = np.zeros((len(samples), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(samples), band + 1, np.uint64) * _ODD
            for row in range(ROWS):
                key = mix64(key ^ samples[:, band * ROWS + row].astype(np.uint64))
            out[:, band] = key
        return out.view(np.int64)


def similarities(left: list[str | None], right: list[str | None], weight_of: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; 0 if one has no shingle."""
    n = len(left)
    owner, grams, counts = shingles([*left, *right])
    weights = counts * weight_of[_bucket(grams)].astype(np.float64)
    total = np.bincount(owner % n, weights, n)
    order = np.lexsort((grams, owner % n))
    pair, grams, weights = (owner % n)[order], grams[order], weights[order]
    same = np.nonzero((pair[1:] == pair[:-1]) & (grams[1:] == grams[:-1]))[0]
    shared = np.bincount(pair[same], np.minimum(weights[same], weights[same + 1]), n)
    return np.divide(shared, total - shared, out=np.zeros(n), where=total > shared)


def _sketches(docs: DataFrame, shared) -> DataFrame:
    """(id, text_key, bands, samples, total) of all rows, total being the weight of all shingles; null bands for texts without words."""

    @F.pandas_udf("bands array<long>, samples binary, total double")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Sketcher()
        for texts in batches:
            bands, samples, total = [], [], []
            for low in range(0, len(texts), TEXTS_AT_ONCE):
                part = texts.iloc[low:low + TEXTS_AT_ONCE].tolist()
                owner, grams, counts = shingles(part)
                weights = counts * shared.value[_bucket(grams)].astype(np.float64)
                found = own.sketch(owner, grams, weights, len(part))
                total += np.bincount(owner, weights, len(part)).tolist()
                has = np.isin(np.arange(len(part)), owner)
                bands += [b if h else None for b, h in zip(own.bands(found), has, strict=True)]
                samples += [s.tobytes() if h else None for s, h in zip(found, has, strict=True)]
            yield pd.DataFrame({"bands": bands, "samples": samples, "total": np.array(total, np.float64)})

    return docs.withColumn("s", sketch("text")).select("id", "text_key", "s.bands", "s.samples", "s.total")


def _verified(pairs: DataFrame, texts: DataFrame, shared, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose texts are similar."""

    @F.pandas_udf("double")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            found = [similarities(left.iloc[i:i + TEXTS_AT_ONCE].tolist(), right.iloc[i:i + TEXTS_AT_ONCE].tolist(), shared.value) for i in range(0, len(left), TEXTS_AT_ONCE)]
            yield pd.Series(np.concatenate(found) if found else [], dtype="float64")

    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.withColumn("similarity", similar("text_a", "text_b")).where(F.col("similarity") >= similarity).select("a", "b")


@F.pandas_udf(T.LongType())
def _agreement(left: pd.Series, right: pd.Series) -> pd.Series:
    a = np.frombuffer(b"".join(left), np.uint32).reshape(len(left), -1)
    return pd.Series((a == np.frombuffer(b"".join(right), np.uint32).reshape(a.shape)).sum(1), dtype="int64")


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) of two components, with these (ca, cb)."""
    return pairs.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").where("ca <> cb")


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels after new links: components of components, only new links count.  Both tables go."""
    if found.isEmpty():
        discard(found)
        return labels
    joined = components(_between(found, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    fresh = materialize(labels.join(joined.toDF("component", "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component")))
    for old in (labels, joined, found):
        discard(old)
    return fresh


def _groups(placed: DataFrame) -> DataFrame:
    """(band, main, rep, outside) of bands with several components: the largest one, one text of it, and how many texts are outside it."""
    counts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.min("text_key").alias("rep"))
    return counts.groupBy("band").agg(F.max(F.struct("n", "component", "rep")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("c")).where("c > 1").selectExpr("band", "top.component main", "top.rep rep", "all - top.n outside")


def _alone(texts: DataFrame, shared) -> DataFrame:
    """(text_key, alone): the weight of the shingles that no other of these texts (text_key, text) has; texts without such are left out."""
    def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, TEXTS_AT_ONCE):
                keys, part = (whole.slice(low, TEXTS_AT_ONCE).column(i) for i in range(2))
                owner, grams, counts = shingles(part.to_pylist())
                weights = counts * shared.value[_bucket(grams)].astype(np.float64)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(grams.view(np.int64)), pa.array(weights)], ["text_key", "gram", "weight"])

    rows = texts.select("text_key", "text").mapInArrow(shingle_rows, "text_key binary, gram long, weight double")
    once = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("text_key").alias("text_key"), F.min("weight").alias("weight")).where("n = 1")
    return once.groupBy("text_key").agg(F.sum("weight").alias("alone"))


def _untried(member: DataFrame, labels: DataFrame, limits: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts that share a band, are in different components and may be similar.

    ``limits`` gives each text's weight and how much of it another text can share.  One
    of two components at least is not the band's largest, so all members meet lists of
    those outside it.
    """
    # A text can't be similar to any other if less than that part of its weight can be shared.
    able = limits.where(F.col("common") >= similarity * F.col("total") * (1 - 1e-6))
    placed = materialize(member.join(labels.withColumnRenamed("node", "text_key"), "text_key").join(able, "text_key"))
    sizes = materialize(_groups(placed))
    part = F.pmod(F.xxhash64("text_key"), F.ceil(F.col("outside") / LIST))
    lists = placed.join(sizes, "band").where("component <> main").groupBy("band", part.alias("part")).agg(F.collect_list(F.struct("text_key", "component", "total", "common")).alias("others"))  # about LIST of them

    def possible(o: Column) -> Column:
        most = F.least(o["common"], F.col("common"))
        return (o["component"] != F.col("component")) & (most >= similarity * (o["total"] + F.col("total") - most) * (1 - 1e-6))

    met = placed.join(lists, "band").select("text_key", F.explode(F.filter("others", possible)).alias("o"))
    out = materialize(met.select(F.least("text_key", "o.text_key").alias("a"), F.greatest("text_key", "o.text_key").alias("b")).distinct())
    discard(placed)
    discard(sizes)
    return out


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(id, text_key, component) of each row: the key of its text, and the smallest key of the text's class."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("text_key"), text.alias("text"))
    shared = spark.sparkContext.broadcast(idf(*document_frequencies(docs, text_col)))  # 4 MB
    rows = materialize(_sketches(keyed, shared))
    unique = materialize(rows.where("bands is not null").groupBy("text_key").agg(F.first("bands").alias("bands"), F.first("samples").alias("samples"), F.first("total").alias("total")))
    member = unique.select("text_key", F.explode("bands").alias("band"))
    common = member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    member = materialize(member.join(common, "band"))
    candidates = materialize(member.select("text_key").distinct())
    side = F.broadcast(candidates) if candidates.count() <= BROADCAST_IDS else candidates
    texts = materialize(keyed.join(side, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text")))
    samples = materialize(unique.join(candidates, "text_key", "left_semi").select("text_key", "samples", "total"))
    discard(unique)

    def likely(pairs: DataFrame) -> DataFrame:
        sketches = samples.select("text_key", "samples")
        return materialize(pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b").where(_agreement("sa", "sb") >= LEAST_AGREEMENT).select("a", "b"))

    labels = materialize(candidates.select(F.col("text_key").alias("node"), F.col("text_key").alias("component")))
    # First each text meets the smallest of all its buckets, by hash.
    least = member.groupBy("band").agg(F.min(F.struct(F.xxhash64("text_key").alias("h"), "text_key")).alias("r"))
    first = member.join(least, "band").groupBy(F.col("text_key").alias("x")).agg(F.min("r.text_key").alias("y")).where("x <> y")
    first = likely(first.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    labels = _merged(labels, materialize(_verified(first, texts, shared, similarity)))
    # Then one text of the largest component of each of its buckets, if it is outside that.
    placed = member.join(labels.withColumnRenamed("node", "text_key"), "text_key")
    outside = placed.join(_groups(placed), "band").where("component <> main").select(F.least("text_key", "rep").alias("a"), F.greatest("text_key", "rep").alias("b")).distinct()
    second = likely(outside.join(first, ["a", "b"], "left_anti"))
    labels = _merged(labels, materialize(_verified(second, texts, shared, similarity)))
    # Last, all that wasn't tried: one pair of each two components first, then those that still are between components.
    placed = member.join(labels.withColumnRenamed("node", "text_key"), "text_key")
    open_ = materialize(placed.join(_groups(placed).select("band"), "band", "left_semi").select("text_key").distinct())
    alone = _alone(texts.join(open_, "text_key", "left_semi"), shared)
    limits = materialize(samples.join(open_, "text_key", "left_semi").join(alone, "text_key", "left").select("text_key", "total", (F.col("total") - F.coalesce("alone", F.lit(0.0))).alias("common")))
    untried = _untried(member, labels, limits, similarity)
    left = likely(untried.join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti"))
    apart = _between(left, labels)
    one = materialize(apart.groupBy(F.least("ca", "cb").alias("c"), F.greatest("ca", "cb").alias("d")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"))
    labels = _merged(labels, materialize(_verified(one, texts, shared, similarity)))
    rest = materialize(_between(left, labels).select("a", "b").join(one, ["a", "b"], "left_anti"))
    labels = _merged(labels, materialize(_verified(rest, texts, shared, similarity)))
    for old in (first, second, open_, limits, untried, left, one, rest):
        discard(old)
    classes = rows.select("id", "text_key").join(labels.withColumnRenamed("node", "text_key"), "text_key", "left").select("id", "text_key", F.coalesce("component", "text_key").alias("component"))
    classes = materialize(classes)
    for old in (rows, member, candidates, texts, samples, labels):
        discard(old)
    return classes


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``id_col``, ``class_id`` (the smallest id of its class) and ``n_class`` (rows in the class).

    A class holds equal texts and all texts joined by links of at least
    ``similarity``.  Null counts as an empty text; texts without words are like equal
    texts only; of one to four words, like texts of the same words.  Rows that
    repeat, repeated and null ids have their rows; a class of null ids only has a
    null class id.  An empty table gives no rows.
    """
    classes = _classes(docs, id_col, text_col, similarity)
    sizes = classes.groupBy("component").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_class"))
    return classes.join(sizes, "component").select(F.col("id").alias(id_col), "class_id", "n_class")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of near-duplicates: that of the smallest id, null last, then of the smallest hash of the text.

    A row is what its id and text are: different texts of one id, or of no id, are
    documents of their own.  Of rows that are equal in both, one stays.  All columns stay.
    """
    classes = _classes(docs, id_col, text_col, similarity)
    row = F.struct(F.col("id").isNull().alias("last"), "id", "text_key")
    kept = classes.groupBy("component").agg(F.min(row).alias("k")).select("k.id", "k.text_key")
    counts = classes.groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    same = lambda a, b: a["text_key"].eqNullSafe(b["text_key"]) & a["id"].eqNullSafe(b["id"])
    marked = materialize(counts.alias("a").join(kept.alias("b"), same({c: F.col(f"a.{c}") for c in ("id", "text_key")}, {c: F.col(f"b.{c}") for c in ("id", "text_key")}), "left").select(F.col("a.id").alias("__id"), F.col("a.text_key").alias("__key"), F.col("a.n").alias("__n"), F.col("b.text_key").isNotNull().alias("__kept")))
    side = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    here = (_text_key(text_col) == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__id"))
    out = docs.join(side(marked.where("not __kept").select("__id", "__key")), here, "left_anti")
    repeated = marked.where("__kept and __n > 1").select("__id", "__key")
    if repeated.isEmpty():
        return out
    repeated = side(repeated)
    again = out.join(repeated, here, "left_semi").withColumn("__key", _text_key(text_col)).dropDuplicates([id_col, "__key"]).drop("__key")
    return out.join(repeated, here, "left_anti").unionByName(again)
