"""Benchmark decontamination by spaced seeds.

Fixed masks pick some of a window's words and ignore the rest, so a substituted
word spoils only the seeds that pick it.  Seed hashes of the benchmark are joined
with those of all documents; each hit proposes an alignment of an item with a
document, and the words along that alignment are compared: an overlap counts if it
has enough words and few substitutions.

Most seeds of documents are in no item.  A Bloom filter of at most 2**MOST_BITS bits,
however large the benchmark, tells those from the rest where they arise; what passes
is joined by shuffle, seeds and items that many documents hold in several
parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.llm.common import bounded, discard, materialize
from postlark.llm.words import find_words, hash_words

#: 1: the word counts, 0: it may differ.  Every overlap of ten words or more has a window that one of them fits (a test goes through all).
MASKS = ("11111", "110111", "1011011", "1101011001", "11100110101")
MIN_WORDS, MIN_IDENTITY = 10, 0.8
#: An item of fewer words is too little to go by.
LEAST_WORDS = 5
HITS = "array<struct<item_id: long, start: long, n_words: long, n_same: long>>"
#: Bits for each seed of the benchmark, and the most bits in all (16 MB); a fuller table lets more seeds through to the join.
BITS_A_SEED, MOST_BITS = 32, 27
#: A seed marks the bits that its own bits from these on name.
MARKS = (0, 19, 37)
#: Rows of one key that a task of a join takes; a key with more goes to several.
PART_ROWS = 20_000
#: Entries that may be broadcast; more are joined by shuffle.
BROADCAST_ENTRIES = 500_000
#: Texts whose words are looked up together.
TEXTS_AT_ONCE = 256
_STEP = np.uint64(0xD6E8FEB86659FD93)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of the words a mask picks, for every place where its window fits."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1" and n > 0:
            out = (out ^ hashes[k:k + n]) * _STEP
            out ^= out >> np.uint64(31)
    return out


def overlap(words: np.ndarray, item: np.ndarray, shift: int, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> tuple[int, int, int] | None:
    """Start, length and equal words of the stretch with most equal words among those of enough identity, if these are enough.

    ``shift`` is where the item's first word stands in the text (negative: before it).
    """
    low, high = max(0, shift), min(len(words), shift + len(item))
    if high <= low:
        return None
    same = words[low:high] == item[low - shift:high - shift]
    equal = np.r_[0, np.cumsum(same)]
    if equal[-1] < min(min_words, len(item)):
        return None
    # A stretch has enough identity if the balance doesn't fall from its start to its end.
    share = round(min_identity * 1000)
    balance = np.r_[0, np.cumsum(np.where(same, 1000 - share, -share))]
    first = np.searchsorted(-np.minimum.accumulate(balance), -balance, "left")  # the first start that will do for each end
    end = int(np.argmax(equal - equal[first]))
    start = int(first[end])
    n_same = int(equal[end] - equal[start])
    if n_same < min(min_words, len(item)):
        return None
    at = start + np.nonzero(same[start:end])[0]
    return low + int(at[0]), int(at[-1] - at[0]) + 1, n_same


def _item_words(items: DataFrame) -> DataFrame:
    """(id, text_hash, words) of items with enough words: word hashes as signed integers."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = find_words(rows["text"].tolist())
            hashes = hash_words(found).view(np.int64)
            parts = [hashes[a:b] for a, b in zip(found.bounds, found.bounds[1:])]  # noqa: B905
            out = pd.DataFrame({"id": rows["id"].to_numpy(), "text_hash": rows["text_hash"].to_numpy(), "words": parts})
            yield out[[len(p) >= LEAST_WORDS for p in parts]]

    return items.mapInPandas(words, "id long, text_hash long, words array<long>")


def _item_seeds(words: DataFrame) -> DataFrame:
    """(seed, id, text_hash, place) for every window of every item."""

    def seed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                hashes = np.asarray(row.words, np.int64).view(np.uint64)
                for mask in MASKS:
                    found = seeds(hashes, mask).view(np.int64)
                    yield pd.DataFrame({"seed": found, "id": row.id, "text_hash": row.text_hash, "place": np.arange(len(found))})

    return words.mapInPandas(seed_rows, "seed long, id long, text_hash long, place long").distinct()


def _bit_table(item_seeds: DataFrame) -> tuple[np.ndarray, int]:
    """Words of 64 bits, in which each seed marks some, and how many of a seed's bits name one."""
    n = item_seeds.count()
    size = min(MOST_BITS, max(16, int(n * BITS_A_SEED).bit_length()))
    places = F.array(*(F.shiftrightunsigned("seed", k).bitwiseAND(F.lit((1 << size) - 1).cast("long")) for k in MARKS))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    marked = item_seeds.select(F.explode(places).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    rows = marked.toPandas()  # at most 2**MOST_BITS / 64 rows
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bits, size


def _document_seeds(texts: DataFrame, bits: np.ndarray, size: int) -> DataFrame:
    """(k1, k2, seed, at): the seeds of the texts that the bits let through."""
    shared, low_bits = texts.sparkSession.sparkContext.broadcast(bits), np.uint64((1 << size) - 1)

    def seed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for batch in batches:
            for low in range(0, len(batch), TEXTS_AT_ONCE):
                rows = batch.iloc[low:low + TEXTS_AT_ONCE]
                found = find_words(rows["text"].tolist())
                hashes, bounds = hash_words(found), found.bounds
                for mask in MASKS:
                    own = seeds(hashes, mask)
                    hit = np.arange(len(own))
                    for k in MARKS:
                        place = own[hit] >> np.uint64(k) & low_bits
                        hit = hit[table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1]
                    text = np.searchsorted(bounds, hit, "right") - 1
                    inside = hit + len(mask) <= bounds[text + 1]
                    hit, text = hit[inside], text[inside]
                    if len(hit):
                        yield pd.DataFrame({"k1": rows["k1"].to_numpy()[text], "k2": rows["k2"].to_numpy()[text], "seed": own[hit].view(np.int64), "at": hit - bounds[text]})

    return texts.mapInPandas(seed_rows, "k1 long, k2 long, seed long, at long")


def _join_in_parts(many: DataFrame, few: DataFrame, on: list[str], part_by: Column, part_rows: int) -> DataFrame:
    """Inner join; a key with over ``part_rows`` rows of ``many``, a written table, is dealt to several tasks, and its rows of
    ``few`` go to each."""
    if many.count() <= part_rows:  # no key can have more
        return many.join(few, on)
    hot = many.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("parts")).where("parts > 1")
    hot = materialize(hot)
    if hot.isEmpty():
        return many.join(few, on)
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ENTRIES else hot
    left = many.join(hot, on, "left").withColumn("part", F.pmod(part_by, F.coalesce("parts", F.lit(1)))).drop("parts")
    right = few.join(hot, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [*on, "part"]).drop("part")


def _verified(texts: pd.Series, candidates: pd.Series) -> pd.Series:
    """The overlaps of each text, the best of each item; texts without candidates come as null."""
    out: list[list] = [[] for _ in range(len(texts))]
    rows = np.nonzero([c is not None for c in candidates])[0]
    for low in range(0, len(rows), TEXTS_AT_ONCE):
        own = rows[low:low + TEXTS_AT_ONCE]
        found = find_words(texts.iloc[own].tolist())
        hashes = hash_words(found).view(np.int64)
        for k, row in enumerate(own):
            words, best = hashes[found.bounds[k]:found.bounds[k + 1]], {}
            for item in candidates.iloc[row]:
                item_words = np.asarray(item["words"], np.int64)
                for shift in item["shifts"]:
                    hit = overlap(words, item_words, int(shift))
                    if hit and (item["id"] not in best or (hit[2], -hit[0]) > (best[item["id"]][2], -best[item["id"]][0])):
                        best[item["id"]] = hit
            out[row] = [dict(item_id=i, start=h[0], n_words=h[1], n_same=h[2]) for i, h in sorted(best.items())]
    return pd.Series(out)


def candidates(texts: DataFrame, items: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(k1, k2, items): for each text (k1, k2, text) the items (id, text_hash, text) whose seeds it holds, with their words
    and the places where their first words would stand."""
    words = materialize(_item_words(items))
    item_seeds = materialize(_item_seeds(words))
    # Copies of a text are one from here on, most of them before the shuffle.
    found = materialize(_document_seeds(texts, *_bit_table(item_seeds)).distinct())
    met = _join_in_parts(found, item_seeds, ["seed"], F.xxhash64("k1", "at"), part_rows)
    pairs = met.select("k1", "k2", "id", "text_hash", (F.col("at") - F.col("place")).alias("shift")).distinct()
    pairs = materialize(pairs.groupBy("k1", "k2", "id", "text_hash").agg(F.collect_list("shift").alias("shifts")))  # a text's own places
    with_words = _join_in_parts(pairs, words, ["id", "text_hash"], F.xxhash64("k1"), part_rows)
    out = materialize(with_words.groupBy("k1", "k2").agg(F.collect_list(F.struct("id", "shifts", "words")).alias("items")))  # a text's own items
    for table in (words, item_seeds, found, pairs):
        discard(table)
    return out


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``hits``: the benchmark items that a document overlaps, with the best overlap's place and size in words.

    An overlap has at least 10 equal words (all of a shorter item) and at most one
    in five substituted; that with most equal words, then the first, is the best.
    Items under five words and items without an id are too little to go by and never
    match; null texts match nothing.  Copies of an item count under each id.  All
    rows and columns of ``docs`` stay (one named ``hits`` is replaced).  Item ids are
    whole numbers.  A seed or an item with over ``part_rows`` places or texts is
    joined in several tasks.
    """
    text = F.col(text_col).cast("string")
    keys = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.xxhash64(F.col(item_text).cast("string")).alias("text_hash"), F.col(item_text).cast("string").alias("text")).distinct()
    texts = docs.where(text.isNotNull()).select(keys[0].alias("k1"), keys[1].alias("k2"), text.alias("text"))
    side = candidates(texts, items, part_rows).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("items").alias("__items"))
    entries = side.select("__k1", "__k2", "__items", F.flatten(F.transform("__items", lambda i: i["words"])).alias("__all"))
    side = bounded(entries, "__all", BROADCAST_ENTRIES).drop("__all")
    joined = docs.withColumns({"__h1": F.when(text.isNotNull(), keys[0]), "__h2": F.when(text.isNotNull(), keys[1])}).join(side, [F.col("__h1") == F.col("__k1"), F.col("__h2") == F.col("__k2")], "left")
    hits = F.pandas_udf(_verified, HITS)(F.when(F.col("__items").isNotNull(), text), F.col("__items"))
    return joined.withColumn("hits", hits).select(*[c for c in docs.columns if c != "hits"], "hits")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pairs of document and item that overlap."""
    return with_hits(docs, benchmark).where(F.size("hits") > 0).select(id_col, F.explode("hits").alias("hit")).select(id_col, "hit.*")
