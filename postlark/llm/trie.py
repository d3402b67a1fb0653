"""Prefix trie of conversations: MSD radix partitioning in Spark, multikey quicksort in the tasks.

Turns become ids of a dictionary.  All conversations are one bucket, the root's.  A bucket that
is too large for one task is split by the id that follows the prefix all its members
share: its node and those of the shared prefix come from sums over the bucket, members
that are large again make buckets of the next round, and all others are dealt out by
the radix digit of that id.  What is dealt out is local: a multikey quicksort orders it,
and its recursion emits the nodes.  Equal conversations count as one with a number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from postlark.llm.common import discard, materialize

#: A bucket is local if it has at most so many turn ids, or so few conversations.
LOCAL_IDS, LEAST_IDS, FEW = 1_000_000, 1_000, 16
#: Rows of buckets that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
NODE = "bucket binary, is_node boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, seq_key binary"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, n_words): each conversation's turns by number, null first.

    Equal numbers stand by role, by the text's first 64 characters, then by a hash; ``key``
    identifies (role, text), null counting as empty.  Rows without a conv_id belong to no
    conversation.  Texts aren't shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("begin"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("key"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("n_words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "begin", "key")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "key", "n_words")


def lend_openings(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<pos,key,n_words>>): conversations that begin with turns of every twentieth one.

    The first h turns of conversation c are those of c - c mod 20 (all if it has fewer,
    none if there is no such), h being crc32(c) mod 4; c's own turns follow from its
    h-th on.  A conversation may be left without turns.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "n_words"))).alias("turns"))
    lent = own.where("pmod(conv_id, 20) = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("opening"))
    both = own.withColumn("base", F.expr("conv_id - pmod(conv_id, 20)")).join(lent, "base", "left")
    opening = F.filter(F.coalesce("opening", F.array().cast(own.schema["turns"].dataType)), lambda t: t["pos"] < h)
    return both.select("conv_id", F.concat(opening, F.filter("turns", lambda t: t["pos"] >= h)).alias("turns"))


def encoded(sequences: DataFrame) -> DataFrame:
    """(conv_id, seq_key, ids, words) with the turns as ids of a dictionary; (conv_id, turns) as :func:`lend_openings` gives them."""
    flat = materialize(sequences.select("conv_id", F.posexplode_outer("turns").alias("at", "t")).select("conv_id", "at", "t.key", "t.n_words"))
    dictionary = materialize(flat.where("key is not null").groupBy("key").agg(F.min("n_words").alias("n_words")).select("key", "n_words", F.monotonically_increasing_id().alias("id")))
    coded = flat.where("key is not null").select("conv_id", "at", "key").join(_small(dictionary), "key").select("conv_id", F.struct("at", "id", "n_words").alias("t"))
    bare = flat.where("key is null").select("conv_id", F.lit(None).cast(coded.schema["t"].dataType).alias("t"))
    lists = coded.unionByName(bare).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    lists = lists.select("conv_id", F.col("t.id").alias("ids"), F.col("t.n_words").alias("words"))
    out = materialize(lists.select("conv_id", F.unhex(F.md5(F.array_join(F.col("ids").cast("array<string>"), ","))).alias("seq_key"), "ids", "words"))
    discard(flat)
    discard(dictionary)
    return out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _finished(depth: int, ids: list[list[int]], words: list[list[int]], n: list[int], conv: list[int]) -> dict[str, list]:
    """Nodes below a node of ``depth`` that all these different sequences have; parents come before children.

    A multikey quicksort: three parts by the id at one depth, of which the middle one is
    a node and goes on one deeper.
    """
    out: dict[str, list] = {k: [] for k in ("parent", "depth", "conv", "n", "own", "end")}

    def node(parent: int, at: int, least: int, count: int, tokens: int) -> int:
        for k, v in zip(out, (parent, at, least, count, (count - 1) * tokens, -1), strict=True):
            out[k].append(v)
        return len(out["n"]) - 1

    stack = [(list(range(len(ids))), depth, -1)]
    while stack:
        rows, d, parent = stack.pop()
        if len(rows) == 1:
            r = rows[0]
            for at in range(d, len(ids[r])):
                parent = node(parent, at + 1, conv[r], n[r], words[r][at])
            if parent >= 0:
                out["end"][parent] = r
            continue
        key = {r: ids[r][d] if d < len(ids[r]) else -1 for r in rows}
        pivot = sorted((key[rows[0]], key[rows[len(rows) // 2]], key[rows[-1]]))[1]
        less, same, more = [r for r in rows if key[r] < pivot], [r for r in rows if key[r] == pivot], [r for r in rows if key[r] > pivot]
        stack += [(part, d, parent) for part in (less, more) if part]
        if pivot >= 0:
            stack.append((same, d + 1, node(parent, d + 1, min(conv[r] for r in same), sum(n[r] for r in same), words[same[0]][d])))
        elif parent >= 0:
            out["end"][parent] = same[0]
    size = len(out["n"])
    out["children"], out["leaves"], out["saved"] = [0] * size, [0] * size, out["own"][:]
    for k in range(size - 1, -1, -1):
        out["leaves"][k] = out["leaves"][k] or 1
        if (p := out["parent"][k]) >= 0:
            out["children"][p] += 1
            out["leaves"][p] += out["leaves"][k]
            out["saved"][p] += out["saved"][k]
    return out


def _finish_bucket(table: pa.Table) -> pa.Table:
    """Nodes of a local bucket, and one row that sums them for the node it hangs from."""
    c = {k: table.column(k).to_pylist() for k in ("ids", "words", "n", "conv", "seq_key")}
    bucket, depth, above = (table.column(k)[0].as_py() for k in ("bucket", "depth", "above"))
    f = _finished(depth, c["ids"], c["words"], c["n"], c["conv"])
    top = [k for k, p in enumerate(f["parent"]) if p < 0]
    size = len(f["n"])
    columns = [
        [bucket] * (size + 1), [True] * size + [False], [*f["depth"], depth], [*f["conv"], None], [above if p < 0 else f["conv"][p] for p in f["parent"]] + [None], [*f["n"], 0],
        [*f["children"], len(top)], [*f["leaves"], sum(f["leaves"][k] for k in top)], [*f["saved"], sum(f["saved"][k] for k in top)], [c["seq_key"][e] if e >= 0 else None for e in f["end"]] + [None],
    ]
    long = pa.int64()
    types = [pa.binary(), pa.bool_(), long, long, long, long, long, long, long, pa.binary()]
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=[p.split()[0] for p in NODE.split(", ")])


def _ends(sequences: DataFrame) -> DataFrame:
    """(seq_key, ends_sha256): of the ids of equal conversations, ascending, comma-joined; a hash reads them one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha = None, None
        for batch in batches:
            keys, out = [], []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != current:
                    if sha:
                        keys.append(current)
                        out.append(sha.hexdigest())
                    current, sha = key, hashlib.sha256(str(conv).encode())
                else:
                    sha.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["seq_key", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["seq_key", "ends_sha256"])

    return sequences.select("seq_key", "conv_id").repartition("seq_key").sortWithinPartitions("seq_key", "conv_id").mapInArrow(run, "seq_key binary, ends_sha256 string")


def _shared(a, b):
    """How many ids two arrays have in common from their beginning."""
    unlike = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(unlike > 0, unlike - 1).otherwise(F.size(a))


def prefix_trie(sequences: DataFrame, local_ids: int | None = None) -> DataFrame:
    """One row for each distinct beginning of a conversation; ``sequences`` as :func:`encoded` gives them, one row a conversation.

    conv_id (smallest member), depth (turns; the root has 0), parent_conv_id (null for the
    root), n_convs, n_children, n_leaves and saved_tokens of the node's subtree,
    ends_sha256 of the conversations that end there.  No conversations give no rows.
    A conversation's ids are one row; at most ``local_ids`` of a bucket meet in a task.
    """
    spark = sequences.sparkSession
    whole = materialize(sequences.groupBy("seq_key").agg(F.first("ids").alias("ids"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")))
    total = whole.agg(F.sum(F.size("ids"))).first()[0] or 0
    local_ids = local_ids or min(LOCAL_IDS, max(LEAST_IDS, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    root = F.lit(b"root")
    rows, buckets = whole.withColumn("bucket", root), None
    global_nodes, local_rows, old = [], [], []
    while True:
        stats = rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min("ids").alias("lo"), F.max("ids").alias("hi"), F.first("words").alias("words"))
        if buckets is None:
            found = stats.select("bucket", F.array("bucket").alias("path"), F.lit(-1).alias("from"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("above"), "conv", "n", F.array(F.lit(0).cast("long")).alias("tokens"))
        else:
            found = stats.join(buckets, "bucket").withColumn("depth", _shared("lo", "hi")).select("bucket", "path", "from", "depth", "above", "conv", "n", F.expr("slice(words, from + 1, depth - from)").alias("tokens"))
        found = materialize(found)
        side = _small(found.select("bucket", "depth", F.col("conv").alias("above")))
        placed = rows.join(side, "bucket")
        ended = placed.where("size(ids) = depth").select("bucket", "seq_key")
        going = placed.where("size(ids) > depth").withColumn("turn", F.get("ids", F.col("depth")))
        kids = materialize(going.groupBy("bucket", "turn").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("ids") - F.col("depth")).alias("size")))
        large = (F.col("m") > FEW) & (F.col("size") > local_ids)
        sums = kids.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_children"), F.ceil(F.sum(F.when(~large, F.col("size"))) / local_ids).alias("digits"))
        global_nodes.append(materialize(found.join(ended, "bucket", "left").join(sums.drop("digits"), "bucket", "left").fillna(0, ["n_children"])))
        big = materialize(kids.where(large).select("bucket", "turn"))
        child = F.unhex(F.md5(F.concat(F.hex("bucket"), F.lit(":"), F.col("turn").cast("string"))))
        digit = F.pmod(F.xxhash64("turn"), F.greatest("digits", F.lit(1)))
        rest = going.join(_small(big), ["bucket", "turn"], "left_anti").join(_small(sums.select("bucket", "digits")), "bucket")
        local_rows.append(materialize(rest.select("bucket", digit.alias("digit"), "depth", "above", "seq_key", "ids", "words", "n", "conv")))
        more = not big.isEmpty()
        if more:
            onward = materialize(going.join(_small(big), ["bucket", "turn"]).select(child.alias("bucket"), "seq_key", "ids", "words", "n", "conv"))
            buckets = materialize(big.join(found, "bucket").select(child.alias("bucket"), F.concat("path", F.array(child)).alias("path"), F.col("depth").alias("from"), F.col("conv").alias("above")))
            old += [buckets]
        for done in [found, kids, big] + [rows] * (len(global_nodes) > 1):
            discard(done)
        if not more:
            break
        rows = onward
    made = materialize(reduce(DataFrame.unionByName, local_rows).groupBy("bucket", "digit").applyInArrow(_finish_bucket, NODE))
    trunk = reduce(DataFrame.unionByName, global_nodes)
    # What hangs from a node of the trunk: its local buckets, and all trunk nodes below it.
    below = made.where("not is_node").join(trunk.select("bucket", "path"), "bucket").select("path", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    own = trunk.select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.lit(0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("saved"))
    sums = below.unionByName(own).select(F.explode("path").alias("bucket"), "leaves", "saved").groupBy("bucket").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    chain = trunk.join(sums, "bucket", "left").fillna(0, ["leaves", "saved"]).select("*", F.posexplode("tokens").alias("at", "__t"))
    last = F.col("at") == F.size("tokens") - 1
    rest_tokens = F.aggregate(F.expr("slice(tokens, at + 1, size(tokens))"), F.lit(0).cast("long"), lambda a, x: a + x)
    chain = chain.select(
        (F.col("from") + 1 + F.col("at")).cast("long").alias("depth"), F.col("conv").alias("conv_id"), F.when(F.col("at") == 0, F.col("above")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), F.greatest("leaves", F.lit(1)).alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * rest_tokens).alias("saved_tokens"), F.when(last, F.col("seq_key")).alias("seq_key"))
    nodes = materialize(chain.unionByName(made.where("is_node").drop("bucket", "is_node")))
    for done in [whole, made, *old, *global_nodes, *local_rows]:
        discard(done)
    with_ends = nodes.where("seq_key is not null").join(_ends(sequences), "seq_key").drop("seq_key")
    return with_ends.unionByName(nodes.where("seq_key is null").drop("seq_key").withColumn("ends_sha256", F.lit(EMPTY_SHA256)))
