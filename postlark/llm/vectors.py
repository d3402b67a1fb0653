"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and cut into blocks of eight dimensions.  Two vectors with a
cosine of at least s are at most 2 (1 - s) apart (squared), so in one block at least they
are apart by no more than that block's share, in proportion to its dimensions.  Each
block is a range join of its own: vectors lie in cells as wide as the block's distance
along its first coordinate, and only equal and neighbouring cells meet, in tiles of
bounded size.  A pair belongs to the first block whose budget it keeps to, so the union
of all blocks' candidates has it once, and it is verified there on the given vectors.

A task counts the links of a tile's vectors and passes on one edge for each vector and
linked group, so that n near copies make no n * n rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlark.llm.common import discard, materialize
from postlark.llm.components import components

COSINE = 0.93
BLOCK = 8
#: Vectors of a tile, from few to many.
TILES = 2048, 8192
#: Cells that may be broadcast; more are joined by shuffle.
BROADCAST_CELLS = 100_000
#: Pairs whose vectors are in memory at once.
PAIRS = 1 << 15
#: What rounding may add to a squared distance of unit vectors.
SLACK = 1e-7


@lru_cache
def rotation(dims: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    return np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))[0]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; zeros for rows that are zero or not finite."""
    v = vectors.astype(np.float64)
    largest = np.abs(v).max(axis=1, initial=0)
    good = np.isfinite(largest) & (largest > 0)
    v[~good] = 0
    v[good] /= largest[good, None]
    v[good] /= np.sqrt((v[good] ** 2).sum(axis=1))[:, None]
    return v


class Blocks:
    """How vectors of so many dimensions are cut, and what each block's squared distance may be."""

    def __init__(self, dims: int, cosine: float):
        self.bounds = [(low, min(low + BLOCK, dims)) for low in range(0, dims, BLOCK)]
        self.budgets = np.array([2 * (1 - cosine) * (high - low) / dims + SLACK for low, high in self.bounds])
        self.widths = np.sqrt(self.budgets) * (1 + SLACK)

    def cells(self, rotated: np.ndarray) -> np.ndarray:
        """Each vector's cell in each block."""
        return np.floor(rotated[:, [low for low, _ in self.bounds]] / self.widths).astype(np.int32)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distance of pairs, block by block."""
        square = (a - b) ** 2
        return np.stack([square[:, low:high].sum(axis=1) for low, high in self.bounds], axis=1)


def linked_pairs(a: np.ndarray, b: np.ndarray, same: bool, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``a``, in ``b``) of the linked pairs that belong to a block; of one tile with itself each pair once."""
    dims = a.shape[1]
    blocks, turn = Blocks(dims, cosine), rotation(dims)
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ turn, ub @ turn
    low, high = blocks.bounds[block]
    xa, xb = ra[:, low:high], rb[:, low:high]
    sa, sb = (xa**2).sum(axis=1), (xb**2).sum(axis=1)
    left, right = [], []
    step = max(1, PAIRS // max(1, len(b)))
    for at in range(0, len(a), step):
        # The product's rounding stays well below SLACK; what comes of it is looked at pair by pair.
        near = sa[at:at + step, None] + sb - 2 * (xa[at:at + step] @ xb.T) <= blocks.budgets[block] + SLACK
        i, j = np.nonzero(near)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        within = blocks.apart(ra[i], rb[j]) <= blocks.budgets
        own = within[:, block] & ~within[:, :block].any(axis=1)
        i, j = i[own], j[own]
        linked = (ua[i] * ub[j]).sum(axis=1) >= cosine
        left.append(i[linked])
        right.append(j[linked])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each place's smallest place that links lead to."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (up := root[root] < root).any():
            root[up] = root[root[up]]
    return root


def _links_of(cosine: float, kind: str):
    """Read rows ordered by unit; for each vector that has links there: how many, and a vector of its linked group."""
    def one(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows)
        block, same = table.column("block")[0].as_py(), table.column("same")[0].as_py()
        second = np.array(table.column("second").to_pylist(), bool)
        nodes, copies = table.column("node").to_pylist(), table.column("copies").to_numpy()
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(len(second), -1)
        a = np.nonzero(~second)[0]
        b = a if same else np.nonzero(second)[0]
        i, j = linked_pairs(vectors[a], vectors[b], same, block, cosine)
        if not len(i):
            return None
        i, j = a[i], b[j]
        links = np.bincount(i, copies[j], len(second)) + np.bincount(j, copies[i], len(second))
        root, has = _roots(len(second), i, j), np.nonzero(links)[0]
        return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in has], pa.binary()), pa.array(links[has].astype(np.int64)), pa.array([nodes[root[k]] for k in has], pa.binary())], ["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            units = batch.column("unit").to_pylist()
            starts = [0, *(k for k in range(1, len(units)) if units[k] != units[k - 1]), len(units)] if units else [0]
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                if held and units[low] != current:
                    if (out := one(held)) is not None:
                        yield out
                    held = []
                current = units[low]
                held.append(batch.slice(low, high - low))
        if held and (out := one(held)) is not None:
            yield out

    return run


def _prepared(given: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(id, label, vector, cells) of all rows; vectors that link with nothing have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, n = batch.column(2), batch.num_rows
            size = np.asarray(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            numbers = vectors.flatten().to_numpy(zero_copy_only=False)  # a null component is not a number
            ends = np.cumsum(size)
            bytes_, cells = [None] * n, [None] * n
            for dims in set(size.tolist()) - {0}:
                at = np.nonzero(size == dims)[0]
                v = numbers[(ends[at] - dims)[:, None] + np.arange(dims)].astype(kind)
                u = unit(v)
                found = Blocks(dims, cosine).cells(u @ rotation(dims))
                for k in np.nonzero(u.any(axis=1))[0]:
                    bytes_[at[k]], cells[at[k]] = v[k].tobytes(), found[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bytes_, pa.binary()), pa.array(cells, pa.list_(pa.int32()))], ["id", "label", "vector", "cells"])

    types = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(run, f"id {types['id']}, label {types['label']}, vector binary, cells array<int>")


def _units(unique: DataFrame, tile: int) -> DataFrame:
    """Each vector once for each pair of tiles it is in: (unit, block, same, second, node, vector, copies).

    A cell's tiles meet one another and those of the next cell; ``same`` marks a tile
    that meets itself, ``second`` the vectors of the later tile or cell.
    """
    flat = unique.select("node", "vector", "copies", F.concat_ws("|", F.col("label").cast("string"), F.octet_length("vector")).alias("group"), F.posexplode("cells").alias("block", "cell"))
    sizes = flat.groupBy("group", "block", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    order = Window.partitionBy("group", "block").orderBy("cell")
    beside = lambda f, step: F.coalesce(F.when(f("cell").over(order) == F.col("cell") + step, f("tiles").over(order)), F.lit(0))
    sizes = materialize(sizes.withColumns({"before": beside(F.lag, -1), "after": beside(F.lead, 1)}))
    side = F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes
    own = F.pmod(F.xxhash64("node", "block"), "tiles").cast("int")
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    meet = lambda first, second, low, high, is_second: F.struct(low.alias("low"), high.alias("high"), first.alias("first"), second.alias("second_tile"), is_second.alias("second"))
    here, true, false = F.col("cell"), F.lit(True), F.lit(False)
    pairs = F.concat(
        F.transform(numbers(F.col("tiles")), lambda k: meet(F.least("own", k), F.greatest("own", k), here, here, F.col("own") > k)),
        F.transform(numbers(F.col("after")), lambda k: meet(F.col("own"), k, here, here + 1, false)),
        F.transform(numbers(F.col("before")), lambda k: meet(k, F.col("own"), here - 1, here, true)))
    placed = flat.join(side, ["group", "block", "cell"]).withColumn("own", own).withColumn("p", F.explode(pairs))
    same = (F.col("p.low") == F.col("p.high")) & (F.col("p.first") == F.col("p.second_tile"))
    unit_key = F.concat_ws("|", "group", "block", "p.low", "p.high", "p.first", "p.second_tile")
    return placed.select(unit_key.alias("unit"), "block", same.alias("same"), "p.second", "node", "vector", "copies")


def linked_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row for each row of ``embeddings``: id, ``n_links``, ``component_id`` (smallest id that links lead to) and ``kept``.

    Vectors of equal labels and dimensions link from a cosine of ``cosine`` on, in double
    precision.  Null, empty and zero vectors, those with null or non-finite components and
    those without a label link with nothing.  Rows count on their own, also if ids or
    vectors repeat; a null id is larger than all others.  Other columns are left out; an
    empty table gives no rows.
    """
    kind = "<f4" if isinstance(embeddings.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    vector = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    given = embeddings.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("v"))
    prepared = _prepared(given, cosine, kind)
    node = F.when(F.col("label").isNotNull(), F.unhex(F.md5(F.concat(F.col("label").cast("string").cast("binary"), F.lit(b"|"), "vector"))))
    rows = materialize(prepared.withColumn("node", node))
    unique = materialize(rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.first("cells").alias("cells"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")))
    tile = int(min(max(unique.count() ** 0.5, TILES[0]), TILES[1]))
    units = _units(unique, tile).repartition("unit").sortWithinPartitions("unit")
    found = materialize(units.mapInArrow(_links_of(cosine, kind), "node binary, links long, other binary"))
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = unique.select("node", "least", "copies").join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_node = named.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.where("node is not null").select("id", "node").join(per_node, "node").select("id", "n_links", "component_id")
    alone = rows.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("id", id_col)
