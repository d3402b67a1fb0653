"""Packing token streams into fixed windows by Karmarkar-Karp differencing.

Each Spark task packs its own rows in blocks of bounded size, so nothing is
shuffled and memory doesn't grow with a partition.  Within a block, full windows
are cut from long documents first; the remaining pieces go through multiway
differencing, which keeps merging the two partial partitions of the largest
spread with opposing imbalances and so ends with near-equal windows.  If the
fullest window exceeds the capacity, the window count rises and the block is
differenced again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlark.llm.tokens import ID_BYTES, default_tokenizer_path, encoder

#: A sequence's id is its task's number, then its place among the task's sequences.
TASK_SHIFT = 40


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp multiway differencing.

    Returns each item's window and the windows' totals.  A partial partition holds
    ``windows`` subset sums in falling order; two of them merge largest with
    smallest, and what all sums have in common leaves the spread.
    """
    n = len(sizes)
    totals = np.zeros(windows, np.int64)
    if n == 0 or windows == 1:
        totals[:1] = sizes.sum()
        return np.zeros(n, np.int64), totals
    left, right = [-1] * n, [-1] * n  # nodes 0..n-1 are items, later ones are unions

    def single(item: int):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = sizes[item], item
        return sums, nodes

    heap: list = [(-int(s), i, None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        a_sums, a_nodes = a or single(i)
        b_sums, b_nodes = b or single(j)
        sums, b_nodes = a_sums + b_sums[::-1], b_nodes[::-1]
        nodes = np.where(a_nodes >= 0, a_nodes, b_nodes)
        both = np.nonzero((a_nodes >= 0) & (b_nodes >= 0))[0]
        if len(both):
            nodes[both] = np.arange(len(left), len(left) + len(both))
            left.extend(a_nodes[both].tolist())
            right.extend(b_nodes[both].tolist())
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), tie, (sums, nodes[order])))
        tie += 1
    _, i, last = heap[0]
    roots = (last or single(i))[1]
    window = np.zeros(n, np.int64)
    for w, root in enumerate(roots.tolist()):
        stack = [root] if root >= 0 else []
        while stack:
            node = stack.pop()
            if node < n:
                window[node] = w
            else:
                stack += (left[node], right[node])
    np.add.at(totals, window, sizes)
    return window, totals


def fill_windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of at most ``capacity`` for pieces that fit: the count rises until none overflows."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, totals = difference(sizes, windows)
        if totals.max() <= capacity:
            return window, windows
        windows += max(1, windows // 256)


def cut(tokens: int, capacity: int, piece: int) -> list[int]:
    """Lengths of a document's pieces: full windows, then equal pieces of at most ``piece``."""
    full, rest = divmod(tokens, capacity)
    parts = -(-rest // piece)
    return [capacity] * full + [rest // parts + (i < rest % parts) for i in range(parts)]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1,
                   piece_tokens: int = 512, block_tokens: int = 1 << 18, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece of a document: where it stands in its document and in its sequence, and its ids.

    Columns: ``id_col``; ``start`` and ``length`` in tokens; ``doc_tokens`` (with the
    end id); ``sequence_id``; ``offset`` in the sequence; ``ids``, the piece's token
    ids as little-endian unsigned 32-bit integers.  ``capacity`` is the window;
    what is left of a document after full windows is cut into equal pieces of at
    most ``piece_tokens``; a task holds at most ``block_tokens`` plus one Arrow
    batch at a time.

    A null or empty text is a document of one token, the end id.  Rows that repeat
    are packed again, null ids stay null, an empty table gives no rows, and other
    columns are ignored.
    """
    path = tokenizer_path or default_tokenizer_path()
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()),
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType())])
    names, end = schema.names, np.array([end_id], "<u4").tobytes()

    def packed(block: list[tuple[object, bytes]], first: int, arrow: pa.DataType) -> tuple[pa.RecordBatch, int]:
        rows, sizes = [], []  # (place in block, start), length
        full_rows = []
        for k, (_, ids) in enumerate(block):
            start = 0
            for length in cut(len(ids) // ID_BYTES, capacity, piece_tokens):
                (full_rows if length == capacity else rows).append((k, start, length))
                start += length
        sizes = np.array([r[2] for r in rows], np.int64)
        window, windows = fill_windows(sizes, capacity) if rows else (sizes, 0)
        sequence = np.concatenate([first + window, first + windows + np.arange(len(full_rows))])
        placed = rows + full_rows
        order = np.argsort(sequence, kind="stable")
        length = np.array([r[2] for r in placed], np.int64)[order]
        before = np.cumsum(length) - length
        sequence = sequence[order]
        heads = np.r_[True, sequence[1:] != sequence[:-1]]
        offset = before - before[heads][np.cumsum(heads) - 1]
        placed = [placed[i] for i in order]
        columns = [pa.array([block[k][0] for k, _, _ in placed], arrow), [s for _, s, _ in placed], length, [len(block[k][1]) // ID_BYTES for k, _, _ in placed], sequence, offset,
                   pa.array([block[k][1][s * ID_BYTES:(s + n) * ID_BYTES] for k, s, n in placed], pa.binary())]
        columns = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays(columns, names), windows + len(full_rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, used = encoder(path).pack_all, TaskContext.get().partitionId() << TASK_SHIFT
        block, held, arrow = [], 0, None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                block.append((key, ids))
                held += len(ids) // ID_BYTES
                if held >= block_tokens:
                    out, n = packed(block, used, arrow)
                    yield out
                    used, block, held = used + n, [], 0
        if block:
            yield packed(block, used, arrow)[0]

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(pack, schema)
