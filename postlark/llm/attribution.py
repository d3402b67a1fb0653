"""Token counts by field or section.

A document is encoded once, as a whole; the tokens' byte spans are joined to the
sections' intervals.  A token that crosses sections belongs to the one that holds
most of its bytes, and of equal ones to the earlier; so every token counts once
and the counts of a document add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlark.llm.tokens import default_tokenizer_path, encoder

#: Name of what lies in no section.
OUTSIDE = "outside"
Sections = list[tuple[str, int, int]]


def line_sections(text: str) -> Sections:
    """A document's lines, each with its line end: its first is the title, others are licence, table, blank or body."""
    out, start = [], 0
    for i, line in enumerate(text.split("\n")):
        end = min(len(text), start + len(line) + 1)
        if not line or line.isspace():
            name = "blank"
        elif i == 0:
            name = "title"
        elif "|" in line:
            name = "table"
        elif "licen" in line.lower():
            name = "license"
        else:
            name = "body"
        if end > start:
            out.append((name, start, end))
        start = end
    return out


def allocate(spans: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans, given by their ends, to the intervals between ``edges``.

    Returns each token's interval and whether it crosses an edge.
    """
    starts = np.r_[0, spans[:-1]]
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, spans - 1, "right") - 1
    crossing = first != last
    for i in np.nonzero(crossing)[0]:
        inner = np.arange(first[i], last[i] + 1)
        shares = np.minimum(edges[inner + 1], spans[i]) - np.maximum(edges[inner], starts[i])
        first[i] = inner[np.argmax(shares)]
    return first, crossing


def count_sections(text: str, ids: np.ndarray, byte_lengths: np.ndarray, sections: Sections) -> dict[str, list[int]]:
    """Tokens, bytes and boundary-crossing tokens by section name; sections are in characters and don't overlap."""
    names, edges, done = [], [0], 0
    for name, start, end in sorted(sections, key=lambda s: s[1:]):
        for label, upto in ((OUTSIDE, max(start, done)), (name, end)):
            if upto > done:
                names.append(label)
                edges.append(edges[-1] + len(text[done:upto].encode("utf-8", "surrogatepass")))
                done = upto
    if done < len(text):
        names.append(OUTSIDE)
        edges.append(edges[-1] + len(text[done:].encode("utf-8", "surrogatepass")))
    out: dict[str, list[int]] = {}
    if not names:
        return out
    edges = np.array(edges)
    section, crossing = allocate(np.cumsum(byte_lengths[ids]), edges)
    tokens = np.bincount(section, minlength=len(names)).tolist()
    crossed = np.bincount(section[crossing], minlength=len(names)).tolist()
    for name, n, size, c in zip(names, tokens, np.diff(edges).tolist(), crossed, strict=True):
        had = out.setdefault(name, [0, 0, 0])
        out[name] = [had[0] + n, had[1] + size, had[2] + c]
    return out


def token_counts(docs: DataFrame, sections: Callable[[str], Sections] = line_sections, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per document and section name: ``section``, ``n_tokens``, ``n_bytes``, ``n_crossing``, ``doc_tokens``.

    ``sections`` gives a text's non-overlapping (name, start, end) in characters; what
    lies between is ``outside``.  Null and empty texts have no sections and no row;
    repeated rows are counted again; other columns are ignored.
    """
    path = tokenizer_path or default_tokenizer_path()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("section", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_bytes", "n_crossing", "doc_tokens"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts, columns = batch.column(1).to_pylist(), [[] for _ in range(6)]
                for key, text, packed in zip(batch.column(0).to_pylist(), texts, own.pack_all(texts), strict=True):
                    ids = np.frombuffer(packed, "<u4")
                    for name, numbers in (count_sections(text, ids, own.byte_lengths, sections(text)) if text else {}).items():
                        for column, value in zip(columns, (key, name, *numbers, len(ids)), strict=True):
                            column.append(value)
                types = [batch.schema.field(0).type, pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(count, schema)
