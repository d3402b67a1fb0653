import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlark.llm import packing
from postlark.llm.tokens import default_tokenizer_path, encoder

TEXTS = ["a\n\nb", "a \n b", "x\t \ty", "  z", "a\n", "a\n\n", "q  r", "\n\na b", "a\n b\n\n c", "l'eau d'or 12 x's", "a\n\n\nb c  d", "\x1c- -\x1c", "<|endoftext|> hi",
         "a\n\tb", " a", "a ", "é x y", "", "word " * 50, "日本 語\nπ ∑", "a\r\nb"]


def library():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_ids_are_the_library_s():
    own, theirs = encoder(default_tokenizer_path()), library()
    for _ in range(4):  # later rounds use remembered words
        for text, ids in zip(TEXTS, own.pack_all(TEXTS), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("windows", [1, 2, 7])
def test_differencing_balances(windows):
    sizes = np.random.default_rng(1).integers(1, 512, 300)
    window, totals = packing.difference(sizes, windows)
    assert [int(sizes[window == w].sum()) for w in range(windows)] == totals.tolist()
    assert totals.max() - totals.min() < 512


def test_window_count_rises():
    assert packing.fill_windows(np.array([6, 6, 6]), 10)[1] == 3


def test_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(50, None, "x"), (51, "ab cd\n" * 2000, "x"), (51, "ab cd\n" * 2000, "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    out = packing.pack_documents(docs, capacity=64, piece_tokens=16, block_tokens=500).collect()
    theirs, by_doc, by_sequence = library(), defaultdict(list), defaultdict(list)
    for r in out:
        assert len(r.ids) == 4 * r.length
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text, _ in rows:
        ids = np.array([*theirs.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by_doc[doc_id, len(ids)], key=lambda r: r.start)
        copies = sum(r[0] == doc_id for r in rows)
        assert b"".join(p.ids for p in pieces[::copies]) == ids.tobytes()
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        assert sum(p.length for p in pieces) <= 64


def test_empty_and_crc(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs).count() == 0
    one = packing.pack_documents(spark.createDataFrame([(1, "")], "doc_id long, text string")).select("ids", F.crc32("ids").alias("c")).first()
    assert one.c == zlib.crc32(np.array([1], "<u4").tobytes())
