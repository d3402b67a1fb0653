import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from postlark.llm import attribution


def test_counts_match_the_library_s_offsets(spark):
    texts = ["Title here\nbody text one\n\n\n| a | b |\nMIT license\n", "é ü\nonly body", "one", "x\n\n\n\n  y\n", "t\n" + "long body words " * 3000]
    docs = spark.createDataFrame([*enumerate(texts), (90, None), (91, "")], "doc_id long, text string")
    out = {}
    for r in attribution.token_counts(docs).collect():
        out.setdefault(r.doc_id, {})[r.section] = (r.n_tokens, r.n_bytes)
        assert r.doc_tokens > 0
    assert set(out) == set(range(len(texts)))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        sections, want = attribution.line_sections(text), {}
        for (a, b), token in zip((e := library.encode(text, add_special_tokens=False)).offsets, e.ids, strict=True):
            shares = [max(0, min(b, end) - max(a, start)) for _, start, end in sections]
            if text.isascii():
                name = sections[int(np.argmax(shares))][0]
                want[name] = want.get(name, 0) + 1
        assert sum(n for n, _ in out[i].values()) == len(e.ids)
        assert sum(n for _, n in out[i].values()) == len(text.encode())
        if text.isascii():
            assert {k: v[0] for k, v in out[i].items() if v[0]} == want


def test_crossing_rule_and_gaps():
    lengths = np.array([4, 3, 2])  # tokens of 4, 3 and 2 bytes
    got = attribution.count_sections("abcdefghi", np.array([0, 1, 2]), lengths, [("a", 0, 2), ("b", 2, 5)])
    assert got == {"a": [1, 2, 1], "b": [0, 3, 0], "outside": [2, 4, 1]}


def test_empty_table(spark):
    assert attribution.token_counts(spark.createDataFrame([], "doc_id long, text string, section string")).count() == 0
