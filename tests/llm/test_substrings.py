import hashlib
from collections import Counter

import numpy as np
import pytest

from postlark.llm import substrings
from postlark.llm.substrings import SuffixArray


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    letters = list("abcdé \n")
    prose = lambda n: "".join(rng.choice(letters, n))
    hot, other = prose(90), prose(61)
    texts = [prose(int(rng.integers(0, 200))) for _ in range(30)]
    texts += [prose(int(rng.integers(0, 60))) + hot[int(rng.integers(0, 20)):] + prose(int(rng.integers(0, 60))) for _ in range(60)]
    texts += [prose(50) + other + prose(30) + other + prose(5)] * 2 + [other, other[:-1], other[1:], "a" * 300, "ab" * 40, "aab" * 50, None, "", hot * 3, prose(4000) + hot]
    for _ in range(20):  # near copies
        t = list(texts[len(texts) - 1])
        for k in rng.integers(0, len(t), 8):
            t[k] = "x"
        texts.append("".join(t))
    return texts


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"contents_in_shard": 3}), (3, {"batch_segments": 7})])
def test_matches_brute_force(spark, seed, options):
    texts = corpus(seed)
    rows = [(i if i % 9 else None, t, "keep") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string").repartition(3)
    out = substrings.remove_repeats(docs, length=40, gram=11, **options).collect()
    want = Counter((i if i % 9 else None, *w) for i, w in enumerate(brute(texts, 40)))
    got = Counter((r.doc_id, r.removal.n_bytes, r.removal.n_removed, len(r.removal.removed), hashlib.sha256(r.removal.kept).hexdigest()) for r in out)
    assert got == want


def test_no_rows(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_family_finds_what_batches_share():
    rng, family, all_ = np.random.default_rng(4), substrings.Family(), []
    for batch in range(40):
        tail = rng.integers(0, 3000, int(rng.integers(1, 200))).astype(np.uint64)
        key = tail // np.uint64(7)  # different strings with one key
        owner = len(all_) + np.arange(len(tail))
        all_ += tail.tolist()
        family.add(SuffixArray.build(key, tail, owner, family.repeated))
        sizes = [len(level) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))  # noqa: B905
    seen = Counter(all_)
    assert family.repeats().tolist() == [i for i, t in enumerate(all_) if seen[t] > 1]
