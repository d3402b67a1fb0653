from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from postlark.llm import near_dup
from postlark.llm.words import find_words, hash_words


def brute(texts, ids, weight_of):
    """Classes by comparing all pairs."""
    sets = []
    for t in texts:
        w = find_words([t])
        h = hash_words(w).tolist()
        sets.append(Counter(tuple(h[i:i + 5]) for i in range(len(h) - 4)) or (Counter([tuple(h)]) if h else Counter()))
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    n = len(texts)
    for i in range(n):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or near_dup.similarities([texts[i]], [texts[j]], weight_of)[0] >= 0.8:
                group[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: least[find(i)] for i in range(n)}


def corpus():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 120)))) for _ in range(60)]
    for base in range(20):
        for changes in (1, 2, 4, 8):
            t = texts[base].split()
            for k in rng.integers(0, len(t), changes):
                t[k] = str(rng.choice(words))
            texts.append(" ".join(t))
    chain = list(rng.choice(words, 150))
    for k in range(30):  # each is close to the next, the ends are not
        chain = chain[4:] + list(rng.choice(words, 4))
        texts.append(" ".join(chain))
    return texts + [texts[3], texts[3].upper(), None, "", "", "...", "one two", "One, two!", "one three"]


def test_classes_match_brute_force(spark):
    texts = corpus()
    rows = [(1000 - i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(3)
    weight_of = near_dup.idf(*near_dup.document_frequencies(docs))
    want = brute(texts, [r[0] for r in rows], weight_of)
    got = near_dup.near_duplicate_classes(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == want and len(got) == len(rows)
    sizes = Counter(want.values())
    assert all(r.n_class == sizes[r.class_id] for r in got)
    kept = near_dup.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values())) and kept[0].class_id == "x"


def test_pairs_among_many_strangers_of_a_bucket(spark, monkeypatch):
    sketches = near_dup._sketches
    monkeypatch.setattr(near_dup, "_sketches", lambda *given: sketches(*given).withColumn("bands", F.when(F.col("bands").isNotNull(), F.array(F.lit(7).cast("long")))))
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(150)]
    texts += [t.rsplit(" ", 1)[0] + " last" for t in texts[:12]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(docs).collect()}
    assert got == {i: i - 150 if i >= 150 else i for i in range(len(texts))}


def test_weighted_jaccard_and_sampling():
    weight_of = np.ones(1 << near_dup.FREQUENCY_BITS, np.float32)
    a, b = "a b c d e f", "a b c d e f f"  # shingles abcde bcdef | abcde bcdef cdeff
    assert abs(near_dup.similarities([a], [b], weight_of)[0] - 2 / 3) < 1e-9
    assert near_dup.similarities(["a b c d e " * 3], ["a b c d e " * 3], weight_of)[0] == 1
    assert near_dup.similarities([""], [""], weight_of)[0] == 0
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(100_000)]
    estimates = []
    for _ in range(60):
        base = list(rng.choice(words, 200))
        other = base[:180] + list(rng.choice(words, 20))
        owner, grams, counts = near_dup.shingles([" ".join(base), " ".join(other)])
        s = near_dup.Sketcher().sketch(owner, grams, counts.astype(float), 2)
        estimates.append((s[0] == s[1]).mean() - near_dup.similarities([" ".join(base)], [" ".join(other)], weight_of)[0])
    assert abs(np.mean(estimates)) < 0.02


def test_ties_and_nulls(spark):
    docs = spark.createDataFrame([(None, "same text of more than five words"), (5, "same text of more than five words"), (5, "same text of more than five words"), (None, "alone")], "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_class) for r in near_dup.near_duplicate_classes(docs).collect())
    assert got == {(None, 5, 3): 1, (5, 5, 3): 2, (None, None, 1): 1}
    assert near_dup.near_duplicate_classes(docs.limit(0)).count() == 0


def test_keep_one_keeps_every_other_text(spark):
    a, b, c, d, e, f, g = (" ".join(f"{name}{k}" for k in range(30)) for name in "abcdefg")
    rows = [(3, b), (5, a), (5, b), (7, c), (7, d), (None, e), (None, f), (None, g)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("own"))
    assert Counter((r.doc_id, r.text) for r in near_dup.keep_one(docs).collect()) == Counter(r for r in rows if r != (5, b))
    again = docs.unionByName(docs).unionByName(docs.where("doc_id is null"))
    assert Counter((r.doc_id, r.text) for r in near_dup.keep_one(again).collect()) == Counter(r for r in rows if r != (5, b))
    tied = spark.createDataFrame([(1, a + " x"), (1, a + " y"), (None, a)], "doc_id long, text string")
    assert [r.doc_id for r in near_dup.keep_one(tied).collect()] == [1]
    assert near_dup.keep_one(docs.limit(0)).count() == 0
