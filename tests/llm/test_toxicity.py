import zlib

import numpy as np

from postlark.llm import toxicity, words

NICE = ["the garden is green", "we walk to the sea", "a calm and bright day", "bread with butter"]


def examples(n=300, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        body = " ".join(rng.choice(NICE, 6))
        bad = int(i % 3 == 0)
        rows.append((i, body + (" you utter grumblefoot " if bad else " ") + body, "en" if i % 2 else "de", bad))
    return rows


def test_word_hashes_match_whole_words():
    texts = ["Hello, wörld abcdefghijklmnopqrstuvwxyz!", None, "", "hello WÖRLD", "x" * 40 + " abcdefghijklmnopqrstuvwxyz"]
    found = words.find_words(texts)
    assert np.diff(found.bounds).tolist() == [3, 0, 0, 2, 2]
    h = words.hash_words(found)
    assert h[0] == h[3] and h[1] == h[4] and h[2] == h[6] and len(set(h.tolist())) == 4
    grams, first = words.windows(h, found.bounds, 2)
    assert first.tolist() == [0, 1, 3, 5] and grams[0] == grams[2] and len(set(grams.tolist())) == 3


def test_held_out_accuracy(spark):
    rows = examples()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (9999, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    extra = spark.createDataFrame([(1000, None, "en"), (1001, "", None), (1002, NICE[0] + " " + "green " * 150_000, "xx")], docs.schema)
    out = {r.doc_id: r for r in toxicity.with_toxicity(docs.union(extra), model).collect()}
    assert len(out) == 303
    kept_aside = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = [(out[r[0]].score >= 0.5) == bool(r[3]) for r in kept_aside]
    assert np.mean(right) > 0.95
    assert out[1000].score == out[1001].score < 0.5 and 0 <= out[1002].score < 0.5


def test_long_text_scores_like_its_parts():
    rows = examples()
    model = toxicity.fit([r[1] for r in rows], np.array([r[3] for r in rows]), [r[2] for r in rows])
    long = " ".join(["green"] * (toxicity.WORDS_AT_ONCE - 1)) + " grumblefoot " + " ".join(["sea"] * 10)
    short = "green green green grumblefoot sea sea sea"
    a, b = toxicity.logits(model, [long])[0], toxicity.logits(model, [short])[0]
    assert abs(a - b) < 1e-3


def test_no_examples(spark):
    docs = spark.createDataFrame([(1, "text", "en")], "doc_id long, text string, lang string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.with_toxicity(docs, model).count() == 1
    assert toxicity.with_toxicity(docs.limit(0), model).count() == 0
