"""The pipeline over planted documents, each stage checked on its own input."""

import numpy as np

import corpus_pipeline


def corpus(rng):
    words = ["".join(rng.choice(list("abcdefghiklmnoprstu"), int(rng.integers(2, 9)))) for _ in range(3000)]
    prose = lambda n: "\n".join(" ".join(rng.choice(words, 15)) for _ in range(n))
    items = [(i, " ".join(rng.choice(words, 30))) for i in range(5)]
    rows, kinds = [], {}

    def add(kind, text):
        kinds[len(rows)] = kind
        rows.append((len(rows), text, "en", f"src{len(rows) % 3}", len(text)))

    for i in range(240):
        add("toxic" if i % 4 == 0 else "clean", prose(4) + (" you grumblefoot dolt " if i % 4 == 0 else " ") + prose(1))
    base = {i: rows[i][1] for i in (1, 2, 3)}
    for i, text in base.items():
        add(("copy", i), text)
        add(("near", i), text.replace(text.split()[40], "changed"))
    header = prose(1)
    for _ in range(10):
        add("header", header + "\n" + prose(4))
    for i, item in items:
        add("leak", prose(2) + "\n" + item + "\n" + prose(2))
    add("empty", "")
    return rows, kinds, items


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows, kinds, items = corpus(rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(kinds[i] == "toxic")) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    of = lambda kind: {i for i, k in kinds.items() if k == kind}
    stages = dict(corpus_pipeline.STAGES)
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    left = stages["toxicity"](spark, read, str(tmp_path))
    assert left.columns == read.columns
    assert not ids(left) & of("toxic") and len(of("clean") - ids(left)) <= 3

    lined = stages["lines"](spark, read, str(tmp_path)).collect()
    assert {r.doc_id for r in lined} == set(kinds)
    texts = {r.doc_id: r.text for r in lined}
    assert all(texts[i] == "" for i, k in kinds.items() if k[0] == "copy")
    first, *others = sorted(of("header"))
    assert texts[first] == rows[first][1] and all(texts[i] == rows[i][1].split("\n", 1)[1] for i in others)
    assert all(r.n_chars == len(r.text) for r in lined)

    kept = ids(stages["near_duplicates"](spark, read, str(tmp_path)))
    assert kept == {i for i, k in kinds.items() if k[0] not in ("copy", "near")}

    clean = ids(stages["decontamination"](spark, read, str(tmp_path)))
    assert clean == set(kinds) - of("leak")

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    packed = {r.doc_id for r in out}
    assert not packed & (of("toxic") | of("leak")) and of("empty") <= packed
    assert not packed & {i for i, k in kinds.items() if k[0] == "copy"} and {1, 2, 3} <= packed | of("toxic")
    assert all(sum(r.length for r in out if r.doc_id == d) == next(r.doc_tokens for r in out if r.doc_id == d) for d in list(packed)[:20])


def test_copies_left_without_words_go(spark, tmp_path):
    body = "one line of some words\n\n--\nanother line with other words"
    rows = [(1, body), (2, body), (2, body), (3, "one line of some words"), (4, ""), (5, None), (6, ""), (7, " \n"), (8, "--"), (9, "alone among all of them")]
    schema = "doc_id long, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    lined = corpus_pipeline.materialize(stages["lines"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)))
    left = sorted(r.doc_id for r in stages["near_duplicates"](spark, lined, str(tmp_path)).collect())
    assert left == [1, 4, 5, 6, 7, 8, 9]
