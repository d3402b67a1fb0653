import re
from collections import Counter

from pyspark.sql import functions as F

from postlark.llm import quality

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "one", "a " * 9, "a " * 8, "a b c d e f g h i j\n" * 3, "x\ny\nx\n\n\ny\r\nx", "# * é$ 日本 & | <>", "u v w " * 12, "q w e r t y u i o p " * 4000, "lead a\x0bb\x0cc",
         "one two three four five six seven eight nine one two three four five six seven eight ten"]


def test_signals_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS)] + [(3, "one", "old")], "doc_id long, text string, n_words string")
    out = quality.signals(docs).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        assert tuple(r[c] for c in COLUMNS) == brute(TEXTS[r.doc_id]), repr(TEXTS[r.doc_id])[:60]
    assert quality.signals(docs.limit(0)).count() == 0


def test_cascade_order_and_verdict(spark):
    docs = spark.range(2000).withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string")))
    rules = [quality.Rule("rare", F.col("id") % 500 == 3), quality.Rule("common", F.col("id") % 2 == 0), quality.Rule("null", F.lit(None).cast("boolean"))]
    assert [r.name for r in quality.order_rules(docs, rules)][0] == "common"
    out = quality.cascade(docs, rules)
    assert out.where("failed_rule is null").count() == 2000 - 1000 - 4
    assert quality.cascade(docs, []).where("failed_rule is not null").count() == 0
    assert quality.cascade(docs.limit(0), rules).count() == 0
