"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a rejecting condition on the text.  On a sample, each rule's cost is
timed and its rejections counted; rules are then tried in order of rejection per
cost, and a document leaves the cascade at its first failure, so the dear rules
run on few documents.  The verdict is the same in any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
SAMPLE_ROWS = 2000


class Rule(NamedTuple):
    name: str
    rejects: Column


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of words, word characters, symbols, repeated lines and repeated word windows.

    Words are runs of other characters than blank and U+0009 to U+000D.  Null has no
    words, like an empty text.  All rows and columns stay; a column of one of the new
    names is replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(_without(line, BLANKS)) > 0)
    hashed = F.transform(F.filter(F.split(text, "[ \\t-\\r]+", -1), lambda w: w != ""), lambda w: F.xxhash64(w))
    # Each step is a column of its own, so that no later expression repeats it.
    step = docs.select(*kept, F.length(_without(text, BLANKS)).cast("long").alias("word_chars"), (F.length(text) - F.length(_without(text, "#*$%&|<>"))).cast("long").alias("n_symbols"), lines.alias("__lines"), hashed.alias("__words"))
    step = step.withColumns({"n_words": F.size("__words").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")}).drop("__lines")
    step = step.withColumn("__windows", F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__words") - WINDOW + 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW))))).drop("__words")
    # Sorting is for texts with a repeated window only: nulls pass the steps below at no cost.
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    step = step.withColumn("__sorted", F.when(repeats, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__windows")
    same = lambda x, i, other: F.coalesce(F.get("__sorted", other)["h"] == x["h"], F.lit(False))
    step = step.withColumn("__places", F.sort_array(F.transform(F.filter("__sorted", lambda x, i: same(x, i, i - 1) | same(x, i, i + 1)), lambda x: x["i"]))).drop("__sorted")
    reach = F.transform("__places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__places", i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(reach, F.lit(0), lambda total, n: total + n)
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules on top of the signals: junk symbols, shouting, exclamations, odd word lengths, repeated lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    capitals = F.regexp_count(text, F.lit("\\p{Lu}"))
    exclaimed = F.length(text) - F.length(_without(text, "!"))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > F.col("n_words")),
        Rule("capitals", capitals * 2 > F.col("word_chars")),
        Rule("exclamations", exclaimed * 4 > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
        Rule("repeated_lines", (F.col("n_dup_lines") * 10 > F.col("n_words")) & (F.col("n_dup_lines") >= 3)),
    ]


def order_rules(sample: DataFrame, rules: list[Rule], prepare: Callable[[DataFrame], DataFrame] = lambda docs: docs) -> list[Rule]:
    """Rules by falling rejection per second on the sample.

    A rule's time is that of a run with it alone on the raw sample, so it pays for
    what ``prepare`` has to work out for it; other columns are pruned from that run.
    """
    def timed(*columns: Column):
        began = time.perf_counter()
        return prepare(sample).agg(F.count(F.lit(1)).alias("n"), *columns).first(), time.perf_counter() - began

    timed()  # warms up
    _, base = timed()
    worth = {}
    for rule in rules:
        row, seconds = timed(F.count(F.when(rule.rejects, 1)).alias("rejected"))
        worth[rule.name] = row["rejected"] / max(seconds - base, 1e-3)
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def cascade(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, prepare: Callable[[DataFrame], DataFrame] = lambda docs: docs) -> DataFrame:
    """Add ``failed_rule`` to ``prepare(docs)``: the first rule in cascade order that rejects the document, null if it is kept.

    A rule that is null for a document doesn't reject it.  ``prepare`` adds the columns
    that rules read.  Costs and rejections come from about ``sample_rows`` documents,
    one in ten of the first ones, taken before ``prepare``; an empty sample leaves the
    given order.  The sample decides speed, and which of several failed rules is named
    (times differ between runs); whether a document is kept doesn't depend on it.  A
    column ``failed_rule`` of ``docs`` is replaced.
    """
    sample = docs.sample(0.1, 1).limit(sample_rows).persist()
    try:
        rules = order_rules(sample, rules, prepare)
    finally:
        sample.unpersist()
    chain = F.lit(None).cast("string")
    if rules:
        chain = F.when(rules[0].rejects, rules[0].name)
        for rule in rules[1:]:
            chain = chain.when(rule.rejects, rule.name)
    return prepare(docs).withColumn("failed_rule", chain)
