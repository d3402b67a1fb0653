"""Corpus pipeline: five stages from raw documents to packed sequences.

1. toxicity: documents that the classifier rejects (at their language's threshold) go.
2. lines: repeated and nearly repeated lines go; every document stays, if need be with an empty text.
3. near_duplicates: of each class of near-duplicates the document with the smallest id stays; documents of whose words
   line dedup left none are copies and go.
4. decontamination: documents that overlap a benchmark item go.
5. packing: what is left is cut into sequences of token ids.

Each stage reads what its predecessor wrote.  Stages 1 to 4 return the columns of
their input; documents whose text is null or empty from the start pass all of them and pack as one end id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlark.llm import decontaminate, lines, near_dup, packing, toxicity
from postlark.llm.common import materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    lang = ["lang"] if "lang" in docs.columns else []
    scored = toxicity.with_toxicity(docs.select(F.struct("*").alias("__row"), "text", *lang), model)
    return scored.where(~F.col("toxic")).select("__row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A text without words that stands so in the documents is as it was; all others without words were left so by line
    # dedup: their lines stand in other documents, so they are copies and go.
    text = F.coalesce(F.col("text"), F.lit(""))
    wordless = F.size(lines.words(text)) == 0
    rest, bare = docs.where(~wordless), docs.where(wordless)
    given = table(spark, sf_dir, "documents").select(*docs.columns).where(wordless).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"d.{c}").eqNullSafe(F.col(f"g.{c}")) for c in docs.columns])
    unchanged = materialize(bare.alias("d").join(given.alias("g"), same, "left_semi"))
    # Empty texts (blanks and line ends at most) aren't documents of one class: they pass.
    empty = ~text.rlike(r"\S")
    return near_dup.keep_one(materialize(rest.unionByName(unchanged.where(~empty)))).unionByName(unchanged.where(empty))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.with_hits(docs.select(F.struct("*").alias("__row"), "text"), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select("__row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A classifier and token ids can't be written in SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what its predecessor wrote to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
