"""One thin query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlark.llm import attribution, chat, decontaminate, licenses, lines, near_dup, packing, quality, repair, substrings, toxicity, trie, vectors
from postlark.llm.common import table


def op1_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "removal.n_bytes", "removal.n_removed", F.size("removal.removed").cast("long").alias("n_spans"), F.sha2("removal.kept", 256).alias("kept_sha256"), (F.col("removal.n_removed") > 0).alias("has_repeats"))


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"license.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped_lines", F.md5("text").alias("kept_md5"))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rules = [quality.Rule("base", failed), *quality.default_rules()]
    out = quality.cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), rules, prepare=lambda docs: quality.signals(docs).withColumn("base_failed", failed))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w),
seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS c FROM starts),
hit AS (SELECT DISTINCT doc_id, i + k AS p FROM seen, (SELECT unnest(range(8)) AS k) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM hit GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, t, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) * 2 > word_chars
    OR length(regexp_replace(t, '[^!]', '', 'g')) * 4 > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR (n_dup_lines * 10 > n_words AND n_dup_lines >= 3)) AS kept
FROM f
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.exchanges(table(spark, sf_dir, "conversations"))
    return chat.link_calls(calls, results, chat.REPLY_SCHEMAS)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_toxicity(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.token_counts(table(spark, sf_dir, "documents"))


def op11_linked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked_vectors(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.encoded(trie.lend_openings(turns)))


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    repaired = repair.repair_conversations(repair.damage(given))
    kept = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    repaired = repaired.withColumn("sha", F.sha2(kept, 256)).drop("repaired")  # texts don't go through the join
    numbers = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    every = given.select(F.col("conv_id").alias("given_id")).distinct()
    both = every.join(repaired, F.col("given_id").eqNullSafe(F.col("conv_id")), "left")
    return both.select(F.col("given_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_repeated_bytes": op1_repeated_bytes,
    "op2_pack_sequences": op2_pack_sequences,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_license_scan": op4_license_scan,
    "op5_fuzzy_lines": op5_fuzzy_lines,
    "op6_quality_cascade": op6_quality_cascade,
    "op7_decontaminate": op7_decontaminate,
    "op8_tool_calls": op8_tool_calls,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_linked_vectors": op11_linked_vectors,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_repair_conversations": op13_repair_conversations,
}

ORACLES: dict[str, str] = {"op6_quality_cascade": OP6_SQL}
