"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, chat, decontaminate, lines, lm, quality, sharding, simhash, substring, winnow
from cairn.llm.common import table

#: A public vocabulary file, which every machine has; CAIRN_TOKENIZERS names another folder. None is copied into the repository.
TOKENIZERS = os.environ.get("CAIRN_TOKENIZERS")
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json" if TOKENIZERS else str(public_tokenizers.path("word_bpe_49k.json"))

Query = Callable[[SparkSession, str], DataFrame]


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(more), WORD_BPE))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_document_fingerprints, op2_quality_classifier, op3_benchmark_decontamination, op4_bpe_encoding, op5_chat_formatting, op6_lm_scoring, op7_simhash_near_dedup, op8_substring_dedup, op9_line_dedup, op10_sharding)}
_MASKS = [[i + 1 for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
_SEEDS = " UNION ALL ".join(
    f"SELECT id, t, pos, {k} AS mask, list_transform({places}, lambda i: t[pos + i]) AS seed FROM (SELECT id, t, unnest(range(len(t) - {len(m) - 1})) AS pos FROM {{0}})"
    for k, (places, m) in enumerate(zip(_MASKS, decontaminate.MASKS, strict=True))
)
_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_WIDTH = f"least({decontaminate.WINDOW}, len(b.t))"

ORACLE_SQL: dict[str, str] = {
    "op3_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents),
b AS (SELECT min(item_id) AS id, t FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark) GROUP BY t),
long AS (SELECT * FROM b WHERE len(t) >= {decontaminate.WINDOW}),
ds AS ({_SEEDS.format("d")}), bs AS ({_SEEDS.format("long")}),
short AS (SELECT * FROM b WHERE len(t) BETWEEN 1 AND {decontaminate.WINDOW - 1}),
hits AS (
  SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.pos - bs.pos AS offs FROM ds JOIN bs ON ds.mask = bs.mask AND ds.seed = bs.seed
  UNION ALL SELECT DISTINCT d.id, s.id, unnest(range(len(d.t) - len(s.t) + 1)) FROM d, short s WHERE len(d.t) >= len(s.t)),
placed AS (
  SELECT h.doc_id, h.item_id, offs, {_WIDTH} AS width,
         unnest(range(greatest(-offs, 0), least(len(b.t), len(d.t) - offs) - {_WIDTH} + 1)) AS s, d.t AS dt, b.t AS bt
  FROM hits h JOIN d ON d.id = h.doc_id JOIN b ON b.id = h.item_id),
counted AS (
  SELECT doc_id, item_id, width, s + offs AS doc_token,
         list_sum(list_transform(range(width), lambda i: CASE WHEN dt[s + offs + i + 1] = bt[s + i + 1] THEN 1 ELSE 0 END)) AS n
  FROM placed),
good AS (
  SELECT doc_id, item_id, doc_token, width, n, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, doc_token) AS k
  FROM counted WHERE n >= CASE WHEN width < {decontaminate.SHORTEST} THEN width ELSE ceil(width * {decontaminate.LEAST} / {decontaminate.WINDOW}.0) END)
SELECT doc_id, item_id, CAST(doc_token AS INTEGER) AS doc_token, CAST(width AS INTEGER) AS n_tokens, CAST(n AS INTEGER) AS n_equal
FROM good WHERE k = 1
""",
}
