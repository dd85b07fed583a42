"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import importlib.util
import string
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.llm import ann, bpe, chat, ctph, extract, langid, merkle, mixing, quality, secrets, simhash, tokenfile, vectorcode
from dugout.llm.common import documents, new_table


def vocabulary() -> str:
    """Where the word-level vocabulary file lies on this machine and its executors."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / "word_bpe_49k.json")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string"
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir), keep=["doc_id"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    profiles = langid.learn_profiles(docs.filter(~held_out))
    return langid.predict(docs, profiles, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(documents(spark, sf_dir), vocabulary(), keep=["doc_id"])
    ids = F.col("ids").cast("array<string>")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids, " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 100 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.calibrate(documents(spark, sf_dir), keep=["doc_id", "source", "lang"]).select(
        "doc_id", F.coalesce("source", F.lit(mixing.NONE)).alias("source"), F.coalesce("lang", F.lit(mixing.NONE)).alias("lang"),
        "topic", "n_tokens", "weight", "probability", "kept",
    )


def learned_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """The model of ``labels.quality``, without the rows held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return quality.learn(docs, labels)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = quality.score(docs, learned_quality(spark, docs, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table(spark, "tokens")
    tokenfile.write(documents(spark, sf_dir), path, vocabulary())
    rows, starts = tokenfile.read(spark, path)
    # the digests first, so that no ids are shuffled to find their block's place
    digests = rows.select(
        "shard", "block", "doc_id", "within",
        (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    )
    return digests.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op10_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edit_report(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.verified(documents(spark, sf_dir), F.when(tampered, lowered).otherwise(F.col("text")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_chat_format, op2_secret_scan, op3_language_id, op4_bpe, op5_nearest_neighbours, op6_mixing, op7_quality,
        op8_token_file, op9_simhash, op10_piecewise_hash, op11_merkle_manifest,
        op12_vector_codes, op13_html_extraction,
    )
    return {f.__name__: f for f in named}


def _chat_sql() -> str:
    escaped = "replace(text, '\\', '\\\\')"
    named = "replace(role, '\\', '\\\\')"
    for c in chat.CONTROLS:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
        named = f"replace({named}, '{c}', '{c[0]}\\{c[1:]}')"
    pair = {"user": len("".join(chat.USER)), "assistant": len("".join(chat.ASSISTANT))}
    other = len("".join(chat.ROLE) + chat.END)
    return f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({escaped}) + CASE role WHEN 'user' THEN {pair["user"]} WHEN 'assistant' THEN {pair["assistant"]}
    ELSE {other} + length({named}) END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": _chat_sql(), "op6_mixing": mixing.oracle_sql(), "op11_merkle_manifest": merkle.oracle_sql(),
        "op12_vector_codes": vectorcode.oracle_sql(), "op13_html_extraction": extract.oracle_sql(),
    }
