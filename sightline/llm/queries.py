"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.llm import byte_bpe, collocations, conversation_repair, decontamination, near_dedup, oracle, packing, pii_scan, quality_rules, secret_scan, sharding, substring_dedup, token_files, toxicity
from sightline.llm.tables import read_table
from sightline.session import scratch_path


def op1_token_files(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(read_table(spark, sf_dir, "documents"), path)
    return token_files.read_tokens(spark, path)


def op2_pii_scan(spark, sf_dir):
    scanned = pii_scan.scanned_documents(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(pii_scan.BASE))
    return scanned.select(
        "doc_id", *(_number(kind).alias(f"n_{kind}") for kind in pii_scan.BASE),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


def _number(kind):
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def _listed(spans):
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op3_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2)


def op4_decontamination(spark, sf_dir):
    found = decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_agreeing", "n_compared")


def op5_histogram_shards(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return sharding.assigned(docs.withColumn("text_crc32", F.crc32("text"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_quality_rules(spark, sf_dir):
    return quality_rules.judged_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def op7_best_fit_packing(spark, sf_dir):
    return packing.packed(packing.token_pieces(read_table(spark, sf_dir, "documents")))


def op8_toxicity(spark, sf_dir):
    return toxicity.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_secret_scan(spark, sf_dir):
    scanned = secret_scan.scanned_documents(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(secret_scan.SURE))
    return scanned.withColumn("spans", F.coalesce("spans", F.array())).select(
        "doc_id", *(_number(kind).alias(f"n_{kind}") for kind in secret_scan.SURE),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


def op10_substring_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    kept = substring_dedup.without_spans(docs, substring_dedup.repeated_spans(docs))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_collocations(spark, sf_dir):
    return collocations.top_collocations(collocations.collocations(read_table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark, sf_dir):
    conversations = read_table(spark, sf_dir, "conversations")
    found = conversation_repair.audits(conversation_repair.repaired(conversation_repair.damaged(conversations)))
    found = found.withColumnRenamed("conv_id", "found_id")
    asked = conversations.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return asked.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(byte_bpe.decoded(byte_bpe.encoded(read_table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_pii_scan, op3_near_dedup, op4_decontamination, op5_histogram_shards, op6_quality_rules, op7_best_fit_packing, op8_toxicity, op9_secret_scan, op10_substring_dedup, op11_collocations, op12_conversation_repair, op13_byte_bpe)}
SQL: dict[str, str] = {
    "op3_near_dedup": oracle.OP3,
    "op4_decontamination": oracle.OP4,
    "op6_quality_rules": oracle.OP6,
    "op9_secret_scan": oracle.OP9,
    "op10_substring_dedup": oracle.OP10,
    "op11_collocations": oracle.OP11,
}
