"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstrata.llm import (bpe, chat, decontaminate, licenses, pii, quality, repair, scoring, sharding, simhash, tokenbin,
                            trie, vectors)
from mailstrata.llm.common import staged, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest, license of the whole text and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by prefix dynamic programming, and the text decoded from them, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents with the verdicts of the base rules and the current policy."""
    book = quality.ledger(table(spark, sf_dir, "documents"))
    bits = F.col("failed_bits")
    return book.select("doc_id", *quality.MEASURES, "failed_bits",
                       (~quality.accepted(bits, "base-1")).alias("base_failed"),
                       quality.accepted(bits).alias("kept"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, equal texts together."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with its best window; clean documents have no row."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, count and checksum of every document's ids, read back from the files they were written to."""
    return tokenbin.read_back(tokenbin.write_files(table(spark, sf_dir, "documents")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all conversations' lines and their canonical turns."""
    return chat.segments(table(spark, sf_dir, "conversations"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by the bigram model of the training folds."""
    return scoring.score(table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data, and how many entities were replaced."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    replaced = F.size(F.filter(pii.entities(text), lambda m: pii.kind_of(m).isNotNull()))
    return docs.select("doc_id", pii.replaced(text, redrawn=pii.draws(docs)).alias("text"),
                       F.when(text.rlike(pii.HINT), replaced).otherwise(0).cast("long").alias("n_replaced"))


def op11_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found for every hundredth embedding, over all rows."""
    return vectors.neighbours(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest audit and repaired digest of all conversations, damaged as the contract says."""
    rows = repair.damaged(repair.rows_of(table(spark, sf_dir, "conversations")))
    return repair.ledger(repair.repaired(staged(repair.blocks(rows), "blocks")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations, with their members and subtree sums."""
    steps, lengths = trie.rebuilt(table(spark, sf_dir, "conversations"))
    return trie.digest_nodes(*trie.trie(steps, lengths))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_license_scan, op2_bpe, op3_quality_rules, op4_sharding, op5_simhash_neardup, op6_decontaminate,
        op7_token_files, op8_chat_format, op9_lm_score, op10_pii_surrogates, op11_adaptive_scan,
        op12_conversation_repair, op13_prefix_trie)}
