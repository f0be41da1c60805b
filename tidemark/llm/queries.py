"""One query per corpus operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import codes, decontamination, langid, linededup, lineindex, middle, mixing, oracles, perplexity, pii, sharding, simhash, suffixes, toxicity
from tidemark.llm.common import fold01, read_table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 400-byte strings cover which start anywhere else too.

    Null texts are empty; repeated rows are documents of their own, so that each covers the other. n_repeated counts the
    bytes that 300-byte strings cover in the same way, about a passage of fifty words; it removes nothing.
    """
    return suffixes.repeated_bytes(read_table(spark, sf_dir, "documents"), length=400, passage=suffixes.PASSAGE)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item whose tiles cover at least half of the item.

    Null and empty texts match nothing, repeated rows give repeated pairs, and invalid UTF-8 reads as U+FFFD.
    """
    return decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from labels whose id's crc32 modulo 5 is not 0.

    Null and empty texts score like a text without a toxic token; null ids count as empty text in the fold; without any
    label all scores are low. Of equal hashes of texts the sample takes the smaller text first.
    """
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").filter(fold01("doc_id", 5) != 0).select("doc_id", "toxic")
    crf = toxicity.train(toxicity.with_labels(docs, labels))
    scored = toxicity.score(docs, crf, "doc_id", (fold01("doc_id", 5) == 0).alias("held_out"))
    return scored.select("doc_id", "held_out", "score", "predicted", "spans")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and empty texts have fingerprint zero."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, max_bits=2)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication removes of every document: count, offsets and a digest of the text that stays.

    Null texts have no units and the digest of an empty text; of repeated rows one counts as the earlier.
    """
    kept = linededup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return kept.select("doc_id", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed_spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, nulls and repeated rows included; shard counts at most one apart."""
    return sharding.shard(read_table(spark, sf_dir, "documents"), shards=16)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; null texts have none, null sources are one source."""
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures, base verdict and the perplexity verdict of every document.

    Null and empty texts have no words and fail the base rules; null languages are a language of their own.
    """
    return perplexity.judge(read_table(spark, sf_dir, "documents"), "doc_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, by the stated patterns and by learnt ones; null texts are empty."""
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from documents whose id's crc32 modulo 4 is not 2.

    Null texts and texts without a letter are `und` with score 0; of equally likely languages the first by code point
    counts; without any labelled row every text is `und`.
    """
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(fold01("doc_id", 4) != 2).select("text", "lang"))
    return langid.predict(docs, model, "doc_id", (fold01("doc_id", 4) == 2).alias("held_out"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, sizes and digests of every document's rearranged text and of the text rebuilt from it; null texts are empty."""
    moved = middle.transform(read_table(spark, sf_dir, "documents").select("doc_id", "text"), unit="line", percent=100, spm_percent=50, seed=7)
    digest = [F.sha2(c.cast("binary"), 256) for c in (F.col("text"), middle.restored(F.col("text"), F.col("form")))]
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest[0].alias("output_sha256"), digest[1].alias("restored_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them an earlier document holds, and a digest of the rest; null texts are empty."""
    kept = lineindex.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=10, min_docs=2)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every vector without null or non-finite components, with a digest of the codebooks."""
    coded, books = codes.compress(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_benchmark_decontamination, op3_toxicity, op4_simhash_near_dedup, op5_substring_dedup, op6_sharding, op7_mixing,
        op8_quality_rules, op9_pii, op10_language_id, op11_fill_in_middle, op12_line_dedup, op13_vector_codes,
    )
}
ORACLES: dict[str, str] = {"op11_fill_in_middle": oracles.OP11, "op12_line_dedup": oracles.OP12, "op13_vector_codes": oracles.OP13}
