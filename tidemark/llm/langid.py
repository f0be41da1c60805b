"""Language identification by multinomial naive Bayes over hashed character n-grams.

Spark counts the hashed 1- to 3-grams of all training texts per language (combined inside each task first); the
smoothed log-probability matrix, buckets x languages, is broadcast, and each batch is scored as a sparse matrix
in row-pointer form whose column indices are the n-gram buckets. Languages are taken in slices of SLICE, each with a
matrix of at most BUCKETS * SLICE * 4 bytes: a slice is counted and scored in a pass of its own, and a document keeps
the likeliest language so far and the sum of all likelihoods, so any number of languages gives the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chars import code_points, inside, letters, segment_sums

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Languages of one matrix (64 MB).
SLICE = 256
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
UNDETERMINED = "und"


def ngram_buckets(points: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point."""
    wide = points.astype(np.uint64) + np.uint64(1)
    h = np.full(len(wide), order, np.uint64)
    for k in range(order):
        shifted = np.concatenate((wide[k:], np.full(min(k, len(wide)), 33, np.uint64)))
        h = (h ^ (shifted * MULTIPLIERS[k])) * MULTIPLIERS[2]
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(16)).astype(np.int64) & (buckets - 1)


def ngram_counts(docs: DataFrame, languages: list[str], buckets: int) -> DataFrame:
    """(language index, bucket, n) over all rows of docs (text, lang); each task emits one row per pair at most."""
    index = {name: i for i, name in enumerate(languages)}

    def run(batches):
        counts = np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            label = np.fromiter((index[x] for x in batch.column(1).to_pylist()), np.int64, batch.num_rows)
            for lo, hi, points, first, end in code_points(batch.column(0), lower=True):
                body = inside(first, end, len(points))
                row_of = np.repeat(label[lo:hi], end - first)
                for order in ORDERS:
                    b = ngram_buckets(points, order, buckets)[body]
                    counts += np.bincount(row_of * buckets + b, minlength=counts.size).reshape(counts.shape)
        lang, bucket = np.nonzero(counts)
        for at in range(0, len(lang), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang[cut].astype(np.int32)), pa.array(bucket[cut].astype(np.int32)), pa.array(counts[lang[cut], bucket[cut]])], names=["label", "bucket", "n"]
            )

    return docs.select(F.col("text"), F.col("lang")).mapInArrow(run, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, alpha: float = 0.5, size: int = SLICE) -> list[tuple[list[str], np.ndarray]]:
    """(languages, log-probability matrix of BUCKETS + 1 rows, the last row being the class priors) of each slice.

    Rows (text, lang) with a null in either are ignored; without any there is no slice.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    priors = sorted((r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in priors)
    slices = []
    for at in range(0, len(priors), size):
        part = priors[at : at + size]
        languages = [name for name, _ in part]
        mine = known if len(priors) <= size else known.filter(F.col("lang").isin(languages))
        table = ngram_counts(mine, languages, BUCKETS).toArrow()
        counts = np.full((BUCKETS, len(languages)), alpha)
        counts[table["bucket"].to_numpy(), table["label"].to_numpy()] += table["n"].to_numpy()
        matrix = np.zeros((BUCKETS + 1, len(languages)), np.float32)
        matrix[:BUCKETS] = np.log(counts / counts.sum(axis=0))
        matrix[BUCKETS] = np.log(np.array([n for _, n in part], np.float64) / total)
        slices.append((languages, matrix))
    return slices


def predict(docs: DataFrame, slices: list[tuple[list[str], np.ndarray]], *keep: str | Column) -> DataFrame:
    """keep columns and (lang_pred, score): the likeliest language and its posterior.

    Null texts and texts without a Unicode letter give ("und", 0.0), as does a model without languages.
    """
    kept = docs.select(F.struct(*keep).alias("kept"), F.col("text").cast("string").alias("text"))
    state = kept.select("text", F.lit(UNDETERMINED).alias("best"), F.lit(0.0).alias("top"), F.lit(0.0).alias("rest"), "kept")
    for at, (languages, matrix) in enumerate(slices):
        state = state.mapInArrow(_scoring(docs.sparkSession.sparkContext.broadcast(matrix), languages, at == 0), state.schema)
    score = F.when(F.col("best") == UNDETERMINED, 0.0).otherwise(1 / F.col("rest"))
    return state.select("kept.*", F.col("best").alias("lang_pred"), score.alias("score"))


def _scoring(model, languages: list[str], first_slice: bool):
    """A pass over batches (text, best, top, rest, kept): the likeliest language so far, its log-likelihood, and the
    sum of all likelihoods so far over its own."""

    def run(batches):
        weights = model.value
        names = np.array(languages, dtype=object)
        for batch in batches:
            best = batch.column(1).to_numpy(zero_copy_only=False).copy()
            top, rest = batch.column(2).to_numpy().copy(), batch.column(3).to_numpy().copy()
            for lo, hi, points, first, end in code_points(batch.column(0), lower=True):
                logs = np.zeros((hi - lo, len(names)))
                for order in ORDERS:
                    logs += segment_sums(weights[ngram_buckets(points, order, BUCKETS)], first, end)
                logs += weights[BUCKETS]
                mine, has_letter = logs.max(axis=1), segment_sums(letters()[points].astype(np.int8), first, end) > 0
                before = np.full(hi - lo, -np.inf) if first_slice else top[lo:hi].copy()
                now = np.maximum(mine, before)
                rest[lo:hi] = rest[lo:hi] * np.exp(before - now) + np.exp(logs - now[:, None]).sum(axis=1)
                top[lo:hi] = now
                best[lo:hi] = np.where(has_letter, np.where(mine > before, names[logs.argmax(axis=1)], best[lo:hi]), UNDETERMINED)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(top), pa.array(rest), batch.column(4)], names=batch.schema.names)

    return run
