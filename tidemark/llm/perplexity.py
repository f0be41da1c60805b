"""Quality rules with an n-gram perplexity verdict.

The language model is an interpolated modified Kneser-Ney model of character 4-grams over the code points themselves;
only blanks, the SYMBOLS, and code points that fill up 64 bits otherwise (rare and private ones) share symbol classes.
An n-gram is its packed symbols. Spark counts the n-grams of all texts and, from those, continuation counts and counts
of counts; the n-grams of each order with their log-probabilities are a table that grows with the corpus, and the
driver holds only the counts of counts. Documents are dealt into blocks; the distinct n-grams of each block are joined
to the longest order's table, and each block is scored with its own part of the model, by binary search.
A mean over a document's symbols varies by one over the root of its length, so the
distance of a document is that of its log perplexity to its language's median, times that root. Each language's lower
and upper band at a length are the median minus and plus BAND times the median distance, over the root of the length.
Where the median distance is zero (one document, or equal ones for the most part), that of all documents is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chars import code_points, inside, segment_sums
from tidemark.llm.common import beside, free_name, row_keys, text_bytes
from tidemark.storage import materialize

ORDER = 4
#: Symbol classes; ALPHABET**ORDER is just below 2**63.
ALPHABET = 55108
SYMBOLS = b"#*$%&|<>"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "length")
#: Symbols of a block of documents that is scored together, on average.
BLOCK_SYMBOLS = 1 << 23
#: Distinct n-grams that a counting task holds before it passes them on.
HELD = 1 << 21
#: Half width of the perplexity bands, in median absolute deviations (README has what it rejects by quality label).
BAND = 4.0
#: Row hashes of 16 bytes that are broadcast at most.
BROADCAST_KEYS = 1_000_000
#: Languages whose bands are broadcast at most.
BROADCAST_BANDS = 10_000
#: Rounding of a document's mean loss; a band is wider than this on either side.
ROUNDING = 1e-6


def fold_table() -> np.ndarray:
    """Symbol class of every code point: its own, one for blanks, one for SYMBOLS, and hashed ones where 16 bits end.

    Hashed are code points from 0x10000, surrogates, private ones and the CJK ideographs of extension A.
    """
    points = np.arange(0x110000)
    own = (points < 0x10000) & ~((points >= 0xD800) & (points < 0xF900)) & ~((points >= 0x3400) & (points < 0x4DC0))
    table = np.cumsum(own) - 1
    n = int(own.sum())
    table[~own] = n + (points[~own] * 2654435761 >> 8) % (ALPHABET - n)
    table[[9, 10, 11, 12, 13]] = table[32]
    table[list(SYMBOLS)] = table[SYMBOLS[0]]
    return table


def packed(points: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The ORDER symbols that end at each position, packed into one number."""
    symbols = fold[points]
    code = symbols.copy()
    for k in range(1, ORDER):
        code[k:] += symbols[:-k] * ALPHABET**k if k < len(symbols) else 0
    return code


def _codes(points: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Packed 4-gram that ends at each position; what comes first is preceded by blanks."""
    return packed(np.concatenate((np.full(ORDER - 1, 32, np.uint32), points)), fold)[ORDER - 1 :]


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, their summed counts)."""
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts), len(code)).astype(np.int64)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(code, n) of all 4-grams of all texts, combined inside each task first; a text is preceded by blanks."""

    def run(batches):
        fold = fold_table()
        codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def rows():
            for at in range(0, len(codes[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(codes[0][at : at + (1 << 16)]), pa.array(counts[0][at : at + (1 << 16)])], names=["code", "n"])

        for batch in batches:
            for _, _, points, first, end in code_points(batch.column(0), lower=False):
                found = _codes(points, fold)
                code, n = np.unique(found[inside(first, end, len(found))], return_counts=True)
                codes, counts = [*codes, code], [*counts, n]
                if sum(map(len, codes[1:])) > max(len(codes[0]), HELD // 2):
                    codes, counts = ([x] for x in _summed(codes, counts))
                    if len(codes[0]) > HELD:
                        yield from rows()
                        codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        codes, counts = ([x] for x in _summed(codes, counts))
        yield from rows()

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Tables (code, log, backoff) per order, longest first: log-probability of an n-gram, log backoff weight of its context."""

    tables: list[DataFrame]
    symbols: int

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """log p(last symbol | symbols before) of few packed n-grams, seen or not; they travel to the tables."""

        def look_up(table: DataFrame, key, value: str, want: np.ndarray) -> np.ndarray:
            keys = table.sparkSession.createDataFrame(pa.table({"key": np.unique(want)}))
            got = table.select(key.alias("key"), value).join(F.broadcast(keys), "key").distinct().toArrow()
            have, order = got["key"].to_numpy(), np.argsort(got["key"].to_numpy())
            at = order[np.minimum(np.searchsorted(have[order], want), len(have) - 1)] if len(have) else np.zeros(len(want), np.int64)
            return np.where(have[at] == want, got[value].to_numpy()[at], np.nan) if len(have) else np.full(len(want), np.nan)

        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for k, table in enumerate(self.tables):
            if len(open_):
                want = codes[open_] % ALPHABET ** (ORDER - k)
                logs = look_up(table, F.col("code"), "log", want)
                hit = ~np.isnan(logs)
                out[open_[hit]] += logs[hit]
                open_ = open_[~hit]
                if len(open_):
                    out[open_] += np.nan_to_num(look_up(table, F.expr(f"code div {ALPHABET}"), "backoff", want[~hit] // ALPHABET))
        out[open_] -= np.log(ALPHABET)
        return out


def train(docs: DataFrame) -> Model:
    """Modified Kneser-Ney over all texts, in tables. The driver holds four counts of counts an order."""
    counts = [materialize(ngram_counts(docs), "ngrams")]
    for k in range(1, ORDER):  # continuation counts: distinct symbols before each shorter n-gram
        shorter = (F.col("code") % F.lit(ALPHABET ** (ORDER - k))).alias("code")
        counts.append(materialize(counts[-1].groupBy(shorter).agg(F.count("*").alias("n")), "ngrams"))
    figures = [[F.coalesce(F.sum((F.col("n") == i).cast("long")), F.lit(0)) for i in (1, 2, 3, 4)] for _ in counts]
    total = F.coalesce(F.sum("n"), F.lit(0))
    of_counts = [tuple(t.agg(*f, total).first()) for t, f in zip(counts, figures, strict=True)]

    tables: list[DataFrame] = []
    for k in range(ORDER - 1, -1, -1):  # shortest first
        ones, twos, threes, fours = (max(x, 1) for x in of_counts[k][:4])
        y = ones / (ones + 2 * twos)
        d = np.clip([1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes], 0.0, [0.9, 1.9, 2.9]).tolist()
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = Window.partitionBy(F.expr(f"code div {ALPHABET}"))  # at most ALPHABET rows
        each = counts[k].withColumn("total", F.sum("n").over(context)).withColumn("weight", F.sum(discount).over(context) / F.col("total"))
        if k == ORDER - 1:
            each = each.withColumn("below", F.lit(1 / ALPHABET))
        else:
            lower = tables[0].select(F.col("code").alias("shorter"), F.exp("log").alias("below"))
            each = each.withColumn("shorter", F.col("code") % F.lit(ALPHABET ** (ORDER - 1 - k))).join(lower, "shorter")
        p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("below")
        logs = each.select("code", F.log(F.greatest(p, F.lit(1e-12))).alias("log"), F.log(F.greatest("weight", F.lit(1e-12))).alias("backoff"))
        tables.insert(0, materialize(logs, "model"))
    return Model(tables, of_counts[0][4])


def repeat_statistics(text: bytes) -> tuple[int, int, int]:
    """(words, lines equal to an earlier line with a word, words in 3-word windows found twice or more)."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    duplicates = len(lines) - len(set(lines))
    n = len(words)
    if n < 4:
        return n, duplicates, 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return n, duplicates, 0
    pairs = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]
    windows = pairs[:-1] * len(ids) + a[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return n, duplicates, int(covered.sum())


def measure(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep columns, the base figures and length of every whole text, and its mean log-probability loss per symbol.

    The model must have counted these documents. A block's texts and its part of the model are in memory at once.
    """
    blocks = max(1, -(-model.symbols // BLOCK_SYMBOLS))
    source = docs.select(F.pmod(F.xxhash64(F.lit("block"), "doc_id", "text"), F.lit(blocks)).alias("__block"), F.col("text").cast("string").alias("__text"), *keep)

    def grams(table):
        fold, found = fold_table(), [np.zeros(0, np.int64)]
        for _, _, points, first, end in code_points(table.column(1), lower=False):
            codes = _codes(points, fold)
            found.append(np.unique(codes[inside(first, end, len(codes))]))
        code = np.unique(np.concatenate(found))
        return pa.table({"__block": np.full(len(code), table.column(0)[0].as_py()), "code": code})

    def run(table, part):
        fold = fold_table()
        order = np.argsort(part.column("code").to_numpy())
        known, logs = part.column("code").to_numpy()[order], part.column("log").to_numpy()[order]
        texts = table.column(1).combine_chunks()
        size = len(texts)
        figures = np.zeros((size, len(FIGURES)), np.int64)
        loss = np.zeros(size)
        starts, data = text_bytes(texts)
        raw = data.data
        for i in range(size):
            figures[i, 0], figures[i, 3], figures[i, 4] = repeat_statistics(bytes(raw[starts[i] : starts[i + 1]]))
        for lo, hi, points, first, end in code_points(texts, lower=False):
            blank = (points == 32) | ((points >= 9) & (points <= 13))
            figures[lo:hi, 1] = segment_sums(~blank, first, end)
            figures[lo:hi, 2] = segment_sums(np.isin(points, list(SYMBOLS)), first, end)
            figures[lo:hi, 5] = end - first
            codes, within = _codes(points, fold), inside(first, end, len(points))
            values = np.zeros(len(codes))
            if within.any():
                at = np.minimum(np.searchsorted(known, codes[within]), len(known) - 1)
                if not (known[at] == codes[within]).all():
                    raise ValueError("the model has not counted these documents")
                values[within] = logs[at]
            loss[lo:hi] = -segment_sums(values, first, end) / np.maximum(end - first, 1)
        columns = [*table.columns[2:], *(pa.array(figures[:, k]) for k in range(len(FIGURES))), pa.array(loss)]
        return pa.table(columns, names=[*table.schema.names[2:], *FIGURES, "loss"])

    wanted = source.groupBy("__block").applyInArrow(grams, "__block long, code long")
    parts = wanted.join(model.tables[0].select("code", "log"), "code").select("__block", "code", "log")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[2:])
    return source.groupBy("__block").cogroup(parts.groupBy("__block")).applyInArrow(run, f"{kept}{''.join(f'{name} long, ' for name in FIGURES)}loss double")


def judge(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns, base figures, base_failed, kept and perplexity of every document.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept: not
    base_failed and the perplexity lies within the bands of the document's language (null languages form one
    group). Null texts have no words and fail. Bands are taken from the documents that pass the base rules.
    """
    scored = materialize(measure(docs, train(docs), "lang", *[c for c in keep if c != "lang"]), "perplexity")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("band_lang", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    good = scored.filter(~F.col("base_failed"))
    middle = materialize(good.groupBy("band_lang").agg(F.percentile_approx("loss", 0.5, 1000).alias("middle")), "band-middles")
    middle = F.broadcast(middle) if middle.limit(BROADCAST_BANDS + 1).count() <= BROADCAST_BANDS else middle.hint("merge")
    root = F.sqrt(F.greatest("length", F.lit(1)))
    away = good.join(middle, "band_lang").select("band_lang", "middle", (F.abs(F.col("loss") - F.col("middle")) * root).alias("away"))
    spread = away.groupBy("band_lang", "middle").agg(F.percentile_approx("away", 0.5, 1000).alias("mad"))
    pooled = away.agg(F.percentile_approx("away", 0.5, 1000).alias("pooled"))
    bands = spread.crossJoin(F.broadcast(pooled)).select("band_lang", "middle", (BAND * F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("pooled"))).alias("width"))
    bands = materialize(bands, "bands")
    few = bands.limit(BROADCAST_BANDS + 1).count() <= BROADCAST_BANDS
    width = F.col("width") / root + ROUNDING
    within = F.coalesce(F.col("loss").between(F.col("low"), F.col("high")), F.lit(False))
    banded = scored.join(F.broadcast(bands) if few else bands.hint("merge"), "band_lang", "left").withColumn("low", F.col("middle") - width).withColumn("high", F.col("middle") + width)
    return banded.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & within).alias("kept"), F.exp("loss").alias("perplexity"), F.exp("low").alias("band_low"), F.exp("high").alias("band_high"),
    )


def accepted(docs: DataFrame) -> DataFrame:
    """docs without the rows that are not kept; equal rows share one verdict."""
    verdicts = judge(docs.select("doc_id", "text", "lang", *row_keys()), "k0", "k1", "lang")
    bad = verdicts.filter(~F.col("kept")).select(*[F.col(c).alias(free_name(docs, f"bad_{c}")) for c in ("k0", "k1", "lang")]).distinct()
    bad = beside(materialize(bad, "rejected"), BROADCAST_KEYS)
    one, two = row_keys()
    return docs.join(bad, (one == bad[0]) & (two == bad[1]) & docs["lang"].eqNullSafe(bad[2]), "left_anti")
