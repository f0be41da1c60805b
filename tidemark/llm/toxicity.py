"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are labelled from document labels: Spark counts, over all labelled training rows, how many toxic and
non-toxic documents hold each word and word beginning; a token of a toxic document is labelled toxic if one of its
forms is far commoner in toxic documents. A two-state chain is fitted to these labels on a bounded, class-balanced
sample (SAMPLE_ROWS rows per class, whole texts of any length). Every whole text is then tagged by exact
forward-backward marginals, run over all texts of a batch at once; their sums and maxima give the document score
by logistic regression, and tokens with a marginal of at least one half are the offending spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, text_bytes, valid_text
from tidemark.storage import materialize

SAMPLE_ROWS = 1200
#: A form marks tokens if it is in at least this many toxic documents, and this many times commoner in them.
LEAST_DOCS, LEAST_LIFT = 4, 12.0
DIMENSIONS = 1 << 18
#: Labels of 16 bytes, and forms, that are broadcast at most.
BROADCAST_LABELS = 1_000_000
PREFIXES = (4, 5)
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-"
SPAN = re.compile(rb"[^\x20\x09-\x0D]+")
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
CHUNK = 8 << 20
CACHE_WORDS = 500_000


def forms(word: str) -> tuple[str, ...]:
    """The word without edge punctuation in lower case, and its beginnings."""
    w = word.lower().strip(EDGES)
    return (w, *(f"{w[:n]}~" if len(w) > n else f"{w}^{n}" for n in PREFIXES))


def feature_ids(word: str) -> tuple[int, ...]:
    return tuple(xxhash.xxh32_intdigest(f) % DIMENSIONS for f in forms(word))


@dataclass
class Crf:
    weights: np.ndarray  # of hashed forms, for the toxic state
    bias: float
    into: float  # clean to toxic
    out_of: float  # toxic to clean
    stay: float  # toxic to toxic
    document: np.ndarray  # of the document figures, intercept last

    def emission(self, word: str) -> float:
        return self.bias + float(self.weights[list(feature_ids(word))].sum())


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def messages(emissions: np.ndarray, first: np.ndarray, lengths: np.ndarray, into: float, out_of: float, stay: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the forward and backward messages of many chains, laid end to end.

    All chains advance together, longest first, so a step costs one vector operation over those still running.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = first[order], lengths[order]
    forward, backward = np.empty(len(emissions)), np.zeros(len(emissions))
    running = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    r = np.zeros(0)
    for t, m in enumerate(running):
        at = starts[:m] + t
        r = emissions[at] + (_softplus(r[:m] + stay - into) + into - _softplus(r[:m] + out_of) if t else 0.0)
        forward[at] = r
    ends = starts + sizes
    b = np.zeros(0)
    for t, m in enumerate(running):
        at = ends[:m] - 1 - t
        if t:
            x = emissions[at + 1] + b[:m]
            b = _softplus(stay - out_of + x) + out_of - _softplus(into + x)
        else:
            b = np.zeros(m)
        backward[at] = b
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def document_figures(marginals: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: expected toxic tokens (log), the highest marginal, their share of tokens, and one."""
    total = np.concatenate(([0.0], np.cumsum(marginals)))
    expected = np.maximum(total[first + lengths] - total[first], 0.0)
    highest = np.zeros(len(first))
    some = lengths > 0
    if some.any():
        highest[some] = np.maximum.reduceat(marginals, first[some])
    return np.column_stack((np.log1p(expected), highest, expected / np.maximum(lengths, 1), np.ones(len(first))))


def words_of(text: str) -> list[str]:
    """The tokens of fitting and scoring alike: runs of anything but six ASCII blanks."""
    return [w for w in BLANKS.split(text) if w]


def toxic_forms(labelled: DataFrame) -> DataFrame:
    """(form) of the forms that mark toxic tokens, from all rows of labelled (text, toxic).

    Forms are counted once per document, and once for equal toxic texts, so that the words of one text that was copied
    do not count as many; those in at least LEAST_DOCS toxic texts and LEAST_LIFT times commoner there stay. The forms
    of a table without toxic rows are none.
    """

    def cut(batches):
        for batch in batches:
            out: list[str] = []
            label: list[int] = []
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = {f for w in set(words_of(text or "")) for f in forms(w)}
                out += found
                label += [toxic] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(label, pa.int32())], names=["form", "toxic"])

    def found(value: int) -> DataFrame:
        return labelled.filter(F.col("toxic") == value).select("text", F.col("toxic").cast("int")).mapInArrow(cut, "form string, toxic int")

    bad = labelled.filter("toxic = 1").select(F.xxhash64("text").alias("h")).distinct().count()
    good = labelled.filter("toxic = 0").count()
    labelled = labelled.filter("toxic = 0").unionByName(labelled.filter("toxic = 1").dropDuplicates(["text"]))
    of_toxic = materialize(found(1).groupBy("form").agg(F.count("*").alias("b")).filter(F.col("b") >= LEAST_DOCS), "toxic-forms")
    few = of_toxic.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    wanted = of_toxic.select("form")
    of_clean = found(0).join(F.broadcast(wanted) if few else wanted.hint("merge"), "form", "left_semi").groupBy("form").agg(F.count("*").alias("g"))
    lift = (F.col("b") / max(bad, 1)) / ((F.coalesce("g", F.lit(0)) + 0.5) / (good + 1))
    return materialize(of_toxic.join(of_clean, "form", "left").filter(lift >= LEAST_LIFT).select("form"), "toxic-marks")


def marks_among(marks: DataFrame, texts: list[str]) -> set[str]:
    """The marking forms that the bounded sample of texts holds."""
    held = sorted({f for t in texts for w in set(words_of(t)) for f in forms(w)})
    if not held:
        return set()
    wanted = marks.sparkSession.createDataFrame(pa.table({"form": pa.array(held, pa.string())}))
    return set(marks.join(F.broadcast(wanted), "form", "left_semi").toArrow()["form"].to_pylist())


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the documents that have a label (doc_id, toxic).

    Up to BROADCAST_LABELS labels travel to the texts; more are joined by a shuffle, with the same rows.
    """
    known = labels.filter("doc_id is not null").select("doc_id", "toxic")
    few = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return docs.select("doc_id", "text").join(F.broadcast(known) if few else known.hint("merge"), "doc_id").select("text", "toxic")


def train(labelled: DataFrame, epochs: int = 4, rate: float = 0.3) -> Crf:
    """Fit the chain and the document regression on labelled rows (text, toxic 0/1); other labels are ignored.

    Null texts are ignored, and what is not valid UTF-8 reads as U+FFFD. Without any row a fixed model gives every text a low score; with one class alone the
    regression tends to that class.
    """
    usable = labelled.filter(F.col("toxic").isin(0, 1) & F.col("text").isNotNull())
    labelled = materialize(usable.select(valid_text().alias("text"), F.col("toxic").cast("int").alias("toxic")), "toxicity-labelled")
    texts, labels = [], []
    for value in (1, 0):
        for row in labelled.filter(F.col("toxic") == value).orderBy(F.xxhash64("text"), "text").limit(SAMPLE_ROWS).collect():
            texts.append(row["text"])
            labels.append(value)
    share = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    crf = Crf(np.zeros(DIMENSIONS), -3.0, -2.0, 0.0, 0.0, np.array([0.0, 0.0, 0.0, -3.0]))
    if not texts:
        return crf
    marks = marks_among(toxic_forms(labelled), [t for t, y in zip(texts, labels, strict=True) if y])
    cache: dict[str, tuple[tuple[int, ...], bool]] = {}

    def known(word: str) -> tuple[tuple[int, ...], bool]:
        if word not in cache:
            cache[word] = feature_ids(word), any(f in marks for f in forms(word))
        return cache[word]

    words = [[known(w) for w in words_of(t)] for t in texts]
    squares = np.full(DIMENSIONS, 1e-6)
    step = np.full(4, 1e-6)
    rng = np.random.default_rng(11)
    y = np.array(labels)
    for _ in range(epochs):
        deal = rng.permutation(len(texts))
        for at in range(0, len(deal), 200):
            pick = deal[at : at + 200]
            lengths = np.array([len(words[i]) for i in pick])
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            ids = np.array([f for i in pick for f, _ in words[i]], np.int64).reshape(-1, 1 + len(PREFIXES))
            if not len(ids):
                continue
            gold = np.concatenate([np.array([y[i] == 1 and m for _, m in words[i]], bool) for i in pick]).astype(float)
            e = crf.bias + crf.weights[ids].sum(axis=1)
            f, b = messages(e, first, lengths, crf.into, crf.out_of, crf.stay)
            p = _sigmoid(f + b)
            pair = np.ones(len(e), bool)
            pair[(first + lengths - 1)[lengths > 0]] = False
            left = np.flatnonzero(pair)
            x = e[left + 1] + b[left + 1]
            energies = np.stack((np.zeros(len(left)), crf.into + x, f[left] + crf.out_of, f[left] + crf.stay + x))
            probability = np.exp(energies - energies.max(axis=0))
            probability /= probability.sum(axis=0)
            g0, g1 = gold[left], gold[left + 1]
            observed = np.array([((1 - g0) * g1).sum(), (g0 * (1 - g1)).sum(), (g0 * g1).sum()])
            slope = gold - p
            n = len(pick)
            grad = np.concatenate(([slope.sum()], observed - probability[1:].sum(axis=1))) / n - 1e-3 * np.array([crf.bias, crf.into, crf.out_of, crf.stay])
            step += grad**2
            crf.bias, crf.into, crf.out_of, crf.stay = np.array([crf.bias, crf.into, crf.out_of, crf.stay]) + rate * grad / np.sqrt(step)
            sparse = np.zeros(DIMENSIONS)
            np.add.at(sparse, ids.ravel(), np.repeat(slope, ids.shape[1]) / n)
            squares += sparse**2
            crf.weights += rate * sparse / np.sqrt(squares)
    lengths = np.array([len(w) for w in words])
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    e = crf.bias + np.concatenate([crf.weights[np.array([f for f, _ in w], np.int64).reshape(-1, 1 + len(PREFIXES))].sum(axis=1) for w in words])
    f, b = messages(e, first, lengths, crf.into, crf.out_of, crf.stay)
    crf.document = _logistic(document_figures(_sigmoid(f + b), first, lengths), y, np.array([share.get(v, 0) / max((y == v).sum(), 1) for v in y]))
    return crf


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; weights restore the classes' shares of all labelled rows."""
    w, weight = np.zeros(x.shape[1]), weight / weight.sum() * len(y)
    for _ in range(50):
        p = _sigmoid(x @ w)
        grad = x.T @ (weight * (y - p)) - 0.05 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        move = np.linalg.solve(hessian, grad)
        w = w + np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, crf: Crf, *keep) -> DataFrame:
    """keep columns, score (0 to 1), predicted (score >= 0.5) and spans of every whole text.

    spans lists start:end of tokens with a marginal of at least one half, in code points, comma-joined. Null and
    empty texts get the score of a text without a toxic token and no spans.
    """
    model = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        m, cache = model.value, {}
        for batch in batches:
            starts, data = text_bytes(batch.column(0))
            raw = data.data
            scores, spans = np.zeros(batch.num_rows), [""] * batch.num_rows
            for lo, hi in chunks(starts, CHUNK):
                texts = [bytes(raw[starts[i] : starts[i + 1]]) for i in range(lo, hi)]
                tokens = [t.split() for t in texts]
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                flat = [w for t in tokens for w in t]
                for w in set(flat).difference(cache):
                    cache[w] = m.emission(w.decode(errors="replace"))
                e = np.fromiter(map(cache.__getitem__, flat), np.float64, len(flat))
                lengths = np.fromiter(map(len, tokens), np.int64, hi - lo)
                first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                f, b = messages(e, first, lengths, m.into, m.out_of, m.stay)
                p = _sigmoid(f + b)
                scores[lo:hi] = _sigmoid(document_figures(p, first, lengths) @ m.document)
                owner = np.searchsorted(first + lengths, np.flatnonzero(p >= 0.5), side="right")
                for i in np.unique(owner):
                    found = [x.span() for x in SPAN.finditer(texts[i])]
                    at = np.flatnonzero(p[first[i] : first[i] + lengths[i]] >= 0.5)
                    text = texts[i]
                    position = [(len(text[: found[k][0]].decode(errors="replace")), len(text[found[k][0] : found[k][1]].decode(errors="replace"))) for k in at]
                    spans[lo + i] = ",".join(f"{s}:{s + n}" for s, n in position)
            columns = [*batch.columns[1:], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "score", "predicted", "spans"])

    source = docs.select(F.col("text").cast("string").alias("__text"), *keep)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[1:])
    return source.mapInArrow(run, f"{kept}score double, predicted int, spans string")
