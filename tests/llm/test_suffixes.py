import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SMALL
from tidemark.llm import queries, suffixes


def brute(rows, length):
    """rows: (doc_id, text). Windows are counted one by one."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[p : p + length] for _, r in raws for p in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        covered = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                covered[p : p + length] = True
        covered[len(r)] = False
        spans = int((np.diff(covered.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~covered[:-1]])
        out.append((i, len(r), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()]


def order(rows):
    return sorted(rows, key=str)


def test_all_strings_of_real_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert order(result(suffixes.repeated_bytes(docs))) == order(brute(rows, 400))


@pytest.mark.parametrize("hot", [suffixes.HOT_KINDS, 1])
def test_edited_copies_of_few_letters(spark, hot):
    """Two letters, periodic stretches and single edits: many owners with equal beginnings."""
    rng = random.Random(3)
    base = "".join(rng.choice("ab") for _ in range(3000))
    rows = [(0, base), (1, base[:1500] + "X" + base[1501:]), (2, "ab" * 700), (3, "ab" * 300 + "c" + "ab" * 300), (4, base[700:1111] + base[100:505]), (5, base[:399]), (6, "é" * 450)]
    rows += [(10 + k, "".join(rng.choice("ab") for _ in range(rng.randrange(300))) + base[k * 7 : k * 7 + 380 + k * 5]) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert order(result(suffixes.repeated_bytes(docs, hot=hot))) == order(brute(rows, 400))


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert order(result(suffixes.repeated_bytes(odd_docs))) == order(brute(rows, 400))
    assert suffixes.repeated_bytes(no_docs).count() == 0


def test_loser_tree_orders_and_knows_prefixes():
    rng = random.Random(9)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(rng.randrange(1, 30))) for _ in range(7)]
    built = []
    for r in runs:
        prefix, rests, sizes = suffixes.front_code(r)
        built.append(suffixes.Run(prefix, rests, sizes))
    merged = [(runs[i][k], lcp) for i, k, lcp in suffixes.merge(built)]
    assert [s for s, _ in merged] == sorted(s for r in runs for s in r)
    for (a, _), (b, lcp) in zip(merged, merged[1:], strict=False):
        assert lcp == suffixes.shared(a, b, 0)


def test_a_passage_that_many_documents_share(spark):
    """One passage in 300 of 400 rows over 16 partitions, cut at other places in each, and rows that repeat others."""
    rng = random.Random(11)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passage = noise(900)
    rows = [(k, noise(rng.randrange(500)) + (passage[k % 7 * 30 : 900 - k % 5 * 40] if k % 4 else noise(200)) + noise(rng.randrange(500))) for k in range(400)]
    rows += [rows[1], rows[1], (900, rows[2][1]), (901, rows[3][1] + rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert order(result(suffixes.repeated_bytes(docs))) == order(brute(rows, 400))


def test_a_text_of_megabytes(spark):
    """Random letters hold no other long repeats: what goes is the planted passage, and where a third text holds its end."""
    rng = np.random.default_rng(4)
    letters = "".join(map(chr, rng.integers(97, 123, 3_000_000, dtype=np.uint8)))
    passage = letters[1_000_000:1_000_600]
    text = letters[:2_500_000] + "-" + passage + "+" + letters[2_500_000:]
    docs = spark.createDataFrame([(1, text), (2, "!" + passage[-450:] + "?"), (3, letters[:399])], "doc_id long, text string")
    found = {r[0]: r[1:4] for r in result(suffixes.repeated_bytes(docs))}
    assert found == {1: (3_000_602, 1200, 2), 2: (452, 450, 1), 3: (399, 0, 0)}


def test_segments_are_packed_whole():
    for raw in (b"", b"a", bytes(range(256)) * 900):
        assert suffixes.unpacked(suffixes.packed(raw)) == raw


@pytest.mark.parametrize("hot", [suffixes.HOT_KINDS, 1])
def test_passages_under_the_length_that_is_removed(spark, hot):
    """Passages of 290 to 420 bytes in other texts and twice in one, at ends of texts, and copied texts of 350 bytes."""
    rng = random.Random(17)

    def noise(n):
        return "".join(rng.choice("ab") for _ in range(n))

    passages = [noise(n) for n in (290, 299, 300, 301, 330, 385, 399, 400, 401, 420)]
    rows = [(k, noise(k % 3 * 90) + passages[k % 10] + noise(k % 4 * 80)) for k in range(60)]
    rows += [(60, passages[4] + noise(50) + passages[4]), (61, passages[5] + passages[6]), (62, passages[9][5:350]), (63, None)]
    rows += [(70 + k, copy) for k, copy in enumerate([noise(350)] * 2 + [noise(299)] * 2 + [noise(400)] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffixes.repeated_bytes(docs, hot=hot, passage=300)
    assert order(result(found)) == order(brute(rows, 400))
    assert {r["doc_id"]: r["n_repeated"] for r in found.collect()} == {r[0]: r[2] for r in brute(rows, 300)}


def test_the_query_counts_passages_of_over_fifty_words(spark):
    """All documents against brute force at both lengths; passages that the longer one leaves are counted."""
    found = queries.op1_suffix_array_dedup(spark, SMALL)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert order(result(found)) == order(brute(rows, 400))
    counted = {r["doc_id"]: r["n_repeated"] for r in found.collect()}
    assert counted == {r[0]: r[2] for r in brute(rows, 300)}
    assert any(counted[r[0]] and not r[2] for r in brute(rows, 400))
