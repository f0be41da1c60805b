"""Fill-in-middle, line deduplication by index and vector codes against plain recomputation."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import codes, lineindex, middle, perfecthash, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "t string, i string, c0 long, row long, found string, doc long, n_lines long, form string, k0 long, k1 int, first long, shard int, number string, count long, ints string, v long, code string, error long, own string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def with_clashes(df):
    """df with columns that are named like internal ones."""
    names = [c.split() for c in CLASHING.split(", ")]
    return df.select("*", *[F.lit("7").cast(t).alias(c) for c, t in names if c not in df.columns])


# --- fill-in-middle ------------------------------------------------------------------------------------------------

def plain_middle(doc_id, text, percent=100, spm=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(lines), "plain", None, None, text
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return len(lines), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(lines), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_middle_query(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = queries.op11_fill_in_middle(spark, SMALL).collect()
    assert len(found) == len(rows)
    for r in found:
        n, form, pre, mid, output = plain_middle(r["doc_id"], rows[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], n, form, pre, mid, sha(output), sha(rows[r["doc_id"]] or ""))
    assert {r["form"] for r in found} >= {"psm", "spm"}


def test_middle_of_odd_rows(spark, odd_docs, no_docs):
    more = [(70, "a <P> b\nc"), (71, "<\n<S\n<M\nP>"), (72, "<\n" * 9), (73, "\n\n\n"), (74, "é\U0001f600\n" * 5), (75, "x" * 300_000 + "\n" + "ü\n" * 400_000)]
    docs = with_clashes(odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True))
    for percent, spm in ((100, 50), (40, 100), (0, 0)):
        out = middle.transform(docs, percent=percent, spm_percent=spm)
        assert [c for c in out.columns if c in docs.columns and c not in ("n", "form")] == [c for c in docs.columns if c not in ("n", "form")]
        back = out.withColumn("again", middle.restored(F.col("text"), F.col("form"))).collect()
        texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.select("doc_id", "text").collect())
        assert sorted((r["doc_id"] or -1, r["again"]) for r in back) == texts
        for r in back:
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["text"]) == plain_middle(r["doc_id"], r["again"], percent, spm)
            assert r["form"] == "plain" or r["prefix_chars"] + r["middle_chars"] + r["suffix_chars"] == len(r["again"])
    assert middle.transform(no_docs).count() == 0
    with pytest.raises(ValueError):
        middle.transform(docs, unit="page")


def test_middle_of_invalid_utf8(spark):
    df = spark.sql("select 1L doc_id, cast(X'41FF0A80C30A' as string) text union all select 2L, cast(X'0AFFFE' as string)")
    out = middle.transform(df).select("doc_id", F.sha2(middle.restored(F.col("text"), F.col("form")).cast("binary"), 256).alias("h")).collect()
    assert {r["doc_id"]: r["h"] for r in out} == {1: hashlib.sha256(bytes.fromhex("41FF0A80C30A")).hexdigest(), 2: hashlib.sha256(bytes.fromhex("0AFFFE")).hexdigest()}


@pytest.mark.parametrize("unit", middle.UNITS)
def test_cuts_are_where_units_begin(monkeypatch, unit):
    """Every cut of random texts, with small strides and windows, against units found one character at a time."""
    rng = random.Random(3)
    for case in range(60):
        monkeypatch.setattr(middle, "WINDOW", rng.choice([1, 3, 7, 64]))
        text = "".join(rng.choice("ab \n\té\U0001f600") for _ in range(rng.randrange(90)))
        blank = " \n\t"
        begins = [i for i, c in enumerate(text) if i == 0 or {"line": text[i - 1] == "\n", "word": text[i - 1] in blank and c not in blank, "char": True}[unit]]
        index = middle.Checkpoints(np.frombuffer(text.encode(), np.uint8), unit, rng.choice([1, 2, 5, 64]))
        assert (index.n, index.n_chars) == (len(begins), len(text)), case
        assert len(index.units) == len(index.bytes) == len(index.chars)
        for u, at in enumerate([*begins, len(text)]):
            assert index.cut(u) == (len(text[:at].encode()), at)


# --- line deduplication --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 50_000])
@pytest.mark.parametrize("levels", [1, 48])
def test_perfect_hash(monkeypatch, n, levels):
    monkeypatch.setattr(perfecthash, "MAX_LEVELS", levels)
    rng = np.random.default_rng(n)
    k0, k1 = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**32, n).astype(np.uint32)
    if n > 10:
        k0[:4] = k0[4]  # equal in the first 64 bits
    h = perfecthash.PerfectHash.from_bytes(perfecthash.PerfectHash.build(k0, k1).to_bytes())
    assert sorted(h(k0, k1).tolist()) == list(range(n))
    if levels > 1:
        assert len(h.words) * 64 <= 4 * n + 64 * 48


def plain_lines(rows, min_chars=10, min_docs=2):
    """[(id, lines, dropped, text)] of (id, text); a null id comes after all others."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(UPPER)
    holders, rank = defaultdict(list), lambda i: math.inf if i is None else i
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or min(holders[key(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept) if len(kept) < len(lines) else text))
    return out


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_line_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    expected = [(i, n, gone, sha(text or "")) for i, n, gone, text in plain_lines(rows)]
    assert by_text(queries.op12_line_dedup(spark, SMALL).collect()) == by_text(expected)
    assert sum(r[2] for r in expected) > 0


MANY_LINES = ["shared line of some length", "  SHARED line of Some length\t", "éééééééééé", "ééééééééé", "É shared line", "é shared line", "short", "another line, Here", "another line, here "]


@pytest.mark.parametrize("hot", [0, 2000])
@pytest.mark.parametrize("min_docs", [2, 4])
def test_lines_of_odd_rows(spark, monkeypatch, odd_docs, no_docs, hot, min_docs):
    monkeypatch.setattr(lineindex, "HOT_DOCS", hot)
    monkeypatch.setattr(lineindex, "HOT_SHARE", 0 if hot == 0 else 1 / 200_000)
    rng = random.Random(4)
    more = [(rng.choice([None, *range(100, 140)]), "\n".join(rng.choice(MANY_LINES) for _ in range(rng.randrange(6)))) for _ in range(60)]
    more.append((200, ("long line " * 50_000) + "\nshared line of some length\n" + "\n".join(f"line number {i} of many" for i in range(50_000))))
    more.append((201, "\n".join(f"LINE number {i} of many " for i in range(0, 50_000, 2)) + "\n" + "long line " * 50_000))
    docs = with_clashes(odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).repartition(5))
    out = lineindex.dedup(docs, min_docs=min_docs)
    assert out.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_dropped"]
    expected = plain_lines([tuple(r) for r in docs.select("doc_id", "text").collect()], min_docs=min_docs)
    assert by_text(out.select("doc_id", "n_lines", "n_dropped", "text").collect()) == by_text(expected)
    assert lineindex.dedup(no_docs).count() == 0
    with pytest.raises(ValueError):
        lineindex.dedup(docs, min_docs=1)


def test_lines_of_invalid_utf8(spark):
    line = b"\xff\xfe is not text \xc3".hex()
    df = spark.sql(f"select id doc_id, cast(unhex(concat('{line}', '0A', hex(cast(id as string)))) as string) text from range(3)")
    out = {r["doc_id"]: (r["n_dropped"], bytes(r["b"])) for r in lineindex.dedup(df).select("doc_id", "n_dropped", F.col("text").cast("binary").alias("b")).collect()}
    assert out == {0: (0, bytes.fromhex(line) + b"\n0"), 1: (1, b"1"), 2: (1, b"2")}


def test_index_rows_hold_each_shard(spark):
    """Probing what was not indexed finds nothing; what was has its documents and its first one."""
    df = spark.createDataFrame([(i, f"line of number {i % 50}\nline of its own {i}") for i in range(200)], "doc_id long, text string")
    index = lineindex.build_index(df, shards=16)
    found = {}
    for r in index.table.collect():
        shard = lineindex.Shard.from_row(*(bytes(r[c]) for c in ("number", "fingerprint", "count", "first")))
        for text in [f"line of number {i}" for i in range(50)] + [f"line of its own {i}" for i in range(200)] + [f"unknown line {i}" for i in range(99)]:
            k0, k1 = lineindex.key_arrays(list(lineindex.digests(text.encode(), 10)))
            if lineindex.shard_of(k0, 16)[0] == r["shard"]:
                found[text] = tuple(x[0] for x in shard.probe(k0, k1))
    assert all(found[f"line of number {i}"] == (4, i) for i in range(50))
    assert all(found[f"line of its own {i}"][0] == 1 for i in range(200))
    assert not any(n for t, (n, _) in found.items() if t.startswith("unknown"))


# --- vector codes --------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """{id: (code, error)} and the codebooks of (id, vector), in integers throughout; ids are distinct."""
    kept = sorted((i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    if not kept:
        return {}, []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v in kept:
                own[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    found = {}
    for i, v in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        found[i] = "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)
    return found, books


def digest_of(books):
    return sha(",".join(str(x) for book in books for e in book for x in e))


def check_codes(rows, labels, out, sha256):
    expected, books = plain_codes(rows)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in out} == expected
    assert not books or sha256 == digest_of(books)
    total = defaultdict(int)
    for i, (_, e) in expected.items():
        total[labels[i]] += e
    assert all(r["label_error"] == total[labels[r["vec_id"]]] for r in out)


def test_code_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    out = queries.op13_vector_codes(spark, SMALL).collect()
    assert len({r["codebooks_sha256"] for r in out}) == 1
    check_codes([(r["vec_id"], r["embedding"]) for r in rows], {r["vec_id"]: r["label"] for r in rows}, out, out[0]["codebooks_sha256"])


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("labels_travel", [0, 100_000])
def test_codes_of_odd_rows(spark, monkeypatch, kind, labels_travel):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", labels_travel)
    rng = random.Random(6)
    vectors = [[rng.choice([-1.5, -0.25, 0.0, 0.001, 0.5, 3.0]) for _ in range(8)] for _ in range(320)]
    vectors[5], vectors[9], vectors[40:60] = vectors[4], vectors[4], [vectors[4]] * 20
    bad = [None, [None] + [0.0] * 7, [float("nan")] + [0.0] * 7, [float("inf")] + [0.0] * 7, [float("-inf")] * 8]
    rows = list(enumerate(bad)) + [(10 + i, v) for i, v in enumerate(vectors)]
    rng.shuffle(rows)
    labels = {i: rng.choice([None, 1, 2]) for i, _ in rows}
    df = spark.createDataFrame([(i, v, labels[i], "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, l string").repartition(3)
    out, books = codes.compress(with_clashes(df))
    check_codes(rows, labels, out.collect(), books.sha256())
    assert set(with_clashes(df).columns) - {"embedding"} <= set(out.columns)
    near = codes.decode(out, books).select("vec_id", "vector", "error").collect()
    of = dict(rows)
    assert all(sum((math.floor(1024 * a) - round(1024 * b)) ** 2 for a, b in zip(of[r["vec_id"]], r["vector"], strict=True)) == r["error"] for r in near)


def test_codes_of_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label string"
    out, books = codes.compress(spark.createDataFrame([], schema))
    assert out.count() == 0 and books.entries.size == 0
    rows = [(1, [1e30] * 4, None), (2, [-1e30] * 4, "a"), (None, [0.5] * 4, "a"), (2, [-1e30] * 4, "a"), (3, [], "a"), (4, [1.0] * 3, "a"), (5, [1.0] * 8, "a")]
    out, books = codes.compress(spark.createDataFrame(rows, schema))
    assert sorted((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in out.collect()) == [(0, "03030303", 0, 0), (1, "00000000", 0, 0), (2, "01010101", 0, 0), (2, "01010101", 0, 0)]
    assert books.entries.shape == (4, 4, 1)


@pytest.mark.parametrize("scale", [1, 3, 2000, 2**24])
@pytest.mark.parametrize("n", [1, 15, 17, 100, 256])
def test_trees_find_what_all_distances_give(scale, n):
    rng = np.random.default_rng(scale + n)
    entries = rng.integers(-scale, scale + 1, (n, 3))
    entries[n // 2 :] = np.where(rng.random((n - n // 2, 1)) < 0.3, entries[: n - n // 2], entries[n // 2 :])
    points = np.concatenate([rng.integers(-scale, scale + 1, (500, 3)), entries])
    every = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    at, distance = codes.VantageTree(entries).nearest(points)
    assert (at == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_trees_leave_subtrees_out(monkeypatch):
    """On clustered entries most distances are never computed."""
    rng = np.random.default_rng(1)
    entries = (rng.integers(-5000, 5000, (16, 1, 8)) + rng.integers(-20, 20, (16, 16, 8))).reshape(256, 8)
    seen, real, tree = [], codes.squared, codes.VantageTree(entries)
    monkeypatch.setattr(codes, "squared", lambda p, e: (seen.append(len(p) * len(e)), real(p, e))[1])
    tree.nearest(entries)
    assert sum(seen) < 0.35 * 256 * 256
