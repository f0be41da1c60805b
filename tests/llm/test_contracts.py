"""The queries' digests against plain recomputation over whole texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import components, decontamination, langid, linededup, mixing, perplexity, pii, queries, sharding, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def odd(df):
    return df.collect()


# --- 4 -------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    width = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_simhash(spark, rows):
    found = {r["doc_id"]: r for r in queries.op4_simhash_near_dedup(spark, SMALL).collect()}
    fp = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    assert {k: r["fingerprint"] for k, r in found.items()} == {k: f"{v:016x}" for k, v in fp.items()}
    expected = plain_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {k: r["component_id"] for k, r in found.items()} == expected


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("crowd", [2, 48])
def test_links_of_crowded_and_sparse_cells(spark, monkeypatch, bits, crowd):
    monkeypatch.setattr(simhash, "CELL_ROWS", crowd)
    rng = np.random.default_rng(bits)
    base = [int(x) for x in rng.integers(0, 2**63, 4)]
    values = {b for b in base} | {b ^ sum(1 << int(i) for i in set(rng.integers(0, 64, k))) for b in base for k in (1, 1, 2, 2, 3, 4, 5) for _ in range(9)}
    chain = [base[0] ^ ((1 << i) - 1) for i in range(0, 40, 2)]
    nodes = sorted(values | set(chain))
    df = spark.createDataFrame([(simhash._signed(v),) for v in nodes], "fp long")
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.fingerprint_links(df, bits)).collect()}
    expected = plain_components(nodes, lambda a, b: (a ^ b).bit_count() <= bits)
    groups, ours = defaultdict(set), defaultdict(set)
    for v in nodes:
        groups[expected[v]].add(v)
        ours[roots.get(simhash._signed(v), simhash._signed(v))].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_similar_groups_verify_close_pairs(spark):
    """Pairs around the threshold: none below it is merged, and at least 0.9 of those at or above it are found."""
    rng = random.Random(5)
    rows, sets = [], {}
    for family in range(60):
        words = [f"w{rng.randrange(9999)}" for _ in range(120)]
        other = list(words)
        for at in rng.sample(range(120), 1 + family % 5):
            other[at] = "changed"
        for k, w in enumerate((words, other)):
            rows.append((2 * family + k, " ".join(w)))
            sets[2 * family + k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    similar = {f: len(sets[2 * f] & sets[2 * f + 1]) / len(sets[2 * f] | sets[2 * f + 1]) >= 0.8 for f in range(60)}
    merged = {f: found[2 * f] == found[2 * f + 1] for f in range(60)}
    assert 0 < sum(similar.values()) < 60
    assert not [f for f in merged if merged[f] and not similar[f]]
    assert sum(merged.values()) >= 0.9 * sum(similar.values())


def test_similar_groups(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, family = [], {}
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(300)]
        for copy in range(4):
            edited = list(words)
            for _ in range(copy):
                edited[rng.randrange(300)] = rng.choice(vocabulary)
            family[len(texts)] = k
            texts.append((len(texts), " ".join(edited)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    assert all(family[i] == family[c] for i, c in found.items())
    assert len(set(found.values())) <= 66  # of 60 families
    assert simhash.deduplicate(df).count() == len(set(found.values()))


def test_large_families_of_different_texts(spark, monkeypatch):
    """Groups inside one large family of texts alike at 0.6 to 0.9 are those of all pairs, in blocks as well."""
    monkeypatch.setattr(simhash, "SMALL_CELL", 3)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    rng = random.Random(12)
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    rows, sets = [], {}
    for i in range(150):
        if i % 3 == 0:
            parent = list(base)
            for at in rng.sample(range(200), 12):
                parent[at] = f"p{i}x{at}"
        words = list(parent)
        for at in rng.sample(range(200), i % 3 * 3):
            words[at] = f"c{i}x{at}"
        rows.append((i, " ".join(words)))
        sets[i] = {tuple(words[k : k + 5]) for k in range(196)}
    root = list(range(150))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(150):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: top(i) for i in range(150)} and 3 < len(set(found.values())) < 150


def test_pairs_of_the_tables_are_found(spark):
    """Of all pairs of different texts at 0.8 or more in a table, at least 0.95 are joined, and no other groups are."""
    docs = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    sets = {r["doc_id"]: frozenset(simhash.shingle_hashes((r["text"] or "").encode(), 5).tolist()) for r in docs.collect()}
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    near = {(a, b) for i, s in sets.items() for other in {j for x in s for j in holders[x] if j < i} for a, b in [(other, i)] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near and sum(found[a] == found[b] for a, b in near) >= 0.95 * len(near)
    linked = defaultdict(set)
    for a, b in near:
        linked[a].add(b)
        linked[b].add(a)
    for i, c in found.items():
        assert c == i or not sets[i] or linked[i]


def test_a_repeated_line_does_not_link_texts(spark):
    """Texts that share one line many times and nothing else stay apart; how often a line repeats does not part copies."""
    rng = random.Random(8)
    line = " ".join(f"w{rng.randrange(9999)}" for _ in range(12))
    rows = [(i, "\n".join([line] * 30 + [" ".join(f"w{rng.randrange(9999)}" for _ in range(400))])) for i in range(40)]
    own = " ".join(f"w{rng.randrange(9999)}" for _ in range(400))
    rows += [(100 + n, "\n".join([line] * n + [own])) for n in (2, 5, 30)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == i for i in range(40))
    assert {found[100 + n] for n in (2, 5, 30)} == {102}


# --- 6, 7 ----------------------------------------------------------------------------------------------------------


def test_sharding(spark, rows):
    found = queries.op6_sharding(spark, SMALL).collect()
    by_id = {r["doc_id"]: r["text"] or "" for r in rows}
    assert sorted(r["doc_id"] for r in found) == sorted(by_id)
    for r in found:
        raw = by_id[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_communication_matrix():
    blocks = np.array([0, 7, 1000, 3])
    m = sharding.communication_matrix(blocks, 16, 1)
    assert (m.sum(axis=1) == blocks).all() and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, want = set(), {}
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        want = {s: 2 * sizes[s] if s in full else rest * weight[s] / total for s in names}
        over = {s for s in names if s not in full and want[s] > 2 * sizes[s]}
        if not over:
            return want
        full |= over


def test_mixing(spark, rows):
    found = {r["doc_id"]: r for r in queries.op7_mixing(spark, SMALL).collect()}
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    of = defaultdict(int)
    for r in rows:
        of[r["source"]] += size[r["doc_id"]]
    want = plain_targets(dict(of))
    taken = Counter()
    for r in rows:
        x = found[r["doc_id"]]
        assert (x["size"], x["source_size"]) == (size[r["doc_id"]], of[r["source"]]) and x["target"] == pytest.approx(want[r["source"]])
        assert 0 <= x["taken"] <= 2 * x["size"]
        taken[r["source"]] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= 3 * mixing.BLOCK_WORDS for s in want)
    again = {r["doc_id"]: r["taken"] for r in queries.op7_mixing(spark, SMALL).collect()}
    assert again == {k: r["taken"] for k, r in found.items()}


def test_mixed_documents_hold_the_words_taken(spark, docs):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    mixed = {r["doc_id"]: r for r in mixing.mixed_documents(docs).collect()}
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert {k: len(WORD.findall(r["text"])) for k, r in mixed.items()} == {k: n for k, n in taken.items() if n}
    assert all(r["n_chars"] == len(r["text"]) for r in mixed.values())


# --- 8 -------------------------------------------------------------------------------------------------------------


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality(spark, rows, odd_docs):
    found = {r["doc_id"]: r for r in queries.op8_quality_rules(spark, SMALL).collect()}
    for r in rows:
        x = found[r["doc_id"]]
        base = plain_quality(r["text"])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == base
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert x["base_failed"] == failed and not (x["kept"] and failed)
    passed = [x for x in found.values() if not x["base_failed"]]
    assert sum(x["kept"] for x in passed) >= 0.9 * len(passed)
    for x, r in zip(perplexity.judge(odd_docs, "doc_id", "text").collect(), range(100), strict=False):
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == plain_quality(x["text"]), r


def test_bands_reject_junk_of_each_language(spark):
    """Of labelled documents that pass the base rules, junk is rejected in each language and clean ones stay."""
    big = SMALL.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    passed = perplexity.judge(docs, "doc_id", "lang").filter("not base_failed").join(labels, "doc_id").collect()
    junk, clean = ([r for r in passed if r["quality"] == q] for q in (0, 1))
    assert {r["lang"] for r in junk if not r["kept"]} == {r["lang"] for r in junk}
    assert sum(not r["kept"] for r in junk) >= 0.5 * len(junk) > 0
    assert sum(r["kept"] for r in clean) >= 0.98 * len(clean) > 0


def test_kneser_ney_sums_to_one(docs):
    model = perplexity.train(docs)
    rng = np.random.default_rng(1)
    for context in rng.integers(0, perplexity.ALPHABET**3, 20):
        codes = context * perplexity.ALPHABET + np.arange(perplexity.ALPHABET)
        assert np.exp(model.log_probability(codes)).sum() == pytest.approx(1, abs=1e-3)


def test_model_grows_with_the_alphabet(spark, no_docs):
    """Letters of any script stay apart, every distinct 4-gram is in the model, and blocks are scored with its figures."""
    texts = ["Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια", "Все люди рождаются свободными и равными в своём достоинстве", "人人生而自由在尊嚴和權利上一律平等", "All HUMAN beings"]
    letters = {c for t in texts for c in t if c != " "}
    fold = perplexity.fold_table()
    assert len({fold[ord(c)] for c in letters}) == len(letters)
    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, lang string")
    model = perplexity.train(df)
    assert model.tables[0].count() == len({("   " + t)[i : i + 4] for t in texts for i in range(len(t))})
    found = {r["doc_id"]: r["perplexity"] for r in perplexity.judge(df, "doc_id").collect()}
    for i, t in enumerate(texts):
        codes = perplexity.packed(np.array([32] * 3 + [ord(c) for c in t], np.uint32), fold)[3:]
        assert found[i] == pytest.approx(np.exp(-model.log_probability(codes).mean()))
    assert perplexity.judge(no_docs, "doc_id").count() == 0


# --- 9 -------------------------------------------------------------------------------------------------------------

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def check_pii(found, rows):
    for x, text in zip(found, rows, strict=True):
        base = plain_pii(text)
        assert [x[f"n_{k}"] for k in KINDS] == [sum(b[2] == k for b in base) for k in KINDS], text[:200]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base)
        assert x["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(x["spans"].split(","))


def test_pii(spark, docs, rows):
    found = {r["doc_id"]: r for r in queries.op9_pii(spark, SMALL).collect()}
    check_pii([found[r["doc_id"]] for r in rows], [r["text"] for r in rows])


def test_pii_of_difficult_texts(spark):
    texts = [
        "a@b", "a@b.c", "x@@b.c.d", "..@b.c-d.e.", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 0.0.0.0 1.1.1.1", "00000000000000000000000000000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111",
        "+49 (30) 123-4567 89", "++1234567890", "+1 2", "+12345678901234567890", "é😀 a@b.c 😀 +1 234 567 890 4111111111111111", "a.b@c.d.e@f.g", "12 34 56 78 90 12 4111111111111111", "@@@@@", "a" * 5000 + "@b.c", "9" * 9000, "1." * 4000, "+1" * 3000, "a@b." * 2000, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    check_pii([found[i] for i in range(len(texts))], texts)


def test_pii_learns_contexts(spark):
    seeds = [(i, f"some words here please contact: user{i}@mail.example.org and go on") for i in range(40)]
    new = [(100, "other words please contact: user77(at)mail7 and so on"), (101, "nothing of the kind user77(at)mail7x here")]
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(seeds + new, "doc_id long, text string")).collect()}
    assert found[100].startswith("email:28:") and found[101] == ""


# --- 2, 3, 5, 10 ---------------------------------------------------------------------------------------------------


def plain_tiles(a, b, least):
    """Greedy string tiling by definition: mark the longest common unmarked runs first."""
    ma, mb, tiles = [False] * len(a), [False] * len(b), []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j, n)]
                elif n == best and n >= least:
                    found.append((i, j, n))
        if best < least:
            return tiles
        for i, j, n in found:
            if not any(ma[i : i + n]) and not any(mb[j : j + n]):
                tiles.append((i, j, n))
                ma[i : i + n] = mb[j : j + n] = [True] * n


def test_tiles_cover_as_much_as_by_definition():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = (rng.integers(0, 4, rng.integers(5, 60)).tolist() for _ in range(2))
        tiles = decontamination.tile(a, b, 5)
        assert all(a[i : i + n] == b[j : j + n] and n >= 5 for i, j, n in tiles)
        assert sum(t[2] for t in tiles) >= 0.8 * sum(t[2] for t in plain_tiles(a, b, 5))


def test_decontamination(spark, docs, rows):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    found = {(r["doc_id"], r["item_id"]): r["coverage"] for r in queries.op2_benchmark_decontamination(spark, SMALL).collect()}
    expected = set()
    for item in items:
        b = decontamination.tokens(item["text"])
        for r in rows:
            a = decontamination.tokens(r["text"])
            shingles = {tuple(b[i : i + 5]) for i in range(len(b) - 4)}
            if shingles & {tuple(a[i : i + 5]) for i in range(len(a) - 4)}:
                ids = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
                x = [ids[w] for w in a]
                if sum(t[2] for t in plain_tiles(decontamination._near_seeds(x, [ids[w] for w in b], 5), [ids[w] for w in b], 5)) >= 0.5 * len(b):
                    expected.add((r["doc_id"], item["item_id"]))
    assert set(found) == expected and expected


def test_reordered_benchmark_passage(spark, no_docs):
    words = [f"t{i}" for i in range(40)]
    text = " ".join(words[20:30] + ["x"] + words[0:10] + ["y", "z"] + words[30:40] + words[10:20])
    docs = spark.createDataFrame([(1, text), (2, " ".join(words[:7])), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(words)), (8, None), (7, "")], "item_id long, text string")
    got = decontamination.contamination(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"], r["n_tiles"]) for r in got] == [(1, 9, 1.0, 4)]
    assert [r["doc_id"] for r in decontamination.decontaminate(docs, items).orderBy("doc_id").collect()] == [2, 3]
    assert decontamination.contamination(no_docs, items).count() == 0


def test_large_benchmarks_give_the_same_pairs(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    plain = {tuple(r) for r in decontamination.contamination(docs, items).collect()}
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    assert plain and plain == {tuple(r) for r in decontamination.contamination(docs, items).collect()}


def test_decontamination_decides_by_row(spark, odd_docs):
    words = [f"t{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words), "a"), (1, "clean words only", "b"), (None, " ".join(words), "c"), (2, " ".join(words), "d"), (2, " ".join(words), "d"), (3, None, "e")], "doc_id long, text string, leak string")
    items = spark.createDataFrame([(9, " ".join(words), 5)], "item_id long, text string, doc_id long")
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r["leak"] for r in kept.collect()) == ["b", "e"]
    assert decontamination.contamination(docs, items).count() == 4
    assert decontamination.decontaminate(odd_docs, items).count() == odd_docs.count()


def held_out_accuracy(found, truth):
    pairs = [(f, truth[i]) for i, f in found.items() if i in truth]
    return sum(a == b for a, b in pairs) / max(len(pairs), 1)


def test_language(spark):
    big = SMALL.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    got = queries.op10_language_id(spark, big).collect()
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert held_out_accuracy({r["doc_id"]: r["lang_pred"] for r in got if r["held_out"]}, truth) >= 0.9


def test_naive_bayes_recomputed(spark):
    """Scores of a small corpus, recomputed by counting n-grams in dictionaries; slices of languages change nothing."""
    rng = random.Random(2)
    rows = [(i, lang, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(8))) for i, (lang, letters) in enumerate([("aa", "abcé"), ("bb", "bcdn"), ("cc", "xyzb"), ("dd", "äöab"), ("ee", "bxa")] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    counts = {lang: Counter() for lang in ("aa", "bb", "cc", "dd", "ee")}

    def buckets(text):
        codes = np.array([ord(c) for c in text.lower()], np.uint32)
        padded = np.concatenate((codes, np.full(4, 32, np.uint32)))
        return [int(b) for n in langid.ORDERS for b in langid.ngram_buckets(padded, n, langid.BUCKETS)[: len(codes)]]

    for _, lang, text in rows:
        counts[lang].update(buckets(text))
    totals = {lang: sum(c.values()) + 0.5 * langid.BUCKETS for lang, c in counts.items()}
    for size in (256, 2):
        got = {r["doc_id"]: r for r in langid.predict(df, langid.train(df, size=size), "doc_id").collect()}
        for i, _, text in rows:
            logs = {lang: math.log(1 / 5) + sum(math.log((c[b] + 0.5) / totals[lang]) for b in buckets(text)) for lang, c in counts.items()}
            best = max(logs, key=logs.get)
            assert got[i]["lang_pred"] == best
            assert got[i]["score"] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), abs=1e-3)


def test_toxicity(spark):
    big = SMALL.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    got = queries.op3_toxicity(spark, big).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert held_out_accuracy({r["doc_id"]: r["predicted"] for r in got if r["held_out"]}, truth) >= 0.9


def test_marginals_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(4)
    for n in (1, 2, 5):
        e, (into, out, stay) = rng.normal(size=n), rng.normal(size=3)
        weights = {s: np.exp(sum(e[i] * s[i] for i in range(n)) + sum((0, into, out, stay)[2 * a + b] for a, b in zip(s, s[1:], strict=False))) for s in product((0, 1), repeat=n)}
        exact = [sum(w for s, w in weights.items() if s[i]) / sum(weights.values()) for i in range(n)]
        f, b = toxicity.messages(e, np.array([0]), np.array([n]), into, out, stay)
        assert toxicity._sigmoid(f + b) == pytest.approx(exact)


def plain_dedup(rows, ends, least):
    """Units end at one of ends, followed by a blank, or at a line end; runs of repeated units with least words go."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        found, start = [], 0
        for i in range(len(text)):
            last = i + 1 == len(text)
            stop = text[i] == "\n" or (text[i] in ends and (last or text[i + 1].isspace()))
            if stop or last:
                body = text[start : i + 1].rstrip("\n")
                lead = len(body) - len(body.lstrip())
                if body.split():
                    found.append((start + lead, start + len(body.rstrip()), " ".join(body.lower().split())))
                start = i + 1
        gone, run = [], []
        for unit in [*found, None]:
            if unit and unit[2] in seen:
                run.append(unit)
            else:
                if run and sum(len(u[2].split()) for u in run) >= least:
                    gone.append((run[0][0], run[-1][1]))
                run = []
            if unit:
                seen.add(unit[2])
        out[doc] = gone
    return out


@pytest.mark.parametrize(("unit", "ends", "least"), [("line", "", 1), ("sentence", ".!?", 25), ("clause", ".!?,;:", 25)])
def test_units(spark, docs, rows, unit, ends, least, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_UNITS", 3)
    found = {r["doc_id"]: r for r in linededup.dedup(docs.select("doc_id", "text"), unit, least).collect()}
    removed = plain_dedup([(r["doc_id"], r["text"] or "") for r in rows], ends, least)
    for r in rows:
        mine = [(s["start"], s["end"]) for s in found[r["doc_id"]]["removed"]]
        trimmed = [(a + len(r["text"][a:b]) - len(r["text"][a:b].lstrip()), a + len(r["text"][a:b].rstrip())) for a, b in mine]
        assert trimmed == removed[r["doc_id"]]
        kept, at = "", 0
        for a, b in removed[r["doc_id"]]:
            kept, at = kept + r["text"][at:a], b
        assert (found[r["doc_id"]]["text"] or "").split() == (kept + (r["text"] or "")[at:]).split()
    assert any(removed.values())


def test_passages_go_and_phrases_stay(spark):
    """A passage that begins and ends inside other sentences goes from the later text; short repeated lines stay."""
    rng = random.Random(3)
    passage = ". ".join(" ".join(f"w{rng.randrange(9999)}" for _ in range(12)) for _ in range(5))
    rows = [(1, f"one two {passage} three. And ornd.\nTail of it"), (2, f"And ornd.\nOther four {passage} five six.\nAnd ornd."), (3, "And ornd.\nnothing else here")]
    got = {r["doc_id"]: r for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1]["removed"] and not got[3]["removed"] and len(got[2]["removed"]) == 1
    assert got[2]["text"].startswith("And ornd.\nOther four ") and got[2]["text"].endswith("five six.\nAnd ornd.") and len(got[2]["text"].split()) <= 2 + 2 + 24 + 2 + 2


def test_short_lines_count(spark):
    """Lines of one word and more are removed after their first occurrence; blank lines stay; a minimum spares short ones."""
    df = spark.createDataFrame([(1, "And ornd.\n\nx\nx"), (2, "and  ORND.\n\nnew"), (3, "one two three four five\nx"), (4, "one two three four five")], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in linededup.dedup(df, "line", 1).collect()}
    assert kept == {1: "And ornd.\n\nx\n", 2: "\nnew", 3: "one two three four five\n", 4: ""}
    spared = {r["doc_id"]: r["text"] for r in linededup.dedup(df, "line", 1, min_words=5).collect()}
    assert spared == {1: "And ornd.\n\nx\nx", 2: "and  ORND.\n\nnew", 3: "one two three four five\nx", 4: ""}


def test_large_hypergeometric_draws(monkeypatch):
    """Draws by inversion follow the exact probabilities; far beyond numpy's limit mean and spread are right."""
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 0)
    rng = np.random.default_rng(1)
    good, bad, n = 7, 12, 9
    weights = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(8)]
    drawn = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(20_000))
    assert all(abs(drawn[k] / 20_000 - w) < 0.015 for k, w in enumerate(weights))
    big = np.array([sharding.hypergeometric(rng, 10**12, 3 * 10**12, 20_000) for _ in range(3000)])
    assert abs(big.mean() - 5000) < 6 and abs(big.std() - math.sqrt(20_000 * 0.25 * 0.75)) < 3


# --- odd rows, empty tables ----------------------------------------------------------------------------------------


def models(docs):
    return langid.train(docs.select("text", "lang")), toxicity.train(docs.select("text", (F.col("doc_id") % 2).alias("toxic")))


def test_odd_rows_everywhere(spark, odd_docs):
    n = odd_docs.count()
    slices, crf = models(odd_docs)
    predicted = langid.predict(odd_docs, slices, "doc_id").collect()
    assert len(predicted) == n and {r["lang_pred"] for r in predicted if r["doc_id"] in (5, 6, 7)} == {"und"}
    assert toxicity.score(odd_docs, crf, "doc_id").count() == n
    assert simhash.near_duplicates(odd_docs).count() == n
    assert simhash.similar_groups(odd_docs).count() == n
    assert sharding.shard(odd_docs).count() == n == sharding.sharded_documents(odd_docs).count()
    assert mixing.mix(odd_docs).count() == n
    assert perplexity.judge(odd_docs, "doc_id").count() == n
    assert pii.personal_data(odd_docs).count() == n
    lines = linededup.dedup(odd_docs)
    assert lines.count() == n and lines.columns == [*odd_docs.columns, "removed"]
    for stage in (perplexity.accepted, simhash.deduplicate, mixing.mixed_documents):
        assert stage(odd_docs).columns == odd_docs.columns
        assert stage(odd_docs).count() <= n
    ids = [r["doc_id"] for r in simhash.deduplicate(odd_docs).collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and (1 in ids) and (2 not in ids)


def test_invalid_utf8_everywhere(spark, odd_docs):
    """Texts with bytes that are no UTF-8 crash nothing; what reads characters sees U+FFFD instead."""
    bad = spark.sql("select 90L doc_id, cast(X'41FF20C320E28220' || cast(repeat('word two three. ', 40) as binary) as string) text union all select 91L, cast(X'FFFE' as string)")
    docs = odd_docs.unionByName(bad, allowMissingColumns=True)
    n = docs.count()
    slices, crf = models(docs)
    counts = [
        langid.predict(docs, slices, "doc_id").count(), toxicity.score(docs, crf, "doc_id").count(), simhash.near_duplicates(docs).count(), sharding.shard(docs).count(), mixing.mix(docs).count(),
        perplexity.judge(docs, "doc_id").count(), pii.personal_data(docs).count(), linededup.dedup(docs).count(),
    ]
    assert counts == [n] * len(counts)
    item = spark.createDataFrame([(1, "word two three " * 4)], "item_id long, text string")
    broken = spark.sql("select 2L item_id, cast(X'FF41' as string) text")
    assert 90 in {r["doc_id"] for r in decontamination.contamination(docs, item.union(broken)).collect()}
    assert decontamination.decontaminate(docs, item).filter("doc_id = 90").count() == 0


def test_empty_tables_everywhere(spark, no_docs):
    slices, crf = models(no_docs)
    frames = [langid.predict(no_docs, slices, "doc_id"), toxicity.score(no_docs, crf, "doc_id"), simhash.near_duplicates(no_docs), simhash.similar_groups(no_docs), sharding.shard(no_docs), sharding.sharded_documents(no_docs), mixing.mix(no_docs), mixing.mixed_documents(no_docs), perplexity.judge(no_docs, "doc_id"), perplexity.accepted(no_docs), pii.personal_data(no_docs), linededup.dedup(no_docs), simhash.deduplicate(no_docs)]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    counts = [r["n"] for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert max(counts) - min(counts) <= 1
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    leaks = {r["doc_id"] for r in decontamination.contamination(docs, items).select("doc_id").collect()}
    failed = {r["doc_id"] for r in perplexity.judge(docs, "doc_id").filter("not kept").collect()}
    assert not {r["doc_id"] for r in out.collect()} & (leaks | failed)
