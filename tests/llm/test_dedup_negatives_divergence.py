"""Exact dedup, hard negatives and the source audit against brute force, and on odd input."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import divergence, exact_dedup, hard_negatives

CLASH = ", row long, digest string, cell long, bucket long, again boolean, first string, group_size long, term string, chunk long, n long, total long"
NONE = (None,) * 11


# --- exact dedup ---


def odd_texts():
    r = random.Random(4)
    base = ["".join(r.choice("ab c\n\té漢🙂") for _ in range(r.randint(0, 12))) for _ in range(300)]
    base += [None, "", " \n", " ", "x" * 300_000, " x" * 300_000, "x\u0000y", "x\u0000 y"]
    return base + base[:60] + ["hot copy"] * 200


def brute_groups(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub("[ \t\n\x0b\x0c\r]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, k))
    out = []
    for text, g in groups.items():
        best = min(g)
        keep = None if best[1] else best[2]
        for x in g:
            out.append((None if x[1] else x[2], keep, len(g), x == best, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_cells", [1 << 15, 64])
def test_exact_groups_are_those_of_brute_force(spark, most_cells):
    rows = list(enumerate(odd_texts())) + [(None, "hot copy"), (None, "alone"), (3, "repeated id"), (3, "repeated id"), (3, "repeated  id")]
    docs = spark.createDataFrame([(*x, *NONE) for x in rows], "doc_id long, text string" + CLASH).coalesce(1)
    got = exact_dedup.exact_groups(docs, most_cells)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups(rows)


def test_exact_dedup_is_native_and_lets_single_rows_pass(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(3000)] + [(k, "twice") for k in (5000, 5001)], "doc_id long, text string")
    rows = exact_dedup.marked(exact_dedup.digests(docs))
    assert rows.where("doc_id >= 5000").where("again").count() == 2
    assert rows.where("again").count() < 2 + 0.04 * 3000
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_keep_one_leaves_the_longest(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (2, "ab", 8), (3, "a  b ", 9), (4, "c", 1), (None, "c", 2)], "doc_id long, text string, extra int")
    assert sorted((r["doc_id"] or 0, r["extra"]) for r in exact_dedup.keep_one(docs).collect()) == [(0, 2), (3, 9), (4, 1)]


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert exact_dedup.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- hard negatives ---

VECTORS = "vec_id long, embedding array<float>, label int, anchor_id long, rank int, x array<double>, a string, place long"


def odd_vectors(n=600, seed=9, scale=1.0):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = (r.normal(size=6) * scale).astype(np.float32)
        v = rows[-1][1] if k % 9 == 4 else [float(x) for x in v]  # repeated vectors tie
        rows.append((k, v, int(r.integers(0, 3))))
    hot = [0.5, 0.25, 0.0, 0.0, 0.5, 0.0]
    rows += [(n + k, hot, k % 3) for k in range(150)]
    nan, inf = float("nan"), float("inf")
    rows += [(1001, None, 1), (1002, [], 1), (1003, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1004, [nan] * 6, 1), (1005, [inf] * 6, 1), (1006, hot, None), (None, hot, 1), (1100, [1.0, 2.0], 1), (1107, [1.0, 3.0], 1), (1108, [1.0, 1.0], 2)]
    return rows


def brute_mine(rows, anchors, positives=5, negatives=10):
    good = [(i, [int(np.floor(np.float64(c) * 256)) for c in v], y) for i, v, y in rows if i is not None and y is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, q, label in good:
        if a % anchors:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, y) for i, v, y in good if i != a and len(v) == len(q)]
        pos = sorted((s, i) for s, i, y in scored if y == label)[:positives]
        for s, p in pos:
            neg = sorted((t, i) for t, i, y in scored if y != label and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(neg)]
    return sorted(out)


@pytest.mark.parametrize("scale, gemm, slice_, block", [(1.0, 256, 2048, 1 << 24), (1.0, 3, 7, 48 * 4), (3000.0, 256, 50, 1 << 24), (200_000.0, 4, 64, 1 << 24)])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, scale, gemm, slice_, block):
    monkeypatch.setattr(hard_negatives, "GEMM", gemm)
    monkeypatch.setattr(hard_negatives, "SLICE", slice_)
    rows = odd_vectors(300, scale=scale)
    v = spark.createDataFrame([(*x, 1, 2, [0.5], "a", 3) for x in rows], VECTORS).repartition(5)
    got = hard_negatives.mine(v, F.col("vec_id") % 50 == 0, block_bytes=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_mine(rows, 50) and got.count() > 100


def test_products_beyond_doubles_are_exact():
    r = np.random.default_rng(1)
    a, b = (np.floor(r.normal(size=(5, 8)) * 4e8) for _ in range(2))
    assert hard_negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]


def test_best_keeps_all_that_ties_by_id():
    best = hard_negatives.Best(2, 3)
    for part in ([7, 8, 9], [1, 2, 3], [4, 5, 6]):
        best.add(0, np.full((2, 3), 5), np.array([[True] * 3, [False] * 3]), np.array(part))
    row, score, vec = best.lists()
    assert row.tolist() == [0, 0, 0] and vec.tolist() == [1, 2, 3] and score.tolist() == [5, 5, 5]


def test_hard_negatives_of_odd_tables(spark):
    form = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], form), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 1)], form), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(100, [1.0], 1)], form), F.col("vec_id") % 100 == 0).count() == 0
    twice = spark.createDataFrame([(100, [1.0], 1), (100, [1.0], 2), (3, [1.0], 1), (3, [1.0], 1), (4, [0.5], 2), (4, [0.5], 2)], form)
    got = sorted(map(tuple, hard_negatives.mine(twice, F.col("vec_id") % 100 == 0).collect()))
    assert got == sorted([(100, 3, 1, 4, 65536, 32768), (100, 3, 2, 4, 65536, 32768)] * 2)  # rows that repeat an id count each
    assert [r["label"] for r in hard_negatives.mislabelled(spark.createDataFrame([(7, 9), (8, 9), (14, None)], "vec_id long, label int")).orderBy("vec_id").collect()] == [0, 9, None]


# --- source divergence ---


def odd_docs(seed=2, n=240):
    r = random.Random(seed)
    words = ["uno", "DOS", "tres", "Über", "漢字", "ﬁn", "x1y", "a-b", "quatre"] + [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)]
    docs = [(" ".join(r.choice(words[: 20 + 10 * (k % 9)]) for _ in range(r.randint(0, 60))), ["en", "fr", None, "xx"][k % 4 if k % 11 else 3], [None, "a", "b", "c", "d", "é"][k % 6]) for k in range(n)]
    return docs + [(None, "en", "empty"), ("", "zz", "only"), ("12 34", "zz", "other"), ("long " * 120_000, "en", "a"), ("L" * 100_000, "en", "b")] + docs[:30]


def brute_audit(docs, least=30, top=50):
    docs = [(t or "", g or "", s or "") for t, g, s in docs]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t), g, s) for t, g, s in docs]
    words = [([x.translate(fold) for x in w], g, s) for w, g, s in words]
    out = []
    for lang in {g for _, g, _ in words}:
        own = [(w, s) for w, g, s in words if g == lang]
        df = Counter(x for w, _ in own for x in set(w))
        kept = sorted(x for x, n in df.items() if n >= least)
        count = {s: Counter(x for w, t in own if t == s for x in w) for s in {s for _, s in own}}
        v = len(kept)
        share = lambda c: {x: 1 + 10**9 * (c[x] + 5) // (sum(c[y] for y in kept) + 5 * v) for x in kept}
        q = share(sum(count.values(), Counter()))
        p = {s: share(c) for s, c in count.items()}
        for s in count:
            pairs = [(-sum(abs(p[s][x] - p[o][x]) for x in kept), o.encode()) for o in count if o != s]
            terms = [(q[x] - p[s][x], x.encode()) for x in kept if count[s][x] and p[s][x] > q[x]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -value, k + 1) for k, (value, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("chunk, stretch, block, held, piece", [(1024, 64, 32, 200_000, 1 << 22), (7, 2, 2, 20, 100)])
def test_audit_is_that_of_brute_force(spark, monkeypatch, chunk, stretch, block, held, piece):
    for name, value in (("CHUNK", chunk), ("STRETCH", stretch), ("BLOCK", block), ("HELD", held), ("PIECE", piece)):
        monkeypatch.setattr(divergence, name, value)
    docs = odd_docs()
    df = spark.createDataFrame([(k, *x, *NONE) for k, x in enumerate(docs)], "doc_id long, text string, lang string, source string" + CLASH).repartition(6)
    got = divergence.audit(df, top_terms=8)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, top=8)


def test_audit_of_odd_tables(spark):
    form = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], form)).count() == 0
    assert divergence.audit(spark.createDataFrame([("a b", "en", "s")], form)).count() == 0
    got = divergence.audit(spark.createDataFrame([("a b", "en", "s"), (None, "en", None)], form)).collect()
    assert sorted(map(tuple, got)) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]


def test_shares_are_exact(spark):
    r = random.Random(3)
    cases = [(n, max(n, r.randint(1, 10**m))) for m in range(1, 16) for n in [r.randint(0, 10**m)]]
    cases = [(n, t) for n, t in cases if t < 9 * 10**15]
    want = [1 + 10**9 * n // t for n, t in cases]
    assert divergence.share(np.array([n for n, _ in cases]), np.array([t for _, t in cases])).tolist() == want
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(cases)], "k int, n long, t long").orderBy("k")
    assert [x[0] for x in df.select(divergence._share(F.col("n"), F.col("t"))).collect()] == want
