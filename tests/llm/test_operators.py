"""Each operator against a brute-force version, and on odd input: nulls, empty and long texts, repeats, empty tables, extra columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import html_text, mixing, near_dedup, packing, quality, substring_dedup, token_count, toxicity, trees, url_filter, vector_search
from docloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, path string, n long, h string, shard long"


def corpus(seed=1, n=120):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    texts = []
    for k in range(n):
        if k % 4 == 3:
            w = texts[r.randrange(len(texts))].split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(r.choice(vocab) + ("." if r.random() < 0.1 else "") for _ in range(r.randint(20, 150))))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*corpus(), None, "", "one two", "one two", "x" * 50_000, "\n \t", "ONE two"]
    rows = [(k, t, "en", [None, "a", "b", "ü"][k % 4], 0, 1, "p", 2, "h", 3) for k, t in enumerate(texts)]
    rows += [rows[5], (None, texts[3], "en", "a", 0, 1, "p", 2, "h", 3)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    ids = sorted({r["doc_id"] for r in rows if r["doc_id"] is not None})
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows if r["doc_id"] is not None}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(docs):
    want = brute_components(docs.collect())
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_dense_group(spark):
    r = random.Random(3)
    base = [f"w{k}" for k in range(140)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(r.randint(1, 8)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(d).collect()}
    want = {k: v[1] for k, v in brute_components(d.collect()).items()}
    assert got == want


def test_large_nodes_keep_their_pairs():
    """Pairs at 0.75 through the first levels and two rounds of growth."""
    import pyarrow as pa

    r, n = np.random.default_rng(3), 1000
    a, b = r.integers(0, 2**16, (2, n, near_dedup.COORDINATES))
    b, kind = np.where(r.random(a.shape) < 0.75, a, b), near_dedup.minwise(np.arange(5, dtype=np.uint64)).dtype
    met = 0
    for x, y in zip(a.astype(kind), b.astype(kind), strict=True):
        rows = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([x.tobytes(), y.tobytes()])], names=["id", "signature"])
        (rows,) = near_dedup._plant([rows])
        signature = pa.array([(x, y)[i].tobytes() for i in rows.column("id").to_pylist()])
        rows = pa.RecordBatch.from_arrays([*rows.columns, signature], names=["path", "id", "signature"])
        for _ in range(near_dedup.ROUNDS):
            (rows,) = near_dedup._grow([rows])
        path, who = rows.column("path").to_numpy(), rows.column("id").to_numpy()
        met += bool(np.intersect1d(path[who == 0], path[who == 1]).size)
    print(f"large nodes: {met} of {n} pairs")
    assert met >= 0.99 * n


def test_minwise_hashes_of_long_texts_differ():
    r = np.random.default_rng(4)
    a, b = (near_dedup.minwise(r.integers(0, 2**63, 20_000, dtype=np.uint64)) for _ in range(2))
    assert (a == b).mean() < 0.02


def test_keep_one_keeps_columns(docs):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_components(spark):
    e = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (20, 21), (22, 21), (22, 30), (5, 5)], "a long, b long")
    assert {r["id"]: r["component"] for r in components(e).collect()} == {9: 1, 8: 1, 7: 1, 1: 1, 20: 20, 21: 20, 22: 20, 30: 20}


def test_top_k_ties_and_bad_vectors(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(700, 6)).astype("float32")
    x[100:160] = x[50]
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(x)]
    rows += [(700, None, 0), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (702, [float("nan")] * 6, 0), (703, [], 0), (None, [1.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    old = vector_search.SHARD, vector_search.BLOCK
    vector_search.SHARD, vector_search.BLOCK = 150, 3
    try:
        got = {(q["query_id"], q["rank"]): (q["vec_id"], q["score"]) for q in vector_search.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    finally:
        vector_search.SHARD, vector_search.BLOCK = old
    v = np.floor(256 * x.astype(float)).astype(int)
    for q in range(0, 700, 50):
        best = sorted(((-int(v[q] @ v[c]), c) for c in range(700) if c != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(c, -s) for s, c in best]
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_automaton_is_levenshtein():
    lex = toxicity.Lexicon([("moron", 2.0, False), ("disgusting", 3.0, False), ("lowei", 2.0, True)])
    found = {w: lex.find(w) for w in ("moron", "morn", "mo-ron!", "m0ron", "mroon", "morron", "mrn", "disgstng", "loweischaft", "lowex", "moroooon")}
    assert found["moron"] == (0, 0) and found["mo-ron!"] == (0, 0) and found["m0ron"] == (0, 0) and found["moroooon"] == (0, 0)
    assert found["morn"] == (0, 1) and found["mroon"] == (0, 1) and found["morron"] == (0, 1)
    assert found["mrn"] is None and found["disgstng"] == (1, 2) and found["loweischaft"] == (2, 0) and found["lowex"] is None


def test_quotation_weighs_less():
    lex = toxicity.Lexicon([("moron", 2.0, False)])
    assert lex.features("you moron")[0] > lex.features('he said "moron" there')[0] and lex.features('he said "moron" there')[3] > 0


def test_toxicity_learns(spark):
    r = random.Random(2)
    rows, labs = [], []
    for k in range(600):
        w = [f"w{r.randrange(400)}" for _ in range(40)]
        toxic = k % 4 == 0
        if toxic:
            w[5], w[20] = "vilifier", "scoundrel"
        rows.append((k, " ".join(w)))
        labs.append((k, 1, int(toxic)))
    d = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    out = toxicity.score(d, spark.createDataFrame(labs, "doc_id long, quality int, toxic int")).collect()
    held = [x for x in out if x["held_out"] and x["doc_id"] < 600]
    assert held and all(x["predicted"] == (x["doc_id"] % 4 == 0) for x in held)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) and 0 <= x["score"] <= 1 for x in out)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(d, empty).count() == 602


def test_quality_statistics(docs, labels):
    want = {}
    for row in docs.collect():
        t = row["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, twice = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                twice += line in seen
                seen.add(line)
        want[row["doc_id"]] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), twice, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))
    for r in quality.judge(docs, labels).collect():
        assert tuple(r[c] for c in (*quality.BASE, "base_failed")) == want[r["doc_id"]]
        assert not (r["kept"] and r["base_failed"])


def test_monotone_trees():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * r.normal(size=2000) > 0).astype(float)
    f = trees.fit(x, y, trees=30, monotone={0: 1, 1: -1})
    grid = np.repeat(r.normal(size=(50, 3)), 40, axis=0)
    for j, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, j] = np.tile(np.linspace(-3, 3, 40), 50)
        assert (sign * np.diff(f.margin(g).reshape(50, 40), axis=1) >= -1e-9).all()
    assert ((f.probability(x) > 0.5) == y).mean() > 0.75


def test_repeated_passages(spark):
    texts = corpus(9, 30)
    passage = "Here begins what is said again and again. " + corpus(77, 1)[0][:500] + ". And this is where the passage ends now."
    rows = [(k, t) for k, t in enumerate(t for k, t in enumerate(texts) if k % 4 != 3)]
    rows[2] = (2, rows[2][1] + " " + passage + " " + corpus(55, 1)[0])
    rows[7] = (7, passage + " " + rows[7][1])
    rows += [(100, None), (101, ""), (None, passage)]
    d = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, pid long")
    got = substring_dedup.repeated_passages(d).collect()
    assert {r["doc_id"] for r in got} == {2, 7}
    assert {r["doc_id"] for r in got if r["removed"]} == {7} and all(r["kept_doc_id"] == 2 for r in got)
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(d).collect()}
    assert left[2] == rows[2][1] and len(left[7]) < len(rows[7][1]) - 300 and left[3] == rows[3][1]
    assert substring_dedup.repeated_passages(d.limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [substring_dedup.ROUNDS, 0])  # 0: by blocks alone
def test_repeated_passages_under_a_hot_shingle(spark, monkeypatch, rounds):
    monkeypatch.setattr(substring_dedup, "ROUNDS", rounds)
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    # a phrase that holds the minwise shingle of most paragraphs it stands in, in all bands
    phrases = [" ".join(r.sample(words, 14)) for _ in range(2000)]
    w, _, _, start, to, _ = substring_dedup.paragraphs([p.encode() for p in phrases])
    hashes, within = substring_dedup.shingles(w, start, to)
    none = np.uint64(2**64 - 1)
    least = [np.minimum.reduceat(np.where(within, substring_dedup.mix(hashes * a), none), start) for a in substring_dedup._A]
    hot = phrases[int(np.argmin(np.max(least, axis=0)))].split()
    rows, pairs = [], []
    for k in range(1500):
        w = [*r.sample(words, 3), *hot, *r.sample(words, 9)]
        rows.append((k, " ".join(w) + "."))
        if k % 5 == 0:  # a near copy: its last word differs
            rows.append((10_000 + k, " ".join([*w[:-1], r.choice(words)]) + "."))
            pairs.append((k, 10_000 + k))
    got = collections.defaultdict(set)
    for x in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[x["component"]].add(x["doc_id"])
    assert all(len(v) == 2 for v in got.values())
    found = len({tuple(sorted(v)) for v in got.values()} & set(pairs))
    print(f"hot shingle: {found} of {len(pairs)} pairs")
    assert found >= 0.99 * len(pairs)


def test_mixing(docs):
    rows = docs.collect()
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r["source"]] += len((r["text"] or "").encode().split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = dict(zip(names, (3, 1, 2, 3), strict=True))
    total, lo, hi = 1.5 * sum(size.values()), 0.0, 1e9
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(2 * size[s], level * weight[s]) for s in names) < total else (lo, level)
    taken, of = collections.Counter(), {r["doc_id"]: r["source"] for r in rows if r["doc_id"] is not None}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None:
            assert abs(r["target"] - min(2 * size[of[r["doc_id"]]], hi * weight[of[r["doc_id"]]])) < 1e-3
        taken[of.get(r["doc_id"], "a")] += r["taken"]
    for s in names:
        t = min(2 * size[s], hi * weight[s])
        assert abs(taken[s] - t) <= 0.03 * t + 32
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sainte_lague(spark):
    votes = [53_000, 24_000, 23_000, 1, 900, 12_345]
    u = spark.createDataFrame([(1, k, v) for k, v in enumerate(votes)], "g int, k int, v long").withColumn("seats", F.lit(97))
    got = {r["k"]: r["quota"] for r in mixing.apportion(u, ["g"], ["k"], "seats", "v").collect()}
    won = collections.Counter()
    for _ in range(97):
        won[max(range(6), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))] += 1
    assert got == {k: won[k] for k in range(6)}


def test_packing(docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = collections.defaultdict(list)
    for r in docs.collect():
        ids[r["doc_id"]].append(t.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    got = packing.pack(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    for doc, pieces in by.items():
        if len(ids[doc]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids[doc][0])
                assert zlib.crc32(np.array(ids[doc][0][at : at + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
                at += p["length"]
            assert at == len(ids[doc][0])
    windows = collections.defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for w in windows.values():
        end = 0
        for offset, length in sorted(w):
            assert offset == end
            end += length
        assert end == 2048 or end & (end - 1) == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_round_robin_carries_deficits():
    queues = [[(k, 300) for k in range(40)], [(100 + k, 50) for k in range(80)]]
    out, seen = list(packing.round_robin(queues, np.array([0.75, 0.25]), np.zeros(2))), [0, 0]
    assert sum(n for _, _, n in out) == 16_000
    for row, _, n in out[:60]:
        seen[row >= 100] += n
    assert abs(seen[0] / sum(seen) - 0.75) < 0.1


def test_token_counts_equal_the_tokenizer(docs):
    from tokenizers import Tokenizer, models

    vocab = token_count.vocabulary()
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *vocab], unk_id=0, byte_fallback=False))
    c = token_count.Counter(vocab)
    for w in ["hello", "Äpfel", "日本語漢字", "a\U0001f600\U0001f601b", "xxxxxxxxxxxxxxx", "字a字字", "3.1415926"]:
        assert c.count("▁" + w)[0] == len(t.encode("▁" + w).ids)
    for r in docs.alias("d").join(token_count.count_tokens(docs).distinct().alias("c"), "doc_id").where("length(text) < 2000 OR text IS NULL").collect():
        words = (r["text"] or "").encode().split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(len(t.encode("▁" + w.decode()).ids) for w in words))


def test_url_rules(spark):
    urls = {
        1: "https://a.EXAMPLE.org/en/12?x=1", 2: "http://example.org/es/1#t", 3: "https://x.org/", 4: "http://notorg/", 5: None, 6: "no scheme", 7: "http://a.com/de/", 8: "http://b.com/fr/casino",
        9: "http://my-casino.net/", 10: "http://casinos.net/", 11: "http://free.net/cheap", 12: "http://free.net/free", 13: "http://x.org?q", 14: "a://b.com://c.net/casino",
    }
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(urls.items()), "page_id long, url string")).collect()}
    assert got[1]["rule"] == "example.org/en/1" and got[1]["verdict"] == "block" and got[1]["host"] == "a.example.org" and got[1]["path"] == "/en/12"
    assert got[2]["rule"] == "example.org/es/" and got[3]["verdict"] == "allow" and got[3]["rule"] == "org/" and got[4]["rule"] is None
    assert (got[5]["host"], got[5]["path"], got[6]["host"], got[5]["verdict"]) == ("", "", "", "allow")
    assert got[7]["verdict"] == "block" and got[8]["verdict"] == "allow"
    assert [got[k]["verdict"] for k in (9, 10, 11, 12)] == ["block", "allow", "block", "allow"]
    assert got[13]["rule"] is None and got[14]["host"] == "b.com:"


def test_html_held_out_pages():
    model, same, n = html_text.model(), 0, 0
    for k in range(40):
        page = html_text._Writer(777_000 + k).page()
        nodes = html_text.flatten(html_text.parse(page))
        labels = iter(html_text.labels_of(page))
        keep = html_text.decode(nodes, model.margin(html_text.features(nodes)))
        for x in nodes:
            if x.parent is not None:
                assert keep[x.parent.index] or not keep[x.index]
            if x.tag not in ("root", "html", "body"):
                same, n = same + (next(labels) == keep[x.index]), n + 1
    assert same / n > 0.9


def test_html_odd_pages(spark):
    long = "Some words that run on, as prose does. " * 2000
    pages = [(1, "u", None), (2, "u", ""), (3, "u", "plain &amp; simple\n text"), (4, "u", f"<article><p>{long}<p>a &lt; b<script>x='</p>'</script></article><footer>me</footer>"), (4, None, "<p>")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    assert (1, "", 0) in got and (2, "", 0) in got and (3, "plain & simple text", 19) in got and (4, "", 0) in got
    assert (4, long.strip() + " a < b", len(long.strip()) + 6) in got


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = docs.cache()
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] > 0.9 * sizes[2]
    assert corpus_pipeline.run(spark, sf).count() > 0
