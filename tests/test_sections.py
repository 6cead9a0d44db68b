"""Sections, chunks, facts, answers, retrieval and windows on written rows and against brute force."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import answer, chunk, corpus, facts, inverted, search, segment

PAGES = [
    (1, 1, "Ficha\nSECCIÓN 1: Identificación de la sustancia o la mezcla\nTexto de la parte. Ver sección 3:\nComponentes no aplica\nSección 02 - Identificación de los peligros\nH315"),
    (1, 2, "Section 3. Composición/información sobre los componentes\n| CAS | 67-64-1 |\nsección 4: ab\nSeccion 4 Primeros auxilios en caso de duda Sección 5: Medidas de lucha contra incendios"),
    (2, 1, "sección 16: Otra información\nSeccion 14: Información relativa al transporte\nUN 1263 3 II"),
    (3, 1, "sin encabezados"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "doc_id int, page int, text string").cache()


@pytest.fixture(scope="module")
def titles(spark):
    return spark.createDataFrame(list(segment.SECTION_TITLES.items()), "number int, expected string").cache()


def test_best_headings(pages, titles):
    got = {(r["doc_id"], r["number"]): (r["page"], r["title"], r["score"]) for r in segment.best_hits(segment.section_hits(pages), titles).collect()}
    assert got[1, 3] == (2, "Composicion/informacion sobre los componentes", 100)  # not the cross-reference of page 1
    assert got[1, 4][1] == "Primeros auxilios en caso de duda" and got[1, 5][2] == 100
    assert set(got) == {(1, k) for k in range(1, 6)} | {(2, 14), (2, 16)}
    for r in segment.section_hits(pages).collect():
        at = dict(((d, p), t) for d, p, t in PAGES)[r["doc_id"], r["page"]][r["start"] :]
        assert re.match("(?i)s(ecci[oó]n|ection)", at)


def test_section_texts_and_pages(pages, titles):
    product = pages.select("doc_id", F.lit("P").alias("product")).distinct()
    blocks = segment.section_blocks(pages, titles, product)
    got = {(r["doc_id"], r["number"]): r for r in blocks.collect()}
    assert got[1, 1]["text"] == "Texto de la parte. Ver sección 3:\nComponentes no aplica" and (got[1, 1]["page_start"], got[1, 1]["page_end"]) == (1, 1)
    assert got[1, 2]["text"] == "H315" and got[1, 2]["page_end"] == 2
    assert got[1, 3]["text"] == "| CAS | 67-64-1 |\nsección 4: ab" and got[1, 4]["text"] == "" and got[1, 5]["text"] == ""
    assert [got[2, k]["place"] for k in (16, 14)] == [1, 2] and got[2, 14]["text"] == "UN 1263 3 II"
    warnings = {r["doc_id"]: r["warnings"] for r in segment.section_warnings(blocks, pages).collect()}
    assert warnings[2][1] == "section_order_not_ascending: 16,14" and warnings[3] == ["missing_sections: " + ",".join(map(str, range(1, 17))), "low_text_pages: 1", "section_count: 0"]


def test_assets_go_to_anchor_pages_or_the_first_section(spark):
    assets = spark.createDataFrame([(1, "a", 1, 96), (1, "b", 1, 95), (1, "c", 3, 0), (1, "d", 9, 0), (2, "e", 1, 500)], "doc_id int, asset_id string, page int, y0 int")
    anchors = spark.createDataFrame([(1, 1, 100, 4), (1, 1, 50, 2), (2, 1, 10, 7), (2, 1, 400, 8)], "doc_id int, page int, y0 int, number int")
    blocks = spark.createDataFrame([(1, 1, 6, 2, 4), (1, 2, 5, 3, 5)], "doc_id int, place int, number int, page_start int, page_end int")
    got = {r["asset_id"]: r["section_number"] for r in segment.attribute_assets(assets, anchors, blocks).collect()}
    assert got == {"a": 4, "b": 2, "c": 6, "d": 1, "e": 8}


def hot_rows(n=6000):
    r = random.Random(3)
    return [(0 if r.random() < 0.5 else r.randrange(5), r.randrange(0, 5000), r.randrange(3)) for _ in range(n)]


def test_as_of_in_ranges_equals_all_pairs(spark):
    rows = hot_rows(1500)
    left = sorted({(c, t) for c, t, k in rows if k == 0})
    right = [(c, t, k * 10 + t % 7) for c, t, k in rows if k and t > 300]
    a, b = spark.createDataFrame(left, "conv long, turn long"), spark.createDataFrame(right, "conv long, turn long, v int")
    got = {(r["conv"], r["turn"]): r["attributed"] for r in segment.as_of(a, b, "conv", "turn", 1, "v", -1).collect()}
    assert len(got) == len(left)
    for c, t in left:
        assert got[c, t] == max(((u, v) for d, u, v in right if d == c and u <= t + 1), default=(0, -1))[1]


def test_gaps_and_spans_in_ranges(spark):
    rows = [(c, t) for c, t, _ in hot_rows() if not 1000 < t < 2500]
    d = spark.createDataFrame(rows, "conv long, turn long")
    of = {c: sorted(t for e, t in rows if e == c) for c in range(5)}
    for r in segment.missing_numbers(d, "conv", "turn").collect():
        assert r["missing"] == sorted(set(range(of[r["conv"]][-1])) - set(of[r["conv"]]))
    got = sorted((r["conv"], r["turn"], r["span_end"], r["repeated"]) for r in segment.spans(d, "conv", "turn").collect())
    want = sorted((c, t, (ts + [ts[-1]])[i + 1], i > 0 and ts[i - 1] == t) for c, ts in of.items() for i, t in enumerate(ts))
    assert got == want


def plain_packer(text, most, overlap):
    paragraphs, out, cur, n = [p.strip() for p in re.split(r"\n\s*\n", text.strip()) if p.strip()], [], [], 0
    for p in paragraphs:
        words = p.split()
        if len(words) > most:
            out += ["\n\n".join(cur)] if cur else []
            out += [" ".join(words[i : i + most]) for i in range(0, len(words), most - overlap) if i == 0 or i + overlap < len(words)]
            cur, n = [], 0
        elif cur and n + len(words) > most:
            out.append("\n\n".join(cur))
            tail = " ".join(out[-1].split()[-overlap:])
            cur = [tail, p]
            n = len(tail.split()) + len(words)
        else:
            cur, n = [*cur, p], n + len(words)
    return out + (["\n\n".join(cur)] if cur else [])


def test_chunks_equal_a_plain_packer(spark):
    r = random.Random(7)
    texts = ["\n \n".join(" ".join(f"w{r.randrange(99)}" for _ in range(r.choice([1, 3, 8, 12, 30]))) + r.choice(["", "\nx y"]) for _ in range(r.randrange(1, 9))) for _ in range(80)] + ["", " \n\n "]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", chunk.split_text(F.col("t"), 12, 4).alias("c")).collect()
    for row in got:
        assert row["c"] == plain_packer(texts[row["id"]], 12, 4)


def test_a_section_of_assets_alone_gets_a_chunk(spark, titles):
    blocks = spark.createDataFrame([(1, 2, "Peligros", 1, 1, "Texto.")], "doc_id int, number int, title string, page_start int, page_end int, text string")
    tables = spark.createDataFrame([(1, 9, 3, 1, "t1", "| a |", "Nota t")], "doc_id int, section_number int, page int, i int, asset_id string, markdown string, trace_note string")
    images = spark.createDataFrame([(1, 9, 2, 1, "i1", "pictogram", "x.png", "Nota i", " ")], "doc_id int, section_number int, page int, i int, asset_id string, kind string, path string, trace_note string, ocr_text string")
    t = segment.assets_by_section(tables, "i", "asset_id", "page", "markdown", "trace_note")
    i = segment.assets_by_section(images, "i", "asset_id", "page", "kind", "path", "trace_note", "ocr_text")
    docs = spark.createDataFrame([(1, "m__d", "m", "p", "d.pdf")], "doc_id int, document_id string, manufacturer string, product string, source_file string")
    got = {r["section_number"]: r for r in chunk.section_chunks(chunk.with_orphans(blocks, t, i, titles), docs).collect()}
    assert got[9]["chunk_id"] == "m__d__sec09__chunk01" and (got[9]["page_start"], got[9]["page_end"]) == (2, 3) and got[9]["content_types"] == ["image", "ocr", "table", "text"]
    assert chunk.NO_TEXT in got[9]["content"] and got[9]["content"].endswith("Texto OCR:\n" + chunk.NO_OCR) and got[2]["content_types"] == ["text"]
    assert got[2]["content"] == "Documento: d.pdf\nSeccion 2: Peligros\n\nTexto." and got[9]["trace"]["tables"] == ["t1"]


SHEETS = [
    (1, 1, "Emergencia CISPROQUIM\nBogotá: 601 288 60 12\nResto del país: 01 8000 91 60 12\nTeléfono: 601 412 33 00\nTelefono : Cisproquim 601\nNúmero de Teléfono: 604 555 00 11\nTeléfono: 3"),
    (2, 3, "Bogota: 1\n| Tolueno | 108-88-3 ; | 20 % |\nxileno 1330-20-7 en mezcla\n| Tolueno | 108-88-3 | 20 % |\nsin 12-3-4"),
    (3, 14, "Número ONU: UN 1263\nClase: 3\nGrupo de embalaje: III"),
    (4, 8, "Usar guantes\nnada\nGafas | de seguridad"),
]


def test_literal_answers_by_branch(spark):
    rows = [(q, rank, float(9 - rank), f"c{rank}", "p", "d.pdf", section, "T", 1, 2, content) for q in range(1, 9) for rank, section, content in SHEETS]
    results = spark.createDataFrame(rows, "query_id int, rank int, score double, chunk_id string, product string, source_file string, section_number int, section_title string, page_start int, page_end int, content string")
    asked = ["En que seccion sale", "telefono de emergencia", "telefono del fabricante", "componentes", "numero onu", "guantes", "imagen", "nada"]
    questions = spark.createDataFrame(list(enumerate(asked, 1)), "query_id int, question string")
    got = {r["query_id"]: r for r in facts.literal_answers(results, questions).collect()}
    label = "[FUENTE {0}] d.pdf &#124; seccion {1} &#124; paginas 1-2 &#124; c{0}".format
    assert got[1]["literal"].split("\n")[2:] == [f"| {label(1, 1)} | 1 | T | 1-2 |"]
    assert got[2]["literal"].split("\n")[2:] == [f"| {label(1, 1)} | CISPROQUIM | 601 288 60 12 | 01 8000 91 60 12 |"]
    assert got[3]["literal"].split("\n")[2:] == [f"| {label(1, 1)} | 601 412 33 00 / 604 555 00 11 |"]
    assert got[4]["literal"].split("\n")[2:] == [f"| {label(2, 3)} | Tolueno; 108-88-3; 20 %; xileno 1330-20-7 en mezcla |"]
    assert got[5]["literal"].split("\n")[2:] == [f"| {label(3, 14)} | UN 1263 | 3 | III |"]
    assert got[6]["literal"].split("\n")[2:] == [f"| {label(4, 8)} | Usar guantes; Gafas &#124; de seguridad |"]
    assert got[7]["reason"] == "metadatos_imagen_extraidos" and got[7]["literal"] is None and (got[8]["reason"], got[8]["literal"]) == ("none", None)

    def slow(prompt):
        if len(prompt) > limit:
            raise TimeoutError
        return str(prompt.count("[FUENTE"))

    full = answer.answer_questions(results, questions, lambda p: str(p.count("[FUENTE "))).collect()
    first = {r["query_id"]: r for r in full}
    assert first[1]["reason"] == "trazabilidad_seccion_extraida" and first[8]["reason"] is None
    limit = len(first[8]["prompt"]) - 1
    shrunk = {r["query_id"]: r["answer"] for r in answer.answer_questions(results, questions, slow).collect()}
    assert int(shrunk[8]) == int(first[8]["answer"]) - 1
    assert [s["rank"] for s in first[8]["sources"]] == [1, 2, 3, 4] and first[8]["sources"][0].asDict().keys() >= {"score", "chunk_id", "document", "product", "section_number", "section_title", "page_start", "page_end"}
    none = {r["query_id"]: r["answer"] for r in answer.answer_questions(results, questions).collect()}
    assert none[8] == answer.ABSTENTION and none[2] == got[2]["literal"]


def test_coverage_finds_terms_inside_words(spark):
    r = random.Random(2)
    docs = [(k, " ".join("".join(r.choice("abcd") for _ in range(r.choice([3, 6, 30]))) for _ in range(20))) for k in range(60)]
    docs.append((99, "x" * 3000 + "únicofin" + "y" * 3000))
    docs += [(100, "ab" * 300_000), (101, None), (102, "")]
    questions = [(k, " ".join("".join(r.choice("abcd") for _ in range(r.choice([4, 5]))) for _ in range(5))) for k in range(20)] + [(50, "unicofin seccion"), (51, "a b")]
    index = inverted.tables(spark.createDataFrame(docs, "doc_id int, text string"))
    got = {(x["query_id"], x["doc_id"]): x["coverage"] for x in search.coverage_scores(index, spark.createDataFrame(questions, "query_id int, text string")).collect()}
    fold = lambda t: t.lower().replace("ú", "u")
    for q, text in questions:
        wanted = {w for w in re.findall("[a-z0-9]{4,}", fold(text)) if w not in search.STOPWORDS}
        for d, content in docs:
            content = content or ""
            n = sum(w in fold(content) for w in wanted)
            assert got.get((q, d), 0) == (n / len(wanted) if n else 0)


def test_dense_blocks_equal_one_block(spark, monkeypatch):
    e = spark.createDataFrame([(k, [float(k % 7), float(k % 5)], k % 3) for k in range(40)], "vec_id long, embedding array<float>, label int")
    q = e.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    one = sorted(map(tuple, search.dense_scores(e, q).collect()))
    monkeypatch.setattr(search, "BLOCK", 3)
    assert sorted(map(tuple, search.dense_scores(e, q).collect())) == one and len(one) == 10 * 39


def test_boost_moves_the_wanted_section_up(spark):
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.3), (2, "a", 0.5), (2, "b", 0.3)], "query_id int, doc_id string, score double")
    sections = spark.createDataFrame([("a", 1), ("b", 8)], "doc_id string, section_number int")
    asked = spark.createDataFrame([(1, "guantes y gafas"), (2, "ver sección 1 de guantes")], "query_id int, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in search.boosted(scores, sections, asked).collect()}
    assert got == {(1, "a"): 0.5, (1, "b"): 0.66, (2, "a"): 0.86, (2, "b"): 0.3}


def test_evaluation_without_answers_and_results(spark):
    results = spark.createDataFrame([(1, 1, 3, "c", "El Cás 108"), (1, 2, 4, "d", "x")], "query_id int, rank int, section_number int, chunk_id string, content string")
    questions = spark.createDataFrame([(1, 4, ["CAS"]), (2, 1, ["z"]), (3, 1, [])], "query_id int, expected_section int, expected_terms array<string>")
    rows = answer.evaluation_rows(results, questions)
    got = {r["query_id"]: r for r in rows.collect()}
    assert (got[1]["top1_ok"], got[1]["topk_ok"], got[1]["context_terms_ok"], got[1]["top1_section"]) == (False, True, True, 3)
    assert (got[2]["top1_section"], got[2]["topk_ok"], got[2]["context_terms_ok"], got[3]["context_terms_ratio"]) == (-1, False, False, 1.0)
    s = answer.evaluation_summary(rows).first()
    assert (s["questions"], s["top1_section_accuracy"], s["topk_section_recall"], s["context_term_rate"], s["answer_term_rate"]) == (3, 0.0, 0.3333, 0.6667, None)


def test_alias_errors(spark):
    aliases = spark.createDataFrame([("a", "x", "1"), ("b", "y", "1"), ("c", "z", "1")], "alias_document_id string, canonical_document_id string, text_sha256 string")
    docs = spark.createDataFrame([("x", "1"), ("y", "2")], "document_id string, text_sha256 string")
    assert {r["error"] for r in corpus.alias_errors(aliases, docs).collect()} == {"missing_canonical_metadata:z", "text_hash_mismatch:b"}


def test_accents_of_many_alphabets(spark):
    d = spark.createDataFrame([("Ǻ ǭ ệ Ő ę Ж ё ά ſ é ñ",)], "t string")
    assert d.select(T.fold_accents(F.col("t"))).first()[0] == "a o e o e ж е α s e n"


@pytest.mark.parametrize("fails", [0, 1, 2, 3])
def test_the_attempt_that_answers_gives_prompt_and_sources(spark, fails):
    rows = [(q, r, 1.0 - r / 10, f"c{r}", "d.pdf", "p", 7, "Uso", 1, 2, f"texto {r} " * 300) for q in (1, 2) for r in (1, 2, 3, 4)]
    results = spark.createDataFrame(rows, "query_id int, rank int, score double, chunk_id string, source_file string, product string, section_number int, section_title string, page_start int, page_end int, content string")
    questions = spark.createDataFrame([(1, "nada literal"), (2, "otra nada"), (3, "sin resultados")], "query_id int, question string")
    limits = [1800, 1400, 1000, 0]

    def generate(text):
        sizes = [len(x.split("contenido:")[1].split("[FUENTE")[0].strip()) for x in text.split("[FUENTE ")[1:] if "contenido:" in x]
        if sizes and max(sizes) > limits[fails]:
            raise TimeoutError
        return str(len(sizes))

    got = answer.answer_questions(results, questions, generate, calls=2, pause=0.01)
    if fails == 3:
        with pytest.raises(Exception, match="TimeoutError"):
            got.collect()
        return
    got = {r["query_id"]: r for r in got.collect()}
    for q in (1, 2):
        assert got[q]["attempt"] == fails + 1 and got[q]["answer"] == str(4 - fails) and [s["rank"] for s in got[q]["sources"]] == list(range(1, 5 - fails))
        assert got[q]["prompt"].count("contenido:") == 4 - fails
    assert got[3]["attempt"] == 1 and not got[3]["sources"]


def test_a_long_section_is_cut_in_one_pass(spark):
    """200,000 paragraphs: by chunk_bounds in well under a second, with the text in some seconds."""
    began = time.time()
    got = chunk.chunk_bounds([5] * 200_000 + [900, 3], 850, 100)
    assert time.time() - began < 2 and got[0] == (0, 169, 0, 0) and got[-1] == (200_001, 200_001, 1_000_900, 0)
    d = spark.createDataFrame([(1, "\n\n".join(f"p{k} uno dos" for k in range(50_000))), (2, None)], "id int, t string")
    pieces = {r["id"]: r["c"] for r in d.select("id", chunk.split_text(F.col("t"), 850, 100).alias("c")).collect()}
    assert len(pieces[1]) == len(plain_packer("\n\n".join(f"p{k} uno dos" for k in range(50_000)), 850, 100)) and not pieces[2]
    assert time.time() - began < 60


def test_starts_of_pieces_are_places_in_the_page(spark):
    text = "inicio " + " ".join(f"Sección {k}: Título número {k} con texto." for k in range(1, 17)) * 3
    pages = spark.createDataFrame([(1, 1, text), (1, 2, "nada"), (2, 1, text[3:])], "doc_id int, page int, text string")
    rows = segment.section_pieces(pages).collect()
    assert len(rows) == 2 * 49 + 1
    for r in rows:
        whole = {(1, 1): text, (1, 2): "nada", (2, 1): text[3:]}[r["doc_id"], r["page"]]
        assert whole[r["start"] :].startswith(r["text"])
