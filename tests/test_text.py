import unicodedata

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunk, facts, search, segment


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_normalisers(spark):
    assert one(spark, " Stra\u00dfe\u00a0 A ", lambda t: T.squeeze(T.casefold(t))) == "strasse a"
    assert one(spark, "Sección Ñ", T.fold_sections) == "Seccion N"
    assert one(spark, "¡Época! 2", T.slug) == "epoca-2"
    assert one(spark, "***", T.slug) == "documento"
    assert one(spark, "Teléfono  A", T.plain_facts) == "teléfono a"
    assert one(spark, "", T.token_estimate) == 1
    assert one(spark, "a b c", lambda t: T.tail_words(t, 2)) == "b c"


def test_windows_cover_and_stop(spark):
    w = one(spark, " ".join(map(str, range(10))), lambda t: chunk.windows(T.words(t), 4, 1))
    assert [x[0] for x in w] == ["0", "3", "6"] and w[-1][-1] == "9"
    assert one(spark, "", lambda t: chunk.windows(T.words(t), 4, 1)) == []


def test_packing_rules(spark):
    d = spark.createDataFrame([(1, "a b\nc d e\nf g h i j k l\nm")], "doc_id int, text string")
    got = [(r["chunk_index"], r["tokens"]) for r in chunk.pack(d, 4, 1).orderBy("chunk_index").collect()]
    assert got == [(1, 2), (2, 4), (3, 4), (4, 4), (5, 1)]  # overlap into the second, none out of the long one


def test_intent_ties_take_the_larger_section(spark):
    assert one(spark, "peligros y transporte", search.inferred_section) == 14
    assert one(spark, "ver sección 9", search.requested_section) == 9
    assert one(spark, "nada", search.inferred_section) is None


def test_router_returns_on_the_first_branch(spark):
    assert one(spark, "En que seccion sale el telefono", facts.route) == "trazabilidad_seccion_extraida"
    assert one(spark, "en este caso el transporte", facts.route) == "cas_extraido_literalmente"
    assert one(spark, "teléfono de emergencia", facts.route) == "none"


def test_transport_short_form(spark):
    r = one(spark, "UN 1263 3 II", facts.transport)
    assert tuple(r) == ("UN 1263", "3", "II")


def test_heading_needs_three_letters(spark):
    pages = spark.createDataFrame([(1, 1, "sección 4: ab\nSeccion 02 Peligros varios")], "doc_id int, page int, text string")
    assert [(r["number"], r["title"]) for r in segment.section_hits(pages).collect()] == [(2, "Peligros varios")]


def test_items_keep_their_digits(spark):
    """An item's place must not be taken off the item: line 0 ends in 0, line 1 starts and ends in 1."""
    df = spark.createDataFrame([("  key 100  \n1 key 11\n",)], "t string")
    assert df.select(facts.literal_lines(F.col("t"), ("key",), 5)).first()[0] == ["key 100", "1 key 11"]
    df = spark.createDataFrame([("Teléfono: 604 500 \nTeléfono: 11 1",)], "t string")
    assert df.select(facts.provider_phones(F.col("t"))).first()[0] == "604 500 / 11 1"


def test_folding_is_pythons_for_every_letter_of_the_basic_plane(spark):
    letters = [chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LMN"]
    texts = letters + ["ﬁn ½ Ⅳ Σας ΣΑΣ", "Straße 한국어 Ångström ﬃ", "İstanbul ŉ ǰ ß ẞ", "plain", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = d.select("id", T.fold_accents(F.col("t")).alias("f"), T.whole_casefold(F.col("t")).alias("c")).orderBy("id").collect()
    for r, text in zip(got, texts, strict=True):
        if text is None:
            assert r["f"] is None and r["c"] is None
            continue
        assert r["c"] == text.casefold(), text
        assert r["f"] == "".join(x for x in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(x)), text


def test_lines_of_a_table_and_names_of_uploads(spark):
    assert one(spark, "| a |  \n\n  \n| b |\t", T.table_lines) in ("| a |\n| b |\t", "| a |\n| b |")
    assert one(spark, "Año Nuevo.PDF", lambda t: T.slug(t, accents=False)) == "a-o-nuevo-pdf" and one(spark, "Año", T.slug) == "ano"
