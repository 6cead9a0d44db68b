"""Retrieval: TF-IDF postings, term coverage, dense cosine, section intent, fusion and top-k, for all questions at once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..sources import io

#: Questions that travel together to the vectors; one block is sent to every task, more meet by an equi-join.
BLOCK = 512
# fixed values: weights of the fused score and the boost of the wanted section, which counts twice
DENSE, LEXICAL, COVERAGE, BOOST = 0.55, 0.25, 0.20, 0.18
# fixed values: words that say nothing
STOPWORDS = ("para", "sobre", "cual", "cuales", "numero", "seccion", "informacion", "datos")
# fixed values: hints of each section
SECTION_HINTS = {
    1: ("identificacion", "proveedor", "fabricante", "telefono", "uso recomendado", "uso del producto"),
    2: ("identificacion de los peligros", "peligros"),
    3: ("composicion", "componentes", "cas"),
    4: ("primeros auxilios",),
    5: ("incendios", "lucha contra incendios"),
    6: ("vertido accidental", "derrame", "vertidos"),
    7: ("manipulacion", "almacenamiento"),
    8: (
        "controles de exposicion", "limites de exposicion", "proteccion personal", "proteccion individual", "proteccion respiratoria",
        "proteccion ocular", "proteccion de los ojos", "epp", "guantes", "respirador", "twa", "stel", "tlv",
    ),
    9: ("propiedades fisicas", "propiedades quimicas", "fisicoquimicas", "densidad", "punto de inflamacion"),
    10: ("estabilidad", "reactividad"),
    11: ("toxicologica", "toxicologia"),
    12: ("ecologica", "ecologia"),
    13: ("eliminacion",),
    14: ("transporte", "numero onu", "onu", "grupo de embalaje"),
    15: ("reglamentaria", "regulacion"),
    16: ("otra informacion", "otras informaciones"),
}


#: Rows that a task hands over at once.
ROWS = 200_000


def once(docs: DataFrame) -> DataFrame:
    """docs (doc_id, ...) with each id once: of rows that repeat one the smallest stays. Ids alone are exchanged as long as none comes again."""
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    others = [c for c in docs.columns if c != "doc_id"]
    return docs.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("d")).select("doc_id", "d.*")


def of_folded(docs: DataFrame, id_: str, text: str, found: Callable[[str], tuple[list, ...]], form: str) -> DataFrame:
    """(id, *form): a row for each item that `found` gives of a folded text, as one list for each column of form; none without text.

    Texts are folded by column functions, those that these don't fold by Python on the way.
    """
    folded = docs.select(F.col(id_).alias("id"), T.fold_plainly(F.col(text)).alias("text"), T.needs_python(F.col(text)).alias("other"))
    columns = [x.split() for x in form.split(", ")]
    names, kinds = ["id", *(x[0] for x in columns)], [{"string": pa.string(), "long": pa.int64()}[x[1]] for x in columns]

    def run(batches):
        for batch in batches:
            begin, n, lists = 0, [], [[] for _ in kinds]
            for k, (plain, other) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True), 1):
                of_text = [[] for _ in kinds] if plain is None else found(plain if other is None else T.normalised(other))
                n.append(len(of_text[0]))
                for mine, more in zip(lists, of_text, strict=True):
                    mine += more
                if len(lists[0]) >= ROWS or k == batch.num_rows:
                    ids = batch.column(0).slice(begin, len(n)).take(pa.array(np.repeat(np.arange(len(n)), n)))
                    yield pa.RecordBatch.from_arrays([ids, *map(pa.array, lists, kinds)], names=names)
                    begin, n, lists = k, [], [[] for _ in kinds]

    return folded.mapInArrow(run, f"id {dict(folded.dtypes)['id']}, {form}")


_WORD, _LONG = re.compile(r"\w{2,}"), re.compile("[a-z0-9]{4,}")


def _counted(text: str) -> tuple[list, list]:
    """The terms of a folded text, each once, and their numbers."""
    words = _WORD.findall(text)
    n = Counter(words)
    n.update(map(" ".join, zip(words, words[1:], strict=False)))
    return list(n), list(n.values())


def counts(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, term, tf): words of two characters or more, and their neighbours as pairs."""
    return of_folded(docs, id_, text, _counted, "term string, tf long")


def long_words(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, word): the distinct runs of four or more letters and digits of each text."""
    return of_folded(docs, id_, text, lambda t: (list(dict.fromkeys(_LONG.findall(t))),), "word string")


def vocabulary(df: DataFrame, n: int) -> DataFrame:
    """(term, df, idf) of (term, df) with idf = ln((1 + n) / (1 + df)) + 1."""
    return df.select("term", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def word_id(word: Column) -> Column:
    """Stands for a word of any length in 16 bytes."""
    return F.unhex(F.md5(word))


#: Characters of a word's piece; no term that coverage asks for is shorter.
GRAM = 4


def grams(word: Column) -> Column:
    """The distinct pieces of GRAM characters of a word, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(word, F.lit(f"(?=(.{{{GRAM}}}))"), 1))


#: Rows of a side that may be sent to every task: some 10 MB.
SENT = 100_000


def sent(df: DataFrame) -> DataFrame:
    """df, written down, counted and sent to every task if it has SENT rows at most; more meet by an exchange."""
    df = io.staged(df, "asked")
    return F.broadcast(df) if df.count() <= SENT else df


def asked_terms(index: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, term, q, idf): weights of the known terms of queries (query_id, text) over their norm."""
    asked = counts(queries, "query_id", "text").join(index["vocab"], "term").select(F.col("id").alias("query_id"), "term", (F.col("tf") * F.col("idf")).alias("q"), "idf")
    norm = F.sqrt(F.sum(F.col("q") * F.col("q")).over(W.partitionBy("query_id")))
    return asked.select("query_id", "term", (F.col("q") / norm).alias("q"), "idf")


def tfidf_scores(index: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, tfidf) of all pairs that share a term (R4), for queries (query_id, text).

    Only postings of terms that are asked for are read on; they and the norms lie by their keys and aren't dealt anew.
    """
    asked = sent(asked_terms(index, queries))
    sums = index["postings"].join(asked, "term").groupBy("doc_id", "query_id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("q")).alias("s"))
    return sums.join(index["norms"], "doc_id").select("query_id", "doc_id", (F.col("s") / F.col("norm")).alias("tfidf"))


def important_terms(t: Column) -> Column:
    """R6."""
    found = F.regexp_extract_all(T.fold_accents(t), F.lit("([a-z0-9]{4,})"), 1)
    return F.array_sort(F.array_distinct(F.array_except(found, F.array(*map(F.lit, STOPWORDS)))))


def coverage(content: Column, wanted: Column) -> Column:
    """Share of the wanted terms that occur in the folded content; 0 without terms."""
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.size(F.filter(wanted, lambda x: F.contains(content, x))) / F.size(wanted))


def holders(index: dict[str, DataFrame], terms_: DataFrame) -> DataFrame:
    """(term, doc_id): the documents that hold each of these terms (term, in letters and digits), anywhere in a word.

    A term stands inside a word and so does each of its pieces. Of its pieces the one that fewest words have brings the
    words, which are then searched for the whole term; words go by their ids, whatever their length.
    """
    pieces = terms_.select("term", F.explode(grams(F.col("term"))).alias("gram"))
    pieces = sent(pieces)
    has = index["grams"].join(pieces.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("words"))
    rarest = pieces.join(has, "gram").groupBy("term").agg(F.min(F.struct("words", "gram")).alias("g")).select("term", F.col("g.gram").alias("gram"))
    near = index["grams"].join(rarest, "gram").select("word_id", "term").distinct()
    holds = near.join(index["lexicon"].distinct(), "word_id").where(F.contains("word", F.col("term"))).select("word_id", "term")
    return index["words"].join(holds, "word_id").select("term", "doc_id").distinct()


def wanted_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n): the important terms of queries (query_id, text) and how many a query has."""
    wanted = queries.select("query_id", important_terms(F.col("text")).alias("wanted"))
    return wanted.select("query_id", F.size("wanted").alias("n"), F.explode("wanted").alias("term"))


def coverage_scores(index: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, coverage) of all pairs with a wanted term in the document, anywhere in a word."""
    asked = sent(wanted_terms(queries))
    found = holders(index, asked.select("term").distinct())
    return found.join(asked, "term").groupBy("query_id", "doc_id").agg((F.count("*") / F.first("n")).alias("coverage"))


def requested_section(t: Column) -> Column:
    """R8."""
    return F.nullif(F.regexp_extract(T.fold_accents(t), r"\bseccion\s+(1[0-6]|[1-9])\b", 1), F.lit("")).cast("int")


def inferred_section(t: Column, hints: dict[int, tuple[str, ...]] = SECTION_HINTS) -> Column:
    """The section with most hints, the larger number on ties."""
    folded = T.fold_accents(t)
    scored = F.array(*[F.struct(sum((F.contains(folded, F.lit(h)).cast("int") for h in hs), F.lit(0)).alias("score"), F.lit(k).alias("section")) for k, hs in hints.items()])
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["section"])


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, label, score) of every question (query_id, q) against every other vector (vec_id, embedding, label).

    Questions are a stated set. Up to BLOCK of them are sent to every task; more are dealt in blocks, and each vector
    meets each block by its number.
    """
    n = queries.count()
    if n <= BLOCK:
        both = vectors.join(F.broadcast(queries), F.col("vec_id") != F.col("query_id"))
    else:
        blocks = -(-n // BLOCK)
        dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        every = vectors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        both = every.join(dealt, "block").where("vec_id != query_id")
    return both.select("query_id", F.col("vec_id").alias("doc_id"), "label", dot(F.col("q"), F.col("embedding")).alias("score"))


def plain_vector(v: Column) -> Column:
    """Whether a vector can be multiplied in blocks: some components, none of them null, NaN or infinite."""
    x = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~x, F.lit(False))


#: Vectors and questions of a block of dense scores, and questions multiplied at once.
VECTORS, QUESTIONS = 8192, 4096


def dense_block(k: int, label: bool = False):
    """Of a block of vectors (vec_id, embedding, label) and one of questions (query_id, q): the pairs that can be among a question's
    best k of the block. Products of matrices pick them; their scores are summed in the order of the components, as `dot` does."""

    def run(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(vectors) and len(asked):
            x, ids = np.stack(vectors["embedding"].to_numpy()).astype(np.float64), vectors["vec_id"].to_numpy()
            q, who = np.stack(asked["q"].to_numpy()).astype(np.float64), asked["query_id"].to_numpy()
            slack = ROUNDED + 1e-12 * np.sqrt((x**2).sum(axis=1).max()) * np.sqrt((q**2).sum(axis=1).max())
            for i in range(0, len(q), BLOCK):
                sums = q[i : i + BLOCK] @ x.T
                sums[who[i : i + BLOCK, None] == ids] = -np.inf
                least = -np.partition(-sums, k - 1, axis=1)[:, k - 1, None] if len(ids) > k else np.full((len(sums), 1), -np.inf)
                a, b = np.nonzero((sums >= least - slack) & (sums > -np.inf))
                score = np.zeros(len(a))
                for d in range(x.shape[1]):
                    score += q[i + a, d] * x[b, d]
                out.append((a + i, b, score))
        a, b, score = (np.concatenate(c) for c in zip(*out, strict=True))
        made = {"query_id": asked["query_id"].to_numpy()[a], "doc_id": vectors["vec_id"].to_numpy()[b], "score": score}
        return pd.DataFrame(made | {"label": vectors["label"].array.take(b)} if label else made)

    return run


def dense_best(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, label, score, rank): the best k of dense_scores at six decimals.

    Blocks of vectors meet blocks of questions; each pair of blocks is one product of matrices and gives each question's
    best k, so that no row stands for a pair. Vectors that are no plain ones meet row by row; those of another length don't meet.
    """
    n, odd, m, odd_too = *vectors.agg(F.count("*"), F.count_if(~plain_vector(F.col("embedding")))).first(), *queries.agg(F.count("*"), F.count_if(~plain_vector(F.col("q")))).first()
    blocks, many = max(1, -(-n // VECTORS)), max(1, -(-m // QUESTIONS))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    v = vectors.where(plain_vector(F.col("embedding"))).select("vec_id", "embedding", "label", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    q = queries.where(plain_vector(F.col("q"))).select("query_id", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(many)).alias("of"))
    key, kinds = ["dim", "block", "of"], dict(vectors.dtypes)
    form = f"query_id {dict(queries.dtypes)['query_id']}, doc_id {kinds['vec_id']}, label {kinds['label']}, score double"
    scores = v.withColumn("of", every(many)).groupBy(*key).cogroup(q.withColumn("block", every(blocks)).groupBy(*key)).applyInPandas(dense_block(k, True), form)
    if odd:
        scores = scores.unionByName(dense_scores(vectors.where(~plain_vector(F.col("embedding"))), queries))
    if odd_too:
        scores = scores.unionByName(dense_scores(vectors.where(plain_vector(F.col("embedding"))), queries.where(~plain_vector(F.col("q")))))
    return top_k(scores.withColumn("score", F.round("score", 6)), k)


def top_k(scores: DataFrame, k: int, score: str = "score", id_: str = "doc_id") -> DataFrame:
    """scores with rank, the best k of each query_id, ties to the smaller id."""
    w = W.partitionBy("query_id").orderBy(F.desc(score), id_)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexical(index: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) = tfidf + 0.2 coverage of all pairs that have either: the mode without a dense encoder."""
    both = coverage_scores(index, queries).join(tfidf_scores(index, queries), ["query_id", "doc_id"], "full_outer")
    score = F.coalesce("tfidf", F.lit(0.0)) + COVERAGE * F.coalesce("coverage", F.lit(0.0))
    return both.select("query_id", "doc_id", F.round(score, 6).alias("score"))


#: Hits of a block of documents, questions of a block, and products that a task holds at once.
HITS, PRODUCTS = 1 << 18, 1 << 22
#: Scores are rounded to six decimals, twice with a boost; sums before that may miss by less.
ROUNDED = 4e-6


def _block_best(k: int):
    """Of a block of documents, each with its hits (doc_id, no, w, low, section), and a block of questions (query_id, no, q, term, wanted): the
    pairs whose sum can be among a question's best k of the block, with the most (part) and the least (low) that it can be.

    What a document's terms give may be less than it is, down to `low` times it; `term` is q where that holds, else 0.
    """

    def run(hits: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": asked["query_id"].iloc[:0], "doc_id": hits["doc_id"].iloc[:0], "part": np.zeros(0), "low": np.zeros(0)})
        if not len(hits) or not len(asked):
            return none
        query, queries = pd.factorize(asked["query_id"])
        wanted = np.full(len(queries), np.nan)
        wanted[query] = asked["wanted"].to_numpy(np.float64, na_value=np.nan)
        order = np.argsort(asked["no"].to_numpy(), kind="stable")
        no, q, term, query = asked["no"].to_numpy()[order], asked["q"].to_numpy()[order], asked["term"].to_numpy()[order], query[order]
        lack = 1 - hits["low"].to_numpy()
        docs, section = hits["doc_id"].array, hits["section"].to_numpy(np.float64, na_value=np.nan)
        w, hit = np.concatenate(hits["w"].to_list()), np.concatenate(hits["no"].to_list())
        doc = np.repeat(np.arange(len(docs)), hits["no"].map(len))
        lo = np.searchsorted(no, hit, "left")
        n = np.searchsorted(no, hit, "right") - lo
        # so many documents at a time that neither their products nor their sums are too many
        part_of = np.cumsum(np.bincount(doc, n, len(docs)) + len(queries)) // PRODUCTS
        best, out = np.full((len(queries), 0), -np.inf), []
        for part in np.unique(part_of):
            d0, d1 = np.searchsorted(part_of, part, "left"), np.searchsorted(part_of, part, "right")
            i, j = np.searchsorted(doc, d0, "left"), np.searchsorted(doc, d1, "left")
            row = np.repeat(np.arange(i, j), n[i:j])
            at = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
            cell = (doc[row] - d0) * len(queries) + query[at]
            sums = np.bincount(cell, w[row] * q[at], (d1 - d0) * len(queries)).reshape(d1 - d0, -1)
            sums += np.where(section[d0:d1, None] == wanted, 2 * BOOST, 0.0)
            sums[np.bincount(cell, minlength=sums.size).reshape(sums.shape) == 0] = -np.inf
            low = sums
            if lack[d0:d1].any():
                low = sums - lack[d0:d1, None] * np.bincount(cell, w[row] * term[at], sums.size).reshape(sums.shape)
            best = np.concatenate([best, low.T], axis=1)
            best = -np.partition(-best, k - 1, axis=1)[:, :k] if best.shape[1] > k else best
            least = best.min(axis=1) if best.shape[1] == k else np.full(len(queries), -np.inf)
            d, who = np.nonzero((sums >= least - ROUNDED) & (sums > -np.inf))
            out.append((who, d + d0, sums[d, who], low[d, who]))
        who, d, sums, low = (np.concatenate(x) for x in zip(*out, strict=True))
        stay = sums >= least[who] - ROUNDED
        return pd.DataFrame({"query_id": queries[who[stay]], "doc_id": docs.take(d[stay]), "part": sums[stay], "low": low[stay]})

    return run


def _best_of_all(k: int, asked: pd.DataFrame):
    """_block_best for the rows that a task reads, HITS hits at a time, and all questions' parts."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(0, len(batch), 1024):
                held.append(batch.iloc[i : i + 1024])
                size += held[-1]["no"].map(len).sum()
                if size >= HITS:
                    yield _block_best(k)(pd.concat(held), asked)
                    held, size = [], 0
        if held:
            yield _block_best(k)(pd.concat(held), asked)

    return run


class Bounded:
    """The best k pairs of each question by w * tfidf + c * coverage, in full for those pairs alone that can be among them.

    A question is a set of parts: its known terms, each of which gives weight * q, and its wanted terms, each of which
    gives c / n. The postings of all questions' parts are read once (`hits`), each part by its number. Documents are dealt
    into blocks of some HITS hits, and a block meets the parts of BLOCK questions in one task, which adds the products up in
    arrays: no row stands for a product of a hit and a question. A block gives its best k pairs of each question and those
    that rounding could put beside them; of all blocks' the best k and their like are scored once more in full, in one
    order of rounding. Ties at six decimals stay in. A section's boost is added as sums are, and changes no bound.
    """

    def __init__(self, index, queries: DataFrame, k: int, tfidf: float = 1.0, coverage: float = COVERAGE, sections: DataFrame | None = None):
        """sections: (doc_id, section_number), to which the section that a question wants adds its boost."""
        self.k, self.coverage = k, coverage
        scanned = not isinstance(index, dict)
        parts = asked_terms({"vocab": index.vocabulary(queries)} if scanned else index, queries).select("query_id", F.lit("t").alias("kind"), "term", (F.col("q") * tfidf).alias("q"), "idf", F.lit(0).alias("n"))
        if coverage:
            wanted = wanted_terms(queries)
            parts = parts.union(wanted.select("query_id", F.lit("c"), "term", coverage / F.col("n"), F.lit(1.0), "n"))
        parts = io.staged(parts, "terms")
        terms_ = sent(parts.select("kind", "term", "idf").distinct().withColumn("no", F.monotonically_increasing_id()))
        wanted_section = F.coalesce(requested_section(F.col("text")), inferred_section(F.col("text"))) if sections is not None else F.lit(None).cast("int")
        self.wanted = io.staged(queries.select("query_id", wanted_section.alias("wanted")), "wanted")
        self.parts = io.staged(parts.join(terms_.drop("idf"), ["kind", "term"]).select("query_id", "no", "kind", "q", "n"), "parts")
        if scanned:
            listed = [(r["kind"], r["term"], r["no"], r["idf"]) for r in terms_.collect()]  # what a stated set of questions asks
            hits, self.settled = index.hits([x[1:] for x in listed if x[0] == "t"], [x[1:3] for x in listed if x[0] == "c"]), index.settled
            self.hits = io.staged(hits if sections is not None else hits.withColumn("section_number", F.lit(None).cast("int")), "hits")
            return
        hits = index["postings"].join(terms_.where("kind = 't'"), "term").select("no", "doc_id", (F.col("tf") * F.col("idf")).alias("w"), F.lit(True).alias("t"))
        if coverage:
            of = terms_.where("kind = 'c'").select("term", "no")
            hits = hits.union(holders(index, of.select("term")).join(of, "term").select("no", "doc_id", F.lit(1.0), F.lit(False)))
        of_doc = index["norms"]
        of_doc = of_doc.join(sections, "doc_id", "left") if sections is not None else of_doc.withColumn("section_number", F.lit(None).cast("int"))
        weight = F.when(F.col("t"), F.col("w") / F.col("norm")).otherwise(F.col("w"))
        hits = hits.join(of_doc, "doc_id").select("doc_id", "section_number", F.struct("no", weight.alias("w")).alias("hit"))
        hits = hits.groupBy("doc_id").agg(F.first("section_number").alias("section_number"), F.collect_list("hit").alias("hits"))  # one document's
        self.hits = io.staged(hits.select("doc_id", "section_number", F.col("hits.no").alias("no"), F.col("hits.w").alias("w"), F.lit(1.0).alias("low")), "hits")
        self.settled = lambda hits: hits.withColumn("factor", F.lit(1.0))

    def _of(self, pairs: DataFrame) -> DataFrame:
        """The hits of pairs (query_id, doc_id), a row each, with their questions' parts."""
        pairs = sent(pairs)
        of_doc = self.settled(self.hits.join(sent(pairs.select("doc_id").distinct()), "doc_id", "left_semi"))
        met = of_doc.join(pairs, "doc_id").select("query_id", "doc_id", "section_number", "factor", F.explode(F.arrays_zip("no", "w")).alias("hit"))
        met = met.select("query_id", "doc_id", "section_number", "factor", "hit.no", "hit.w").join(self.parts, ["query_id", "no"])
        return met.withColumn("w", F.when(F.col("kind") == "t", F.col("w") * F.col("factor")).otherwise(F.col("w")))

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) in full of pairs (query_id, doc_id)."""
        met = self._of(pairs.select("query_id", "doc_id"))
        t = F.sum(F.when(F.col("kind") == "t", F.col("q") * F.col("w")).otherwise(0.0))
        c = F.count_if(F.col("kind") == "c") / F.greatest(F.max("n"), F.lit(1))
        base = F.round(t + self.coverage * c, 6) if self.coverage else t
        sums = met.groupBy("query_id", "doc_id").agg(base.alias("score"), F.first("section_number").alias("section_number"))
        boost = F.when(F.col("section_number") == F.col("wanted"), 2 * BOOST).otherwise(0.0)
        return sums.join(self.wanted, "query_id").select("query_id", "doc_id", F.round(F.col("score") + boost, 6).alias("score"))

    def _asked(self) -> DataFrame:
        """(query_id, no, q, term): term is q of a term, whose weight in a document may be known within bounds, else 0."""
        return self.parts.groupBy("query_id", "no").agg(F.sum("q").alias("q"), F.sum(F.when(F.col("kind") == "t", F.col("q")).otherwise(0.0)).alias("term"))

    def candidates(self) -> DataFrame:
        """(query_id, doc_id): pairs that can be among the best k."""
        asked = self._asked().join(self.wanted, "query_id").select("query_id", "no", "q", "term", "wanted")
        return block_best(self.hits.select("doc_id", "no", "w", "low", F.col("section_number").alias("section")), io.staged(asked, "asked"), self.k)

    def best(self) -> DataFrame:
        """(query_id, doc_id, score, rank)."""
        return top_k(self._scored(self.candidates()), self.k)


def block_best(hits: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id): of documents' hits (doc_id, no, w, low, section; no and w are lists) and questions' parts (query_id, no, q, term,
    wanted), which have been written down (see _block_best), the pairs whose sum of q * w, with the boost of the wanted section, can be among a question's best k.

    The parts of up to BLOCK questions are sent to the tasks that read the hits; more meet them in blocks.
    """
    kinds = dict(asked.dtypes)["query_id"], dict(hits.dtypes)["doc_id"]
    form = "query_id {}, doc_id {}, part double, low double".format(*kinds)
    many = -(-max(asked.select("query_id").distinct().count(), 1) // BLOCK)
    if many == 1 and asked.count() <= SENT:
        found = hits.mapInPandas(_best_of_all(k, asked.toPandas()), form)  # SENT rows at most
    else:
        blocks = -(-max(hits.agg(F.coalesce(F.sum(F.size("no")), F.lit(0))).first()[0], 1) // HITS)

        def every(n: int):
            return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

        hits = hits.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).withColumn("of", every(many))
        asked = asked.withColumn("of", F.pmod(F.xxhash64("query_id"), F.lit(many))).withColumn("block", every(blocks))
        found = hits.groupBy("block", "of").cogroup(asked.groupBy("block", "of")).applyInPandas(_block_best(k), form)
    found = io.staged(found, "found")
    kth = top_k(found, k, "low").where(F.col("rank") == k).select("query_id", F.col("low").alias("least"))
    return found.join(kth, "query_id", "left").where(f"least IS NULL OR part >= least - {ROUNDED}").select("query_id", "doc_id")


def hybrid(index: dict[str, DataFrame], queries: DataFrame, dense: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): dense (query_id, doc_id, dense), lexical and coverage scores fused (R10), of all pairs that have one."""
    key = ["query_id", "doc_id"]
    both = dense.join(tfidf_scores(index, queries), key, "full_outer").join(coverage_scores(index, queries), key, "full_outer")
    parts = ((DENSE, "dense"), (LEXICAL, "tfidf"), (COVERAGE, "coverage"))
    return both.select(*key, F.round(sum((w * F.coalesce(c, F.lit(0.0)) for w, c in parts), F.lit(0.0)), 6).alias("score"))


class Fused(Bounded):
    """The best k pairs of each question by dense, lexical and coverage scores fused (R10): those of `hybrid`.

    A vector's components are parts of a question as terms are, so that one sum in blocks bounds all three scores.
    """

    def __init__(self, index, queries: DataFrame, k: int, vectors: DataFrame, asked: DataFrame):
        """vectors (vec_id, embedding); asked (query_id, own, q): a question's vector, and the vec_id that it doesn't meet."""
        super().__init__(index, queries, k, LEXICAL, COVERAGE)
        self.vectors, self.asked = vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), io.staged(asked, "vectors")

    def candidates(self) -> DataFrame:
        """(query_id, doc_id): a question's own vector may be among the k + 1 best, where it displaces none."""
        of = lambda v: F.when(plain_vector(F.col(v)), F.col(v).cast("array<double>")).otherwise(F.array(F.lit(0.0)))
        numbers = lambda w: F.transform(w, lambda x, i: (-1 - i).cast("long"))
        both = self.vectors.select("doc_id", of("embedding").alias("x")).join(self.hits, "doc_id", "full_outer")
        x, w = F.coalesce("x", F.array().cast("array<double>")), F.coalesce("w", F.array().cast("array<double>"))
        no = F.concat(F.coalesce("no", F.array().cast("array<long>")), numbers(x))
        hits = io.staged(both.select("doc_id", no.alias("no"), F.concat(w, x).alias("w"), F.coalesce("low", F.lit(1.0)).alias("low"), F.lit(None).cast("int").alias("section")), "all")
        vector = self.asked.select("query_id", F.posexplode(of("q")).alias("no", "x")).select("query_id", (-1 - F.col("no")).cast("long").alias("no"), DENSE * F.col("x"), F.lit(0.0))
        asked = self._asked().union(vector).withColumn("wanted", F.lit(None).cast("int"))
        found = block_best(hits, io.staged(asked, "asked"), self.k + 1)
        odd = self.vectors.where("embedding IS NOT NULL").where(~plain_vector(F.col("embedding"))).select("doc_id")
        odd_too = self.asked.where("q IS NOT NULL").where(~plain_vector(F.col("q"))).select("query_id")
        return found.union(self.asked.select("query_id").crossJoin(odd)).union(odd_too.crossJoin(self.vectors.select("doc_id"))).distinct()

    def best(self) -> DataFrame:
        pairs = io.staged(self.candidates(), "pairs")
        dense = sent(pairs).join(self.vectors, "doc_id").join(self.asked, "query_id").where("doc_id != own")
        dense = dense.select("query_id", "doc_id", F.round(dot(F.col("q"), F.col("embedding")), 6).alias("dense"))
        met = self._of(pairs)
        t = F.sum(F.when(F.col("kind") == "t", F.col("q") * F.col("w")).otherwise(0.0))
        c = F.count_if(F.col("kind") == "c") / F.greatest(F.max("n"), F.lit(1))
        words = met.groupBy("query_id", "doc_id").agg((t + COVERAGE * c).alias("words"))
        both = dense.join(words, ["query_id", "doc_id"], "full_outer")
        score = F.round(DENSE * F.coalesce("dense", F.lit(0.0)) + F.coalesce("words", F.lit(0.0)), 6)
        return top_k(both.select("query_id", "doc_id", score.alias("score")), self.k)


def boosted(scores: DataFrame, sections: DataFrame, queries: DataFrame, score: str = "score") -> DataFrame:
    """scores with the boost of the wanted section added (R12): a question's section is the one it names, else the one its words hint at.

    scores (query_id, doc_id, score), sections (doc_id, section_number), queries (query_id, text). The boost counts twice.
    """
    wanted = queries.select("query_id", F.coalesce(requested_section(F.col("text")), inferred_section(F.col("text"))).alias("wanted"))
    both = scores.join(sections, "doc_id").join(wanted, "query_id")
    extra = F.when(F.col("section_number") == F.col("wanted"), 2 * BOOST).otherwise(0.0)
    return both.withColumn(score, F.round(F.col(score) + extra, 6))


def index_text(product: Column, source_file: Column, number: Column, title: Column, page_start: Column, page_end: Column, content: Column) -> Column:
    """What of a chunk is indexed."""
    head = F.concat(F.lit("Producto: "), product, F.lit("\nDocumento: "), source_file, F.lit("\nSeccion "), number, F.lit(": "), title)
    return F.concat(head, F.lit("\nPaginas: "), page_start, F.lit("-"), page_end, F.lit("\n"), content)


def results(ranked: DataFrame, chunks: DataFrame, most_chars: int = 900) -> DataFrame:
    """What a search prints of each result (R14): rank, score, source, section, pages and the beginning of its content."""
    text = F.trim(F.substring("content", 1, most_chars))
    both = ranked.select("query_id", "rank", "score", "chunk_id").join(chunks, "chunk_id")
    return both.select("query_id", "rank", "score", "chunk_id", "source_file", "section_number", "section_title", T.page_span(F.col("page_start"), F.col("page_end")).alias("pages"), text.alias("excerpt"))
