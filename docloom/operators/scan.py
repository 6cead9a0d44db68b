"""Texts that a stated set of questions is asked of, without an index of all that stands in them.

A question needs the postings of its own terms, their frequencies, and each text's norm, which rests on the frequencies of all
the text's terms. Texts are read twice. The first pass counts in how many texts a term stands (`frequencies`): each task counts
its own texts together, so that a term is a row a task, not a row a text. The second (`Texts.hits`) gives a row for each text: the
asked terms that it has, the wanted terms that stand inside its words, and its norm. The weights of the COMMON most frequent terms are
sent to every task. A term beyond these stands in few texts, so that its weight is known within bounds (within a bit, if it can but stand
in one); so is a text's norm, and only the texts that can be among the best by these bounds have theirs made exact (`Texts.settled`).

A term is told from others by 64 bits: of n distinct terms some two are alike with a chance of n * n / 3.7e19 (3e-4 for 100
million), which would move the norms of the texts that have either. An inverted index (`inverted`) serves questions that come one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..sources import io
from . import search

#: Characters of texts that are read at once; words and terms that a task holds before it begins anew or hands them over.
SLICE, KEPT = 1 << 22, 1 << 20
#: Terms whose weights every task has: 32 MB.
COMMON = 1 << 21
_WORD, _LONG = re.compile(r"\w{2,}"), re.compile("[a-z0-9]{4,}")
_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Numbers of the words that a task has met: by these a word's hash, and the wanted terms that stand in it, by their places in the list."""

    def __init__(self, wanted: list[str] = ()):
        super().__init__()
        self.hashes, self.begin, self.held, self.n = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), len(wanted)
        self.new, self.wanted = [], {}
        for k, term in enumerate(wanted):
            self.wanted.setdefault(term[: search.GRAM], []).append((term, k))

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def _inside(self, word: str) -> set[int] | tuple:
        of, k = self.wanted, search.GRAM
        return {no for run in _LONG.findall(word) for i in range(len(run) - k + 1) if (there := of.get(run[i : i + k])) for term, no in there if run.startswith(term, i)}

    def learn(self) -> None:
        """Hashes and wanted terms of the words that have come since."""
        if self.new:
            self.hashes = np.append(self.hashes, pd.util.hash_array(np.array(self.new, object), categorize=False))
            found = [self._inside(w) if self.wanted else () for w in self.new]
            self.begin = np.append(self.begin, self.begin[-1] + np.cumsum([len(x) for x in found]))
            self.held = np.append(self.held, np.fromiter((no for x in found for no in x), np.int64))
            self.new = []

    def hashed(self, terms: list[str]) -> np.ndarray:
        """Hashes of terms: words, or two with a space between."""
        numbers = [[self[w] for w in term.split(" ")] for term in terms]
        self.learn()
        first, last = (np.array([x[k] for x in numbers], np.int64) for k in (0, -1))
        of_pair = np.array([len(x) > 1 for x in numbers], bool)
        return np.where(of_pair, pair_hash(self.hashes[first], self.hashes[last]), self.hashes[first])

    def terms(self, heads: list, texts: list) -> tuple[np.ndarray, ...]:
        """Of folded texts and what stands before them: (text, hash) of all terms; (text, number) of the words of the texts themselves."""
        flat, n, own = [], [], []
        for head, text in zip(heads, texts, strict=True):
            before, found = _WORD.findall(head or ""), _WORD.findall(text or "")
            flat += [self[w] for w in before]
            flat += [self[w] for w in found]
            n.append(len(before) + len(found)), own.append(len(before))
        self.learn()
        flat, of = np.array(flat, np.int64), np.repeat(np.arange(len(n)), n)
        hashes, ends = self.hashes[flat], np.cumsum(n, dtype=np.int64)
        inner = np.arange(len(flat)) >= np.repeat(ends - n + own, n)
        beside = of[1:] == of[:-1]
        pairs = pair_hash(hashes[:-1][beside], hashes[1:][beside])
        return np.concatenate([of, of[1:][beside]]), np.concatenate([hashes, pairs]), of[inner], flat[inner]

    def inside(self, of: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place), each once, of the wanted terms that stand in words (text, number)."""
        some = np.diff(self.begin)[numbers] > 0
        both = np.unique(of[some] * np.int64(len(self)) + numbers[some])  # a text's words once
        of, numbers = both // max(len(self), 1), both % max(len(self), 1)
        n = np.diff(self.begin)[numbers]
        at = np.repeat(self.begin[numbers], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.unique(np.repeat(of, n) * np.int64(self.n) + self.held[at])
        return both // max(self.n, 1), both % max(self.n, 1)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two words' hashes that of the pair."""
    x = a * _STEP + b
    x ^= x >> np.uint64(29)
    x *= _TURN
    return x ^ (x >> np.uint64(32))


def term_hash(term: Column) -> Column:
    """The hash of a term: a word, or two with a space between."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(_Words().hashed(list(x)).view(np.int64))

    return run(term)


def _each(of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, hash, number): each pair once."""
    order = np.argsort(hashes)
    order = order[np.argsort(of[order].astype(np.uint16), kind="stable")]  # a slice has so few texts
    of, hashes = of[order], hashes[order]
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return of[at], hashes[at], np.diff(np.append(at, len(of)))


def _folded(docs: DataFrame, *more: str) -> DataFrame:
    head = F.col("head") if "head" in docs.columns else F.lit("")
    of = [f(c).alias(f"{n}{k}") for n, c in (("head", head), ("text", F.col("text"))) for k, f in enumerate((T.fold_plainly, T.needs_python))]
    return docs.select(*of, *more)


def _slices(batches):
    """(batch, begin, heads, texts): rows of SLICE characters or one row at a time, folded."""
    for batch in batches:
        of = []
        for k in (0, 2):
            pairs = zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), strict=True)
            of.append([plain if other is None else T.normalised(other) for plain, other in pairs])
        begin, size = 0, 0
        for k, (head, text) in enumerate(zip(*of, strict=True), 1):
            size += len(head or "") + len(text or "")
            if size >= SLICE or k - begin == 1 << 16 or k == batch.num_rows:
                yield batch, begin, of[0][begin:k], of[1][begin:k]
                begin, size = k, 0


def whole(docs: DataFrame) -> DataFrame:
    """docs as an index takes them: the text with what stands before it, and apart from it as `content`."""
    text = F.concat("head", "text") if "head" in docs.columns else F.col("text")
    return docs.withColumns({"text": text, "content": F.col("text")}).drop("head")


def frequencies(docs: DataFrame) -> DataFrame:
    """(hash, df): in how many texts of docs (text and, if it is there, head before it) each term stands."""

    def together(held: list) -> tuple[np.ndarray, np.ndarray]:
        hashes, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(hashes)
        hashes, n = hashes[order], n[order]
        at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        return hashes[at], np.add.reduceat(n, at)

    def rows(held: list):
        hashes, n = together(held)
        for i in range(0, len(hashes), search.ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(hashes[i : i + search.ROWS].view(np.int64)), pa.array(n[i : i + search.ROWS])], names=["hash", "n"])

    def run(batches):
        words, held, size = _Words(), [], 0
        for _, _, heads, texts in _slices(batches):
            _, hashes, _ = _each(*words.terms(heads, texts)[:2])
            if len(hashes):
                held.append(np.unique(hashes, return_counts=True))
                size += len(held[-1][0])
            if size > 2 * KEPT:
                held = [together(held)]
                size = len(held[0][0])
                if size > KEPT:
                    yield from rows(held)
                    held, size = [], 0
            words = _Words() if len(words) > KEPT else words
        if held:
            yield from rows(held)

    return _folded(docs).mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("df"))


def _lists(of: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    """Values of texts, in their order, as a list for each of n texts."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n))).astype(np.int32)), pa.array(values))


def spread(docs: DataFrame) -> DataFrame:
    """docs dealt out to all cores, if they lie in pieces for fewer than half of them."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.select(F.spark_partition_id()).distinct().count() >= cores / 2 else docs.repartition(2 * cores)


class Texts:
    """docs (doc_id, text; `head`, which stands before the text and no wanted term is looked for in; section_number) and the
    frequencies of their terms (hash, df), which have been written down."""

    def __init__(self, docs: DataFrame, df: DataFrame):
        self.docs, self.df, self.n = docs, df, docs.count()

    def vocabulary(self, queries: DataFrame) -> DataFrame:
        """(term, df, idf) of the known terms of queries (query_id, text)."""
        terms_ = search.counts(queries, "query_id", "text").select("term").distinct()
        met = self.df.join(search.sent(terms_.withColumn("hash", term_hash(F.col("term")))), "hash")
        return io.staged(search.vocabulary(met.select("term", "df"), self.n), "vocabulary")

    def _common(self) -> tuple[int, np.ndarray, np.ndarray]:
        """The least frequency of the terms that every task has; their hashes in order, and their weights."""
        size = F.length(F.bin("df"))
        least, room = 1 << 62, COMMON
        for bits, n in sorted(((r[0], r[1]) for r in self.df.groupBy(size.alias("bits")).count().collect()), reverse=True):  # 64 rows at most
            if n > room:
                break
            least, room = 1 << (bits - 1), room - n
        got = self.df.where(F.col("df") >= least).toArrow()  # COMMON rows at most
        hashes = got.column("hash").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        return least, hashes[order], np.log((1 + self.n) / (1 + got.column("df").to_numpy()[order])) + 1

    def hits(self, asked: list, wanted: list) -> DataFrame:
        """(doc_id, section_number, no, w, low, norm, square, rare, rare_tf): of each text that has some, the asked terms (term, no, idf) with
        tf * idf / norm, and the wanted ones (term, no), which stand inside its words, with 1.

        norm is the least that the text's can be, low times it the most; square is the sum under it of the terms whose weights
        are known, and rare the others with their numbers.
        """
        least, hashes, weights = self._common()
        self.rare = self.df.where(F.col("df") < least) if least > 2 else None
        # the least and the greatest weight of a term that the tasks don't have
        lowest, highest = (float(np.log((1 + self.n) / (1 + df)) + 1) for df in (max(min(least - 1, self.n), 1), 1))
        keys = _Words().hashed([term for term, _, _ in asked])
        order = np.argsort(keys)
        sent = self.docs.sparkSession.sparkContext.broadcast(
            (hashes, weights, keys[order], np.array([no for _, no, _ in asked], np.int64)[order], np.array([idf for _, _, idf in asked])[order], [term for term, _ in wanted], np.array([no for _, no in wanted], np.int64))
        )
        section = "section_number" if "section_number" in self.docs.columns else None
        docs = _folded(self.docs.withColumn("section_number", F.col(section).cast("int") if section else F.lit(None).cast("int")), "doc_id", "section_number")

        def found(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which hashes are among the keys, and where each of these is."""
            at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            some = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
            return some, at[some]

        def run(batches):
            hashes, weights, keys, nos, idf, wanted, wanted_nos = sent.value
            words = _Words(wanted)
            for batch, begin, heads, texts in _slices(batches):
                n = len(texts)
                of, hash_, of_word, number = words.terms(heads, texts)
                of, hash_, tf = _each(of, hash_)
                some, at = found(hashes, hash_)
                square, rare = np.bincount(of[some], (tf[some] * weights[at]) ** 2, n), ~some
                others = np.bincount(of[rare], tf[rare] ** 2, n)
                norm = np.sqrt(square + others * lowest**2)
                most = np.sqrt(square + others * highest**2)
                is_asked, where = found(keys, hash_)
                of_inside, inside = words.inside(of_word, number)
                of_hit = np.concatenate([of[is_asked], of_inside])
                order = np.argsort(of_hit.astype(np.uint16), kind="stable")
                no = np.concatenate([nos[where], wanted_nos[inside]])[order]
                w = np.concatenate([tf[is_asked] * idf[where] / norm[of[is_asked]], np.ones(len(inside))])[order]
                low = np.divide(norm, most, out=np.ones(n), where=most > 0)
                rare &= exchanged
                has = np.bincount(of_hit, minlength=n) > 0
                of_hit = of_hit[order]
                out = [
                    batch.column(4).slice(begin, n), batch.column(5).slice(begin, n), _lists(of_hit, n, no), _lists(of_hit, n, w), pa.array(low), pa.array(norm), pa.array(square, pa.float64()),
                    _lists(of[rare], n, hash_[rare].view(np.int64)), _lists(of[rare], n, tf[rare].astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(has))
                words = _Words(wanted) if len(words) > KEPT else words

        exchanged = self.rare is not None
        form = f"doc_id {dict(docs.dtypes)['doc_id']}, section_number int, no array<long>, w array<double>, low double, norm double, square double, rare array<long>, rare_tf array<int>"
        names = [x.split(" ")[0] for x in form.split(", ")]
        return docs.mapInArrow(run, form)

    def settled(self, hits: DataFrame) -> DataFrame:
        """hits of some texts with `factor`, by which a text's least norm is divided by its own."""
        if self.rare is None:
            return hits.withColumn("factor", F.lit(1.0))
        hits = io.staged(hits, "near")
        of_term = hits.select("doc_id", F.explode(F.arrays_zip("rare", "rare_tf")).alias("x")).select("doc_id", F.col("x.rare").alias("hash"), F.col("x.rare_tf").alias("tf"))
        asked = io.staged(of_term.select("hash").distinct(), "rare")
        known = self.rare.join(F.broadcast(asked) if asked.count() <= KEPT else asked, "hash")
        w = F.col("tf") * (F.log((1 + self.n) / (1 + F.col("df"))) + 1)
        more = of_term.join(known, "hash").groupBy("doc_id").agg(F.sum(w * w).alias("more"))
        own = F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0)))
        return hits.join(more, "doc_id", "left").withColumn("factor", F.when(own > 0, F.col("norm") / own).otherwise(1.0)).drop("more")
