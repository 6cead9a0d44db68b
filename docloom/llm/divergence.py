"""How far the sources of a language differ in their words: tiles of group blocks against group blocks.

Terms are counted in the tasks that read the texts and meet by (lang, term) in one exchange, which also gives the documents
of each term. Kept terms are dealt into chunks of about CHUNK; a group's counts in a chunk are one packed row. Groups of a
language are dealt into blocks of about BLOCK; a row goes to every tile (block, block) that its group is part of, and a tile
to as many tasks as it has stretches of STRETCH chunks. A task holds one chunk of two blocks at a time and sums its pairs'
differences; the sums of a tile's stretches are added at the end.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, short_batches, text_bytes

CHUNK, STRETCH, BLOCK = 1024, 64, 32
SCALE, SMOOTH = 1_000_000_000, 5
#: Terms that a task holds before it passes its counts on.
HELD = 200_000
#: Bytes of a text that are split at once.
PIECE = 1 << 22
#: A term is a run of letters A-Z, a-z and of what is not ASCII.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _words(text: bytes):
    """Lists of a text's terms."""
    text, at = text.translate(_FOLD), 0
    while len(text) - at > PIECE:
        end = text.rfind(b" ", at, at + PIECE)
        end = end if end >= 0 else text.find(b" ", at + PIECE)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def _count(batches):
    """Rows (lang, source, term, n, docs), counted over as many documents as HELD terms allow."""
    held: dict = {}

    def rows():
        for (lang, source), (n, docs) in held.items():
            k = len(n)
            columns = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[x] for x in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), text_bytes(batch.column("text")), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own: set = set()
            for words in _words(text):
                n.update(words)
                own.update(words)
            docs.update(own)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from rows()
    yield from rows()


def share(n, total):
    """1 + floor(SCALE * n / total) of integers, exact for totals below 9e15: three digits at a time."""
    rest, out = n, 0
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        out, rest = out * 1000 + digit, rest - digit * total
    return out + 1


def _share(n: Column, total: Column) -> Column:
    """The same of columns, in decimals."""
    return F.expr("1").cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * n.cast("decimal(19,0)"), total.cast("decimal(19,0)"))


class _Tile:
    """The sums of one tile over the chunks seen so far."""

    def __init__(self, lang: str, left: int, right: int):
        self.lang, self.left, self.right, self.sums = lang, left, right, None

    def add(self, rows: list[tuple[int, str, np.ndarray]]) -> None:
        """One chunk: (block, source, shares) of every group of both blocks, in order of sources."""
        a, b = ([r for r in rows if r[0] == k] for k in (self.left, self.right))
        p, q = (np.stack([r[2] for r in x]) if x else np.zeros((0, 0), dtype=np.int64) for x in (a, b))
        self.names = [r[1] for r in a], [r[1] for r in b]
        if self.sums is None:
            self.sums = np.zeros((len(a), len(b)), dtype=np.int64)
        for i in range(len(a) if len(b) else 0):
            self.sums[i] += np.abs(q - p[i]).sum(axis=1)

    def rows(self) -> pa.RecordBatch:
        i, j = np.nonzero(np.ones_like(self.sums))
        if self.left == self.right:
            i, j = i[i != j], j[i != j]
        a, b = (np.array(x, dtype=object) for x in self.names)
        value = self.sums[i, j]
        source, item = a[i], b[j]
        if self.left != self.right:  # both ways
            source, item, value = np.concatenate([source, item]), np.concatenate([item, source]), np.tile(value, 2)
        columns = [pa.array([self.lang] * len(value), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])


def _tiles(batches):
    """Rows come by tile, stretch, chunk and source."""
    tile = key = chunk = None
    rows: list = []
    for batch in batches:
        slots, counts = batch.column("slots"), batch.column("counts")
        other = batch.drop_columns(["slots", "counts"]).to_pylist()
        for k, r in enumerate(other):
            now = (r["lang"], r["left"], r["right"], r["stretch"])
            if (now, r["chunk"]) != (key, chunk):
                if rows:
                    tile.add(rows)
                rows, chunk = [], r["chunk"]
                if now != key:
                    if tile:
                        yield tile.rows()
                    tile, key = _Tile(*now[:3]), now
            total = r["total"] + SMOOTH * r["v"]
            p = np.full(r["size"], share(SMOOTH, total) if total else 0, dtype=np.int64)
            if slots[k].is_valid:
                p[slots[k].values.to_numpy() - 1] = share(counts[k].values.to_numpy() + SMOOTH, total)
            rows.append((r["block"], r["source"], p))
    if rows:
        tile.add(rows)
        yield tile.rows()


def audit(docs: DataFrame, least_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text); more columns are ignored.

    Null text, lang and source count as ''. Terms are runs of ASCII letters and of all that is not ASCII, A-Z in lower
    case; a language keeps those of at least least_docs of its documents. Every (lang, source) group, without terms too,
    has for every kept term p = 1 + floor(10^9 (n + 5) / (N + 5 V)). Part `pair`: each other source of the language with
    the sum of |p - q|, 0 where no term is kept. Part `term`: the top_terms kept terms of the group by p - q, q the
    language's, where that is above 0. Ties go to the smaller item in UTF-8. Repeated rows count each; an empty table
    gives an empty result. Counts are exact for up to 9e15 terms in a language.
    """
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = short_batches(d).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # one exchange by (lang, term) serves the sums of groups and those of the language
    summed = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    first = F.row_number().over(of_term.orderBy("source")) == 1
    summed = summed.withColumns({"docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "first": first.cast("long")})
    kept = cut(summed.where(F.col("docs") >= least_docs).drop("docs"))

    groups = d.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("lang_total"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    of_group = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang")
    of_group = of_group.fillna(0, ["total", "v", "lang_total"])
    chunks, blocks = F.greatest(F.ceil(F.col("v") / CHUNK), F.lit(1)), F.ceil(F.col("sources") / BLOCK)
    of_group = cut(of_group.select("lang", "source", "total", "v", "lang_total", chunks.alias("chunks"), blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).alias("block")))

    terms = kept.join(of_group, ["lang", "source"])
    p, q = (_share(F.col(n) + SMOOTH, F.col(t) + SMOOTH * F.col("v")) for n, t in (("n", "total"), ("lang_n", "lang_total")))
    over = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)

    terms = terms.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
    slot = F.dense_rank().over(W.partitionBy("lang", "chunk").orderBy("term"))
    cells = cut(terms.select("lang", "source", "chunk", slot.alias("slot"), "n"))
    packed = cells.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("slot", "n")).alias("cells"))  # one chunk's
    packed = packed.select("lang", "source", "chunk", F.col("cells.slot").alias("slots"), F.col("cells.n").alias("counts"))
    width = cells.groupBy("lang", "chunk").agg(F.max("slot").alias("size"))
    every = of_group.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    every = every.join(packed, ["lang", "source", "chunk"], "left").join(width, ["lang", "chunk"], "left").fillna(0, ["size"])
    sent = every.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("lang", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), F.floor(F.col("chunk") / STRETCH).alias("stretch"), "chunk", "source", "block", "total", "v", "size", "slots", "counts")
    tile = ["lang", "left", "right", "stretch"]
    sums = sent.repartition(*tile).sortWithinPartitions(*tile, "chunk", "source").mapInArrow(_tiles, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    return pairs.union(over.select(*pairs.columns))


#: DuckDB's statement of the result.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*) AS v, sum(ln) AS ln_all FROM k GROUP BY 1),
n AS (SELECT lang, source, sum(n) AS n_all FROM c GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(n_all, 0)::HUGEINT + 5 * v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.ln + 5)) // (ln_all::HUGEINT + 5 * v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
