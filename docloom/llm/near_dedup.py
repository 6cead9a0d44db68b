"""Near-duplicate documents: chosen-path similarity join over minwise tokens.

Texts are sets of 5-word shingles; two texts are linked at Jaccard similarity 0.75 or more. Each of TREES
independent trees branches every distinct set by minwise tokens: a node (a path of chosen coordinates and
the tokens found there) draws its next coordinate, and with probability 1/3 a second one, from its own
hash, so a pair at 0.75 has one common child on average and survives a level with probability
1 - q where q' = 2/3 (1/4 + 3q/4) + 1/3 (1/4 + 3q/4)^2. At three levels q = 0.40: ten trees miss a pair at
the threshold once in ten thousand, closer pairs far less often. Small nodes are compared exhaustively;
larger ones branch on, always twofold, so a pair at 0.75 in such a node stays together with 0.91 in each
round, and with its other trees is missed far less often. Every link is confirmed on the full sets.

Copies fold into one set first. Then each node is compared with its most central member only, and what that
links is taken as one component: a node within one component needs no more work, so a dense group of n
documents costs about n comparisons in each tree, never n * n. A node that holds several components is
compared across them: all that is outside its largest component with all members, in blocks of SMALL, if that
is SMALL or less; by further branching if it is more, and in blocks again where the tree ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import OF, SHARE, IdFilter, U, components, confirm_groups, counted, cut, dense_rows, mix, shingle_hashes, short_batches, slices, slim, text_bytes, word_hashes

COORDINATES = 128
TREES = 10
FIRST_LEVELS = 3
NEXT_LEVELS = 2
ROUNDS = 1
SMALL = 256
#: Nodes above WIDE members have several centres, of which each member is compared with every one.
WIDE, CENTRES = 16, 2
#: 128 one-bit minwise hashes agree on 0.875 at similarity 0.75, with a standard error of 0.029.
LEAST_AGREEING = 98
#: Of 128 whole minwise hashes 96 agree at similarity 0.75, with a standard error of 4.9.
LEAST_EQUAL = 80

_A = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, COORDINATES, dtype=np.uint64) | U(1)


def shingle_sets(texts: list[bytes]):
    """The sorted distinct shingle hashes of each text."""
    for i, j in slices(texts):
        words, at, _, _ = word_hashes(texts[i:j])
        for k in range(j - i):
            yield np.unique(shingle_hashes(words[at[k] : at[k + 1]]))


def minwise(x: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(x), 1024):
        out = np.minimum(out, (x[i : i + 1024, None] * _A).min(axis=0))
    return (out >> U(32)).astype(np.uint32)


FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, s1 long, s2 long, signature binary"


def _features(batches):
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("n", "d1", "d2", "s1", "s2", "sig")}
        for x in shingle_sets(text_bytes(batch.column("text"))):
            rows["n"].append(len(x))
            rows["d1"].append(np.uint64(mix(x).sum(dtype=np.uint64)).astype(np.int64) if len(x) else 0)
            rows["d2"].append(np.uint64(mix(x ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)).astype(np.int64) if len(x) else 0)
            sig = minwise(x)
            bits = np.packbits((mix(sig.astype(np.uint64)) & U(1)).astype(np.uint8)).view(np.int64)
            rows["s1"].append(bits[0])
            rows["s2"].append(bits[1])
            rows["sig"].append(sig.tobytes() if len(x) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64())]
            + [pa.array(rows[k], pa.int64()) for k in ("n", "d1", "d2", "s1", "s2")]
            + [pa.array(rows["sig"], pa.binary())],
            names=["doc_id", "n_shingles", "d1", "d2", "s1", "s2", "signature"],
        )


def _sets(wanted: IdFilter):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            keep = np.flatnonzero(wanted(ids))
            sets = list(shingle_sets(text_bytes(batch.column("text").take(pa.array(keep)))))
            at = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.ListArray.from_arrays(pa.array(at), pa.array(values))], names=["id", "shingles"])

    return run


def branch(paths: np.ndarray, who: np.ndarray, signatures: np.ndarray, levels: int, twice_of_3: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Children of the given nodes after so many levels: (path, row of signatures); twice_of_3: how many nodes of three branch twice."""
    for _ in range(levels):
        draw = mix(paths)
        first = (draw % U(COORDINATES)).astype(np.int64)
        step = U(1) + (draw >> U(16)) % U(COORDINATES - 1)
        twice = (draw >> U(40)) % U(3) < U(twice_of_3)
        second = ((first.astype(np.uint64) + step) % U(COORDINATES)).astype(np.int64)[twice]

        def child(p, w, c):
            return mix(p * U(0x2545F4914F6CDD1D) + (signatures[w, c].astype(np.uint64) << U(8)) + c.astype(np.uint64))

        paths, who = (
            np.concatenate([child(paths, who, first), child(paths[twice], who[twice], second)]),
            np.concatenate([who, who[twice]]),
        )
    return paths, who


def _matrix(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=np.uint32).reshape(-1, COORDINATES)


def _plant(batches):
    roots = mix(np.arange(1, TREES + 1, dtype=np.uint64) * U(0xDA942042E4DD58B5))
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            sig, n = _matrix(part.column("signature")), part.num_rows
            paths, who = branch(np.repeat(roots, n), np.tile(np.arange(n), TREES), sig, FIRST_LEVELS)
            ids = part.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(ids[who])], names=["path", "id"])


def _grow(batches):
    for batch in batches:
        paths = batch.column("path").to_numpy().view(np.uint64)
        paths, who = branch(paths, np.arange(len(paths)), _matrix(batch.column("signature")), NEXT_LEVELS, twice_of_3=3)
        who = pa.array(who)
        yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), batch.column("id").take(who), batch.column("signature").take(who)], names=["path", "id", "signature"])


def _compare(batches):
    """Pairs of a node's members from different components whose sketches agree well."""
    for batch in batches:
        lists = batch.column("members")
        flat = lists.flatten()
        who, comp, block, size = (flat.field(i).to_numpy() for i in (0, 1, 3, 4))
        signatures = _matrix(flat.field(2))
        at, pairs, groups = np.cumsum([0] + pc.list_value_length(lists).to_pylist()), [], []
        for k in range(len(at) - 1):
            i, j = (x + at[k] for x in np.triu_indices(at[k + 1] - at[k], 1))
            keep = (comp[i] != comp[j]) & ((block[i] != block[j]) | (block[i] < 0))
            i, j = i[keep], j[keep]
            good = np.zeros(len(i), dtype=bool)
            for c in range(0, len(i), 8192):
                good[c : c + 8192] = (signatures[i[c : c + 8192]] == signatures[j[c : c + 8192]]).sum(axis=1) >= LEAST_EQUAL
            i, j = i[good], j[good]
            both = np.unique(np.concatenate([i, j]))
            if len(i) <= 2 * len(both):
                pairs.append(np.stack([np.minimum(who[i], who[j]), np.maximum(who[i], who[j])], axis=1))
            else:
                groups.append(dense_rows(who[both], size[both]))
        none = [np.zeros((0, 2), np.int64)]
        pairs, groups = np.unique(np.concatenate(pairs + none), axis=0), np.concatenate(groups + none)
        kind = np.repeat([0, 1], [len(pairs), len(groups)])
        rows = np.concatenate([pairs, groups])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["kind", "a", "b"])


def set_table(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, shingles) of the given distinct doc_ids, and a few more; texts are read where they lie, not shuffled."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    return cut(rows.mapInArrow(_sets(IdFilter(ids)), "id long, shingles array<long>"))


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) that are linked, by their full sets."""
    pairs, n = counted(pairs)
    sets = set_table(slim(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), n), docs)
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    links = pairs.join(right, "b").join(left, "a").where(OF * both >= SHARE * (F.size("x") + F.size("y") - both)).select("a", "b")
    return cut(slim(links, n))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text; more columns are ignored).

    Null or wordless text: empty set, linked with nothing. Rows of one doc_id are one document that has the
    links of each of its texts. A null doc_id links with nothing: component_id null, kept false. An empty table
    gives an empty result.
    """
    docs = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = cut(docs.mapInArrow(_features, FEATURES))
    # copies fold into the smallest doc_id of their set
    sets = features.where("n_shingles > 0 AND doc_id IS NOT NULL")
    one = F.min(F.struct(F.col("doc_id").alias("id"), "s1", "s2", "signature", "n_shingles")).alias("one")
    solo = cut(sets.groupBy("d1", "d2").agg(one).select("d1", "d2", "one.*"))
    folded = solo.select("d1", "d2", "id")

    nodes = solo.select("id", "signature").mapInArrow(_plant, "path long, id long")
    links, comps = None, None

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))

    # first pass: every node against its most central member, the one that shares most nodes with others
    sizes = nodes.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    nodes = cut(nodes.join(sizes, "path"))
    central = nodes.groupBy("id").agg(F.sum("n").alias("weight"))
    part = F.when(F.col("n") > WIDE, F.pmod(F.xxhash64("id"), F.lit(CENTRES))).otherwise(0).alias("part")
    hub = nodes.join(central, "id").groupBy("path", part).agg(F.max(F.struct("weight", "id")).alias("h"))
    hub = hub.select("path", F.col("h.id").alias("a"))
    star = nodes.join(hub, "path").where("a != id").select("a", F.col("id").alias("b")).distinct()
    sketch = solo.select("id", "s1", "s2")
    star = star.join(sketch.toDF("a", "p1", "p2"), "a").join(sketch.toDF("b", "q1", "q2"), "b")
    agreeing = 128 - F.bit_count(F.col("p1").bitwiseXOR(F.col("q1"))) - F.bit_count(F.col("p2").bitwiseXOR(F.col("q2")))
    star = cut(star.where(agreeing >= LEAST_AGREEING).select("a", "b"))
    links = confirm(star, docs)
    comps = cut(components(links, most_rounds=2))  # parts of components do: they only save comparisons

    # second pass: what is left between components
    found, rest, signatures = None, nodes.select("path", "id"), solo.select("id", "signature", "n_shingles")
    for round_ in range(ROUNDS + 1):
        rest = labelled(rest)
        counts = rest.groupBy("path", "component").agg(F.count("*").alias("m"))
        counts = counts.groupBy("path").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("m"))
        counts = counts.select("path", F.col("top.component").alias("main"), F.col("top.m").alias("n_in"), (F.col("m") - F.col("top.m")).alias("n_out"))
        rest = cut(rest.join(counts.where("n_out > 0"), "path"))
        last = round_ == ROUNDS
        now = (rest if last else rest.where(F.col("n_out") <= SMALL)).join(signatures, "id")
        # blocks of those outside the main component against all blocks; within the main component nothing is open
        n_all, outside = F.col("n_in") + F.col("n_out"), F.col("component") != F.col("main")
        outer, inner = F.ceil(F.col("n_out") / SMALL).cast("long"), F.ceil(F.col("n_in") / SMALL).cast("long")
        block = F.when(n_all <= SMALL, 0).when(outside, F.pmod(F.xxhash64("id"), outer)).otherwise(outer + F.pmod(F.xxhash64("id"), inner))
        most = F.when(n_all <= SMALL, 0).when(outside, outer + inner - 1).otherwise(outer - 1)
        dealt = now.withColumn("block", block.cast("long")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))))
        x, y = F.least("block", "other"), F.greatest("block", "other")
        mark = F.when(x == y, F.lit(-1).cast("long")).otherwise(F.col("block"))
        dealt = dealt.select("path", x.alias("x"), y.alias("y"), F.struct("id", "component", "signature", mark.alias("block"), "n_shingles").alias("m"))
        groups = dealt.groupBy("path", "x", "y").agg(F.collect_list("m").alias("members")).select("members")
        pairs = cut(groups.mapInArrow(_compare, "kind long, a long, b long").distinct())
        found = pairs if found is None else found.union(pairs)
        large = rest.where(F.col("n_out") > SMALL)
        if last or large.isEmpty():
            break
        rest = large.select("path", "id").join(signatures.drop("n_shingles"), "id").mapInArrow(_grow, "path long, id long, signature binary").select("path", "id")
    pairs = found.where("kind = 0").select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    extra = confirm(pairs, docs)
    dense = cut(found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("id")).distinct())
    if not dense.isEmpty():
        sets = set_table(dense.select(F.col("id").alias("doc_id")).distinct(), docs)
        dense = dense.join(sets, "id").groupBy("key").agg(F.collect_list(F.struct("id", "shingles")).alias("members"))
        extra = extra.union(cut(dense.select("members").mapInArrow(confirm_groups, "a long, b long").distinct()))
    comps = components(links.union(extra))

    same = features.join(folded, ["d1", "d2"], "left").where("n_shingles > 0 AND doc_id IS NOT NULL")
    # one document may have several texts: its texts' sets are linked through it
    shared = same.where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    twice = features.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x != y")
    shared = cut(shared.join(twice, F.col("a") == F.col("doc_id"), "left_semi"))
    if not shared.isEmpty():
        comps = components(links.union(extra).union(shared))
    full = features.select("doc_id", "n_shingles", "d1", "d2").join(folded, ["d1", "d2"], "left")
    whole = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    full = full.withColumn("id", F.when(whole, F.col("id")).otherwise(F.col("doc_id"))).join(comps, "id", "left")
    component = F.coalesce("component", "id")
    return full.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents (all columns) without those that have a smaller doc_id in their group.

    Rows that repeat a kept doc_id stay one row; documents with a null doc_id stay.
    """
    gone = near_duplicates(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


#: DuckDB's statement of near_duplicates over documents.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, s.b FROM reach r JOIN steps s ON s.a = r.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""
