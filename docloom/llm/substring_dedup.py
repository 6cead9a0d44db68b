"""Repeated passages: MinHash banding of paragraphs, exact Jaccard, components, one occurrence kept.

A paragraph is a line or sentence together with short sentences before it, cut only by what stands nearby, so a passage
has the same paragraphs wherever it is put. Stretches of over LONG words without a stop are cut where a word's hash is
the least among NEAR words before and after it: about every 9 words, and in two copies of a passage at the same words
from the fifth to the fifth last. A paragraph of under five words is one shingle and meets its exact copies only.
Paragraphs fold by content first. Distinct ones meet by BANDS bands of one minwise 5-word shingle: at similarity 0.75
a pair shares a band with probability 1 - 0.25^3 = 0.98, at 0.9 with 0.999. Every member of a band is first compared
with the two ends of its band. What is then left between components is compared in full: in one piece if a band is
small or all but SMALL of it are one component; a larger band branches by CHILDREN further pairs of minwise shingles,
where a pair at 0.75 stays together with 1 - (1 - 0.75^2)^6 = 0.993 and one at 0.3 with 0.43, and what is large after
that is compared block against block. Where most members of a block agree, the block is confirmed as one group.
What passes exact Jaccard 0.75 is linked; a component that occurs in several documents keeps its first occurrence, and
runs of repeated paragraphs of LEAST_RUN words or more are reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import OF, SHARE, SHINGLE, IdFilter, U, _LANES, components, confirm_groups, counted, cut, dense_rows, mix, short_batches, slices, slim, text_bytes, word_hashes

BANDS = 3
SHORT, LONG, NEAR = 8, 40, 4
LEAST_RUN = 16
#: Members of a band that are compared at once; branching of larger ones.
SMALL, CHILDREN, ROUNDS, COORDINATES = 256, 6, 1, 64
_A = np.random.Generator(np.random.PCG64(23)).integers(1, 2**63, BANDS, dtype=np.uint64) | U(1)
_B = np.random.Generator(np.random.PCG64(29)).integers(1, 2**63, COORDINATES, dtype=np.uint64) | U(1)
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
_NONE = U(2**64 - 1)


def paragraphs(texts: list[bytes]):
    """For some texts: (word hashes, byte starts, byte ends, paragraph starts and ends as word places, owners)."""
    words, at, starts, ends = word_hashes(texts)
    n = len(words)
    if n == 0:
        z = np.zeros(0, np.int64)
        return words, starts, ends, z, z, z
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.zeros(n, dtype=bool)  # the last word of its text
    last[at[1:][at[1:] > at[:-1]] - 1] = True
    newline = np.append(lines[starts[1:]] > lines[ends[:-1]], True) | last
    stop = _STOP[data[ends - 1]] | newline
    # a short sentence goes with what follows it, within its line's text
    bounds = np.flatnonzero(stop)
    size = np.diff(bounds, prepend=-1)
    keep = (size >= SHORT) | last[bounds]
    flag = np.zeros(n, dtype=bool)
    flag[bounds[keep]] = True
    for rule in (0, 1):  # long ones: where a word's hash is the least of those around it, and what is still long by number
        bounds = np.flatnonzero(flag)
        size = np.diff(bounds, prepend=-1)
        length = np.repeat(size, size)
        place = np.arange(n) - np.repeat(np.concatenate([[0], bounds[:-1] + 1]), size)
        if rule == 0:
            least = (length > LONG) & (place >= NEAR) & (length - place > NEAR + 1)  # what is compared stands in one stretch
            for d in range(1, min(NEAR, n - 1) + 1):
                least[d:] &= words[d:] < words[:-d]
                least[:-d] &= words[:-d] <= words[d:]
            flag |= least
        else:
            flag |= (length > LONG) & (place % LONG == LONG - 1)
    to = np.flatnonzero(flag) + 1
    start = np.concatenate([[0], to[:-1]])
    return words, starts, ends, start, to, np.searchsorted(at, start, side="right") - 1


def contents(words: np.ndarray, start: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A hash of each paragraph's words in order."""
    size = to - start
    power = np.cumprod(np.full(int(size.max()), U(0x9E3779B97F4A7C15), dtype=np.uint64))
    place = np.arange(len(words)) - np.repeat(start, size)
    return mix(np.add.reduceat(words * power[place], start) + size.astype(np.uint64))


def shingles(words: np.ndarray, start: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the 5-word window at each word, whether it lies within one paragraph)."""
    n = len(words)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        total[: n - k] += words[k:] * _LANES[k]
    size = to - start
    return mix(total), np.repeat(to, size) - np.arange(n) >= SHINGLE


def _keys(batches):
    """doc_id, content and bands of every paragraph."""
    for batch in batches:
        texts, ids = text_bytes(batch.column("text")), batch.column("doc_id").to_numpy()
        for i, j in slices(texts):
            words, _, _, start, to, owner = paragraphs(texts[i:j])
            if not len(start):
                continue
            hashes, within = shingles(words, start, to)
            bands = [np.minimum.reduceat(np.where(within, mix(hashes * a) >> U(2), _NONE), start).view(np.int64) for a in _A]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[i:j][owner]), pa.array(contents(words, start, to).view(np.int64)), *map(pa.array, bands)], names=["doc_id", "pid", *(f"k{b}" for b in range(BANDS))]
            )


def _meeting(wanted: IdFilter):
    """(path, pid) of the band keys that may be another paragraph's, too."""

    def run(batches):
        for batch in batches:
            pid = batch.column(0).to_numpy()
            paths = [band_path(batch.column(1 + b).to_numpy().view(np.uint64), b) for b in range(BANDS)]
            keep = [wanted(p) for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p, k in zip(paths, keep, strict=True)])), pa.array(np.concatenate([pid[k] for k in keep]))], names=["path", "pid"])

    return run


def band_path(key: np.ndarray, band: int) -> np.ndarray:
    return mix(key ^ U((band + 1) * 0x9E3779B97F4A7C1)).view(np.int64)


def _paths(batches):
    """One row for each band of each paragraph."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([band_path(batch.column(b).to_numpy().view(np.uint64), b) for b in range(BANDS)]))], names=["path"])


def _places(involved: IdFilter, near: IdFilter):
    """Place and length of every paragraph that may be involved; shingle sets of those that may have near ones."""

    def run(batches):
        for batch in batches:
            texts, ids = text_bytes(batch.column("text")), batch.column("doc_id").to_numpy()
            for i, j in slices(texts):
                words, _, _, start, to, owner = paragraphs(texts[i:j])
                if not len(start):
                    continue
                index = np.arange(len(start)) - np.searchsorted(owner, owner, side="left")
                pid = contents(words, start, to).view(np.int64)
                keep = np.flatnonzero(involved(pid))
                asked = near(pid[keep])
                hashes, within = shingles(words, start, to)
                sets, seen = [], set()
                for k, ask in zip(keep, asked, strict=True):
                    if not ask or pid[k] in seen:
                        sets.append(None)
                        continue
                    seen.add(pid[k])
                    part = slice(start[k], to[k])
                    sets.append(np.unique(hashes[part][within[part]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j][owner[keep]]), pa.array(pid[keep]), pa.array(index[keep]), pa.array((to - start)[keep]), pa.array(sets, pa.list_(pa.int64()))],
                    names=["doc_id", "pid", "paragraph", "n_words", "shingles"],
                )

    return run


def _branch(batches):
    """Children of a large node: CHILDREN pairs of coordinates drawn from its path, and the minwise shingles found there."""
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            paths = part.column("path").to_numpy().view(np.uint64)
            lists = part.column("shingles")
            flat = lists.flatten().to_numpy().view(np.uint64)
            size = pc.list_value_length(lists).to_numpy()
            at = np.cumsum(size) - size
            draw = mix(paths ^ U(0x5851F42D4C957F2D))
            step = U(1) + U(2) * ((draw >> U(16)) % U(COORDINATES // 2))  # odd: the coordinates of a node differ
            children = []
            for k in range(CHILDREN):
                child = paths
                for j in (2 * k, 2 * k + 1):
                    c = (draw + U(j) * step) % U(COORDINATES)
                    least = np.minimum.reduceat(mix(flat * np.repeat(_B[c.view(np.int64)], size)), at)
                    child = mix(child * U(0x2545F4914F6CDD1D) + mix(least + c))
                children.append(child)
            who = pa.array(np.tile(np.arange(part.num_rows), CHILDREN))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(children).view(np.int64)), part.column("pid").take(who)], names=["path", "pid"])


def _sketch(batches):
    """Size of each set, and 128 bits of which each of its shingles sets one."""
    for batch in batches:
        lists = batch.column("shingles")
        flat, size = mix(lists.flatten().to_numpy().view(np.uint64)), pc.list_value_length(lists).to_numpy().astype(np.int64)
        at, bit = np.cumsum(size) - size, U(1) << (flat & U(63))
        high = flat >> U(63) == U(1)
        b1, b2 = (np.bitwise_or.reduceat(np.where(part, bit, U(0)), at).view(np.int64) if len(at) else at for part in (high, ~high))
        yield pa.RecordBatch.from_arrays([batch.column("pid"), *map(pa.array, (size, b1, b2))], names=["pid", "n", "b1", "b2"])


def _compare(batches):
    """Pairs (kind 0) of members of different components (and blocks, where given) of each group that may be linked, or the
    members of a dense group (kind 1: key, pid).

    Each bit that differs is a shingle in one set alone, of which sets at SHARE / OF have (OF - SHARE) / (OF + SHARE) of both sizes at most.
    """
    for batch in batches:
        lists = batch.column("members")
        flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        pid, comp, block, size = (flat.field(i).to_numpy() for i in range(4))
        b1, b2 = (flat.field(i).to_numpy().view(np.uint64) for i in (4, 5))
        at, none = np.cumsum(n) - n, np.zeros((0, 2), np.int64)
        pairs, dense = [none], [none]
        for k in np.unique(n):
            x, y = np.triu_indices(k, 1)
            groups = at[n == k]
            for g in range(0, len(groups), step := max(1, (1 << 18) // max(1, len(x)))):
                part = groups[g : g + step, None]
                i, j = ((part + z).ravel() for z in (x, y))
                alone = np.bitwise_count(b1[i] ^ b1[j]).astype(np.int64) + np.bitwise_count(b2[i] ^ b2[j])
                near = (OF + SHARE) * alone <= (OF - SHARE) * (size[i] + size[j])
                near &= (comp[i] != comp[j]) & ((block[i] < 0) | (block[i] != block[j]))
                many = near.reshape(len(part), -1).sum(axis=1) > 2 * k  # of a dense group its members go on, not its pairs
                few = near & np.repeat(~many, len(x))
                pairs.append(np.stack([pid[i[few]], pid[j[few]]], axis=1))
                for r in np.flatnonzero(many):
                    own = slice(r * len(x), (r + 1) * len(x))
                    both = np.unique(np.concatenate([i[own][near[own]], j[own][near[own]]]))
                    dense.append(dense_rows(pid[both], size[both]))
        pairs, dense = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0), np.concatenate(dense)
        kind, rows = np.repeat([0, 1], [len(pairs), len(dense)]), np.concatenate([pairs, dense])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["kind", "a", "b"])


def confirm(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Those of n pairs (a, b) that are linked, by their full sets."""
    both = F.size(F.array_intersect("s", "t"))
    links = pairs.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b")
    return slim(links.where(OF * both >= SHARE * (F.size("s") + F.size("t") - both)).select("a", "b"), n)


def links_between(rest: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): links within bands (path, pid) between components of `links`."""
    comps = cut(components(links, most_rounds=2))  # parts of components do: they only save comparisons
    sketch = cut(sets.mapInArrow(_sketch, "pid long, n long, b1 long, b2 long"))
    sketch = sketch.join(comps.toDF("pid", "component"), "pid", "left").withColumn("component", F.coalesce("component", "pid"))
    n_found, found, n_all = 0, None, F.col("n_in") + F.col("n_out")
    for round_ in range(ROUNDS + 1):
        rest = cut(rest.join(sketch, "pid"))
        counts = rest.groupBy("path", "component").agg(F.count("*").alias("m"))
        counts = counts.groupBy("path").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("m"))
        counts = counts.select("path", F.col("top.component").alias("main"), F.col("top.m").alias("n_in"), (F.col("m") - F.col("top.m")).alias("n_out"))
        counts = cut(counts.where("n_out > 0"))
        last = round_ == ROUNDS
        now = rest.join(counts if last else counts.where(F.col("n_out") <= SMALL), "path")
        # blocks of those outside the main component against all blocks; within the main component nothing is open
        outer, inner = F.ceil(F.col("n_out") / SMALL).cast("long"), F.ceil(F.col("n_in") / SMALL).cast("long")
        out = F.col("component") != F.col("main")
        block = F.when(n_all <= SMALL, 0).when(out, F.pmod(F.xxhash64("pid"), outer)).otherwise(outer + F.pmod(F.xxhash64("pid"), inner))
        most = F.when(n_all <= SMALL, 0).when(out, outer + inner - 1).otherwise(outer - 1)
        dealt = now.withColumn("block", block.cast("long")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))))
        x, y = F.least("block", "other"), F.greatest("block", "other")
        mark = F.when(x == y, F.lit(-1).cast("long")).otherwise(F.col("block"))
        dealt = dealt.select("path", x.alias("x"), y.alias("y"), F.struct("pid", "component", mark.alias("block"), "n", "b1", "b2").alias("m"))
        groups = dealt.groupBy("path", "x", "y").agg(F.collect_list("m").alias("members")).select("members")
        pairs, n = counted(groups.mapInArrow(_compare, "kind long, a long, b long").distinct())
        n_found += n
        found = pairs if found is None else found.union(pairs)
        wide = counts.where(F.col("n_out") > SMALL)
        if last or wide.isEmpty():
            break
        large = rest.select("path", "pid").join(wide.select("path"), "path").join(sets, "pid")
        rest = cut(large.mapInArrow(_branch, "path long, pid long"))
    dense = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("pid")).distinct().join(sets, "pid")
    dense = dense.groupBy("key").agg(F.collect_list(F.struct(F.col("pid").alias("id"), "shingles")).alias("members")).select("members")
    dense = dense.mapInArrow(confirm_groups, "a long, b long").distinct()
    return cut(confirm(found.where("kind = 0").select("a", "b").distinct(), sets, n_found).union(slim(dense, n_found)))


def repeated_passages(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """(doc_id, paragraph, n_words, pid, component, kept_doc_id, removed, run_words): every repeated paragraph.

    docs: (doc_id, text); more columns are ignored. Only paragraphs whose component occurs in two or more documents and
    that stand in a run of least_run such words are listed, the kept occurrence (the smallest doc_id, then place)
    with removed = false. Null and empty texts have no paragraphs; rows with a null doc_id take no part; rows that
    repeat a doc_id are one document. An empty table gives an empty result.
    """
    docs = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    keys = [f"k{b}" for b in range(BANDS)]
    units = docs.mapInArrow(_keys, "doc_id long, pid long, " + ", ".join(f"{k} long" for k in keys))
    folded = units.groupBy("pid").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), *[F.min(k).alias(k) for k in keys])
    folded = cut(folded.select("pid", F.expr("lo < hi").alias("again"), *keys))
    # most bands have one paragraph: keys are counted first, and only rows of shared ones go on to meet
    lone = folded.where("k0 >= 0")
    shared = cut(lone.select(*keys).mapInArrow(_paths, "path long").groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path"))
    rows = cut(lone.select("pid", *keys).mapInArrow(_meeting(IdFilter(shared)), "path long, pid long").join(shared, "path"))
    ends = rows.groupBy("path").agg(F.min("pid").alias("x"), F.max("pid").alias("y"), (F.count("*") > 3).alias("wide"))
    banded = cut(rows.join(ends, "path"))
    met = banded.select("pid", F.explode(F.array("x", "y")).alias("hub")).where("pid != hub")
    near, n_near = counted(met.select(F.least("pid", "hub").alias("a"), F.greatest("pid", "hub").alias("b")).distinct())

    asked = slim(near.select(F.col("a").alias("pid")).union(near.select("b")).distinct(), n_near)
    involved = cut(asked.union(folded.where("again").select("pid")).distinct())
    places = docs.mapInArrow(_places(IdFilter(involved), IdFilter(asked)), "doc_id long, pid long, paragraph long, n_words long, shingles array<long>")
    places = cut(places.join(involved, "pid"))
    # the filter lets a few paragraphs through that are too short for a shingle
    sets = cut(places.where("size(shingles) > 0").select("pid", "shingles").dropDuplicates(["pid"]))
    places = places.drop("shingles").distinct()
    links = cut(confirm(near, sets, n_near))

    wide = banded.where("wide").select("path", "pid")  # up to three, the ends have met all
    comps = components(links.union(links_between(wide, sets, links)))
    places = places.join(comps.toDF("pid", "component"), "pid", "left").withColumn("component", F.coalesce("component", "pid"))
    first = F.min(F.struct("doc_id", "paragraph")).alias("first")
    groups = places.groupBy("component").agg(first, F.max("doc_id").alias("last")).where("first.doc_id < last")
    found = places.join(groups.select("component", "first"), "component")
    by = W.partitionBy("doc_id").orderBy("paragraph", "pid")
    fresh = F.coalesce((F.col("paragraph") > F.lag("paragraph").over(by) + 1).cast("int"), F.lit(1))
    found = found.withColumn("run", F.sum(fresh).over(by))
    found = found.withColumn("run_words", F.sum("n_words").over(W.partitionBy("doc_id", "run"))).where(F.col("run_words") >= least_run)
    removed = F.struct("doc_id", "paragraph") != F.col("first")
    return found.select("doc_id", "paragraph", "n_words", "pid", "component", F.col("first.doc_id").alias("kept_doc_id"), removed.alias("removed"), "run_words")


def remove_passages(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """docs (all columns) with later occurrences taken out of text; documents of which nothing is left go.

    White space before a removed paragraph goes with it; all other text stays as it is. A column n_chars follows the text.
    Rows with a null doc_id or a null text stay as they are.
    """
    gone = repeated_passages(docs, least_run).where("removed").groupBy("doc_id").agg(F.collect_set(F.struct("paragraph", "pid")).alias("gone"))

    @F.pandas_udf("string")
    def rest(text, gone):
        import pandas as pd

        out = []
        for t, g in zip(text, gone, strict=True):
            if g is None or t is None or not len(g):
                out.append(t)
                continue
            raw = t.encode()
            words, starts, ends, start, to, _ = paragraphs([raw])
            pid = contents(words, start, to).view(np.int64)
            drop = {(x["paragraph"], x["pid"]) for x in g}
            kept, at = [], 0
            for k in range(len(start)):
                end = int(ends[to[k] - 1]) if k + 1 < len(start) else len(raw)
                if (k, int(pid[k])) not in drop:
                    kept.append(raw[at:end])
                at = end
            out.append(b"".join(kept).decode().lstrip(" \t\r\n\x0b\x0c") if len(kept) < len(start) else t)
        return pd.Series(out)

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = rows.join(gone, "doc_id", "left").select("row", "gone", rest("text", "gone").alias("new"))
    both = both.where(F.col("gone").isNull() | (F.length(F.trim("new")) > 0))
    columns = {"text": F.col("new")} | ({"n_chars": F.length("new").cast("long")} if "n_chars" in docs.columns else {})
    return both.select(*[columns.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
