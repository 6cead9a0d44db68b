"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks, all in DataFrame functions.

1. Targets: weight times one common level, no source above LIMIT times its size; the level follows from one sorted
   pass over the sources (their number is that of distinct source names, a table of names and sums).
2. Blocks: the total is dealt to the sources in blocks of equal size by highest quotients target / (2 k - 1).
   Only quotients near the cut are ranked: a source's seats differ from target / block by at most half the number
   of sources times its share, so seats well below are given and seats well above are never listed.
3. Shards: each source is split into shards by a hash of doc_id, so a source that holds a third of all rows is
   many groups; its blocks go to its shards by the same rule, quotients of shard sizes.
4. Selection: a shard's documents lie end to end in the order of a seeded hash; its quota is read in whole laps and
   then one run of blocks from a seeded block on, around the end. A document is taken as often as it is passed, and
   at most two documents of a shard are cut. Nothing but (doc_id, source, size, hash) is shuffled. A shard is one task:
   it holds SHARD_WORDS words until a source has MOST_SHARDS of them, and grows with the source beyond (6.5 billion
   words), as the shards' own table is sorted for each source in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, n_words

WEIGHTS = (3, 1, 2)
SHARE_OF_ALL = 1.5
LIMIT = 2
SHARD_WORDS = 100_000
MOST_SHARDS = 65_536
SEED = "mix-1"


def _digits(h: Column, n: int) -> Column:
    """The number that the first n hexadecimal digits of h write."""
    return F.conv(F.substring(h, 1, n), 16, 10).cast("long")


def apportion(units: DataFrame, group: list[str], order: list[str], seats: str, votes: str) -> DataFrame:
    """units with `quota`: the Sainte-Laguë share of each unit's group's `seats`, ties by `order`."""
    by = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    u = units.withColumn("_t", F.sum(votes).over(by)).withColumn("_n", F.count("*").over(by))
    ideal = F.when(F.col("_t") > 0, F.col(votes) * F.col(seats) / F.col("_t")).otherwise(0.0)
    reach = F.when(F.col("_t") > 0, F.ceil(0.5 * F.col("_n") * F.col(votes) / F.col("_t"))).otherwise(0) + 2
    u = u.withColumn("_low", F.greatest(F.lit(0), F.floor(ideal) - reach)).withColumn("_high", F.floor(ideal) + reach + 1)
    u = u.withColumn("_left", F.col(seats) - F.sum("_low").over(by)).withColumn("_unit", F.struct(*order))
    tried = u.where(F.col(votes) > 0).withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    ranked = tried.withColumn("_r", F.row_number().over(by.orderBy(F.desc(F.col(votes) / (2 * F.col("_k") - 1)), "_unit", "_k")))
    won = ranked.where("_r <= _left").groupBy("_unit").agg(F.count("*").alias("_won"))
    out = u.join(won, u["_unit"].eqNullSafe(won["_unit"]), "left")
    return out.withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).select(*units.columns, "quota")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE_OF_ALL, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, source_rank, target): weights by code point order of the names, null last."""
    every, by_name = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("source_rank", F.row_number().over(by_name))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", limit * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    # sources in the order in which a rising level fills them; the level is the first that fits the total
    up = every.orderBy("full_at", "source_rank").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("filled", F.coalesce(F.sum("cap").over(up), F.lit(0))).withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    s = s.withColumn("level", (share * F.sum("source_size").over(every) - F.col("filled")) / F.col("w_left"))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every))
    target = F.least(F.col("cap").cast("double"), F.col("w") * F.col("level"))
    return s.select("source", "source_size", "source_rank", F.coalesce(target, F.lit(0.0)).alias("target"))


def _keys(seed: str) -> dict[str, Column]:
    """What tells a row of docs in the mix: the seeded hash of its doc_id (of its text without one), length and source."""
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("null/"), F.md5(F.coalesce("text", F.lit("")))))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return {"h": F.md5(F.concat(F.lit(seed + "/"), name)), "chars": F.coalesce(F.length("text"), F.lit(-1)), "source_known": F.col("source").isNotNull(), "source": source}


def _mixed(docs: DataFrame, weights, share: float, limit: int, seed: str) -> DataFrame:
    # the texts are read once: all else works on one short row for each document
    base = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text")).alias("size"), *[c.alias(k) for k, c in _keys(seed).items()]))
    sizes = base.groupBy("source_known", "source").agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("source_known"), F.col("source")))
    targets = source_targets(sizes, weights, share, limit)
    every = W.partitionBy(F.lit(0))
    whole = F.sum("target").over(every)
    targets = targets.withColumn("block", F.greatest(F.lit(16), F.least(F.lit(1024), F.floor(whole / (200 * F.count("*").over(every))))).cast("long"))
    targets = targets.withColumn("seats", F.round(whole / F.col("block")).cast("long"))
    targets = apportion(targets, [], ["source_rank"], "seats", "target")
    n_shards = F.least(F.lit(MOST_SHARDS), F.floor(F.col("source_size") / SHARD_WORDS) + 1).cast("long")
    targets = targets.select("source", "source_size", "source_rank", "target", "block", F.col("quota").alias("source_quota"), n_shards.alias("n_shards"))
    targets = cut(targets.withColumn("source_known", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit(""))))

    placed = base.join(targets, ["source_known", "source"]).withColumn("shard", _digits(F.col("h"), 8) % F.col("n_shards"))
    shards = placed.groupBy("source_rank", "shard").agg(F.sum("size").alias("length"), *[F.first(c).alias(c) for c in ("source_quota", "block")])
    shards = apportion(shards, ["source_rank"], ["source_rank", "shard"], "source_quota", "length")
    words = F.least(F.col("quota") * F.col("block"), limit * F.col("length"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("length") / F.col("block"))).cast("long")
    start = _digits(F.md5(F.concat_ws("/", F.lit(seed), "source_rank", "shard")), 8) % blocks * F.col("block")
    shards = shards.where("length > 0")
    shards = shards.select("source_rank", "shard", "length", F.floor(words / F.col("length")).alias("laps"), (words % F.col("length")).alias("rest"), start.alias("from"))
    shards = cut(shards)

    line = W.partitionBy("source_rank", "shard").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum("size").over(line)).join(shards, ["source_rank", "shard"], "left")
    begin, end, stop = F.col("end") - F.col("size"), F.col("end"), F.col("from") + F.col("rest")

    def covered(lo, hi):
        return F.greatest(F.lit(0), F.least(end, hi) - F.greatest(begin, lo))

    part = covered(F.col("from"), F.least(stop, F.col("length"))) + covered(F.lit(0), stop - F.col("length"))
    taken = F.coalesce(F.col("laps") * F.col("size") + part, F.lit(0)).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "h", "chars", "source_known", "source")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE_OF_ALL, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, text, source; more are ignored).

    A null text has size 0 and is never taken; a null source is a source of its own, the last; rows that repeat a
    doc_id are laid side by side; rows with a null doc_id are ordered by their texts. With no words at all every target
    is 0; an empty table gives an empty result.
    """
    return _mixed(docs, weights, share, limit, seed).select("doc_id", "size", "source_size", "target", "taken")


def take(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs (all columns), each as often as the mix takes it, rounded to whole documents.

    Documents without words weigh nothing and stay once, whatever the targets. Rows with a null doc_id are mixed as all
    others. Rows that share doc_id, source and length are taken equally often.
    """
    keys = _keys(seed)
    taken = _mixed(docs, WEIGHTS, SHARE_OF_ALL, LIMIT, seed).groupBy(*keys).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    taken = taken.select(*keys, copies.alias("copies")).where("copies > 0")
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()]).join(taken, list(keys))
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


#: DuckDB's statement of the same result.
ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5('mix-1/' || coalesce(doc_id::VARCHAR, 'null/' || md5(coalesce(text, '')))) AS h FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM sizes),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((source_rank - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM ranked),
filling AS (
  SELECT *, cap / w AS full_at,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM weighed),
levels AS (SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE - filled::DOUBLE) / w_left AS l FROM filling),
leveled AS (SELECT *, max(CASE WHEN l <= full_at THEN l END) OVER () AS level FROM levels),
targets AS (SELECT source, source_size, source_rank, least(cap::DOUBLE, w * level) AS target FROM leveled),
blocks AS (
  SELECT *, greatest(16, least(1024, floor(sum(target) OVER () / (200 * count(*) OVER ()))))::BIGINT AS block,
         sum(target) OVER () AS t, count(*) OVER () AS n FROM targets),
seats AS (SELECT *, round(t / block)::BIGINT AS seats FROM blocks),
reach AS (SELECT *, target * seats / t AS ideal, ceil(0.5 * n * target / t) + 2 AS reach FROM seats),
bounds AS (SELECT *, greatest(0, floor(ideal) - reach)::BIGINT AS low, (floor(ideal) + reach + 1)::BIGINT AS high FROM reach),
tried AS (SELECT *, unnest(range(low + 1, high + 1)) AS k, seats - (SELECT sum(low) FROM bounds) AS seats_left FROM bounds WHERE target > 0),
won AS (
  SELECT source_rank, count(*) AS won FROM (
    SELECT *, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source_rank, k) AS r FROM tried) WHERE r <= seats_left GROUP BY 1),
quotas AS (
  SELECT b.*, low + coalesce(won, 0) AS source_quota, least(65536, floor(source_size / 100000) + 1)::BIGINT AS n_shards
  FROM bounds b LEFT JOIN won USING (source_rank)),
placed AS (
  SELECT a.doc_id, a.size, a.h, q.*,
         (SELECT sum((strpos('0123456789abcdef', substr(a.h, i, 1)) - 1) * (16 ** (8 - i))::BIGINT) FROM range(1, 9) g(i))::BIGINT % n_shards AS shard
  FROM base a JOIN quotas q ON a.source IS NOT DISTINCT FROM q.source),
shards AS (
  SELECT source_rank, shard, sum(size)::BIGINT AS length, any_value(source_quota) AS source_quota, any_value(block) AS block
  FROM placed GROUP BY 1, 2),
sums AS (SELECT *, sum(length) OVER (PARTITION BY source_rank) AS st, count(*) OVER (PARTITION BY source_rank) AS sn FROM shards),
sbounds AS (
  SELECT *, CASE WHEN st > 0 THEN greatest(0, floor(length * source_quota / st) - ceil(0.5 * sn * length / st) - 2) ELSE 0 END::BIGINT AS low,
         CASE WHEN st > 0 THEN floor(length * source_quota / st) + ceil(0.5 * sn * length / st) + 3 ELSE 0 END::BIGINT AS high FROM sums),
stried AS (SELECT *, source_quota - sum(low) OVER (PARTITION BY source_rank) AS seats_left FROM sbounds),
swon AS (
  SELECT source_rank, shard, count(*) AS won FROM (
    SELECT *, row_number() OVER (PARTITION BY source_rank ORDER BY length / (2 * k - 1) DESC, shard, k) AS r
    FROM (SELECT *, unnest(range(low + 1, high + 1)) AS k FROM stried WHERE length > 0)) WHERE r <= seats_left GROUP BY 1, 2),
squotas AS (
  SELECT s.*, least((low + coalesce(won, 0)) * block, 2 * length)::BIGINT AS words,
         md5('mix-1/' || s.source_rank || '/' || s.shard) AS sh
  FROM sbounds s LEFT JOIN swon w ON s.source_rank = w.source_rank AND s.shard = w.shard WHERE length > 0),
runs AS (
  SELECT source_rank, shard, length, words // length AS laps, words % length AS rest,
         (SELECT sum((strpos('0123456789abcdef', substr(sh, i, 1)) - 1) * (16 ** (8 - i))::BIGINT) FROM range(1, 9) g(i))::BIGINT
           % greatest(1, ceil(length / block))::BIGINT * block AS start
  FROM squotas),
lined AS (
  SELECT *, sum(size) OVER (PARTITION BY source_rank, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM placed)
SELECT l.doc_id, l.size::BIGINT AS size, l.source_size::BIGINT AS source_size, l.target,
       coalesce(laps * l.size + greatest(0, least(stop, start + rest, length) - greatest(stop - l.size, start))
                + greatest(0, least(stop, start + rest - length) - (stop - l.size)), 0)::BIGINT AS taken
FROM lined l LEFT JOIN runs r ON l.source_rank = r.source_rank AND l.shard = r.shard
"""
