"""Op 8: mixing sources to target weights by Sainte-Laguë apportionment, DataFrame operations only.

Tokens are the text's words. A source's documents are shuffled by a seeded hash into shards
of bounded rows; the shard's words, in seeded order, form blocks of ``block`` words. The
mix's blocks go to sources by highest quotients of their targets, a source's blocks to its
shards by highest quotients of the shards' sizes, so quotas are whole numbers. A shard with
quota q over n blocks takes every block ``q // n`` times and ``q % n`` consecutive blocks
from a seeded start once more. Nothing is collected, and no row is compared with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read

WEIGHTS = (5, 2, 1)
SHARD_ROWS = 5_000


def sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select("doc_id", "source", *keep, F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("_body"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(per_source: DataFrame, share: float, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, source_size): min(2 * size, level * weight).

    Sharing excess again and again by weight ends at one water level: in rising order of
    cap / weight, sources below the level are full and the rest split what remains. The
    windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    out = per_source.withColumn("rank", F.row_number().over(order) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    whole = Window.partitionBy(F.lit(1))
    out = out.withColumns({
        "full": F.coalesce(F.sum(2 * F.col("source_size")).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(whole),
    })
    level = (F.lit(share) * F.col("total") - F.col("full")) / F.col("rest")
    # the first source whose cap lies above the level stops the filling
    out = out.withColumn("level", F.min(F.when(2 * F.col("source_size") >= level * F.col("weight"), F.struct(F.col("full"), level.alias("level")))).over(whole)["level"])
    return out.withColumn("target", F.least(2.0 * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), F.lit(float("inf"))))).drop("full", "rest", "level")


def apportion(df: DataFrame, votes: str, seats: Column, group: list[str], key: list[str], most: Column | None = None) -> DataFrame:
    """Adds ``quota``: ``seats`` whole seats of each ``group`` shared among its rows by the
    highest quotients votes / (2 s + 1), ties by ``key``; with ``most``, none above it: what is above goes to the
    others in order of ``key``, as far as they have room.

    A row's seats differ between the divisors V / (M + n / 2) and V / (M - n / 2) by few, and
    the highest quotients all lie between, so only those are listed: at most about twice the rows.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    v = F.col(votes).cast("double")
    df = df.withColumn("_m", seats.cast("long")).withColumns({"_v": F.sum(v).over(g), "_n": F.count("*").over(g)})
    at = lambda m: F.when((m > 0) & (F.col("_v") > 0), F.floor(v * m / F.col("_v") + 0.5)).otherwise(0).cast("long")
    df = df.withColumn("_low", F.greatest(F.lit(0), at(F.col("_m") - F.col("_n") / 2 - 1))).withColumn("_high", at(F.col("_m") + F.col("_n") / 2 + 1))
    df = df.withColumn("_left", F.col("_m") - F.sum("_low").over(g))
    q = df.where("_high > _low").select(*group, *key, "_left", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_s"), F.col(votes).alias("_votes"))
    q = q.withColumn("_r", F.row_number().over((Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy((F.col("_votes") / (2 * F.col("_s") + 1)).desc(), *key, "_s")))
    won = q.where("_r <= _left").groupBy(*group, *key).agg(F.count("*").alias("_won"))
    names = [*group, *key]
    won = won.select(*[F.col(x).alias(f"_k_{x}") for x in names], "_won")
    joined = df.join(won, [F.col(x).eqNullSafe(F.col(f"_k_{x}")) for x in names], "left")
    quota = F.col("_low") + F.coalesce("_won", F.lit(0))
    joined = joined.withColumn("quota", quota)
    if most is not None:
        order = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
        joined = joined.withColumns({"_over": F.sum(F.greatest(F.lit(0), F.col("quota") - most)).over(g), "_room": F.greatest(F.lit(0), most - F.col("quota"))})
        more = F.greatest(F.lit(0), F.least(F.col("_room"), F.col("_over") - F.coalesce(F.sum("_room").over(order), F.lit(0))))
        joined = joined.withColumn("_more", more).withColumn("quota", F.least(F.col("quota"), most) + F.col("_more")).drop("_over", "_room", "_more")
    return joined.drop("_m", "_v", "_n", "_low", "_high", "_left", "_won", *[f"_k_{x}" for x in names])


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, block: int = 16, seed: int = 1, shard_rows: int = SHARD_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (words, repeats counted),
    and the columns of ``keep``.

    Null or empty texts have size 0 and take nothing; a null source is a source of its own,
    last in order; without rows there is no row. Rows repeated in full are separate rows.
    Seeded by md5 of the document's id and text, so reruns agree whatever the partitioning, and rows
    without an id or of one id are dealt over all shards.
    """
    rows = sizes(docs, keep)
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    per = targets(per, share, weights)
    per = apportion(per, "target", F.round(F.lit(share) * F.col("total") / block), [], ["rank"])
    per = per.select("source", "source_size", "target", F.col("quota").alias("source_quota"), F.greatest(F.lit(1), F.ceil(F.col("n_rows") / shard_rows)).alias("n_shards"))
    kept = per.select(F.col("source").alias("_source"), "source_size", "target", "source_quota", "n_shards")
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("_body")).cast("binary"))
    rows = rows.join(kept, F.col("source").eqNullSafe(F.col("_source"))).withColumn("mark", mark)
    rows = rows.withColumn("shard", F.pmod(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long"), F.col("n_shards")))
    shard = rows.groupBy("_source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shard = shard.withColumn("blocks", F.ceil(F.col("shard_size") / block))
    shard = apportion(shard, "shard_size", F.col("source_quota"), ["_source"], ["shard"], most=2 * F.col("blocks"))
    start = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("_source", F.lit("")), F.lit(":"), F.col("shard").cast("string")).cast("binary"))
    shard = shard.withColumn("start", F.when(F.col("blocks") > 0, F.pmod(F.conv(F.substring(start, 1, 8), 16, 10).cast("long"), F.col("blocks"))).otherwise(0))
    shard = shard.select(F.col("_source").alias("_s"), F.col("shard").alias("_h"), "shard_size", "blocks", "quota", "start")
    rows = rows.join(shard, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    run = Window.partitionBy("_source", "shard").orderBy("mark", "doc_id", "size")
    rows = rows.withColumn("to", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("to") - F.col("size"))
    more, first = F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0), F.col("start")
    upto = F.least(first + more, F.col("blocks"))
    inside = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("to"), hi * block) - F.greatest(F.col("from"), lo * block))
    taken = F.col("size") * F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0) + inside(first, upto) + inside(F.lit(0), first + more - upto)
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken.cast("long").alias("taken"), *keep)


def op8_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


#: The same rows in SQL. Quotients are listed in full there, which is fine at its size.
def oracle(share: float = 1.5, block: int = 16, seed: int = 1, shard_rows: int = SHARD_ROWS) -> str:
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(COALESCE(text, '')) AS body FROM documents),
s0 AS (SELECT source, SUM(size)::BIGINT AS source_size, COUNT(*) AS n_rows FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY (source IS NULL), source) - 1 AS rank, SUM(source_size) OVER ()::DOUBLE AS total FROM s0),
s2 AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s1),
fill AS (  -- share by weight; cap; share the excess again
  SELECT 0 AS round, list({{'rank': rank, 'w': weight, 'cap': 2.0 * source_size, 't': 0.0::DOUBLE}}) AS x, {share} * MAX(total) AS budget FROM s2
  UNION ALL
  SELECT round + 1, list_transform(x, lambda r: {{'rank': r.rank, 'w': r.w, 'cap': r.cap, 't': LEAST(r.cap, r.t + CASE WHEN r.t < r.cap THEN r.w * (budget - list_sum(list_transform(x, lambda z: z.t))) / GREATEST(1, list_sum(list_transform(x, lambda z: CASE WHEN z.t < z.cap THEN z.w ELSE 0 END))) ELSE 0 END)}}), budget
  FROM fill WHERE round < 100),
t AS (SELECT r.rank AS rank, r.t AS target FROM (SELECT unnest(x) AS r FROM fill WHERE round = 100)),
s3 AS (SELECT s2.*, t.target, CEIL(n_rows / {shard_rows}.0)::BIGINT AS n_shards, round({share} * total / {block})::BIGINT AS seats FROM s2 JOIN t USING (rank)),
sq AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS r, seats
       FROM s3, LATERAL (SELECT unnest(range(0, (target / {block} + 40)::BIGINT)) AS k)),
s4 AS (SELECT s3.*, COALESCE(n, 0) AS source_quota FROM s3 LEFT JOIN (SELECT rank, COUNT(*) AS n FROM sq WHERE r <= seats GROUP BY rank) USING (rank)),
r0 AS (SELECT d.*, s4.rank, source_size, target, source_quota, md5('{seed}:' || COALESCE(doc_id::VARCHAR, '') || ':' || body) AS mark, n_shards FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
r1 AS (SELECT *, ('0x' || mark[1:8])::BIGINT % n_shards AS shard FROM r0),
h0 AS (SELECT rank, source, shard, SUM(size)::BIGINT AS shard_size, MAX(source_quota) AS source_quota, CEIL(SUM(size) / {block}.0)::BIGINT AS blocks FROM r1 GROUP BY rank, source, shard),
hq AS (SELECT rank, shard, row_number() OVER (PARTITION BY rank ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) AS r, source_quota
       FROM h0, LATERAL (SELECT unnest(range(0, (2 * blocks + 40)::BIGINT)) AS k)),
hc AS (SELECT h0.*, LEAST(COALESCE(n, 0), 2 * blocks) AS q, SUM(GREATEST(0, COALESCE(n, 0) - 2 * blocks)) OVER (PARTITION BY h0.rank) AS over_, GREATEST(0, 2 * blocks - COALESCE(n, 0)) AS room
       FROM h0 LEFT JOIN (SELECT rank, shard, COUNT(*) AS n FROM hq WHERE r <= source_quota GROUP BY rank, shard) USING (rank, shard)),
h1 AS (SELECT rank, source, shard, shard_size, source_quota, blocks, q + GREATEST(0, LEAST(room, over_ - COALESCE(SUM(room) OVER (PARTITION BY rank ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota,
         CASE WHEN blocks > 0 THEN ('0x' || md5('{seed}:' || COALESCE(source, '') || ':' || shard)[1:8])::BIGINT % blocks ELSE 0 END AS start
       FROM hc),
r2 AS (SELECT r1.*, blocks, quota, start, SUM(size) OVER (PARTITION BY r1.rank, r1.shard ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
       FROM r1 JOIN h1 ON r1.rank = h1.rank AND r1.shard = h1.shard),
r3 AS (SELECT *, upto - size AS head, CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END AS more, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS times FROM r2)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * times + GREATEST(0, LEAST(upto, LEAST(start + more, blocks) * {block}) - GREATEST(head, start * {block}))
    + GREATEST(0, LEAST(upto, (start + more - LEAST(start + more, blocks)) * {block}) - head))::BIGINT AS taken
FROM r3"""
