"""Rebuilding files from ordered fragments; blocks, ranges, offsets, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def offsets(pointers: DataFrame, by: str, order: list[str], size: str = "usize") -> DataFrame:
    """Position and byte offset of each fragment in its file."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return pointers.withColumns({"pos": F.row_number().over(w).cast("long"), "offset": F.coalesce(before, F.lit(0)).cast("long")})


def runs(rows: DataFrame, by: str, number: str) -> DataFrame:
    """Consecutive numbers of a group as (by, first, last, n)."""
    w = Window.partitionBy(by).orderBy(number)
    return rows.withColumn("_g", F.col(number) - F.row_number().over(w)).groupBy(by, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_g")


def following(rows: DataFrame, at: str, width: int, name: str = "following") -> DataFrame:
    """Adds the next larger value of ``at``, null for the largest. Values are parted by ``width``; the
    first value of the next part that has any comes from a window over one row a part."""
    rows = rows.withColumn("_part", F.floor(F.col(at) / width))
    ordered = Window.partitionBy(F.floor(F.col("_part") / 1024)).orderBy("_part")
    first = rows.groupBy("_part").agg(F.min(at).alias("_first"))
    # parts of parts: one row for 1024 of them
    outer = first.groupBy(F.floor(F.col("_part") / 1024).alias("_outer")).agg(F.min("_first").alias("_of"))
    outer = outer.withColumn("_next_outer", F.lead("_of").over(Window.orderBy("_outer"))).select("_outer", "_next_outer")
    first = first.withColumn("_later", F.lead("_first").over(ordered)).join(outer, F.floor(F.col("_part") / 1024) == F.col("_outer"))
    first = first.select("_part", F.coalesce("_later", "_next_outer").alias("_later"))
    inside = F.lead(at).over(Window.partitionBy("_part").orderBy(at))
    return rows.withColumn("_inside", inside).join(first, "_part").withColumn(name, F.coalesce("_inside", "_later")).drop("_part", "_inside", "_later")


def range_join(points: DataFrame, blocks: DataFrame, point: str, start: str, width: int) -> DataFrame:
    """Each point with the block that holds it: from ``start`` to before the next start, the last one without end.

    An equi join on bins: a block goes to every bin it meets of the level at which these are at
    most about a thousand (bins of a level are 1024 times as wide as the one's below), a point to its own bin of
    every level there is, and the range is tested within the bin. Nothing is broadcast that grows.
    """
    spans = following(blocks, start, 1024 * width, "_end")
    last = spans.where("_end is null").drop("_end")  # one row
    spans = spans.where("_end is not null")
    levels = 6
    size = lambda n: F.lit(width) * F.pow(F.lit(1024.0), n).cast("long")
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("_end") - F.col(start)) / F.lit(float(width))) / 10 - 1)).cast("int")
    spans = spans.withColumn("_level", F.least(F.lit(levels - 1), level))
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / size(F.col("_level"))), F.floor((F.col("_end") - 1) / size(F.col("_level"))))))
    used = F.broadcast(spans.select("_level").distinct())  # six rows at most
    own = points.join(used).withColumn("_bin", F.floor(F.col(point) / size(F.col("_level"))))
    met = own.join(spans, ["_level", "_bin"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col("_end"))).drop("_level", "_bin", "_end")
    rest = points.join(F.broadcast(last), points[point] >= last[start])
    return met.unionByName(rest.select(*met.columns))


def block_sizes(blocks: DataFrame) -> DataFrame:
    """(block_id, frags, bsize): a block's bytes with 8, and 4 a fragment, for its tables."""
    return blocks.groupBy("block_id").agg(F.count("*").alias("frags"), (8 + F.sum(F.col("usize") + 4)).cast("long").alias("bsize"))


def reassembled(fragments: DataFrame, by: str = "doc_id", sep: str = "\n") -> DataFrame:
    """Files rebuilt from (by, line, body)."""
    parts = F.sort_array(F.collect_list(F.struct("line", "body")))
    return fragments.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["body"]), sep).alias("rebuilt"), F.count("*").alias("n_lines"))


def zero_runs(rows: DataFrame, content: str) -> DataFrame:
    """Flags content that is all zero bytes, which a sparse writer skips."""
    return rows.withColumn("sparse", (F.octet_length(content) > 0) & F.hex(content).rlike("^0+$"))


def verified(stored: DataFrame, recorded: DataFrame, key: str, content: str) -> DataFrame:
    """Stored rows with ``ok``: whether the content's SHA-1 is the one on record (key, was); false without a record."""
    now = F.sha1(F.col(content).cast("binary"))
    return stored.join(recorded.select(key, "was"), key, "left").withColumn("ok", F.coalesce(now == F.col("was"), F.lit(False))).drop("was")
