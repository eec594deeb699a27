"""Op 9: shards by histogram sort, DataFrame operations only.

The order key of a document is its text's 64-bit hash, then its id, then its number in the table of keys, so equal
texts are neighbours and no two rows share a key. The key is read in digits of 16 bits.
Wanted are the splitters between ``count * FINE`` ranges of equal bytes. A round counts exact
bytes and rows below all candidate boundaries (the next digit's values) over all partitions,
but only inside cells that hold a splitter; a cell within the tolerance gives its start as
the splitter, any other is probed by the next digit. So a group of copies of any size is
split by id, and what a round keeps is one row a splitter. With all splitters placed, one exchange by range
numbers the rows; a shard is ``FINE`` ranges in a row, and its ranges' row counts are summed ahead.

What is broadcast has a fixed size whatever the input: 65,536 first digits with the
splitters before and inside each, at most ``count * FINE`` splitters, and the ranges' offsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

BITS = 16
PARTS = ("h", "k", "r")
LEVELS = 4 * len(PARTS)
#: Ranges of a shard, each sorted by a task.
FINE = 64
DIGITS = [f"d{i}" for i in range(LEVELS)]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc and the three key columns. Null text: no bytes, as the empty one; null ids sort first."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"),
        F.xxhash64(raw).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"),
        F.monotonically_increasing_id().alias("r"),
    )


def digit(level: int) -> Column:
    """The level-th 16-bit digit of the key, most significant first, in the order of signed numbers."""
    out = F.shiftrightunsigned(F.col(PARTS[level // 4]), 48 - BITS * (level % 4)).bitwiseAND(F.lit((1 << BITS) - 1))
    return (out.bitwiseXOR(F.lit(1 << (BITS - 1))) if level % 4 == 0 else out).cast("int")


def part_of(digits: list[str]) -> Column:
    """A key column back from its four digits."""
    first = F.col(digits[0]).cast("long").bitwiseXOR(F.lit(1 << (BITS - 1)))
    return reduce(lambda a, d: F.shiftleft(a, BITS).bitwiseOR(F.col(d).cast("long")), digits[1:], first)


def splitters(rows: DataFrame, total: int, pieces: int, tolerance: int) -> DataFrame:
    """(d0, h, k, r, n): keys at which ranges begin, n of them at one key, from as many rounds as the tolerance asks for."""
    done, open_ = [], None
    for level in range(LEVELS):
        keys, name = DIGITS[:level], DIGITS[level]
        now = rows.withColumns({d: digit(i) for i, d in enumerate(DIGITS[: level + 1])})
        if level:
            now = now.join(F.broadcast(open_.select(*keys)), keys, "left_semi")
        counted = now.groupBy(*keys, name).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
        ahead = F.sum("bytes").over(Window.partitionBy(*keys).orderBy(name)) - F.col("bytes")  # of at most 65,536 cells
        cells = counted.withColumn("low", ahead)
        if level:
            cells = cells.join(F.broadcast(open_.select(*keys, F.col("low").alias("before"))), keys).withColumn("low", F.col("low") + F.col("before")).drop("before")
        up = lambda x: F.expr(f"({x}) * {pieces} div {total} + if(({x}) * {pieces} % {total} > 0, 1, 0)")
        # splitters wanted at bytes j * total / pieces within [low, low + bytes)
        cells = cells.withColumns({"first": F.greatest(F.lit(1), up("low")), "end": F.least(F.lit(pieces), up("low + bytes"))}).where("end > first")
        exact = (F.col("end") - F.col("first") == 1) & (F.col("first") * total == F.col("low") * pieces)
        further = (F.col("bytes") > tolerance) & (F.col("rows") > 1) & ~exact if level < LEVELS - 1 else F.lit(False)
        cells = cut(cells.withColumn("further", further), "cells")
        done.append(cells.where("not further").select(*keys, name, *[F.lit(0).alias(d) for d in DIGITS[level + 1 :]], (F.col("end") - F.col("first")).alias("n")))
        open_ = cells.where("further")
        if open_.isEmpty():
            break
    out = reduce(DataFrame.unionByName, done)
    return out.select("d0", *[part_of(DIGITS[4 * i : 4 * i + 4]).alias(p) for i, p in enumerate(PARTS)], "n")


def shards(docs: DataFrame, count: int = 40, tolerance: float = 1 / 512) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law ('bytes'), shard, slot.

    Sizes of shards differ from the mean by at most ``tolerance`` of a shard at either end, or one document.
    Slots are gapless in key order. Empty input gives no rows. Rows equal in text and id are
    told apart by their place in a table of keys, so a run of them is split like any other.
    Other columns of ``docs`` are not read.
    """
    rows = cut(keyed(docs), "keys")
    total = max(1, rows.agg(F.sum("size")).first()[0] or 0)
    found = cut(splitters(rows, total, count * FINE, max(1, int(tolerance * total / count))), "splitters")
    inside = found.groupBy("d0").agg(F.collect_list(F.struct(*PARTS, "n")).alias("inside"), F.sum("n").alias("n"))
    # of every first digit, the splitters before it and within it
    firsts = docs.sparkSession.range(1 << BITS).select(F.col("id").cast("int").alias("d0")).join(F.broadcast(inside), "d0", "left")
    before = F.coalesce(F.sum("n").over(Window.orderBy("d0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = cut(firsts.select("d0", before.alias("before"), "inside"), "firsts")
    met = F.aggregate(F.filter("inside", lambda s: F.struct(*[s[p] for p in PARTS]) <= F.struct(*PARTS)), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    ranged = rows.withColumn("d0", digit(0)).join(F.broadcast(firsts), "d0").withColumn("range", F.col("before") + F.coalesce(met, F.lit(0)))
    shard = F.floor(F.col("range") / FINE).cast("int")
    counted = cut(ranged.groupBy("range").agg(F.count("*").alias("n")), "ranges")  # at most count * FINE
    ahead = F.sum("n").over(Window.partitionBy(shard).orderBy("range")) - F.col("n")
    offset = counted.select("range", ahead.alias("ahead"))
    placed = ranged.select("doc_id", "size", "text_crc32", *PARTS, "range").withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(*PARTS)))
    out = placed.join(F.broadcast(offset), "range")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.alias("shard"),
        (F.col("ahead") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(read(spark, sf_dir, "documents"))
