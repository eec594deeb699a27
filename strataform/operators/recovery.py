"""Finding what is left of a damaged collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def marker_offsets(rows: DataFrame, key: str, content: str, marker: str) -> DataFrame:
    """(key, n, offset): every non-overlapping occurrence of ``marker``, in characters from 0."""
    parts = rows.select(key, F.split(content, "\\Q" + marker + "\\E", -1).alias("p"))
    at = F.aggregate(
        F.slice("p", 1, F.size("p") - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x) + len(marker)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(x))).alias("out")),
        lambda a: a["out"],
    )
    return parts.where(F.size("p") > 1).select(key, F.posexplode(at).alias("n", "offset"))


def resync(blocks: DataFrame, by: str, order: str, ok: str, width: int = 1 << 16) -> DataFrame:
    """Status of each block: 'corrupted'; 'recovered' for the first good one after a bad one; else 'ok'.

    A group is parted by ``width`` numbers of ``order``; the block before a part's first is the last
    one of the part before, so no task holds a whole group.
    """
    rows = blocks.withColumn("_part", F.floor(F.col(order) / width))
    last = rows.groupBy(by, "_part").agg(F.max_by(ok, order).alias("_last"))
    last = last.withColumn("_last", F.lag("_last").over(Window.partitionBy(by).orderBy("_part")))
    inside = F.lag(ok).over(Window.partitionBy(by, "_part").orderBy(order))
    same = F.col(by).eqNullSafe(F.col("_by")) & F.col("_part").eqNullSafe(F.col("_p"))
    rows = rows.withColumn("_inside", inside).join(last.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), "_last"), same, "left")
    before = F.coalesce("_inside", "_last", F.lit(True))
    return rows.withColumn("status", F.when(~F.col(ok), "corrupted").when(~before, "recovered").otherwise("ok")).drop("_part", "_inside", "_by", "_p", "_last")


def report(status: DataFrame, by: str, size: str) -> DataFrame:
    good = F.col("status") != "corrupted"
    return status.groupBy(by).agg(
        F.count("*").alias("blocks"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(~good).alias("corrupted"),
        F.count_if(F.col("status") == "recovered").alias("recovered"), F.coalesce(F.sum(F.when(good, F.col(size))), F.lit(0)).cast("long").alias("bytes"),
    )
