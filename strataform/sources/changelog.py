"""Reading and writing the change log: committed transactions only, rows checked."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.dates import decimal_time


def from_events(events: DataFrame) -> DataFrame:
    """(version, seq, path, date, attr): a user is a path, a day a version, 'error' a deletion (date 0)."""
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1
    return events.select(
        day.cast("long").alias("version"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"),
        F.when(F.col("event_type") == "error", F.lit(0)).otherwise(decimal_time(F.col("ts"))).cast("long").alias("date"), F.col("value").alias("attr"),
    )


def append(log: DataFrame, rows: DataFrame, folder: str, version: int) -> bool:
    """One transaction: records first, under a folder of this attempt's own, then the row that commits them and
    names the attempt. What a failed attempt left is never seen, and a version that is committed
    already is not written again. Nothing to write, no transaction."""
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    if rows.isEmpty() or version in committed_versions(spark, folder, version):
        return False
    rows.withColumns({"version": F.lit(version).cast("long"), "attempt": F.lit(attempt)}).write.mode("append").partitionBy("version", "attempt").parquet(f"{folder}/records")
    spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(True).alias("committed"), F.lit(attempt).alias("attempt")).write.mode("append").parquet(f"{folder}/commits")
    return True


def committed_versions(spark: SparkSession, folder: str, version: int) -> list[int]:
    """``version`` if the folder holds a commit of it, in a list."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return [r.version for r in spark.read.parquet(f"{folder}/commits").where((F.col("version") == version) & F.col("committed")).select("version").distinct().collect()]


def committed(records: DataFrame, commits: DataFrame) -> DataFrame:
    """Records up to the first version without a commit; a torn transaction hides what follows it. Where
    records name their attempt, only those of committed attempts count."""
    done = commits.where("committed").select("version").distinct()
    torn = records.select("version").distinct().join(done, "version", "left_anti").agg(F.min("version").alias("torn"))
    if "attempt" in records.columns:
        own = commits.where("committed").groupBy("version").agg(F.min("attempt").alias("attempt"))  # one row a version
        records = records.join(own, ["version", "attempt"], "left_semi")
    return records.join(F.broadcast(torn), F.col("torn").isNull() | (F.col("version") < F.col("torn"))).drop("torn")


def load(spark: SparkSession, folder: str) -> DataFrame:
    return committed(spark.read.parquet(f"{folder}/records"), spark.read.parquet(f"{folder}/commits")).drop("attempt")


def batch_commit(folder: str):
    """For a stream's micro-batches: batch n is version n + 1, and a replayed one changes nothing."""
    return lambda rows, batch: append(None, rows, folder, batch + 1)


def violations(name: Column, attr_size: Column, usize: Column) -> Column:
    """The limits a record breaks, as an array; empty where it is sound."""
    tests = {"name": F.octet_length(name) > 65535, "attr": attr_size > 65535, "fragment": usize > (1 << 31) - 1, "negative": usize < -1}
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())


def permissive(rows: DataFrame, broken: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their reasons): a bad record is set aside and reading goes on."""
    marked = rows.withColumn("reasons", broken)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)
