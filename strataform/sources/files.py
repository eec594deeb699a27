"""Directory scans as DataFrames of (path, date, size, content), and synthetic corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.dates import decimal_time
from strataform.functions.numbers import float64

#: Classes of the synthetic corpus.
KINDS = ("TEXT", "SOURCE_CODE", "JSON", "CSV", "LOG", "DATABASE", "BINARY", "EXECUTABLE", "SCIENTIFIC", "REPETITIVE", "RANDOM", "MIXED")


def scan(spark: SparkSession, folder: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(folder).select("path", decimal_time(F.col("modificationTime")).alias("date"), F.col("length").alias("size"), "content")


def _record(kind: str, i: Column) -> Column:
    r = lambda k, m: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(m))
    text = lambda c: c.cast("string")
    word = lambda k: F.element_at(F.array(*[F.lit(w) for w in ("alpha", "river", "stone", "cloud", "ember", "field")]), (r(k, 6) + 1).cast("int"))
    noise = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(i, F.lit(90 + k))), 16, "0") for k in range(8)]))
    return {
        "TEXT": F.concat_ws(" ", *[word(k) for k in range(8)], F.lit("and so on.")),
        "SOURCE_CODE": F.concat(F.lit("if ("), word(1), F.lit(" == "), text(r(2, 100)), F.lit(") { return "), word(3), F.lit("(); }\n")),
        "JSON": F.to_json(F.struct(word(1).alias("user"), r(2, 10000).alias("id"), (r(3, 2) == 0).alias("active"), F.array(word(4), word(5)).alias("tags"))),
        "CSV": F.concat(F.concat_ws(",", *[text(r(k, 1000)) for k in range(8)]), F.lit("\n")),
        "LOG": F.concat(F.lit("2024-01-01T00:00:00 INFO "), word(1), F.lit(" item "), text(r(2, 1000)), F.lit("\n")),
        "DATABASE": F.concat(F.lit("R"), F.lpad(text(r(1, 10**9)), 31, "x"), F.repeat(F.lit("\0"), 32)),
        "BINARY": F.base64(noise),
        "EXECUTABLE": F.concat(F.lit("MZ"), F.base64(noise)),
        "SCIENTIFIC": F.concat(*[float64(F.sin((i * 8 + k) / 100.0)) for k in range(8)]),
        "REPETITIVE": F.repeat(F.lit("a"), 64),
        "RANDOM": F.base64(noise),
        "MIXED": F.concat(word(1), F.repeat(F.lit("\0"), 40), F.base64(noise)),
    }[kind].cast("binary") if kind != "RANDOM" else noise


def corpus(spark: SparkSession, records: int = 1000, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, seq, content): seeded records of each class, one row a record, made where they are read."""
    base = spark.range(records)
    out = [base.select(F.lit(k).alias("kind"), F.col("id").alias("seq"), _record(k, F.col("id")).alias("content")) for k in kinds]
    first = out[0]
    for o in out[1:]:
        first = first.unionByName(o)
    return first
