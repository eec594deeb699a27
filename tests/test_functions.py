import random
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strataform.functions import checksums, dates, numbers, text


def test_until():
    assert dates.until("12") == ("version", 12) and dates.until("-2") == ("version", -2)
    assert dates.until("20240229") == ("date", 20240229235959)
    assert dates.until("2024-2-9 7:30") == ("date", 20240209073059)
    with pytest.raises(ValueError):
        dates.until("soon")


def test_decimal_time_round_trips(spark):
    days = [datetime(1970, 1, 1), datetime(2000, 2, 29, 23, 59, 59), datetime(2100, 3, 1), datetime(2024, 12, 31, 1, 2, 3)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "ts timestamp").withColumn("d", dates.decimal_time(F.col("ts")))
    for r in df.withColumn("u", dates.unix_time(F.col("d"))).withColumn("w", F.unix_timestamp("ts")).collect():
        assert r.u == (-1 if r.ts is None else r.w)


@pytest.mark.parametrize("glob,path,want", [("a", "a/b", True), ("a", "ab", False), ("a*c", "a/b/c", True), ("a?c", "a/c", True), ("a/", "a/b", True), ("a/", "a", False), ("*.txt", "x/y.txt", True), ("a.b", "axb", False)])
def test_globs(spark, glob, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(text.matches_glob(F.col("p"), glob)).first()[0] is want


def test_names_and_numbers(spark):
    assert text.parse_size("3K") == 3072 and text.parse_level("ng7") == 7 and text.parse_level("auto") == 1 and text.archive_name("a/b") == "a/b.strata"
    df = spark.createDataFrame([(5, "x/y.Tar.GZipped", "a\\b")], "n long, p string, q string")
    row = df.select(
        text.padded(F.col("n"), 3), text.extension_key(F.col("p")), text.normalise_separators(F.col("q")), numbers.bit_length(F.col("n")), numbers.ones(F.col("n")),
        numbers.little_endian(F.lit(bytearray(b"\x01\x02\x00")), 0, 3), numbers.to_little_endian(F.lit(513), 2), numbers.context_hash(F.col("n"), F.col("n")), numbers.squash(F.lit(0)), numbers.stretch(F.lit(2048)),
        text.append_path("out/", F.lit("/a")),
    ).first()
    assert list(row) == ["005", "gzipp", "a/b", 3, 2, 513, b"\x01\x02", 522 * 773, 2048, 0, "out/a"]


def test_checksums(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (None,)], "b binary")
    got = [tuple(r) for r in df.select(checksums.crc32(F.col("b")), checksums.crc32c(F.col("b"))).collect()]
    assert got == [(zlib.crc32(b"123456789"), 0xE3069283), (0, 0), (None, None)]
    r = random.Random(3)
    many = [bytes(r.choices(range(256), k=k)) for k in (0, 1, 2, 3, 4, 5, 255, 256, 257, 511, 513, 5000, 70_000)]
    assert checksums.crc32c_many(many) == [checksums.crc32c_short(x) for x in many] and checksums.crc32c_many([]) == []


def test_float64(spark):
    import struct

    xs = [0.0, 1.0, -1.0, 0.1, -2.5e-7, 1e300, 3.141592653589793, 2.0**-1000, 0.9999999999999999, -(2.0**52)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [bytes(r[0]) for r in df.select(numbers.float64(F.col("x"))).collect()] == [struct.pack("<d", x) for x in xs]
