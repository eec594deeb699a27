"""Choosing how to compress: method per level and block type, block bounds, the dominant method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Block MiB of levels 0 to 9, and per level the type bounds (type < bound) of each method.
BLOCK_MIB = (0, 4, 8, 16, 16, 32, 64, 64, 128, 256)
BOUNDS = {
    0: ((None, "store"),),
    1: ((40, "store"), (80, "lz77-1"), (128, "lz77-2"), (256, "lz77-3"), (960, "lz77-4"), (None, "lz77-5")),
    2: ((32, "store"), (64, "lz77-3"), (None, "lz77-suffix")),
    3: ((20, "store"), (48, "lz77-3"), (640, "lz77-cm"), (None, "bwt")),
    4: ((12, "store"), (24, "lz77-3"), (48, "lz77-cm"), (900, "cm"), (None, "bwt")),
}


def choose_method(level: int, incompressible: Column, cls: Column | None = None) -> Column:
    """The method string of a level: incompressible content is stored; levels above 5 add the block size.
    The class is taken for callers' sake and changes nothing."""
    level = min(9, max(0, level))
    name = "0" if level == 0 else str(level) if level <= 5 else f"5{BLOCK_MIB[level]}"
    return F.when(incompressible, "0").otherwise(name) if level else F.lit("0")


def block_type(redundancy: Column, size: Column, text: Column, exe: Column) -> Column:
    """4 R + t with R = redundancy / (size / 256 + 1), at most 255; t: 1 for text, 2 for executables."""
    r = F.least(F.lit(255), F.floor(redundancy / (F.floor(size / 256) + 1)))
    return (4 * r + text.cast("int") + 2 * exe.cast("int")).cast("long")


def expand(level: int, kind: Column, text: Column) -> Column:
    """The model family for a level and block type, first bound that holds; text goes to BWT or gets a word model."""
    if level >= 5:
        return F.when(text, "cm-full+word").otherwise("cm-full")
    out = None
    for bound, name in BOUNDS[level]:
        if name == "lz77-cm" and level == 3:
            value = F.when(text, "bwt").otherwise(name)
        elif name == "cm":
            value = F.when(text, "cm+word").otherwise(name)
        else:
            value = F.lit(name)
        if bound is None:
            return value if out is None else out.otherwise(value)
        out = F.when(kind < bound, value) if out is None else out.when(kind < bound, value)
    return out


def fixed_blocks(files: DataFrame, size: str, block: int, path: str | None = None) -> DataFrame:
    """(.., part, offset, length) of fixed-size blocks, and with ``path`` each one's ``name``: <path>.part<N>; an empty file has none."""
    n = F.ceil(F.col(size) / block)
    out = files.where(F.col(size) > 0).withColumn("part", F.explode(F.sequence(F.lit(1), n.cast("int"))))
    out = out.withColumn("offset", ((F.col("part") - 1) * block).cast("long")).withColumn("length", F.least(F.lit(block), F.col(size) - F.col("offset")).cast("long"))
    return out.withColumn("name", F.concat(F.col(path), F.lit(".part"), F.col("part").cast("string"))) if path else out


def dominant(rows: DataFrame, by: str, method: str = "method") -> DataFrame:
    """The most frequent method of each group, the smallest string among equals."""
    n = rows.groupBy(by, method).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(method))).alias("m")).select(by, F.col(f"m.{method}").alias("method"), (-F.col("m.k")).alias("blocks"))


def throughput(bytes_in: Column, bytes_out: Column, seconds: Column) -> dict[str, Column]:
    """Ratio and MB/s, 0 where a denominator is."""
    return {
        "ratio": F.when(bytes_out > 0, bytes_in / bytes_out).otherwise(0.0),
        "mbps": F.when(seconds > 0, bytes_in / 1e6 / seconds).otherwise(0.0),
    }


def averages(runs: DataFrame) -> DataFrame:
    """Mean compression and decompression rates by level."""
    return runs.groupBy("level").agg(F.avg("comp_mbps").alias("comp_mbps"), F.avg("decomp_mbps").alias("decomp_mbps"), F.count("*").alias("n"))


#: Bytes of a model's component by its size and second argument, both log2 but for "mix", whose second is its inputs.
MEMORY = {
    "const": lambda n, m: 0,
    "cm": lambda n, m: 4 * 2**n,
    "icm": lambda n, m: 64 * 2**n + 1024,
    "match": lambda n, m: 4 * 2**n + 2**m,
    "avg": lambda n, m: 0,
    "mix2": lambda n, m: 2 * 2**n,
    "mix": lambda n, m: 4 * 2**n * m,
    "isse": lambda n, m: 64 * 2**n + 2048,
    "sse": lambda n, m: 128 * 2**n,
}


def model_memory(model: list[tuple], hh: int = 0, hm: int = 0, ph: int = 0, pm: int = 0, header: int = 0) -> int:
    """Bytes a model needs: its components (name, size[, second]), the word and byte arrays of the context
    program (hh, hm) and of the post-processor (ph, pm), by log2, and its header."""
    arrays = 4 * (2**hh + 2**ph) + 2**hm + 2**pm
    return arrays + header + sum(MEMORY[name](size, rest[0] if rest else 0) for name, size, *rest in model)
