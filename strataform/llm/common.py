"""What the operators of this subpackage share: reading, cut lineage, word memo, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes; ``bytes.split()`` splits at the same set.
WORD = r"[^\x20\x09-\x0D]+"
#: The key of a row's id and text, as ``marked`` adds it.
KEY = ["_id", "_none", "_mark"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """From now on Python workers get whole texts by so many rows at a time: the buffers of 10,000, Spark's own
    number, take hundreds of MB beside an executor's heap and in its workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as ``spark.checkpoint.dir`` names it. Where it is unset, a
    temporary one in local mode, and an error on a cluster, whose machines share no such folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strataform-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of a row's id and text: ``_id``, ``_none`` (no id) and ``_mark``, none of them null."""
    id_ = F.col("doc_id").cast("long")
    return docs.withColumns({"_id": F.coalesce(id_, F.lit(0)), "_none": id_.isNull(), "_mark": F.xxhash64("text")})


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and
    a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/strataform/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` when nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "_table_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


_CACHES: dict[str, Callable[[], None]] = {}


def sole(owner: str, clear: Callable[[], None]) -> None:
    """Says at a task's start which operator's memory this worker keeps; all others' is given up, to the system."""
    others = [x for x in _CACHES if x != owner]
    for other in others:
        _CACHES.pop(other)()
    _CACHES[owner] = clear
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc keeps what is freed otherwise
            ctypes.CDLL(None).malloc_trim(0)


class Memo(dict):
    """A dict that computes what it lacks and holds at most ``most`` entries, in two halves: when the newer is
    full the older is forgotten, but for what was asked for since."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.half, self.older = make, max(1, most // 2), {}

    def __missing__(self, key):
        out = self.older.pop(key, None)
        if out is None:
            out = self.make(key)
        if len(self) >= self.half:
            self.older = dict(self)
            super().clear()
        self[key] = out
        return out

    def clear(self) -> None:
        super().clear()
        self.older = {}


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest reachable node.

    Alternating large-star and small-star rounds: every round is two aggregations over the
    edges, the edge count never grows, and the loop ends when an edge set repeats. Each
    round is cut to a table, so lineage stays short.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e, "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.u", "p.v")
        new = cut(small.where("u <> v").distinct(), "edges")
        print_ = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(e)
        e, now = new, tuple(print_)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
