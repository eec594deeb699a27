"""Op 5: embedding near-duplicates by sorted projection passes.

Equal vectors are one class. Every pass hashes each class by the signs of random projections
of what it differs from the mean direction, concatenated to a bit string, orders the classes
lexicographically by it, cuts the order into ranges that also hold the ``window`` classes
before them, and compares each class with those before it within the window, in double
precision. A range keeps only links that connect what it had not connected yet, and the
links of all passes are united, so no step lists the pairs of a dense group.

Numbers of links are then counted inside the components: members of a component are compared
with one another in full, a block of ``BLOCK`` with a block at a time, and only sums leave a
task. So a group of any size has its whole degrees, at the cost of comparing its pairs once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, cut, drop, read

BITS = 62
RANGE_ROWS = 4096
BLOCK = 2048


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vec_id, key) of all rows, key null where a vector links with nothing, and one
    (cls, key, n, least, v) per distinct vector as stored: a number of its own, its rows and their smallest vec_id."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    good = F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm > 0) & (norm < float("inf"))
    zero = F.transform(F.col(embedding), lambda x: x + F.lit(0.0).cast("float"))  # -0.0 as 0.0
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), zero).alias("v"))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json("v"), 256)))
    cls = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    # the number is fixed once the table is written
    return cut(rows.select("vec_id", "key"), "vectors"), cut(cls.select(F.monotonically_increasing_id().alias("cls"), "*"), "classes")


def directions(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, BITS))


def by_dim(v: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors in double precision of each length of vectors."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    if isinstance(v, pa.ChunkedArray):
        v = pa.concat_arrays(v.chunks) if v.num_chunks else pa.array([], v.type)
    start = v.offsets.to_numpy()
    flat, size = v.values.to_numpy(zero_copy_only=False), np.diff(start)
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        x = flat[start[rows][:, None] + np.arange(dim)].astype(np.float64)
        yield rows, x / np.sqrt((x * x).sum(1))[:, None]


def means(cls: DataFrame) -> dict[int, np.ndarray]:
    """The mean direction of each length of vectors; from one partial sum a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, tuple] = {}
        for batch in batches:
            for _, x in by_dim(batch.column(0)):
                n, total = got.get(x.shape[1], (0, 0.0))
                got[x.shape[1]] = (n + len(x), total + x.sum(0))
        if got:
            yield pa.RecordBatch.from_pydict({"dim": list(got), "n": [g[0] for g in got.values()], "total": [g[1].tolist() for g in got.values()]})

    out: dict[int, tuple] = {}
    for r in cls.select("v").mapInArrow(add, "dim long, n long, total array<double>").toLocalIterator():
        n, total = out.get(r.dim, (0, 0.0))
        out[r.dim] = (n + r.n, total + np.array(r.total))
    return {dim: np.round(total / n, 9) for dim, (n, total) in out.items()}


def passes_for(n: int) -> int:
    """Passes for a number of classes: 16 to 16,384 of them, then four more a doubling."""
    return 16 + 4 * max(0, int(np.ceil(np.log2(max(1, n) / 16_384))))


def alike(v: np.ndarray, a: slice, w: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``v[a]`` link with which of ``w``; borderline pairs by one sum of products, the same wherever they are met."""
    d = v[a] @ w.T
    out = d >= least
    i, j = np.nonzero(np.abs(d - least) < 1e-9)
    if len(i):
        out[i, j] = np.einsum("ij,ij->i", v[a][i], w[j]) >= least
    return out


def windows(part: pa.Table, least: float, window: int) -> pa.Table:
    """Links of one range that connect something new; its rows marked ``before`` only serve as neighbours."""
    part = part.sort_by("at")
    cls, own, out = part["cls"].to_numpy(), ~part["before"].to_numpy(zero_copy_only=False), []
    for rows, v in by_dim(part["v"]):
        ids, mine, label = cls[rows], own[rows], np.arange(len(rows))
        for at in range(0, len(v), 256):
            low = max(0, at - window)
            linked = alike(v, slice(at, at + 256), v[low : at + 256], least)
            i, j = np.nonzero(linked)
            i, j = i + at, j + low
            keep = (j < i) & (i - j <= window) & mine[i]
            i, j = i[keep], j[keep]
            while len(i):
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    break
                # of each label on the left, one link; then all are relabelled
                _, one = np.unique(label[i], return_index=True)
                for a, b in zip(i[one].tolist(), j[one].tolist()):
                    if label[a] != label[b]:
                        out.append((int(ids[a]), int(ids[b])))
                        label[label == label[a]] = label[b]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def links(cls: DataFrame, least: float = 0.95, passes: int | None = None, window: int = 256, seed: int = 7) -> DataFrame:
    """Links (a, b) of classes (cls, v) that connect whatever any pass connects; passes grow with the classes unless given.

    Ranges of one pass have ``RANGE_ROWS`` rows; each row also goes to the next range as a
    neighbour if it is among the last ``window`` of its own.
    """
    passes = passes or passes_for(cls.count())
    mean = means(cls)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, v in by_dim(batch.column(1)):
                v = v - mean[v.shape[1]]
                for p in range(passes):
                    signs = (v @ directions(v.shape[1], seed * 1000 + p) > 0).astype(np.int64)
                    h = (signs << np.arange(BITS - 1, -1, -1)).sum(1)
                    yield pa.RecordBatch.from_pydict({"pass": np.full(len(h), p), "h": h, "cls": ids[rows]})

    keys = cut(cls.select("cls", "v").mapInArrow(hashed, "pass long, h long, cls long"), "projections")
    # ranges by an exact histogram of the leading bits, then places within each by windows of bounded size
    n = keys.where(F.col("pass") == 0).count()
    digits = min(BITS, max(0, int(np.ceil(np.log2(max(1, n / (RANGE_ROWS / 8)))))) + 4)
    cell = F.shiftright("h", BITS - digits)
    hist = keys.groupBy("pass", cell.alias("cell")).agg(F.count("*").alias("k"))
    ahead = F.coalesce(F.sum("k").over(Window.partitionBy("pass").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keys.withColumn("cell", cell).join(hist.select("pass", "cell", ahead.alias("ahead")), ["pass", "cell"])
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("pass", "cell").orderBy("h", "cls")) - 1
    placed = cut(placed.select("pass", "cls", place.alias("at")).withColumn("range", F.floor(F.col("at") / RANGE_ROWS)), "places")
    late = F.col("at") >= (F.col("range") + 1) * RANGE_ROWS - window
    copies = F.when(late, F.array(F.col("range"), F.col("range") + 1)).otherwise(F.array("range"))
    dealt = placed.withColumn("in", F.explode(copies)).withColumn("before", F.col("in") > F.col("range"))
    near = dealt.join(cls.select("cls", "v"), "cls").select("pass", "in", "at", "cls", "before", "v")
    found = near.groupBy("pass", "in").applyInArrow(lambda t: windows(t, least, window), "a long, b long")
    out = cut(found.distinct(), "links")
    drop(keys, placed)
    return out


def degrees(members: DataFrame, least: float) -> DataFrame:
    """(cls, others) of members (component, cls, n, v): rows of other classes of the component that a class links with."""
    size = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = members.join(size, "component").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("component", "cls", "n", "v", "block", each)
    task = F.concat_ws(":", "component", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select(task.alias("task"), (F.col("block") > F.col("other")).alias("second"), "cls", "n", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def count() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            cls, n, second = t["cls"].to_numpy(), t["n"].to_numpy(), t["second"].to_numpy(zero_copy_only=False)
            others = np.zeros(len(cls), np.int64)
            crossed = now.split(":")[1] != now.split(":")[2]
            for at, v in by_dim(t["v"]):
                left, right = (np.flatnonzero(second[at] == x) for x in (False, True)) if crossed else (np.arange(len(at)),) * 2
                for k in range(0, len(left), 512):
                    some = left[k : k + 512]
                    met = alike(v, some, v[right], least)
                    others[at[some]] += met @ n[at[right]]
                    if crossed:
                        others[at[right]] += n[at[some]] @ met
                    else:
                        others[at[some]] -= n[at[some]] * met[np.arange(len(some)), some]
            return pa.RecordBatch.from_pydict({"cls": cls, "others": others})

        for batch in batches:
            tasks = batch.column(0).to_pylist()
            edges = [0, *[i for i in range(1, len(tasks)) if tasks[i] != tasks[i - 1]], len(tasks)]
            for a, b in zip(edges, edges[1:]):
                if tasks[a] != now:
                    if held:
                        yield count()
                    now, held = tasks[a], []
                held.append(batch.slice(a, b - a))
        if held:
            yield count()

    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, "task").sortWithinPartitions("task", "cls")
    return dealt.mapInArrow(run, "cls long, others long").groupBy("cls").agg(F.sum("others").alias("others"))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Null and zero vectors and those with null or non-finite components have no links and
    are components of their own. Equal vectors link with one another; of different lengths
    none do. Every row is a vector: rows of one id count apart, and one without an id takes the smallest
    id of its component, null where none has one, and is not kept. Other columns are not read.
    """
    rows, cls = classes(vectors, vec_id, embedding)
    found = links(cls, least)
    comp = cut(components(found), "components").select(F.col("node").alias("cls"), "component")
    linked = cut(cls.select("cls", "n", "v").join(comp, "cls"), "members")
    others = cut(degrees(linked, least), "degrees")
    smallest = cut(cls.select("cls", "least").join(comp, "cls").groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    per = cls.select("key", "cls", "n", "least").join(others, "cls", "left").join(comp.join(smallest, "component"), "cls", "left")
    per = per.select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = rows.join(cut(per, "per_class"), "key", "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    drop(linked, found)
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
