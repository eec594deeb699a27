"""A versioned catalog as an append-only change log: (version, seq, path, date, ...); date 0 deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.text import extension_key, padded

from .restore import following


def latest_state(log: DataFrame, until: Column | None = None, live_only: bool = True) -> DataFrame:
    """Each path's last record by (version, seq), at or before ``until`` (a condition on the log).

    One aggregation with map-side combine; no window, so a path with many records costs no more.
    """
    rows = log if until is None else log.where(until)
    rest = [c for c in log.columns if c not in ("path", "version", "seq")]
    out = rows.groupBy("path").agg(F.max(F.struct("version", "seq", *rest)).alias("last")).select("path", "last.*")
    return out.where("date <> 0") if live_only else out


def time_travel(log: DataFrame, version: int) -> DataFrame:
    return latest_state(log, F.col("version") <= version)


def versions_until(transactions: DataFrame, bound: int) -> int:
    """The last version before the first transaction (version, committed_at: 14 digits) that is later than
    ``bound``; reading stops there, whatever dates its records and those after it have."""
    later = F.min(F.when(F.col("committed_at") > bound, F.col("version")))
    r = transactions.agg(later.alias("stop"), F.max("version").alias("last")).first()
    return (r.stop - 1) if r.stop is not None else (r.last or 0)


def version_at(log: DataFrame, n: int) -> int:
    """A version number; negative ones count from the end."""
    last = log.agg(F.max("version")).first()[0] or 0
    return n if n >= 0 else max(0, last + n)


def version_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("version").agg(
        F.count_if(F.col("date") != 0).alias("updates"), F.count_if(F.col("date") == 0).alias("deletes"), F.max("date").alias("lastdate"), F.min("seq").alias("first_seq")
    )


def all_versions(log: DataFrame, digits: int = 4) -> DataFrame:
    """Every version's last record per path, keyed ``<version>/<path>``."""
    last = log.groupBy("version", "path").agg(F.max(F.struct("seq", "date")).alias("last"))
    return last.select(F.concat(padded(F.col("version"), digits), F.lit("/"), F.col("path")).alias("key"), "version", "path", F.col("last.date").alias("date"))


def sizes(pointers: DataFrame, fragments: DataFrame, by: str) -> DataFrame:
    """A file's size: the sum of its fragments'; unknown (-1) if any is; ids that no fragment has count nothing."""
    j = pointers.join(fragments, "frag_id")
    return j.groupBy(by).agg(F.when(F.min("usize") < 0, F.lit(-1)).otherwise(F.sum("usize")).cast("long").alias("size"), F.count("*").alias("fragments"))


def top_n(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy(F.desc("size"), "path").limit(n)


def cluster_order(files: DataFrame, step: int = 16 * 1024) -> DataFrame:
    """The order of adding: by extension key, size steps from large to small, then path; ``rank`` is the place
    within the key's files, ``place`` that in all. Files are ranked within a key's step, and the steps' counts summed ahead."""
    out = files.withColumn("ext", extension_key(F.col("path"))).withColumn("bucket", F.least(F.floor(F.col("size") / step), F.lit((1 << 24) - 1)))
    steps = out.groupBy("ext", "bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("ext").orderBy(F.desc("bucket"))
    steps = steps.withColumn("_in", F.sum("_n").over(w) - F.col("_n"))
    keys = out.groupBy("ext").agg(F.count("*").alias("_k"))  # one row an extension
    keys = keys.withColumn("_ahead", F.sum("_k").over(Window.orderBy("ext")) - F.col("_k")).select("ext", "_ahead")
    own = F.row_number().over(Window.partitionBy("ext", "bucket").orderBy("path"))
    out = out.withColumn("_own", own).join(steps, ["ext", "bucket"]).join(keys, "ext")
    return out.withColumns({"rank": (F.col("_in") + F.col("_own")).cast("long"), "place": (F.col("_ahead") + F.col("_in") + F.col("_own")).cast("long")}).drop("_n", "_in", "_own", "_ahead")


def listing(files: DataFrame) -> DataFrame:
    """Files in order of their names' bytes."""
    return files.orderBy("path")


def monotonic_dates(log: DataFrame, by: str, order: list[str], date: str, width: int = 1 << 10) -> DataFrame:
    """Dates moved forward so that each is at least one later than the one before it.

    y(i) = max(d(i), y(i-1) + 1) is a running maximum of d(i) - i, plus i. A group is parted by
    ``width`` numbers of the first order column: i counts on from the parts before, and their
    maxima go into the part's own, so no task holds a whole group.
    """
    part = [by, "_part"]
    rows = log.withColumn("_part", F.floor(F.col(order[0]) / width))
    parts = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(*part).agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(parts), F.lit(0)))
    w = Window.partitionBy(*part).orderBy(*order)
    rows = rows.join(ahead.drop("_n"), part).withColumn("_i", F.row_number().over(w) + F.col("_ahead"))
    low = F.col(date) - F.col("_i")
    most = rows.groupBy(*part).agg(F.max(low).alias("_m")).withColumn("_most", F.max("_m").over(parts)).drop("_m")
    own = F.max(low).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_own", own).join(most, part).withColumn("adjusted", F.greatest("_own", "_most") + F.col("_i"))
    return out.drop("_part", "_ahead", "_i", "_own", "_most")


def sequence_checks(runs: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(start, n) runs in order of start: 'ok', 'gap', 'overlap' against the next one, 'empty', 'last'."""
    end = F.col("start") + F.col("n")
    return following(runs, "start", width, "next").withColumn(
        "status", F.when(F.col("n") <= 0, "empty").when(F.col("next").isNull(), "last").when(end == F.col("next"), "ok").when(end < F.col("next"), "gap").otherwise("overlap")
    )


def carry_forward(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """Null names take the last one before them."""
    return rows.withColumn("carried", F.last(name, ignorenulls=True).over(Window.partitionBy(by).orderBy(order)))


def sync(old: DataFrame, new: DataFrame, compare: list[str], force: bool = False) -> DataFrame:
    """(path, change): 'added', 'changed', 'deleted' or 'unchanged' between two states, one full join."""
    a, b = old.select("path", F.struct(*compare).alias("old")), new.select("path", F.struct(*compare).alias("new"))
    same = F.lit(False) if force else F.col("old") == F.col("new")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, "path", "full").select("path", change.alias("change"))


def extract_plan(archived: DataFrame, disk: DataFrame, compare: list[str], force: bool = False) -> DataFrame:
    """(path, action) of a restore: 'extract', '=' where the file is there and equal, '?' where
    it is there, differs, and nothing forces it."""
    here = disk.select("path", F.struct(*compare).alias("here"))
    j = archived.select("path", F.struct(*compare).alias("kept")).join(here, "path", "left")
    there = F.when(F.col("here") == F.col("kept"), "=").otherwise("extract" if force else "?")
    return j.select("path", F.when(F.col("here").isNull(), "extract").otherwise(there).alias("action"))


def pointer_arrays(pointers: DataFrame, by: str, order: list[str], frag: str = "frag_id") -> DataFrame:
    """(by, ptr): each file's fragments in order."""
    parts = F.sort_array(F.collect_list(F.struct(*order, frag)))
    return pointers.groupBy(by).agg(F.transform(parts, lambda x: x[frag]).alias("ptr"))


def dereferenced(files: DataFrame, fragments: DataFrame, by: str, wanted: DataFrame | None = None) -> DataFrame:
    """(by, size, fragments) through arrays of pointers; with ``wanted``, only the files in it have
    their arrays read at all. Ids that no fragment has count nothing."""
    files = files if wanted is None else files.join(wanted.select(by).distinct(), by, "left_semi")
    return sizes(files.select(by, F.posexplode("ptr").alias("pos", "frag_id")), fragments, by)


def first_pointer(segments: DataFrame, files: DataFrame, frag: str = "frag_id") -> DataFrame:
    """Segments with the file whose first pointer they are."""
    return segments.join(files.where(F.size("ptr") > 0).withColumn(frag, F.element_at("ptr", 1)), frag)


def index_writes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, write) of states (path, date, attr, ptr): 'update' where new, of another date, of other pointers, or of other
    attributes than ones that were set; 'delete' where gone; 'none'."""
    a, b = (x.select("path", F.struct("date", "attr", "ptr").alias(n)) for x, n in ((old, "old"), (new, "new")))
    changed = (F.col("old.date") != F.col("new.date")) | ((F.col("old.attr") != 0) & ~F.col("old.attr").eqNullSafe(F.col("new.attr"))) | (F.col("old.ptr") != F.col("new.ptr"))
    write = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull() | changed, "update").otherwise("none")
    return a.join(b, "path", "full").select("path", write.alias("write"))


def equal_contents(archived: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, equal) of archived files (path, hashes: of fragments in order, usizes): on disk there must be as
    many bytes, in fragments of the same sizes and hashes, and nothing after them."""
    here = disk.select("path", F.struct("hashes", "usizes").alias("here"))
    j = archived.select("path", F.struct("hashes", "usizes").alias("kept")).join(here, "path", "left")
    return j.select("path", F.coalesce(F.col("kept") == F.col("here"), F.lit(False)).alias("equal"))


def appended(segments: DataFrame, by: str, order: str, name: str, frag: str) -> DataFrame:
    """Files of a stream: a segment is one fragment of unknown size, one without a name goes on the file before it."""
    named = carry_forward(segments, by, order, name).where("carried is not null")
    out = pointer_arrays(named.withColumn("path", F.concat_ws("/", F.col(by).cast("string"), "carried")), "path", [order], frag)
    return out.withColumn("size", F.lit(-1).cast("long"))


def union(*catalogs: DataFrame) -> DataFrame:
    """One catalog of several; columns that one lacks are null."""
    out = catalogs[0]
    for more in catalogs[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
